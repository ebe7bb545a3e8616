"""The streaming container of encoded splat sequences: header, ranges and indices first, then payloads.

Layouts are numpy record types, so one definition reads and writes. Files come as rows of binaryFile; sections are
cut out on the executors. Video payloads are kept as bytes: decoding them needs a video codec. Byte planes in their place are
read by operators.sequence_codec.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
MAGIC, STATIC_MAGIC = b"GSAV", b"GSST"
VERSIONS = (1, 3)
HEADER = np.dtype(
    {
        "names": [
            "magic", "version", "n_splats", "n_frames", "n_chunks", "chunk_size", "atlas_side", "atlas_columns", "atlas_rows", "fps", "flags",
            "ranges_offset", "chunk_index_offset", "frame_index_offset", "low_offset", "video_offset", "codec", "audio_offset", "audio_size",
            "high_offset", "sh_bands", "sh_offset", "static_offset", "static_size", "static_encoding",
        ],
        "formats": ["S4", "<u4", "<u4", "<u4", "<u4", "<u4", "<u2", "u1", "u1", "<u2", "<u2", "<u4", "<u4", "<u4", "<u4", "<u4", "S16", "<u4", "<u4", "<u4", "u1", "<u4", "<u4", "<u4", "u1"],
        "offsets": [0, 4, 8, 12, 16, 20, 24, 26, 27, 28, 30, 32, 36, 40, 44, 48, 52, 68, 72, 76, 80, 81, 85, 89, 93],
        "itemsize": 128,
    }
)
RANGES = np.dtype([(f"{n}_{end}", "<f4", (w,)) for n, w in (("means", 3), ("scales", 3), ("quats", 4), ("opacity", 1), ("sh0", 3)) for end in ("min", "max")])
#: Columns of each field of the ranges.
RANGE_NAMES = {"means": ("x", "y", "z"), "scales": ("s0", "s1", "s2"), "quats": ("qw", "qx", "qy", "qz"), "opacity": ("opacity",), "sh0": ("c0", "c1", "c2")}
CHUNK = np.dtype([("start_frame", "<u4"), ("end_frame", "<u4"), ("offset", "<u4"), ("size", "<u4")])
FRAME = np.dtype([("offset", "<u4"), ("size", "<u4")])
STATIC_TRACK = np.dtype(
    {
        "names": ["magic", "version", "n_splats", "atlas_side", "sh_bands", "flags", "codec", "low_size", "sh_size", "video_size"],
        "formats": ["S4", "<u4", "<u4", "<u4", "<u4", "<u4", "S16", "<u4", "<u4", "<u4"],
        "offsets": [0, 4, 8, 12, 16, 20, 24, 40, 44, 48],
        "itemsize": 64,
    }
)
STATIC_CODEC = b"vp09.00.51.08"
#: Our own codec: byte planes compressed without loss, for lack of a video codec.
PLANES_CODEC = b"planes.zstd"
KEY_FLAG, SIZE_MASK = 0x80000000, 0x7FFFFFFF
LOW_COLUMNS, LOW_BASE, LOW_XOR, LOW_COUNT = 0x80000000, 0x40000000, 0x20000000, 0x1FFFFFFF
AUDIO, DIRECTIONAL, MASKS, STATIC = 0x0001, 0x0002, 0x0010, 0x0020
LEGACY_FLAGS = 0x000F


def check(h: np.void, size: int | None = None) -> None:
    """Raises where a header contradicts itself."""
    problems = []
    say = lambda bad, what: problems.append(what) if bad else None
    side, across, down = (int(h[k]) for k in ("atlas_side", "atlas_columns", "atlas_rows"))
    say(h["magic"] != MAGIC, "magic")
    say(h["version"] not in VERSIONS, "version")
    say(not side or not across or not down or across * down < 14 or side * max(across, down) > 0xFFFF, "atlas")
    say(not 0 < h["n_splats"] <= min(side * side, 0x7FFFFFFF), "number of splats")
    flags, offset, length, encoding = (int(h[k]) for k in ("flags", "static_offset", "static_size", "static_encoding"))
    if h["version"] == 1:
        say(flags & ~LEGACY_FLAGS or offset or length or encoding, "extension in an old version")
    else:
        static = bool(flags & STATIC)
        say(flags & ~(LEGACY_FLAGS | MASKS | STATIC), "flags")
        say(static != bool(offset) or static != bool(length) or static != bool(encoding), "static section")
        if static:
            say(offset != h["frame_index_offset"] + FRAME.itemsize * int(h["n_frames"]) or offset + length != h["low_offset"], "place of the static section")
            say(size is not None and offset + length > size, "end of the static section")
        say(bool(flags & MASKS) and (across, down) != (5, 3), "mask atlas")
    if problems:
        raise ValueError("container: " + ", ".join(problems))


def read_header(data: bytes) -> np.void:
    if len(data) < HEADER.itemsize:
        raise ValueError("container: too short")
    h = np.frombuffer(data, HEADER, count=1)[0]
    check(h, len(data))
    return h


def cut(data: bytes, kind: np.dtype, at: int, n: int = 1) -> np.ndarray:
    if at + n * kind.itemsize > len(data):
        raise ValueError("container: section beyond the end")
    return np.frombuffer(data, kind, count=n, offset=at)


def assemble(fields: dict, ranges: np.ndarray, chunks: np.ndarray, frames: np.ndarray, low: list[bytes], video: bytes = b"", low_flags: int = LOW_COLUMNS, sh: bytes = b"") -> bytes:
    """A container from its sections: each section's place is the sum of the sizes before it."""
    payload = np.uint32(len(low) | low_flags).tobytes() + b"".join(np.uint32(len(x)).tobytes() + x for x in low)
    h = np.zeros(1, HEADER)
    for k, v in {"magic": MAGIC, "version": 3, "atlas_columns": 5, "atlas_rows": 3, "fps": 30, "codec": b"", **fields}.items():
        h[k] = v
    at = HEADER.itemsize
    sections = (("ranges_offset", ranges.tobytes()), ("chunk_index_offset", chunks.tobytes()), ("frame_index_offset", frames.tobytes()), ("low_offset", payload), ("video_offset", video), ("sh_offset", sh))
    for name, body in sections:
        h[name] = at if body or name != "sh_offset" else 0
        at += len(body)
    check(h[0])
    return h.tobytes() + b"".join(body for _, body in sections)


def low_planes(data: bytes, h: np.void) -> Iterator[tuple[int, np.ndarray]]:
    """(frame, bytes of n splats by 3 axes) of all four layouts: plain, by columns, by base, and XOR with the frame before in the chunk."""
    n, frames, at = int(h["n_splats"]), int(h["n_frames"]), int(h["low_offset"])
    if int(h["video_offset"]) - at == 3 * n * frames:
        for f in range(frames):
            yield f, np.frombuffer(data, np.uint8, 3 * n, at + 3 * n * f).reshape(n, 3)
        return
    word = int(np.frombuffer(data, "<u4", 1, at)[0])
    starts = set(cut(data, CHUNK, int(h["chunk_index_offset"]), int(h["n_chunks"]))["start_frame"].tolist())
    at += 4
    unpack, before = zstandard.ZstdDecompressor(), None
    for f in range(word & LOW_COUNT):
        size = int(np.frombuffer(data, "<u4", 1, at)[0])
        raw = np.frombuffer(unpack.decompress(data[at + 4 : at + 4 + size]), np.uint8)
        at += 4 + size
        if word & LOW_BASE:
            base, digits = int(raw[0]), raw[1 + int(raw[0]) :].astype(np.int64)
            out = raw[1 : 1 + base][np.stack([digits // base**2, digits // base % base, digits % base], axis=1)]
        else:
            out = raw.reshape(3, n).T if word & LOW_COLUMNS else raw.reshape(n, 3)
            if word & LOW_XOR and f not in starts:
                out = out ^ before
        before = out
        yield f, out


def headers(spark: SparkSession, files: DataFrame) -> DataFrame:
    """One row of header fields per file (path, content)."""
    names = [n for n in HEADER.names if n not in ("magic", "codec")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [read_header(c) for c in b.column(1).to_pylist()]
            arrays = [b.column(0), pa.array([h["codec"].decode() for h in found]), *[pa.array([int(h[n]) for h in found], pa.int64()) for n in names]]
            yield pa.RecordBatch.from_arrays(arrays, names=["path", "codec", *names])

    return files.select("path", "content").mapInArrow(run, "path string, codec string, " + ", ".join(f"{n} bigint" for n in names))


def range_rows(files: DataFrame) -> DataFrame:
    """One row of ranges per file: min_ and max_ of each channel."""
    names = [(f"{end}_{c}", f"{field}_{end}", i) for field, cs in RANGE_NAMES.items() for i, c in enumerate(cs) for end in ("min", "max")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [cut(c, RANGES, int(read_header(c)["ranges_offset"]))[0] for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([float(x[f][i]) for x in found], pa.float64()) for _, f, i in names]], names=["path", *[n for n, _, _ in names]])

    return files.select("path", "content").mapInArrow(run, "path string, " + ", ".join(f"{n} double" for n, _, _ in names))


def frame_index(files: DataFrame) -> DataFrame:
    """(path, frame, chunk_id, offset, size, is_key, from_byte, to_byte): where each frame's video lies in the file."""
    schema = "path string, frame int, chunk_id int, offset bigint, size bigint, is_key boolean, from_byte bigint, to_byte bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = read_header(data)
                n = int(h["n_frames"])
                frames = cut(data, FRAME, int(h["frame_index_offset"]), n)
                chunks = cut(data, CHUNK, int(h["chunk_index_offset"]), int(h["n_chunks"]))
                number = np.arange(n)
                chunk = np.searchsorted(chunks["start_frame"], number, side="right") - 1
                offset, size = frames["offset"].astype(np.int64), (frames["size"] & np.uint32(SIZE_MASK)).astype(np.int64)
                begin = int(h["video_offset"]) + offset
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * n, pa.string()), pa.array(number.astype(np.int32)), pa.array(chunk.astype(np.int32)), pa.array(offset), pa.array(size), pa.array((frames["size"] & np.uint32(KEY_FLAG)) != 0), pa.array(begin), pa.array(begin + size)],
                    names=[x.split()[0] for x in schema.split(", ")],
                )

    return files.select("path", "content").mapInArrow(run, schema)


def low_rows(files: DataFrame) -> DataFrame:
    """(path, frame, rank, lx, ly, lz) of all frames."""
    schema = "path string, frame int, rank bigint, lx int, ly int, lz int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for frame, low in low_planes(data, read_header(data)):
                    n = len(low)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(np.full(n, frame, np.int32)), pa.array(np.arange(n)), *[pa.array(low[:, i].astype(np.int32)) for i in range(3)]], names=[x.split()[0] for x in schema.split(", ")])

    return files.select("path", "content").mapInArrow(run, schema)


def ivf_frames(data: bytes) -> list[tuple[int, bytes]]:
    """(time stamp, payload) of the frames of an IVF stream. Raises where the stream ends inside a frame."""
    if data[:4] != b"DKIF" or len(data) < 32:
        raise ValueError("not an IVF stream")
    at, out = int.from_bytes(data[6:8], "little"), []
    while at < len(data):
        size, stamp = int.from_bytes(data[at : at + 4], "little"), int.from_bytes(data[at + 4 : at + 12], "little")
        if at + 12 + size > len(data):
            raise ValueError("IVF stream: frame beyond the end")
        out.append((stamp, data[at + 12 : at + 12 + size]))
        at += 12 + size
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files (path, content) of a folder, on any file system that Spark reads."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content"))


def static_track(data: bytes) -> dict[str, object]:
    """Fields, ranges and payloads of a static track, which has one frame and fills its section. Raises where it contradicts itself."""
    begin = STATIC_TRACK.itemsize + RANGES.itemsize
    if len(data) < begin:
        raise ValueError("static track: too short")
    h = cut(data, STATIC_TRACK, 0)[0]
    n, side, bands, flags = (int(h[k]) for k in ("n_splats", "atlas_side", "sh_bands", "flags"))
    sizes = {k: int(h[f"{k}_size"]) for k in ("low", "sh", "video")}
    wrong = {
        "magic or version": h["magic"] != STATIC_MAGIC or h["version"] != 1,
        "number of splats": not 0 < n <= 0x7FFFFFFF or n > side * side,
        "atlas": not 0 < side <= 0xFFFF or side * 5 > 0xFFFF,
        "bands": bands > 3 or bool(flags & DIRECTIONAL) != bool(bands) or bool(sizes["sh"]) != bool(bands),
        "flags": bool(flags & ~(MASKS | DIRECTIONAL)),
        "codec": h["codec"] != STATIC_CODEC,
        "sizes": not sizes["low"] or not 0 < sizes["video"] <= 0x7FFFFFFF or begin + sum(sizes.values()) != len(data),
    }
    if any(wrong.values()):
        raise ValueError("static track: " + ", ".join(k for k, bad in wrong.items() if bad))
    out: dict[str, object] = {"n_splats": n, "atlas_side": side, "sh_bands": bands, "flags": flags, "ranges": cut(data, RANGES, STATIC_TRACK.itemsize)[0]}
    for k, size in sizes.items():
        out[k] = data[begin : begin + size]
        begin += size
    return out


def make_static_track(n: int, side: int, ranges: np.ndarray, low: bytes, video: bytes, sh: bytes = b"", bands: int = 0, masks: bool = False) -> bytes:
    h = np.zeros(1, STATIC_TRACK)
    fields = {"magic": STATIC_MAGIC, "version": 1, "n_splats": n, "atlas_side": side, "sh_bands": bands, "flags": (DIRECTIONAL if bands else 0) | (MASKS if masks else 0), "codec": STATIC_CODEC, "low_size": len(low), "sh_size": len(sh), "video_size": len(video)}
    for k, v in fields.items():
        h[k] = v
    data = h.tobytes() + ranges.tobytes() + low + sh + video
    static_track(data)
    return data

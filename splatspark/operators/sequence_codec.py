"""Splat sequences to encoded frames and back, as one plan each way.

An encoded frame is (frame, n, is_key, low, atlas): the low bytes of positions, and fifteen planes of a byte a splat (high bytes of positions, log
scales, companded rotations, opacity, colours, and the mask of active rows), ordered by rank and compressed without loss. The planes take the place
of video. A frame's rows meet in one task, their number being bounded by the format; frames are independent, so a range of
frames is a predicate on the stored frame number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spaces as v
from ..sources import container
from . import bounds, sequences
from .payloads import LEVEL

#: Order of the planes: positions come as two bytes, of which the low one is kept apart.
BYTES = ("s0", "s1", "s2", "qw", "qx", "qy", "qz", "opacity", "c0", "c1", "c2")
PLANES = ("hx", "hy", "hz", *BYTES, "active")
LOWS = ("lx", "ly", "lz")
FRAME = "frame int, n bigint, is_key boolean, low binary, atlas binary"
QUANTISED = ", ".join(f"{c} int" for c in (*LOWS, *PLANES))


def ranks(splats: DataFrame) -> DataFrame:
    """(gid, rank) of all splats that are ever active, along the Morton order of their first active positions."""
    return sequences.stable_order(splats.withColumn("chunk_id", F.lit(0))).select("gid", "rank")


def quantised(splats: DataFrame, ranges: DataFrame) -> DataFrame:
    """frame, gid, active and the bytes of all channels; ``ranges`` is the row of bounds.ranges(). Inactive rows keep clamped values."""
    rows = splats.crossJoin(F.broadcast(ranges))
    ends = lambda c: (F.col(f"min_{c}"), F.col(f"max_{c}"))
    out: list[Column] = []
    for a in bounds.AXES:
        q = v.quantise16(bounds.RANGE_COLUMNS[a](), *ends(a))
        out += [v.high_byte(q).alias(f"h{a}"), v.low_byte(q).alias(f"l{a}")]
    out += [v.quantise8(bounds.RANGE_COLUMNS[c](), *ends(c)).alias(c) for c in BYTES]
    return rows.select("frame", "gid", F.col("active").cast("int").alias("active"), *out)


def encoded(splats: DataFrame, ranges: DataFrame, order: DataFrame, n: int, chunk: int = 4) -> DataFrame:
    """Encoded frames. ``order`` is ranks() and n its number of rows; splats outside it are never active and go. A splat that a frame lacks is inactive there.

    Null values have no bytes and raise in the packing of their frame.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        frame, pack = int(pdf["frame"].iloc[0]), zstandard.ZstdCompressor(level=LEVEL)
        low, planes = np.zeros((3, n), np.uint8), np.zeros((len(PLANES), n), np.uint8)
        at = pdf["rank"].to_numpy(np.int64)
        for target, names in ((low, LOWS), (planes, PLANES)):
            for i, c in enumerate(names):
                target[i, at] = pdf[c].astype("int64").to_numpy()
        return pd.DataFrame({"frame": [frame], "n": [n], "is_key": [frame % chunk == 0], "low": [pack.compress(low.tobytes())], "atlas": [pack.compress(planes.tobytes())]})

    rows = quantised(splats, ranges).join(order, "gid").select("frame", "rank", *LOWS, *PLANES)
    return rows.groupBy("frame").applyInPandas(run, FRAME)


def planes(low: np.ndarray, atlas: bytes, n: int) -> list[pa.Array]:
    """Columns of QUANTISED from a frame's low bytes (n by 3) and its compressed planes."""
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(atlas), np.uint8).reshape(len(PLANES), n)
    return [pa.array(x.astype(np.int32)) for x in (*low.T, *body)]


def decoded(frames: DataFrame, ranges: DataFrame) -> DataFrame:
    """frame, rank, active and the splat columns of encoded frames: undoes encoded() up to quantisation."""
    names = ["frame", "rank", *LOWS, *PLANES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n = r["n"]
                low = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["low"]), np.uint8).reshape(3, n).T
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["frame"], np.int32)), pa.array(np.arange(n)), *planes(low, r["atlas"], n)], names=names)

    rows = frames.select("frame", "n", "low", "atlas").mapInArrow(run, f"frame int, rank bigint, {QUANTISED}")
    return dequantised(rows.crossJoin(F.broadcast(ranges)), "frame", "rank")


def dequantised(rows: DataFrame, *keys: str) -> DataFrame:
    """Splat columns from bytes and the ranges beside them."""
    ends = lambda c: (F.col(f"min_{c}"), F.col(f"max_{c}"))
    out = {a: v.inverse_log_transform(v.dequantise16(F.col(f"h{a}"), F.col(f"l{a}"), *ends(a))) for a in bounds.AXES}
    for c in BYTES:
        plain = v.dequantise8(F.col(c), *ends(c))
        out[c] = v.expand(plain) if c.startswith("q") else plain
    return rows.select(*keys, (F.col("active") == 1).alias("active"), *[e.alias(c) for c, e in out.items()])


# Container files


def _range_record(row: dict[str, float]) -> np.ndarray:
    out = np.zeros(1, container.RANGES)
    for field, names in container.RANGE_NAMES.items():
        for end in ("min", "max"):
            out[f"{field}_{end}"] = [row[f"{end}_{c}"] for c in names]
    return out


def files(frames: DataFrame, ranges: DataFrame, by: str = "path", chunk: int = 4, fps: int = 30) -> DataFrame:
    """(path, content): a container of the encoded frames of each value of ``by``. ``ranges`` is one row for all. Frames are numbered from 0 without gaps, or it raises.

    A file is one value: the format's 32-bit offsets bound it.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        count = len(pdf)
        if pdf["frame"].tolist() != list(range(count)):
            raise ValueError("frames of a container run from 0 without gaps")
        sizes = np.array([len(x) for x in pdf["atlas"]], np.int64)
        begin = np.concatenate(([0], np.cumsum(sizes)))
        index = np.zeros(count, container.FRAME)
        index["offset"] = begin[:-1]
        index["size"] = sizes.astype(np.uint32) | np.where(pdf["is_key"], container.KEY_FLAG, 0).astype(np.uint32)
        starts = np.arange(0, count, chunk)
        stops = np.minimum(starts + chunk, count)
        chunks = np.array([(a, b - 1, begin[a], begin[b] - begin[a]) for a, b in zip(starts, stops)], container.CHUNK)
        n = int(pdf["n"].iloc[0])
        fields = {"n_splats": n, "n_frames": count, "n_chunks": len(chunks), "chunk_size": chunk, "atlas_side": int(np.ceil(np.sqrt(n))), "fps": fps, "codec": container.PLANES_CODEC, "flags": container.MASKS}
        record = _range_record({c: pdf[c].iloc[0] for c in pdf.columns if c[:4] in ("min_", "max_")})
        content = container.assemble(fields, record, chunks, index, list(pdf["low"]), b"".join(pdf["atlas"]))
        return pd.DataFrame({"path": [str(pdf["path"].iloc[0])], "content": [content]})

    return frames.withColumnRenamed(by, "path").crossJoin(F.broadcast(ranges)).groupBy("path").applyInPandas(run, "path string, content binary")


def read(contents: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """path, frame, rank, active and the splat columns of containers (path, content), all frames or those from first to last: only their planes are
    unpacked. A container whose video isn't planes raises."""
    names = ["path", "frame", "rank", *LOWS, *PLANES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = container.read_header(data)
                if h["codec"] != container.PLANES_CODEC:
                    raise ValueError(f"container: codec {h['codec'].decode()}")
                n = int(h["n_splats"])
                index = container.cut(data, container.FRAME, int(h["frame_index_offset"]), int(h["n_frames"]))
                for frame, low in container.low_planes(data, h):
                    if frame < first or last is not None and frame > last:
                        continue
                    at = int(h["video_offset"]) + int(index[frame]["offset"])
                    atlas = data[at : at + (int(index[frame]["size"]) & container.SIZE_MASK)]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(np.full(n, frame, np.int32)), pa.array(np.arange(n)), *planes(low, atlas, n)], names=names)

    rows = contents.select("path", "content").mapInArrow(run, f"path string, frame int, rank bigint, {QUANTISED}")
    return dequantised(rows.join(F.broadcast(container.range_rows(contents)), "path"), "path", "frame", "rank")

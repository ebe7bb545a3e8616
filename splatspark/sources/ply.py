"""Splat frames in PLY files: little-endian 32-bit properties, one file a frame.

Reading goes through Spark's binaryFile source, so any file system that Spark reads will do; files are parsed on the
executors. Frames are numbered by the natural order of the paths.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions import bits
from ..operators.matching import globally_ranked

#: Property names of the format, and the columns they become.
PROPERTIES = {
    "x": "x", "y": "y", "z": "z", "scale_0": "s0", "scale_1": "s1", "scale_2": "s2", "rot_0": "qw", "rot_1": "qx", "rot_2": "qy", "rot_3": "qz",
    "opacity": "opacity", "f_dc_0": "c0", "f_dc_1": "c1", "f_dc_2": "c2",
}
COLUMNS = tuple(PROPERTIES.values())
KINDS = {"float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8", "uchar": "u1", "uint8": "u1", "char": "i1", "int8": "i1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4"}
SPLAT = "gid bigint, " + ", ".join(f"{c} double" for c in COLUMNS) + ", shn array<double>"


def header(data: bytes) -> tuple[np.dtype, int, int]:
    """Layout of a vertex, number of vertices, and where they begin."""
    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file")
    begin = data.index(b"\n", end) + 1
    count, fields, inside, form = 0, [], False, ""
    for line in data[:end].decode("ascii").splitlines():
        word = line.split()
        if word[:1] == ["format"]:
            form = word[1]
        elif word[:1] == ["element"]:
            inside = word[1] == "vertex"
            count = int(word[2]) if inside else count
        elif word[:1] == ["property"] and inside:
            if word[1] not in KINDS:
                raise ValueError(f"property of type {word[1]}")
            fields.append((word[2], KINDS[word[1]]))
    if form != "binary_little_endian":
        raise ValueError(f"PLY format {form}")
    return np.dtype(fields), count, begin


def parse(data: bytes) -> dict[str, np.ndarray]:
    """Columns of a file; shn coefficient by coefficient, as the file has them channel by channel."""
    kind, n, begin = header(data)
    rows = np.frombuffer(data, kind, count=n, offset=begin)
    out = {c: rows[p].astype(np.float64) for p, c in PROPERTIES.items()}
    rest = sorted((f for f in kind.names if f.startswith("f_rest_")), key=lambda f: int(f[7:]))
    by_channel = np.stack([rows[f] for f in rest], axis=1).astype(np.float64).reshape(n, 3, -1) if rest and n else np.zeros((n, 3, 0))
    out["shn"] = by_channel.transpose(0, 2, 1).reshape(n, -1)
    return out


def render(columns: dict[str, np.ndarray]) -> bytes:
    """The file of a frame; the inverse of parse()."""
    n, shn = len(columns["x"]), columns.get("shn")
    width = 0 if shn is None or not n else shn.shape[1]
    names = [*PROPERTIES, *(f"f_rest_{i}" for i in range(width))]
    rows = np.empty(n, np.dtype([(p, "<f4") for p in names]))
    for p, c in PROPERTIES.items():
        rows[p] = columns[c]
    if width:
        channels = shn.reshape(n, -1, 3).transpose(0, 2, 1).reshape(n, -1)
        for i in range(width):
            rows[f"f_rest_{i}"] = channels[:, i]
    text = "ply\nformat binary_little_endian 1.0\n" + f"element vertex {n}\n" + "".join(f"property float {p}\n" for p in names) + "end_header\n"
    return text.encode("ascii") + rows.tobytes()


def parsed(files: DataFrame) -> DataFrame:
    """(frame, gid, splat columns, shn) of files (frame, content). A file that isn't PLY raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for frame, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = parse(content)
                n = len(got["x"])
                arrays = [pa.array(np.full(n, frame, np.int32)), pa.array(np.arange(n)), *[pa.array(got[c]) for c in COLUMNS], pa.array(list(got["shn"]), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["frame", "gid", *COLUMNS, "shn"])

    return files.select("frame", "content").mapInArrow(run, f"frame int, {SPLAT}")


def layouts(files: DataFrame) -> DataFrame:
    """(frame, n, properties) of files (frame, content), from the first 4,096 bytes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [header(x) for x in b.column(1).to_pylist()]
            arrays = [b.column(0), pa.array([n for _, n, _ in found], pa.int64()), pa.array([len(kind.names) for kind, _, _ in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["frame", "n", "properties"])

    return files.select("frame", F.substring("content", 1, 4096).alias("head")).mapInArrow(run, "frame int, n bigint, properties bigint")


def discover(spark: SparkSession, path: str, pattern: str = "*.ply") -> DataFrame:
    """(frame, path, length) in the natural order of the paths. Only the listing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
    ranked = globally_ranked(files.withColumn("key", bits.natural_key(F.col("path"))), ["key", "path"], "frame").drop("key")
    return ranked.withColumn("frame", F.col("frame").cast("int"))


def read(spark: SparkSession, path: str, pattern: str = "*.ply") -> DataFrame:
    """All splats of a folder of PLY files."""
    content = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return parsed(content.join(discover(spark, path, pattern), "path").select("frame", "content"))


def rendered(splats: DataFrame) -> DataFrame:
    """(frame, content): a file's bytes for each frame, splats in the order of gid."""
    names = ["gid", *COLUMNS] + (["shn"] if "shn" in splats.columns else [])

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("gid")
        columns = {c: pdf[c].to_numpy(float) for c in COLUMNS}
        if "shn" in names:
            columns["shn"] = np.stack(pdf["shn"].to_list())
        return pd.DataFrame({"frame": [int(pdf.frame.iloc[0])], "content": [render(columns)]})

    return splats.select("frame", *names).groupBy("frame").applyInPandas(run, "frame int, content binary")


class FileSink(DataSource):
    """Sink "splat_files": rows (name, content) become files in a folder that driver and executors share. Tasks write parts under names of their
    own, so one that is tried again, or twice at once, meets none of its own files; the driver publishes the parts of the
    tasks that count. A file that is there already raises: nothing is overwritten; each file appears whole or not at all."""

    @classmethod
    def name(cls) -> str:
        return "splat_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"])


@dataclass
class Written(WriterCommitMessage):
    """A task's folder of parts, and (part, target) of each file."""

    staging: str
    parts: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows) -> WriterCommitMessage:
        parts: list[tuple[str, str]] = []
        staging = os.path.join(self.path, f"_staging-{uuid.uuid4().hex}")
        os.makedirs(staging)
        for row in rows:
            part = os.path.join(staging, f"{len(parts)}.part")
            with open(part, "xb") as f:
                f.write(row["content"])
            parts.append((part, os.path.join(self.path, row["name"])))
        return Written(staging, parts)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m]
        try:
            for part, target in (x for m in done for x in m.parts):
                os.link(part, target)  # fails where the target is there
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                shutil.rmtree(m.staging, ignore_errors=True)


def write(splats: DataFrame, path: str, name: str = "frame_%05d.ply") -> None:
    """One file per frame. An empty table raises."""
    files = rendered(splats)
    if splats.isEmpty():
        raise ValueError("nothing to write")
    spark = splats.sparkSession
    spark.dataSource.register(FileSink)
    files.select(F.format_string(name, "frame").alias("name"), "content").write.format("splat_files").mode("append").save(path)

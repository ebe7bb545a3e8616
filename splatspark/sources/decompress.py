"""Containers to PLY frames: python -m splatspark.sources.decompress CONTAINERS OUT [--frames FIRST LAST]."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sequence_codec
from . import container, ply


def decompressed(files: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """(name, content): a PLY file for each frame of each container (path, content), of active splats in the order of rank."""
    rows = sequence_codec.read(files, first, last).where("active").withColumnRenamed("rank", "gid")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("gid")
        name = f"{pdf['stem'].iloc[0]}_{int(pdf['number'].iloc[0]):05d}.ply"
        return pd.DataFrame({"name": [name], "content": [ply.render({c: pdf[c].to_numpy(float) for c in ply.COLUMNS})]})

    flat = rows.select(stem.alias("stem"), F.col("frame").alias("number"), "gid", *ply.COLUMNS)
    return flat.groupBy("stem", "number").applyInPandas(run, "name string, content binary")


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(description="containers to PLY frames")
    parser.add_argument("containers")
    parser.add_argument("out")
    parser.add_argument("--frames", nargs=2, type=int, default=(0, None), metavar=("FIRST", "LAST"))
    a = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    spark.dataSource.register(ply.FileSink)
    decompressed(container.read(spark, a.containers), *a.frames).write.format("splat_files").mode("append").save(a.out)


if __name__ == "__main__":
    main()

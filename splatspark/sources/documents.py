"""JSON: chunk metadata of sequences, and frames as JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = (
    "version string, chunk_size int, total_frames int, total_chunks int, chunks array<struct<chunk_id:int,start_frame:int,end_frame:int,n_frames:int,gaussian_count:bigint,ranges:map<string,string>>>"
)
#: Ranges come as one number or as a list of so many.
WIDTHS = {"means_min": 3, "means_max": 3, "scales_min": 3, "scales_max": 3, "opacities_min": 1, "opacities_max": 1, "quats_min": 1, "quats_max": 1, "sh0_min": 1, "sh0_max": 1}


def _numbers(text: Column, width: int) -> Column:
    one = text.cast("double")
    return F.when(text.startswith("["), F.from_json(text, "array<double>")).otherwise(F.array_repeat(F.when(~text.startswith("["), one), width))


def chunk_metadata(texts: DataFrame) -> DataFrame:
    """One row per chunk of documents (path, text): its frames, splats and ranges as arrays."""
    doc = texts.select("path", F.from_json("text", METADATA).alias("d"))
    rows = doc.select("path", "d.version", "d.total_frames", F.explode("d.chunks").alias("c"))
    return rows.select("path", F.coalesce("version", F.lit("1.0")).alias("version"), "total_frames", "c.chunk_id", "c.start_frame", "c.end_frame", "c.n_frames", F.col("c.gaussian_count").alias("n_splats"), *[_numbers(F.col("c.ranges")[k], w).alias(k) for k, w in WIDTHS.items()])


def read_chunk_metadata(spark: SparkSession, path: str) -> DataFrame:
    return chunk_metadata(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text")))


def frame_documents(splats: DataFrame, precision: int = 6, most: int | None = None) -> DataFrame:
    """(frame, json): a document a frame with positions and opacities rounded half to even, the first ``most`` splats by gid.

    A frame is one document, so its rows meet; the limit is a feature of the sink.
    """
    from pyspark.sql import Window as W

    rows = splats
    if most is not None:
        rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("frame").orderBy("gid"))).where(F.col("_n") <= most)
    at = lambda c: F.bround(F.col(c), precision)
    item = F.struct("gid", F.array(*[at(c) for c in "xyz"]).alias("mean"), at("opacity").alias("opacity"))
    frames = rows.groupBy("frame").agg(F.sort_array(F.collect_list(item)).alias("items"))
    document = F.struct(F.size("items").alias("n_splats"), F.transform("items", lambda i: i["mean"]).alias("means"), F.transform("items", lambda i: i["opacity"]).alias("opacities"))
    return frames.select("frame", F.to_json(document).alias("json"))

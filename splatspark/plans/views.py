"""Splat tables derived from the driver's tables, and the same views as SQL text.

Columns of a splat: gid, frame, x y z (position), s0 s1 s2 (log scale), qw qx qy qz (rotation, not normalised), opacity
(logit), c0 c1 c2 (degree-0 colour coefficients), shn (45 numbers: 15 coefficients of 3 channels).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = 12
PLAIN = ("x", "y", "z", "s0", "s1", "s2", "qw", "qx", "qy", "qz", "opacity", "c0", "c1", "c2")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def splats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One splat per embedding; the label is the frame."""
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("gid"), F.col("label").alias("frame"),
        e(0).alias("x"), e(1).alias("y"), e(2).alias("z"),
        (e(3) * 2 - 5).alias("s0"), (e(4) * 2 - 5).alias("s1"), (e(5) * 2 - 5).alias("s2"),
        e(6).alias("qw"), e(7).alias("qx"), e(8).alias("qy"), e(9).alias("qz"),
        (e(10) * 10).alias("opacity"), (e(11) * 4).alias("c0"), (e(12) * 4).alias("c1"), (e(13) * 4).alias("c2"),
        F.transform(F.slice("embedding", 15, 45), lambda v: v.cast("double")).alias("shn"),
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each splat over twelve frames, drifting, with a fifth of its rows inactive."""
    rows = splats(spark, sf_dir).drop("frame", "shn").withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(FRAMES - 1))))
    return rows.withColumn("x", F.col("x") + 0.02 * F.col("frame") * (F.col("gid") % 3)).withColumn("active", (F.col("gid") + F.col("frame")) % 5 != 0)


def event_splats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One splat per event; the day since 1970 is the frame."""
    ts = F.col("ts")
    second = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("gid"), F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).alias("frame"),
        F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), second.cast("double").alias("z"),
        (F.col("event_type") != "error").alias("active"), "ts", "event_type",
    )


def line_splats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One splat per order line; the month is the frame. There is no short key."""
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        month.alias("frame"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100 + 0.0).alias("z"),
        (F.col("l_tax") * 10 + 0.0).alias("opacity"), F.col("l_orderkey").alias("scene"),
    )


def chunks(spark: SparkSession, size: int = 4, frames: int = FRAMES) -> DataFrame:
    """Groups of pictures: chunk_id, first and last frame (included)."""
    n = (frames + size - 1) // size
    rows = spark.range(n).select(F.col("id").cast("int").alias("chunk_id"), (F.col("id") * size).cast("int").alias("start_frame"))
    return rows.withColumn("end_frame", F.least(F.col("start_frame") + size - 1, F.lit(frames - 1)))


_E = ", ".join(
    [f"CAST(embedding[{i + 1}] AS DOUBLE) AS {n}" for i, n in enumerate(("x", "y", "z"))]
    + [f"CAST(embedding[{i + 4}] AS DOUBLE) * 2 - 5 AS s{i}" for i in range(3)]
    + [f"CAST(embedding[{i + 7}] AS DOUBLE) AS {n}" for i, n in enumerate(("qw", "qx", "qy", "qz"))]
    + ["CAST(embedding[11] AS DOUBLE) * 10 AS opacity"]
    + [f"CAST(embedding[{i + 12}] AS DOUBLE) * 4 AS c{i}" for i in range(3)]
)
#: Common table expressions for the oracle.
SPLATS_SQL = f"s AS (SELECT vec_id AS gid, label AS frame, {_E}, list_transform(embedding[15:59], lambda v: CAST(v AS DOUBLE)) AS shn FROM embeddings)"
TRACKS_SQL = (
    SPLATS_SQL + ", t AS (SELECT gid, CAST(f.range AS INTEGER) AS frame, x + 0.02 * f.range * (gid % 3) AS x, y, z, s0, s1, s2, qw, qx, qy, qz, opacity, "
    f"c0, c1, c2, (gid + f.range) % 5 <> 0 AS active FROM s CROSS JOIN range({FRAMES}) f)"
)
EVENTS_SQL = (
    "v AS (SELECT event_id AS gid, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS frame, value AS x, CAST(user_id AS DOUBLE) AS y, "
    "CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS DOUBLE) AS z, event_type <> 'error' AS active, ts, event_type FROM events)"
)
LINES_SQL = (
    "l AS (SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS frame, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 + 0.0 AS z, "
    "l_tax * 10 + 0.0 AS opacity, l_orderkey AS scene FROM lineitem)"
)
CHUNKS_SQL = f"k AS (SELECT CAST(range AS INTEGER) AS chunk_id, CAST(range * 4 AS INTEGER) AS start_frame, CAST(least(range * 4 + 3, {FRAMES - 1}) AS INTEGER) AS end_frame FROM range({(FRAMES + 3) // 4}))"

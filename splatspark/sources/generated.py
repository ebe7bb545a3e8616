"""Generated scenes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def oscillating(spark: SparkSession, n: int, frames: int, seed: int = 42) -> DataFrame:
    """n splats over frames; y swings once over the sequence, shifted by x. Values follow from (seed, gid) by squaring modulo a prime,
    so any partitioning gives the same scene. Ids are below 2^32."""

    def unit(k: int):
        p = F.lit(2147483647)
        u = (F.col("gid") * 1103515245 + F.lit((k + 1) * 747796405 + seed * 2654435 + 97)) % p
        u = (u * u + F.lit((k + 1) * 40503)) % p
        return (u * 48271 % p) / 2147483647.0

    rows = spark.range(n).withColumnRenamed("id", "gid").select("gid", *[(unit(i) * 2 - 1).alias(c) for i, c in enumerate("xyz")], (unit(3) * 2 - 5).alias("s0"), (unit(4) * 10 - 3).alias("opacity"))
    rows = rows.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))))
    return rows.withColumn("y", F.col("y") + 0.1 * F.sin(2 * math.pi * F.col("frame") / frames + F.col("x")))

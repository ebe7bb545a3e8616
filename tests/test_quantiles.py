"""Exact quantiles against numpy: many rows, ties, nulls and windows far smaller than the table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from splatspark.operators import quantiles

WANTED = (0.0, 0.001, 0.25, 0.5, 0.95, 1.0)


@pytest.mark.parametrize("gather", [50_000, 40])
def test_same_as_sorted(spark, monkeypatch, gather):
    monkeypatch.setattr(quantiles, "GATHER", gather)
    monkeypatch.setattr(quantiles, "ACCURACY", 200)
    rows = spark.range(20_000, numPartitions=5).select(
        (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("spread"),
        F.exp(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(600)) - 300.0).alias("tails"),
        (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(10)) < 9).cast("double").alias("ties"),
        F.when(F.col("id") % 3 == 0, F.col("id") * 1.0).alias("nulls"),
        F.lit(4.0).alias("one"),
    )
    got = quantiles.exact(rows, {c: F.col(c) for c in rows.columns}, WANTED)
    table = rows.toPandas()
    for c in rows.columns:
        np.testing.assert_allclose(got[c], np.quantile(table[c].dropna().to_numpy(), WANTED), rtol=1e-12)


def test_nothing(spark):
    empty = spark.createDataFrame([], "v double")
    assert quantiles.exact(empty, {"v": F.col("v")}, (0.5,)) == {"v": [None]}
    assert quantiles.exact(spark.createDataFrame([(None,), (2.0,)], "v double"), {"v": F.col("v")}, (0.1, 0.9)) == {"v": [2.0, 2.0]}

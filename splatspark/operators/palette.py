"""Palette compression of directional colour: scalar codebook, centroids, labels.

Codebooks (256 numbers) and centroids (at most 65,535 of 45 numbers, 24 MB) are bounded by the format, so they are
broadcast; splats are never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bounds, sequences

CODES = 256
MAX_CENTROIDS = 65_535
BINS = 512


def palette_size(n: int, most: int = MAX_CENTROIDS) -> int:
    return min(most, max(64, n // 10), MAX_CENTROIDS)


def blocked_size(n: int, block: int = 64) -> int:
    """The least power of two times a block that holds n."""
    size = block
    while size < n:
        size *= 2
    return size


def histogram(values: DataFrame, bins: int = BINS) -> DataFrame:
    """(bin, n, total) over bins between equal ranks and equal widths: the narrower the bulk of the values, the more by rank.

    ``values`` has id and value. Ranks come from buckets of values, so no task sees all of them.
    """
    quarters = bounds.overall(values, {"value": F.col("value")}, (0.25, 0.75)).select(*[F.col("quantiles")[i].alias(n) for i, n in enumerate(("q1", "q3"))])
    s = values.agg(F.count(F.lit(1)).alias("rows"), F.min("value").alias("lo"), F.max("value").alias("hi")).crossJoin(F.broadcast(quarters))
    extent = F.col("hi") - F.col("lo")
    beta = F.greatest(F.lit(0.5), F.least(F.lit(0.999), 1 - F.coalesce(F.try_divide(F.col("q3") - F.col("q1"), extent), F.lit(0.0))))
    rows = values.crossJoin(F.broadcast(s.withColumn("beta", beta)))
    share = F.coalesce(F.try_divide(F.col("value") - F.col("lo"), extent), F.lit(0.0))
    ranked = sequences.ranked_in_buckets(rows.withColumn("share", share), [], F.floor(F.col("share") * 64), ["value", "id"])
    blend = F.col("beta") * F.col("rank") / F.col("rows") + (1 - F.col("beta")) * F.col("share")
    size = F.least(F.lit(bins), F.col("rows"))
    return ranked.groupBy(F.least(F.floor(blend * size), size - 1).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def optimal_codebook(counts: np.ndarray, sums: np.ndarray, codes: int = CODES, power: float = 0.5) -> np.ndarray:
    """Cells of consecutive bins with the least weighted squared error, by dynamic programming over at most BINS bins."""
    keep = counts > 0
    mean, weight = sums[keep] / counts[keep], counts[keep] ** power
    n = len(mean)
    codes = min(codes, n)
    w, wx, wxx = (np.concatenate(([0.0], np.cumsum(v))) for v in (weight, weight * mean, weight * mean**2))

    def cost(i: np.ndarray, j: int) -> np.ndarray:
        return wxx[j] - wxx[i] - (wx[j] - wx[i]) ** 2 / (w[j] - w[i])

    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    back = np.zeros((codes + 1, n + 1), np.int64)
    for c in range(1, codes + 1):
        new = np.full(n + 1, np.inf)
        for j in range(c, n + 1):
            i = np.arange(c - 1, j)
            total = best[i] + cost(i, j)
            at = int(np.argmin(total))
            new[j], back[c, j] = total[at], i[at]
        best = new
    out, j = [], n
    for c in range(codes, 0, -1):
        i = back[c, j]
        out.append((wx[j] - wx[i]) / (w[j] - w[i]))
        j = i
    return np.array(out[::-1])


def codebook(values: DataFrame, codes: int = CODES, bins: int = BINS) -> list[float]:
    """At most BINS rows come to the driver."""
    rows = histogram(values, bins).orderBy("bin").collect()
    return optimal_codebook(np.array([r.n for r in rows], float), np.array([r.total for r in rows]), codes).tolist()


def coded(rows: DataFrame, column: str, book: list[float], name: str = "code") -> DataFrame:
    """Adds the number of the nearest code; of two as near, the higher."""
    middle = (np.array(book[:-1]) + np.array(book[1:])) / 2
    shared = rows.sparkSession.sparkContext.broadcast(middle)
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = np.searchsorted(shared.value, b.column(at).to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code.astype(np.int32))], names=[*b.schema.names, name])

    return rows.mapInArrow(run, rows.withColumn(name, F.lit(0)).schema)


def labelled(splats: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(gid, label, d2): the nearest centroid of each splat's shn, the lower of two as near."""
    if len(centroids) > MAX_CENTROIDS:
        raise ValueError("too many centroids")
    shared = splats.sparkSession.sparkContext.broadcast(np.asarray(centroids, float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        step = max(1, (1 << 22) // max(1, c.size))
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1)
            label, d2 = np.zeros(len(x), np.int32), np.zeros(len(x))
            for i in range(0, len(x), step):
                d = ((x[i : i + step, None, :] - c[None]) ** 2).sum(axis=2)
                label[i : i + step] = d.argmin(axis=1)
                d2[i : i + step] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label), pa.array(d2)], names=["gid", "label", "d2"])

    return splats.select("gid", "shn").mapInArrow(run, "gid bigint, label int, d2 double")


def trained(splats: DataFrame, k: int, rounds: int = 20, seed: int = 0) -> np.ndarray:
    """Lloyd's rounds from k splats picked by a keyed hash. Sums per centroid are aggregated in Spark; the driver sees k rows a round."""
    first = splats.select("shn").orderBy(F.xxhash64("gid", F.lit(seed)), "gid").limit(k).collect()
    centroids = np.array([r.shn for r in first], float)
    for _ in range(rounds):
        near = splats.select("gid", "shn").join(labelled(splats, centroids).select("gid", "label"), "gid")
        sums = near.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.element_at("shn", i + 1)).alias(f"v{i}") for i in range(centroids.shape[1])]).collect()
        new = centroids.copy()
        for r in sums:
            new[r.label] = np.array([r[f"v{i}"] for i in range(centroids.shape[1])]) / r.n
        moved = float(np.abs(new - centroids).max())
        centroids = new
        if moved < 1e-9:
            break
    return centroids


def expanded(labels: DataFrame, centroid_codes: DataFrame, book: list[float]) -> DataFrame:
    """(gid, shn) from labels (gid, label), centroids (label, codes: array of code numbers) and the codebook.

    Centroids are bounded by the format and broadcast.
    """
    values = F.array(*[F.lit(float(v)) for v in book])
    joined = labels.join(F.broadcast(centroid_codes), "label")
    return joined.select("gid", F.transform("codes", lambda c: F.element_at(values, c + 1)).alias("shn"))

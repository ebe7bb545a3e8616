"""Connected components of a link table: few links in one task, more by alternating large-star and small-star steps.

Up to ``TASK_LINKS`` links, about 16 bytes each, are labelled where they meet, so a small table costs a pass and not some forty shuffles. Beyond, every step is a partial aggregate and a join, so a vertex with very many links is combined
map-side and its join side can be split by adaptive execution; no group is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

TASK_LINKS = 500_000
BROADCAST_LINKS = 500_000
SALTS = 16


def _with_least(rows: DataFrame, least: DataFrame, n_links: int) -> DataFrame:
    """``rows`` joined to the least vertex m of their u. ``least`` has at most two rows a link: it is broadcast while
    that is few. Beyond, the rows of each vertex are dealt over SALTS tasks."""
    if n_links <= BROADCAST_LINKS:
        return rows.join(F.broadcast(least), "u")
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
    return rows.withColumn("salt", salt).join(salted, ["u", "salt"]).drop("salt")


def _large_star(links: DataFrame, n_links: int) -> DataFrame:
    """Each vertex hands its larger neighbours to the least vertex it knows."""
    both = links.union(links.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both.where("v > u"), least, n_links).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame, n_links: int) -> DataFrame:
    """Each vertex and its smaller neighbours point to the least of them. Links are (larger, smaller)."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(links, least, n_links).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, labels): the least vertex that each reaches over links from ``a`` to ``b``."""
    vertices, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(vertices))
    while len(open_ := np.flatnonzero(label[a] != label[b])):
        a, b = a[open_], b[open_]
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))  # labels are roots here
        while len(np.flatnonzero((up := label[label]) != label)):
            label = up
    return vertices, vertices[label]


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sides = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
    if sides:
        vertices, labels = least_reachable(*(np.concatenate(x) for x in zip(*sides)))
        yield pa.RecordBatch.from_arrays([pa.array(vertices), pa.array(labels)], names=["vertex", "label"])


def component_labels(links: DataFrame) -> DataFrame:
    """(vertex, label) for every vertex in a link; label is the least vertex of its component.

    ``links`` has two bigint columns; loops, repeats and both directions are allowed, nulls are ignored.
    An empty table gives an empty table. The rounds grow with the logarithm of the longest path.
    """
    a, b = links.columns
    found = checkpointed(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    if found.count() <= TASK_LINKS:
        return checkpointed(found.coalesce(1).mapInArrow(_labelled, "vertex bigint, label bigint"))
    found = checkpointed(found.distinct())
    before = _state(found)
    while before[0]:
        found = _small_star(_large_star(found, before[0]).where("u <> v"), before[0]).where("u <> v").distinct()
        found = checkpointed(found)
        now = _state(found)
        if now == before:
            break
        before = now
    roots = found.select("v").distinct()
    return found.union(roots.select("v", "v")).toDF("vertex", "label")

"""Nearest neighbours and slot matching between two sets of splats, exact at any size.

Neighbours are found on a grid: a row meets the rows of its own and the 26 cells around it by an equi-join. If its k-th
neighbour lies within one cell, it is exact; other rows go on with cells twice as wide. Rounds end when a cell spans
everything, so the number of rounds is the logarithm of the extent over the cell.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from .sequences import ranked_in_buckets

XYZ = ("x", "y", "z")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage, in the shared checkpoint folder. Only a session in one process (tests) may do without the setting and gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and context.getCheckpointDir() is None:
        context.setCheckpointDir(own_folder(df.sparkSession))
    return df.checkpoint()


def own_folder(spark: SparkSession) -> str:
    """A temporary folder for a session in one process; a cluster must name a shared one in spark.checkpoint.dir."""
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="splatspark-")


def globally_ranked(rows: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """Rank from 0 over all rows. They are dealt by ranges of the order, ranked inside each range and moved by the sizes of the ranges before, so
    no task has all rows."""
    dealt = checkpointed(rows.orderBy(*order).withColumn("_range", F.spark_partition_id()))
    return ranked_in_buckets(dealt, [], F.col("_range"), order, name).drop("_range")


def _cell(names, width: float) -> list[Column]:
    return [F.floor(F.col(c) / width).cast("bigint") for c in names]


def neighbours(current: DataFrame, previous: DataFrame, k: int = 1, width: float = 0.1) -> DataFrame:
    """(cur, prev, d2, nth) of the k nearest rows of ``previous`` (prev, x, y, z) to each row of ``current`` (cur, x, y, z).

    Ties go to the lower prev. Rows get fewer than k neighbours only where ``previous`` has fewer rows.
    """
    box = previous.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if not box["n"]:
        return current.sparkSession.createDataFrame([], "cur bigint, prev bigint, d2 double, nth int")
    mine = current.agg(*[f(c).alias(f"{n}_{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))]).first()
    bound = lambda f, n, c: f(x for x in (box[f"{n}_{c}"], mine[f"{n}_{c}"]) if x is not None)
    extent = max(bound(max, "hi", c) - bound(min, "lo", c) for c in XYZ)
    want = min(k, box["n"])
    right = previous.select("prev", *[F.col(c).alias(f"p{c}") for c in XYZ])
    around = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip((i, j, m), "ijm")]) for i in (-1, 0, 1) for j in (-1, 0, 1) for m in (-1, 0, 1)])
    left, parts = current.select("cur", *XYZ), []
    while True:
        whole = width > extent
        cells = left.withColumn("o", F.explode(around)).select("cur", *XYZ, *[(c + F.col(f"o.{n}")).alias(f"c{n}") for c, n in zip(_cell(XYZ, width), "ijm")])
        placed = right.select("*", *[c.alias(f"c{n}") for c, n in zip(_cell([f"p{c}" for c in XYZ], width), "ijm")])
        d2 = g.squared_distance([F.col(c) for c in XYZ], [F.col(f"p{c}") for c in XYZ])
        met = cells.join(placed, ["ci", "cj", "cm"]).select("cur", "prev", d2.alias("d2"))
        nth = F.row_number().over(W.partitionBy("cur").orderBy("d2", "prev"))
        best = met.withColumn("nth", nth).where(F.col("nth") <= want)
        sure = best.groupBy("cur").agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("far")).where(F.lit(whole) | ((F.col("n") == want) & (F.col("far") <= width * width)))
        found = checkpointed(best.join(sure.select("cur"), "cur", "left_semi"))
        parts.append(found)
        if whole:
            break
        left = checkpointed(left.join(found.select("cur"), "cur", "left_anti"))
        if left.isEmpty():
            break
        width *= 2
    return reduce(DataFrame.union, [p.select("cur", "prev", "d2", F.col("nth").cast("int").alias("nth")) for p in parts])


def matched(current: DataFrame, previous: DataFrame, passes: int = 10, width: float = 0.1) -> DataFrame:
    """(cur, prev, d2, pass): each pass, a row without a slot claims the nearest free slot; of a slot's claims the nearest wins, then the lower cur."""
    pairs, free = [], previous.select("prev", *XYZ)
    left = current.select("cur", *XYZ)
    for n in range(1, passes + 1):
        claims = neighbours(left, free, 1, width)
        won = checkpointed(claims.groupBy("prev").agg(F.min(F.struct("d2", "cur")).alias("w")).select(F.col("w.cur").alias("cur"), "prev", F.col("w.d2").alias("d2"), F.lit(n).alias("pass")))
        if won.isEmpty():
            break
        pairs.append(won)
        left = checkpointed(left.join(won, "cur", "left_anti"))
        free = checkpointed(free.join(won, "prev", "left_anti"))
        if left.isEmpty() or free.isEmpty():
            break
    return reduce(DataFrame.union, pairs) if pairs else current.sparkSession.createDataFrame([], "cur bigint, prev bigint, d2 double, pass int")


def vacant_slots(current: DataFrame, vacant: DataFrame, k: int = 8, width: float = 0.1) -> DataFrame:
    """(cur, prev, cost): among its k nearest vacant slots each row wants the least distance (over the k-th's), colour and log-scale difference.

    Both tables carry c0 c1 c2 and s0 s1 s2. A slot takes the row of least cost, then the lower cur.
    """
    near = neighbours(current, vacant, k, width)
    far = near.groupBy("cur").agg(F.max("d2").alias("far"))
    extra = ("c0", "c1", "c2", "s0", "s1", "s2")
    mine = current.select("cur", *[F.col(c).alias(f"a_{c}") for c in extra])
    theirs = vacant.select("prev", *[F.col(c).alias(f"b_{c}") for c in extra])
    gap = lambda names: sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in names[1:]), (F.col(f"a_{names[0]}") - F.col(f"b_{names[0]}")) * (F.col(f"a_{names[0]}") - F.col(f"b_{names[0]}")))
    cost = F.col("d2") / F.greatest("far", F.lit(1e-12)) + 0.1 * gap(extra[:3]) + 0.1 * gap(extra[3:])
    priced = near.join(far, "cur").join(mine, "cur").join(theirs, "prev").select("cur", "prev", cost.alias("cost"))
    wanted = priced.groupBy("cur").agg(F.min(F.struct("cost", "prev")).alias("w")).select("cur", F.col("w.prev").alias("prev"), F.col("w.cost").alias("cost"))
    return wanted.groupBy("prev").agg(F.min(F.struct("cost", "cur")).alias("w")).select(F.col("w.cur").alias("cur"), "prev", F.col("w.cost").alias("cost"))


def assigned_blocks(rows: DataFrame, centroids: list[tuple[float, float, float]], capacity: int) -> DataFrame:
    """(gid, block): nearest centroid with room; a block over capacity keeps its nearest rows, the others try their next choice.

    Centroids are few (a parameter); rows are ranked per block by distance, ties by gid.
    """
    if capacity * len(centroids) < rows.count():
        raise ValueError("the blocks are too small together")
    d2 = [g.squared_distance([F.col(c) for c in XYZ], c) for c in centroids]
    choices = F.array_sort(F.array(*[F.struct(d.alias("d2"), F.lit(i).alias("block")) for i, d in enumerate(d2)]))
    state = checkpointed(rows.select("gid", choices.alias("choices"), F.lit(1).alias("at")))
    for _ in range(2 * len(centroids) + 1):
        now = state.withColumn("now", F.element_at("choices", F.col("at")))
        placed = now.select("gid", "choices", "at", F.col("now.block").alias("block"), F.row_number().over(W.partitionBy("now.block").orderBy("now.d2", "gid")).alias("n"))
        placed = checkpointed(placed)
        if placed.where(F.col("n") > capacity).isEmpty():
            return placed.select("gid", "block")
        state = placed.select("gid", "choices", F.when(F.col("n") > capacity, F.least(F.col("at") + 1, F.lit(len(centroids)))).otherwise(F.col("at")).alias("at"))
    # What has run out of choices fills the room that is left.
    kept = placed.where(F.col("n") <= capacity).select("gid", "block")
    room = kept.groupBy("block").count()
    blocks = rows.sparkSession.range(len(centroids)).select(F.col("id").cast("int").alias("block"))
    free = blocks.join(room, "block", "left").select("block", F.explode(F.sequence(F.lit(1), F.lit(capacity) - F.coalesce("count", F.lit(0)).cast("int"))).alias("i")).where("i > 0")
    left = globally_ranked(placed.where(F.col("n") > capacity).select("gid"), ["gid"], "n")
    rest = left.join(globally_ranked(free, ["block", "i"], "n"), "n").select("gid", "block")
    return kept.union(rest)

"""Operators along frames, groups of pictures and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bits

ALL = (W.unboundedPreceding, W.unboundedFollowing)


def by_chunk(splats: DataFrame, size: int = 4) -> DataFrame:
    return splats.withColumn("chunk_id", F.floor(F.col("frame") / size).cast("int"))


def morton_codes(splats: DataFrame, per_frame: bool = True) -> DataFrame:
    """Codes of positions scaled to the box of their frame, or of all frames.

    The boxes are an aggregate that is joined back, so that a frame's rows needn't meet in one task.
    """
    sides = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    code = bits.morton3(*[bits.ten_bits(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in "xyz"])
    box = splats.groupBy("frame").agg(*sides) if per_frame else splats.agg(*sides)
    joined = splats.join(box, "frame") if per_frame else splats.crossJoin(F.broadcast(box))
    return joined.withColumn("code", code).drop(*[f"{n}_{c}" for c in "xyz" for n in ("lo", "hi")])


def ranked(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """Rank from 0 in each group."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)


def ranked_in_buckets(rows: DataFrame, by: list[str], bucket: Column, order: list[Column | str], name: str = "rank") -> DataFrame:
    """As ranked(), where ``bucket`` is an integer that doesn't descend along the order: rows are ranked within buckets, and bucket
    sizes, a small aggregate, give the offsets. No group has to fit one task."""
    rows = rows.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(W.partitionBy(*by, "_bucket").orderBy(*order))
    return rows.withColumn("_in", within).join(offsets, [*by, "_bucket"]).withColumn(name, F.col("_offset") + F.col("_in") - 1).drop("_bucket", "_in", "_n", "_offset")


def refined_codes(splats: DataFrame, crowd: int = 256) -> DataFrame:
    """A second code within the box of each crowded cell: rows of one code, if more than ``crowd``, are scaled to their own box."""
    sides = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    cells = splats.groupBy("frame", "code").agg(F.count(F.lit(1)).alias("_n"), *sides).where(F.col("_n") > crowd)
    inner = bits.morton3(*[bits.ten_bits(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in "xyz"])
    return splats.join(cells, ["frame", "code"], "left").withColumn("code2", F.coalesce(inner, F.lit(0).cast("bigint"))).drop("_n", *[f"{n}_{c}" for c in "xyz" for n in ("lo", "hi")])


def stable_order(splats: DataFrame) -> DataFrame:
    """chunk_id, gid, rank: the order of each splat's first active position in the chunk, for all its frames."""
    first = splats.where("active").groupBy("chunk_id", "gid").agg(F.min_by(F.struct("x", "y", "z"), "frame").alias("p"))
    flat = first.select("gid", F.col("chunk_id").alias("frame"), "p.x", "p.y", "p.z")
    codes = ranked(morton_codes(flat), ["frame"], ["code", "gid"])
    return codes.select(F.col("frame").alias("chunk_id"), "gid", "rank")


def snapped_to_key(rows: DataFrame, value: str, tolerance: int) -> DataFrame:
    """A value within the tolerance of its chunk's first frame takes that value, where it is active now, before and there."""
    w = W.partitionBy("chunk_id", "gid").orderBy("frame")
    first = F.first(F.struct(value, "active")).over(w.rowsBetween(W.unboundedPreceding, 0))
    steady = F.col("active") & first["active"] & F.coalesce(F.lag("active").over(w), F.col("active"))
    near = F.abs(F.col(value) - first[value]) <= tolerance
    return rows.withColumn(value, F.when(steady & near, first[value]).otherwise(F.col(value)))


def filled_inactive(rows: DataFrame, value: str) -> DataFrame:
    """Inactive rows take the value of the last active frame of the chunk, before the first active one its value; never active: the first frame's."""
    w = W.partitionBy("chunk_id", "gid").orderBy("frame")
    live = F.when(F.col("active"), F.col(value))
    back = F.last(live, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    ahead = F.first(live, ignorenulls=True).over(w.rowsBetween(*ALL))
    start = F.first(value).over(w.rowsBetween(*ALL))
    return rows.withColumn(value, F.coalesce(back, ahead, start))


def offsets(rows: DataFrame, by: list[str], order: list[str], size: str) -> DataFrame:
    """Bytes before each row."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("bigint"))


def xor_to_key(rows: DataFrame, value: str) -> DataFrame:
    """XOR with the value at the chunk's first frame, which keeps its own. The same step undoes it on the first frame's values."""
    w = W.partitionBy("chunk_id", "gid").orderBy("frame").rowsBetween(W.unboundedPreceding, 0)
    first = F.first(value).over(w)
    number = F.row_number().over(W.partitionBy("chunk_id", "gid").orderBy("frame"))
    return rows.withColumn(value, F.when(number == 1, F.col(value)).otherwise(F.col(value).bitwiseXOR(first)))


def xor_chain(rows: DataFrame, value: str) -> DataFrame:
    """Running XOR along frames, as parities of running sums of each of eight bits: no prefix is gathered."""
    w = W.partitionBy("chunk_id", "gid").orderBy("frame").rowsBetween(W.unboundedPreceding, 0)
    bit = lambda i: F.shiftleft(F.sum(F.shiftright(value, i).bitwiseAND(F.lit(1).cast("bigint"))).over(w) % 2, i)
    total = bit(0)
    for i in range(1, 8):
        total = total + bit(i)
    return rows.withColumn(value, total)


def delta_chain(rows: DataFrame, value: str) -> DataFrame:
    """Running sum modulo 256 along frames: undoes byte deltas."""
    w = W.partitionBy("chunk_id", "gid").orderBy("frame").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(value, F.pmod(F.sum(value).over(w), F.lit(256)))


def padded(rows: DataFrame, target: int, by: str = "frame", rank: str = "rank") -> DataFrame:
    """Each group with exactly ``target`` ranks: longer ones are cut, shorter ones repeat their last row, inactive."""
    size = rows.groupBy(by).agg((F.max(rank) + 1).alias("_n"), F.max_by(F.struct(*rows.columns), rank).alias("_last"))
    fill = size.where(F.col("_n") < target).select("_last", F.explode(F.sequence(F.col("_n"), F.lit(target - 1).cast("bigint"))).alias("_rank"))
    more = fill.select(*[F.col("_rank").cast(dict(rows.dtypes)[rank]).alias(c) if c == rank else F.lit(False).alias(c) if c == "active" else F.col(f"_last.{c}").alias(c) for c in rows.columns])
    return rows.where(F.col(rank) < target).unionByName(more)


def atlas_cell(rank: Column, side: int, block: int) -> list[Column]:
    """Row and column of a rank on a grid of ``side`` cells a row, filled in Morton order inside square blocks of a power of two."""
    cells = block * block
    tile, inside = F.floor(rank / cells), rank % cells
    x = y = F.lit(0).cast("bigint")
    width = block.bit_length() - 1
    for i in range(width):
        x = x + F.shiftleft(F.shiftright(inside, 2 * i).bitwiseAND(F.lit(1).cast("bigint")), i)
        y = y + F.shiftleft(F.shiftright(inside, 2 * i + 1).bitwiseAND(F.lit(1).cast("bigint")), i)
    across = side // block
    return [F.floor(tile / across) * block + y, tile % across * block + x]


def runs(rows: DataFrame) -> DataFrame:
    """Lifetimes: stretches of consecutive active frames of a splat."""
    n = F.row_number().over(W.partitionBy("gid").orderBy("frame"))
    return rows.where("active").withColumn("_run", F.col("frame") - n).groupBy("gid", "_run").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame")).drop("_run")

"""Time: key frames, as-of lookups, resampling and interpolation.

Key-frame tables are small beside splats, but no size is assumed: lookups are windows over the union of times and key
frames, dealt by buckets of time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import spaces as v

MAX_TIMES = 10_000


def clamped_range(first: int | None, last: int | None, frames: int) -> tuple[int, int]:
    """Frames asked for, within those there are; None means the end on that side. Raises where nothing is left."""
    low, high = max(0, 0 if first is None else first), min(frames - 1, frames - 1 if last is None else last)
    if low > high:
        raise ValueError(f"no frame from {first} to {last} of {frames}")
    return low, high


@dataclass(frozen=True)
class TimeDomain:
    low: float
    high: float
    continuous: bool = False
    fps: float = 30.0

    @property
    def duration(self) -> float:
        return self.high - self.low

    @property
    def frames(self) -> int:
        return int(self.duration * self.fps) if self.continuous else int(self.duration) + 1

    def clamp(self, t: float) -> float:
        return min(max(t, self.low), self.high)


def export_times(low: float, high: float, step: float) -> list[float]:
    """From low in steps, high included where a step meets it."""
    if step <= 0:
        raise ValueError("the step must be positive")
    n = math.floor((high - low) / step + 1e-8) + 1
    if n > MAX_TIMES:
        raise ValueError(f"over {MAX_TIMES} times")
    return [low + i * step for i in range(max(n, 0))]


def overshooting_times(low: float, high: float, step: float) -> list[float]:
    """The older rule: bounds may be swapped, and the last time may lie up to half a step behind high."""
    low, high = min(low, high), max(low, high)
    return [low + i * step for i in range(math.ceil((high + step / 2 - low) / step))]


def resampled(spark, low: float, high: float, step: float) -> DataFrame:
    n = len(export_times(low, high, step))
    return spark.range(n).select(F.col("id").cast("int").alias("out_frame"), (F.lit(low) + F.col("id") * step).alias("t"))


def surrounding(times: DataFrame, keys: DataFrame, by: list[str] | None = None, buckets: int = 256) -> DataFrame:
    """For each time t: the key frame at or before it, the one after it, and the share of the way between.

    ``keys`` has key (bigint) and kt. Before the first key frame both are the first, behind the last both the last. Of key frames of
    one time the last is before and the first after. Times and key frames meet in windows over buckets of time; what a bucket
    lacks at its ends comes from the first and last key frames of the others, one row a bucket. Key frames without a time are left out;
    a time that is null has none.
    """
    by = by or []
    rows = times.withColumns({"key": F.lit(None).cast("bigint"), "order": F.lit(1)})
    rows = rows.unionByName(keys.where("kt is not null").withColumnRenamed("kt", "t").withColumn("order", F.lit(0)), allowMissingColumns=True)
    extent = rows.agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    share = F.coalesce(F.try_divide(F.col("t") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    rows = rows.crossJoin(F.broadcast(extent)).withColumn("_bucket", F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int")).drop("_lo", "_hi")
    key = F.when(F.col("order") == 0, F.struct(F.col("t").alias("kt"), "key"))
    ends = rows.groupBy(*by, "_bucket").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    along = W.partitionBy(*by).orderBy("_bucket")
    ends = ends.select(
        *by, "_bucket",
        F.last("_last", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1)).alias("_left"),
        F.first("_first", ignorenulls=True).over(along.rowsBetween(1, W.unboundedFollowing)).alias("_right"),
    )
    # Both frames grow row by row: one that shrinks from its front is read anew for each row, the square of a bucket in time.
    bucket, sofar = W.partitionBy(*by, "_bucket"), (W.unboundedPreceding, 0)
    up, down = bucket.orderBy("t", "order", "key").rowsBetween(*sofar), bucket.orderBy(F.desc("t"), "order", F.desc("key")).rowsBetween(*sofar)
    rows = rows.withColumns({"before": F.last(key, ignorenulls=True).over(up), "after": F.last(key, ignorenulls=True).over(down)})
    rows = rows.where("order = 1").drop("key", "order").join(ends, [*by, "_bucket"])
    before, after = F.coalesce("before", "_left"), F.coalesce("after", "_right")
    b, a = (F.when(F.col("t").isNotNull(), F.coalesce(*x)) for x in ((before, after), (after, before)))
    # A time on a key frame is that key frame.
    a = F.when(F.col("t") == b["kt"], b).otherwise(a)
    part = F.when(a["kt"] == b["kt"], 0.0).otherwise(F.greatest(F.lit(0.0), F.try_divide(F.col("t") - b["kt"], a["kt"] - b["kt"])))
    return rows.select(*times.columns, b["key"].alias("key_before"), a["key"].alias("key_after"), part.alias("share"))


def nearest(times: DataFrame, keys: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The nearest key frame of each time; of two as near, the earlier."""
    found = surrounding(times, keys, by)
    return found.withColumn("key", F.when(F.col("share") <= 0.5, F.col("key_before")).otherwise(F.col("key_after")))


ATTRIBUTES = {
    "position": ("x", "y", "z"),
    "scale": ("s0", "s1", "s2"),
    "opacity": ("opacity",),
    "colour": ("c0", "c1", "c2"),
}
TURN = ("qw", "qx", "qy", "qz")


def interpolated(splats: DataFrame, before: int, after: int, t: float, linear_scales: bool = True, method: str = "linear") -> DataFrame:
    """Splats between two key frames, matched by gid.

    Both key frames come from one scan and meet in one aggregate. Splats of one of them alone raise, as their number
    must not change between key frames. shn is dropped where its sizes differ.
    """
    if method == "nearest" or t <= 0 or t >= 1:
        return splats.where(F.col("frame") == (before if (t < 0.5 if method == "nearest" else t <= 0) else after)).drop("frame")
    if not linear_scales:
        raise ValueError("scales must be linear")
    columns = [c for c in splats.columns if c not in ("gid", "frame")]
    both = splats.where(F.col("frame").isin(before, after)).groupBy("gid").agg(
        F.count(F.lit(1)).alias("_n"), *[F.max(F.when(F.col("frame") == f, F.struct(*columns))).alias(n) for f, n in ((before, "a"), (after, "b"))]
    )
    gid = F.when(F.col("_n") == 2, F.col("gid")).otherwise(F.raise_error(F.lit("a splat is missing from a key frame")).cast("bigint"))
    a, b, share = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}")), F.lit(float(t))
    out: dict[str, Column] = {}
    for kind, names in ATTRIBUTES.items():
        out |= {c: (v.lerp_log if kind == "scale" else v.lerp)(a(c), b(c), share) for c in names if c in columns}
    if set(TURN) <= set(columns):
        out |= dict(zip(TURN, v.slerp([a(c) for c in TURN], [b(c) for c in TURN], share)))
    if "shn" in columns:
        mixed = F.zip_with(a("shn"), b("shn"), lambda p, q: v.lerp(p, q, share))
        out["shn"] = F.when(F.size(a("shn")) == F.size(b("shn")), mixed)
    return both.select(gid.alias("gid"), *[c.alias(n) for n, c in out.items()])


def integer_keyframes(times: DataFrame) -> DataFrame:
    """Key frames at whole times: frame_before, frame_after and share, exact within a millionth."""
    base = F.floor("t")
    share = F.col("t") - base
    exact = share < 1e-6
    return times.withColumns({"frame_before": base, "frame_after": F.when(exact, base).otherwise(base + 1), "share": F.when(exact, 0.0).otherwise(share)})


def played(spark, frames: int, ticks: int, loop: bool = True) -> DataFrame:
    """The frame at each tick of the clock."""
    i = F.col("id")
    return spark.range(ticks).select(i.alias("tick"), (i % frames if loop else F.least(i, F.lit(frames - 1))).cast("int").alias("frame"))

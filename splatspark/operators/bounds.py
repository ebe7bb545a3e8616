"""Aggregates over splats: bounds, ranges, reports, corrections.

All are one partial aggregate, or two where the second needs the first's row; that row is broadcast (a single row).
Percentiles of whole tables are exact in bounded memory (quantiles.exact, which runs at once); those of a frame hold its values, whose number
the format bounds. ``accuracy`` takes sketches instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spaces as v
from . import quantiles

AXES = ("x", "y", "z")


def quantile(column, p: float, accuracy: int | None = None) -> Column:
    return F.percentile(column, p) if accuracy is None else F.percentile_approx(column, p, accuracy).cast("double")


def overall(rows: DataFrame, columns: dict[str, Column], wanted: tuple[float, ...], accuracy: int | None = None) -> DataFrame:
    """(channel, quantiles): of whole columns, one row each."""
    if accuracy is None:
        found = list(quantiles.exact(rows, columns, wanted).items())
        return rows.sparkSession.createDataFrame(found, "channel string, quantiles array<double>")
    sketch = rows.agg(*[F.percentile_approx(c.cast("double"), list(wanted), accuracy).alias(n) for n, c in columns.items()])
    return sketch.select(F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), F.col(n).alias("quantiles")) for n in columns])).alias("v")).select("v.*")


def scene_bounds(splats: DataFrame, low: float = 0.05, high: float = 0.95, pad: float = 0.1, accuracy: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Percentile box, padded on both sides by a share of its size, with centre and size."""
    if by:
        rows = splats.groupBy(*by).agg(*[quantile(a, p, accuracy).alias(f"{n}{a}") for a in AXES for n, p in (("l", low), ("h", high))])
    else:
        ends = overall(splats, {a: F.col(a) for a in AXES}, (low, high), accuracy)
        rows = ends.agg(*[F.max(F.when(F.col("channel") == a, F.col("quantiles")[i])).alias(f"{n}{a}") for a in AXES for i, n in enumerate("lh")])
    out = [F.col(c) for c in by]
    for a in AXES:
        size = F.col(f"h{a}") - F.col(f"l{a}")
        lo, hi = F.col(f"l{a}") - pad * size, F.col(f"h{a}") + pad * size
        out += [lo.alias(f"min_{a}"), hi.alias(f"max_{a}"), ((lo + hi) / 2).alias(f"centre_{a}"), (hi - lo).alias(f"size_{a}")]
    return rows.select(*out)


def bounding_sphere(splats: DataFrame, p: float = 0.95, margin: float = 1.1, accuracy: int | None = None) -> DataFrame:
    """Mean centre; radius: a percentile of the distances to it, times a margin."""
    centre = splats.agg(*[F.avg(a).alias(f"centre_{a}") for a in AXES])
    away = F.sqrt(sum(((F.col(a) - F.col(f"centre_{a}")) * (F.col(a) - F.col(f"centre_{a}")) for a in AXES[1:]), (F.col("x") - F.col("centre_x")) * (F.col("x") - F.col("centre_x"))))
    rows = splats.crossJoin(F.broadcast(centre)).withColumn("away", away)
    radius = overall(rows, {"away": F.col("away")}, (p,), accuracy).select((F.col("quantiles")[0] * margin).alias("radius"))
    return centre.crossJoin(F.broadcast(radius))


def layer_bounds(splats: DataFrame, *by: str) -> DataFrame:
    d = [F.max(a) - F.min(a) for a in AXES]
    sides = [f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))]
    return splats.groupBy(*by).agg(*sides, (F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) / 2).alias("radius"))


def centroid(splats: DataFrame, keep: Column) -> DataFrame:
    """Mean of the kept rows, counts and share kept; raises if none is kept."""
    rows = splats.agg(*[F.avg(F.when(keep, F.col(a))).alias(a) for a in AXES], F.count_if(keep).alias("kept"), F.count(F.lit(1)).alias("total"))
    x = F.when(F.col("kept") > 0, F.col("x")).otherwise(F.raise_error(F.lit("no splat is left")).cast("double"))
    return rows.select(x.alias("x"), "y", "z", "kept", "total", F.try_divide(100.0 * F.col("kept"), F.col("total")).alias("percent"))


def recommended_max_scale(splats: DataFrame, p: float = 0.995, accuracy: int | None = None) -> DataFrame:
    """Over all three axes of the first frame."""
    first = splats.agg(F.min("frame").alias("first_frame"))
    rows = splats.join(F.broadcast(first), splats["frame"] == F.col("first_frame"))
    return rows.select(F.explode(F.array(*[F.exp(c) for c in ("s0", "s1", "s2")])).alias("scale")).agg(quantile("scale", p, accuracy).alias("max_scale"))


RANGE_COLUMNS = {
    **{a: (lambda a=a: v.log_transform(F.col(a))) for a in AXES},
    **{c: (lambda c=c: F.col(c)) for c in ("s0", "s1", "s2")},
    **{c: (lambda c=c: v.compand(v.clamp(F.col(c), -1.0, 1.0))) for c in ("qw", "qx", "qy", "qz")},
    "opacity": lambda: v.clamp(F.col("opacity"), *v.OPACITY_CLIP),
    **{c: (lambda c=c: v.clamp(F.col(c), -4.0, 4.0)) for c in ("c0", "c1", "c2")},
}


def ranges(splats: DataFrame) -> DataFrame:
    """Least and greatest of each channel in the codec's space, over active rows; one row."""
    return splats.where("active").agg(*[f(e()).alias(f"{n}_{c}") for c, e in RANGE_COLUMNS.items() for n, f in (("min", F.min), ("max", F.max))])


#: Snap steps that divide well into bytes.
SAFE_STEPS = (3, 4, 5, 6, 7, 8, 10, 12, 16, 20, 24, 28, 32, 42, 48, 64, 85, 96, 127)


def auto_step(splats: DataFrame, frames: int = 5) -> DataFrame:
    """The snap step that suits the median scale of the first frames, against the extent of the scene."""
    active = splats.where("active")
    extent = active.agg(F.greatest(*[F.max(a) - F.min(a) for a in AXES]).alias("extent"))
    few = active.where(F.col("frame") < frames).select(F.explode(F.array(*[F.exp(c) for c in ("s0", "s1", "s2")])).alias("scale"))
    row = few.agg(F.expr("percentile_disc(0.5) within group (order by scale)").alias("median")).crossJoin(F.broadcast(extent))
    wanted = F.least(F.greatest(F.rint(0.2 * v.HI_LO_STEPS * F.col("median") / F.col("extent")), F.lit(3.0)), F.lit(127.0))
    steps = F.array(*[F.struct(F.abs(F.lit(k) - wanted).alias("d"), F.lit(k).alias("k")) for k in SAFE_STEPS])
    return row.select("median", "extent", wanted.cast("int").alias("wanted"), F.array_min(steps)["k"].alias("step"))


def distribution(rows: DataFrame, columns: tuple[str, ...], percentiles: tuple[float, ...] = (0.01, 0.5, 0.99), accuracy: int | None = None) -> DataFrame:
    """One row per column: least, greatest, mean, deviation, percentiles, and share of the range outside the 0.1 and 99.9 percentiles."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("value")) for c in columns])).alias("v")).select("v.*")
    shape = long.groupBy("channel").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))
    names = [f"p{p * 100:g}".replace(".", "_") for p in percentiles] + ["_low", "_high"]
    ends = overall(rows, {c: F.col(c) for c in columns}, (*percentiles, 0.001, 0.999), accuracy)
    found = shape.join(F.broadcast(ends), "channel").select(*shape.columns, *[F.col("quantiles")[i].alias(n) for i, n in enumerate(names)])
    waste = 1 - F.try_divide(F.col("_high") - F.col("_low"), F.col("most") - F.col("least"))
    return found.withColumn("waste", F.coalesce(waste, F.lit(0.0))).drop("_low", "_high")


def entropy(rows: DataFrame, value: Column, by: str) -> DataFrame:
    """Shannon entropy in bits of a value's distribution in each group. Two levels of aggregates; no group is gathered."""
    counts = rows.groupBy(by, value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(by).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("s"), F.count(F.lit(1)).alias("values"))
    return total.select(by, (F.log2("total") - F.col("s") / F.col("total")).alias("bits"), F.col("values"))


def psnr(mse: Column) -> Column:
    return F.when(mse <= 0, 99.0).otherwise(-10 * F.log10(F.greatest(mse, F.lit(1e-300))))


# Corrections of colour, on display colour


def _long(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.array(*[v.clamp(v.sh_to_rgb(F.col(c)), 0.0, 1.0) for c in ("c0", "c1", "c2")])).alias("value"))


def auto_exposure(rows: DataFrame) -> DataFrame:
    return _long(rows).agg(v.clamp(0.45 / (F.avg("value") + 1e-6), 0.3, 3.0).alias("brightness"))


def auto_contrast(rows: DataFrame, accuracy: int | None = None) -> DataFrame:
    ends = overall(_long(rows), {"value": F.col("value")}, (0.001, 0.999), accuracy)
    spread = F.col("quantiles")[1] - F.col("quantiles")[0]
    return ends.select(v.clamp(0.9 / (spread + 1e-6), 0.5, 3.0).alias("contrast"))


def white_balance(rows: DataFrame) -> DataFrame:
    """Grey world: gains that make channel means equal, as temperature and tint."""
    means = [F.avg(v.clamp(v.sh_to_rgb(F.col(c)), 0.0, 1.0)) for c in ("c0", "c1", "c2")]
    return _balance(rows.agg(*[m.alias(n) for m, n in zip(means, ("r", "g", "b"))]))


def _balance(means: DataFrame) -> DataFrame:
    grey = (F.col("r") + F.col("g") + F.col("b")) / 3
    gain = lambda c: grey / (F.col(c) + 1e-6)
    return means.select(v.clamp((gain("r") - gain("b")) / 0.6, -1.0, 1.0).alias("temperature"), v.clamp((1 - gain("g")) / 0.3, -1.0, 1.0).alias("tint"))


def white_patch(rows: DataFrame, share: float = 0.01, key: str = "gid") -> DataFrame:
    """As white_balance(), over the brightest share, one row at least: a sorted limit, no global rank."""
    n = max(1, int(share * rows.count()))
    rgb = [v.clamp(v.sh_to_rgb(F.col(c)), 0.0, 1.0).alias(n) for c, n in zip(("c0", "c1", "c2"), ("r", "g", "b"))]
    top = rows.select(key, *rgb).orderBy((F.col("r") + F.col("g") + F.col("b")).desc(), key).limit(n)
    return _balance(top.agg(*[F.avg(c).alias(c) for c in ("r", "g", "b")]))


def auto_enhance(rows: DataFrame, strength: float = 0.5) -> DataFrame:
    """A blend of exposure, contrast and balance with the neutral look; half the warmth."""
    one = auto_exposure(rows).crossJoin(F.broadcast(auto_contrast(rows))).crossJoin(F.broadcast(white_balance(rows)))
    mixed = lambda c: (1 + strength * (F.col(c) - 1)).alias(c)
    return one.select(mixed("brightness"), mixed("contrast"), (F.col("temperature") * strength / 2).alias("temperature"), (F.col("tint") * strength).alias("tint"))

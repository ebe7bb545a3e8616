"""Layers: visibility, order, opacity, static scenery before moving splats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(splats: DataFrame, layers: DataFrame, frame: int | None = None) -> DataFrame:
    """Splats of visible layers with draw_order; opacity times the layer's multiplier, without a clamp.

    ``layers``: layer_id, visible, z_order, opacity_multiplier and, where a frame is given, first_frame and last_frame, both included.
    """
    shown = layers.where("visible")
    if frame is not None:
        shown = shown.where(F.lit(frame).between(F.col("first_frame"), F.col("last_frame")))
    joined = splats.join(shown, "layer_id")
    return joined.withColumn("opacity", F.col("opacity") * F.col("opacity_multiplier")).withColumn("draw_order", F.struct("z_order", "layer_id", "gid"))


def with_static(static: DataFrame, moving: DataFrame, size: int) -> DataFrame:
    """Static splats, then moving ones; shn filled up with zeros to ``size``."""
    fill = lambda df, n: df.withColumns({"part": F.lit(n), "shn": F.concat("shn", F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(size) - F.size("shn"))))})
    return fill(static, 0).unionByName(fill(moving, 1))


def concatenated(parts: list[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("nothing to put together")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

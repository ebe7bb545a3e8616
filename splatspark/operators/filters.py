"""Splat filters as predicates on stored columns.

A filter is a value object; ``predicate()`` is its column. Bounded shapes add the ranges of their bounding box, which the
scan can use to skip row groups. Boundaries belong to the shape. A neutral filter adds no node to the plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import quantiles
from .matching import checkpointed

INF = math.inf
POSITION = ("x", "y", "z")


def _box(low: g.Vector, high: g.Vector) -> Column:
    parts = [F.col(n).between(a, b) for n, a, b in zip(POSITION, low, high)]
    return parts[0] & parts[1] & parts[2]


def _columns() -> list[Column]:
    return [F.col(n) for n in POSITION]


def _local(centre: g.Vector, turn: g.Vector) -> list[Column]:
    """Positions in the frame of a shape that is turned by an axis-angle about its centre."""
    p = [c - v for c, v in zip(_columns(), centre)]
    m = g.transpose(g.quaternion_matrix(g.axis_angle_quaternion(turn)))
    if m == g.IDENTITY:
        return p
    return [p[0] * r[0] + p[1] * r[1] + p[2] * r[2] for r in m]


def _reach(matrix: g.Matrix, half: g.Vector) -> list[float]:
    """Half sizes of the axis-aligned box around a turned box."""
    return [sum(abs(m) * h for m, h in zip(row, half)) for row in matrix]


@dataclass(frozen=True)
class Sphere:
    centre: tuple[float, float, float] = (0.0, 0.0, 0.0)
    radius: float = INF

    @property
    def neutral(self) -> bool:
        return math.isinf(self.radius)

    def predicate(self) -> Column:
        near = g.squared_distance(_columns(), self.centre) <= self.radius**2
        return _box([c - self.radius for c in self.centre], [c + self.radius for c in self.centre]) & near


@dataclass(frozen=True)
class Box:
    low: tuple[float, float, float] = (-INF, -INF, -INF)
    high: tuple[float, float, float] = (INF, INF, INF)
    turn: tuple[float, float, float] = (0.0, 0.0, 0.0)

    @property
    def neutral(self) -> bool:
        return all(map(math.isinf, (*self.low, *self.high)))

    def predicate(self) -> Column:
        if self.turn == (0.0, 0.0, 0.0):
            return _box(self.low, self.high)
        centre = [(a + b) / 2 for a, b in zip(self.low, self.high)]
        half = [(b - a) / 2 for a, b in zip(self.low, self.high)]
        parts = [F.abs(v) <= h for v, h in zip(_local(centre, self.turn), half)]
        reach = _reach(g.quaternion_matrix(g.axis_angle_quaternion(self.turn)), half)
        # A little more than the box, as it is only there to skip.
        around = _box([c - h - 1e-9 * (1 + h) for c, h in zip(centre, reach)], [c + h + 1e-9 * (1 + h) for c, h in zip(centre, reach)])
        return around & parts[0] & parts[1] & parts[2]


@dataclass(frozen=True)
class Ellipsoid:
    centre: tuple[float, float, float] = (0.0, 0.0, 0.0)
    radii: tuple[float, float, float] = (INF, INF, INF)
    turn: tuple[float, float, float] = (0.0, 0.0, 0.0)

    @property
    def neutral(self) -> bool:
        return all(map(math.isinf, self.radii))

    def predicate(self) -> Column:
        parts = [(v / r) * (v / r) for v, r in zip(_local(self.centre, self.turn), self.radii)]
        most = max(self.radii)
        return _box([c - most for c in self.centre], [c + most for c in self.centre]) & (parts[0] + parts[1] + parts[2] <= 1)


@dataclass(frozen=True)
class Frustum:
    """A camera at ``position`` that looks along its own -z; ``fov`` is vertical, in radians."""

    position: tuple[float, float, float] = (0.0, 0.0, 0.0)
    turn: tuple[float, float, float] = (0.0, 0.0, 0.0)
    fov: float = math.pi / 3
    aspect: float = 1.0
    near: float = 0.1
    far: float = 100.0
    neutral: bool = False

    def predicate(self) -> Column:
        x, y, z = _local(self.position, self.turn)
        depth, slope = -z, math.tan(self.fov / 2)
        reach = self.far * math.sqrt(1 + slope**2 * (1 + self.aspect**2)) * (1 + 1e-9)
        around = _box([c - reach for c in self.position], [c + reach for c in self.position])
        return around & depth.between(self.near, self.far) & (F.abs(y) <= depth * slope) & (F.abs(x) <= depth * slope * self.aspect)


@dataclass(frozen=True)
class Range:
    """Of an expression, given as SQL text, so that a filter is a plain value."""

    column: str = ""
    low: float = -INF
    high: float = INF

    @property
    def neutral(self) -> bool:
        return self.low == -INF and self.high == INF

    def predicate(self) -> Column:
        value = F.expr(self.column)
        parts = ([value >= self.low] if self.low > -INF else []) + ([value <= self.high] if self.high < INF else [])
        return parts[0] & parts[1] if len(parts) > 1 else parts[0]


def opacity_range(low: float = -INF, high: float = INF) -> Range:
    return Range("opacity", low, high)


def scale_range(low: float = -INF, high: float = INF) -> Range:
    """Of the largest axis."""
    return Range("greatest(s0, s1, s2)", low, high)


def predicate(*filters, invert: bool = False) -> Column | None:
    """Conjunction of the filters that are not neutral; None if all are, inverted or not."""
    parts = [f.predicate() for f in filters if not f.neutral]
    if not parts:
        return None
    whole = parts[0]
    for p in parts[1:]:
        whole = whole & p
    return ~whole if invert else whole


def apply(splats: DataFrame, *filters, invert: bool = False) -> DataFrame:
    p = predicate(*filters, invert=invert)
    return splats if p is None else splats.where(p)


def to_local(shape, t: g.Transform):
    """The filter on untransformed splats that keeps what ``shape`` keeps after ``t``.

    A sphere under a scale that isn't uniform becomes an ellipsoid. Boxes and frustums need a uniform scale.
    """
    back = lambda p: tuple(t.inverse_points(p))
    turned = lambda v: g.quaternion_axis_angle(g.matrix_quaternion(g.matmul(g.transpose(t.matrix), g.quaternion_matrix(g.axis_angle_quaternion(v)))))
    if isinstance(shape, Sphere):
        if t.uniform:
            return Sphere(back(shape.centre), shape.radius / t.scale[0])
        return Ellipsoid(back(shape.centre), tuple(shape.radius / s for s in t.scale))
    if not t.uniform:
        raise ValueError("this shape can't be rewritten under a scale that isn't uniform")
    s = t.scale[0]
    if isinstance(shape, Ellipsoid):
        return Ellipsoid(back(shape.centre), tuple(r / s for r in shape.radii), turned(shape.turn))
    if isinstance(shape, Frustum):
        return replace(shape, position=back(shape.position), turn=turned(shape.turn), near=shape.near / s, far=shape.far / s)
    if isinstance(shape, Box):
        centre = back([(a + b) / 2 for a, b in zip(shape.low, shape.high)])
        half = [(b - a) / 2 / s for a, b in zip(shape.low, shape.high)]
        return Box(tuple(c - h for c, h in zip(centre, half)), tuple(c + h for c, h in zip(centre, half)), turned(shape.turn))
    return shape


# Masks


def active_only(splats: DataFrame) -> DataFrame:
    return splats.where("active")


def require_finite(splats: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Raises on an active row with a number that isn't finite; minus infinity of opacity means invisible."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.isnan(c) | (F.abs(F.col(c)) == INF)
    return splats.withColumn(columns[0], F.when(F.col("active") & bad, F.raise_error(F.lit("active splat with a number that isn't finite"))).otherwise(F.col(columns[0])))


def sanitised(splats: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Inactive rows get zeros and the identity rotation."""
    return splats.withColumns({c: F.when(F.col("active"), F.col(c)).otherwise(F.lit(1.0 if c == "qw" else 0.0)) for c in columns})


def ever_active(splats: DataFrame) -> DataFrame:
    """Rows of splats that are active in some frame; the ids are a partial aggregate."""
    alive = splats.groupBy("gid").agg(F.bool_or("active").alias("alive")).where("alive").select("gid")
    return splats.join(alive, "gid", "left_semi")


def pruned(splats: DataFrame, min_opacity: float = 0.10, min_scale: float = 1e-3, quantile: float = 0.005) -> DataFrame:
    """Without splats whose greatest opacity, scale or importance over their lifetime is small.

    Importance is opacity times volume. Its quantile is exact and a number by the time the plan is made.
    """
    alpha = 1 / (1 + F.exp(-F.col("opacity")))
    life = splats.where("active").groupBy("gid").agg(
        F.max(alpha).alias("alpha"), F.max(F.exp(F.greatest("s0", "s1", "s2"))).alias("scale"), F.max(F.exp(F.col("s0") + F.col("s1") + F.col("s2"))).alias("volume")
    ).withColumn("importance", F.col("alpha") * F.col("volume"))
    life = checkpointed(life)
    (cut,) = quantiles.exact(life, {"importance": F.col("importance")}, (quantile,))["importance"]
    keep = life.where((F.col("alpha") >= min_opacity) & (F.col("scale") >= min_scale) & (F.col("importance") >= F.lit(cut)))
    return splats.join(keep.select("gid"), "gid", "left_semi")

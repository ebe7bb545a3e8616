"""Value spaces of splat attributes and what moves between them, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
SH_C0 = 0.28209479177387814
SCALE_MIN, SCALE_MAX = 1e-6, 1e3
NORM_FLOOR = 1e-8
QUANT_LOW, QUANT_STEPS = 16, 219
HI_LO_STEPS = 56319
QUAT_CLIP, OPACITY_CLIP, COLOUR_CLIP = (-1.0, 1.0), (-6.0, 12.0), (-2.0, 4.0)
SLERP_NEAR = 0.9995


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def sh_to_rgb(x: Column) -> Column:
    return x * SH_C0 + 0.5


def rgb_to_sh(x: Column) -> Column:
    return (x - 0.5) / SH_C0


def log_transform(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def inverse_log_transform(x: Column) -> Column:
    return F.signum(x) * F.expm1(F.abs(x))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(x: Column, floor: float = 1e-6) -> Column:
    p = clamp(x, floor, 1 - floor)
    return F.ln(p / (1 - p))


def export_logit(alpha: Column) -> Column:
    """Exactly invisible stays so: zero becomes minus infinity."""
    return F.when(alpha <= 0, F.lit(float("-inf"))).otherwise(logit(alpha))


def linear_scale(x: Column) -> Column:
    return clamp(F.exp(x), SCALE_MIN, SCALE_MAX)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return (1 - t) * a + t * b


def lerp_log(a: Column, b: Column, t: Column) -> Column:
    """Between linear values, in log space."""
    low = lambda v: F.ln(F.greatest(v, F.lit(NORM_FLOOR)))
    return F.exp(lerp(low(a), low(b), t))


def norm(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def unit(parts: list[Column]) -> list[Column]:
    n = F.greatest(norm(*parts), F.lit(NORM_FLOOR))
    return [p / n for p in parts]


def slerp(q0: list[Column], q1: list[Column], t: Column) -> list[Column]:
    """Shortest arc between unit quaternions; a straight line where they nearly meet."""
    dot = sum((a * b for a, b in zip(q0[1:], q1[1:])), q0[0] * q1[0])
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    cosine = F.least(F.abs(dot), F.lit(1.0))
    angle = F.acos(cosine)
    sine = F.sin(angle)
    safe = F.when(sine < NORM_FLOOR, 1.0).otherwise(sine)
    near = cosine > SLERP_NEAR
    w0 = F.when(near, 1 - t).otherwise(F.sin((1 - t) * angle) / safe)
    w1 = F.when(near, t).otherwise(F.sin(t * angle) / safe) * sign
    return unit([w0 * a + w1 * b for a, b in zip(q0, q1)])


def quantise8(x: Column, low: Column, high: Column) -> Column:
    """Steps 16 to 235; a range without extent counts as 1."""
    extent = F.when(high > low, high - low).otherwise(1.0)
    return (F.rint(clamp((x - low) / extent, 0.0, 1.0) * QUANT_STEPS) + QUANT_LOW).cast("int")


def dequantise8(q: Column, low: Column, high: Column) -> Column:
    extent = F.when(high > low, high - low).otherwise(1.0)
    return (q - QUANT_LOW) / QUANT_STEPS * extent + low


def quantise16(x: Column, low: Column, high: Column) -> Column:
    extent = F.when(high > low, high - low).otherwise(1.0)
    return F.floor(clamp((x - low) / extent, 0.0, 1.0) * HI_LO_STEPS).cast("int")


def high_byte(q: Column) -> Column:
    return F.least(F.greatest(F.floor(q / 256), F.lit(0)), F.lit(QUANT_STEPS)).cast("int") + QUANT_LOW


def low_byte(q: Column) -> Column:
    return F.pmod(q, F.lit(256)).cast("int")


def snap_low(low: Column, k: int) -> Column:
    """The nearest multiple of ``k``, modulo a byte."""
    return F.pmod(F.floor((low + k // 2) / k) * k, F.lit(256)).cast("int")


def dequantise16(high: Column, low: Column, least: Column, most: Column) -> Column:
    extent = F.when(most > least, most - least).otherwise(1.0)
    return ((high - QUANT_LOW) * 256 + low) / HI_LO_STEPS * extent + least


def compand(q: Column) -> Column:
    return F.asin(clamp(q, -0.9999, 0.9999)) / (math.pi / 2)


def expand(v: Column) -> Column:
    return F.sin(v * (math.pi / 2))


#: Luma and colour differences of the codec; the pair is an approximate inverse.
TO_YCBCR = ((0.299, 0.587, 0.114), (-0.168736, -0.331264, 0.5), (0.5, -0.418688, -0.081312))
FROM_YCBCR = ((1.0, 0.0, 1.402), (1.0, -0.344136, -0.714136), (1.0, 1.772, 0.0))


def mix(matrix, parts: list[Column], offset: tuple[float, ...] = (0.0, 0.0, 0.0)) -> list[Column]:
    """matrix * parts + offset."""
    return [parts[0] * m[0] + parts[1] * m[1] + parts[2] * m[2] + o for m, o in zip(matrix, offset)]


def normalised_time(t: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, 0.0).otherwise(F.try_divide(t - low, high - low))


def denormalised_time(t: Column, low: Column, high: Column) -> Column:
    return low + t * (high - low)


def snap_frame(t: Column, fps: float) -> Column:
    """Halves go to the even frame."""
    return F.rint(t * fps) / fps

"""Edits of splats: activation, filter, transform, colour and opacity, in this order, as one projection."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import spaces as v
from . import filters

COLOURS = ("c0", "c1", "c2")
LUMA = (0.299, 0.587, 0.114)


def activated(splats: DataFrame, has_shn: bool = True) -> DataFrame:
    """Storage to working space: linear scales and opacity, unit rotations, colour in RGB where there is no shn."""
    turn = v.unit([F.col(c) for c in ("qw", "qx", "qy", "qz")])
    out = {c: v.linear_scale(F.col(c)) for c in ("s0", "s1", "s2")} | dict(zip(("qw", "qx", "qy", "qz"), turn))
    out["opacity"] = v.clamp(v.sigmoid(F.col("opacity")), 0.0, 1.0)
    if not has_shn:
        out |= {c: v.clamp(v.sh_to_rgb(F.col(c)), 0.0, 1.0) for c in COLOURS}
    return splats.withColumns(out)


def stored(splats: DataFrame, has_shn: bool = True) -> DataFrame:
    """Working space to storage; an opacity of zero becomes minus infinity."""
    out = {c: F.ln(F.greatest(F.col(c), F.lit(v.NORM_FLOOR))) for c in ("s0", "s1", "s2")}
    out["opacity"] = v.export_logit(F.col("opacity"))
    if not has_shn:
        out |= {c: v.rgb_to_sh(F.col(c)) for c in COLOURS}
    return splats.withColumns(out)


def transformed(splats: DataFrame, t: g.Transform, log_scales: bool = True) -> DataFrame:
    """Positions by the affine map, rotations by its rotation, scales by its uniform factor.

    A scale per axis moves positions alone; shn keeps its frame.
    """
    if t.neutral:
        return splats
    out = dict(zip(filters.POSITION, t.points([F.col(c) for c in filters.POSITION])))
    if t.matrix != g.IDENTITY and "qw" in splats.columns:
        q = tuple(F.lit(float(c)) for c in t.rotation)
        out |= dict(zip(("qw", "qx", "qy", "qz"), g.multiply(q, [F.col(c) for c in ("qw", "qx", "qy", "qz")])))
    if t.uniform and t.scale[0] != 1 and "s0" in splats.columns:
        out |= {c: F.col(c) + F.ln(F.lit(t.scale[0])) if log_scales else F.col(c) * t.scale[0] for c in ("s0", "s1", "s2")}
    return splats.withColumns(out)


@dataclass(frozen=True)
class Colour:
    """Display colour, step by step: temperature and tint, exposure and brightness, contrast, then tone (shadows, highlights and their tints), then
    saturation and vibrance, hue, fade. gamma is applied last and in RGB alone.

    The steps before tone are one affine map, those behind it another. Tone scales a splat by its luminance after contrast, and the tints, which have no
    luminance of their own, shift its colour. Vibrance is half a saturation.
    """

    temperature: float = 0.0
    tint: float = 0.0
    brightness: float = 1.0
    contrast: float = 1.0
    saturation: float = 1.0
    hue: float = 0.0
    fade: float = 0.0
    gamma: float = 1.0
    exposure: float = 0.0
    vibrance: float = 1.0
    shadows: float = 0.0
    highlights: float = 0.0
    shadow_tint_hue: float = 0.0
    shadow_tint_sat: float = 0.0
    highlight_tint_hue: float = 0.0
    highlight_tint_sat: float = 0.0

    @property
    def toned(self) -> bool:
        return any((self.shadows, self.highlights, self.shadow_tint_sat, self.highlight_tint_sat))

    @property
    def neutral(self) -> bool:
        return self == Colour()

    def affine(self, part: slice = slice(None)) -> tuple[g.Matrix, tuple[float, float, float]]:
        """The steps of BEFORE_TONE, of AFTER_TONE, or all as one map."""
        diagonal = lambda a, b, c: ((a, 0.0, 0.0), (0.0, b, 0.0), (0.0, 0.0, c))
        s, k, h = self.saturation * (1 + 0.5 * (self.vibrance - 1)), self.contrast, math.radians(self.hue)
        grey = tuple(tuple((1 - s) * w + (s if i == j else 0.0) for j, w in enumerate(LUMA)) for i in range(3))
        third, root = (1 - math.cos(h)) / 3, math.sin(h) / math.sqrt(3)
        # Turn about the grey axis.
        spin = tuple(tuple(third + (math.cos(h) if i == j else root if (j - i) % 3 == 2 else -root) for j in range(3)) for i in range(3))
        steps = (
            (diagonal(1 + 0.3 * self.temperature, 1 - 0.3 * self.tint, 1 - 0.3 * self.temperature), 0.0),
            (diagonal(*[self.brightness * 2**self.exposure] * 3), 0.0),
            (diagonal(k, k, k), 0.5 * (1 - k)),
            (grey, 0.0),
            (spin, 0.0),
            (diagonal(*[1 - self.fade] * 3), 0.5 * self.fade),
        )
        matrix, offset = g.IDENTITY, (0.0, 0.0, 0.0)
        for m, b in steps[part]:
            offset = tuple(sum(x * y for x, y in zip(row, offset)) + b for row in m)
            matrix = g.matmul(m, matrix)
        return matrix, offset

    def then(self, other: "Colour") -> "Colour":
        """Both settings as one: factors multiply, shifts add, and a tint of the other replaces that of this where it is set."""
        factors = {"brightness", "contrast", "saturation", "vibrance", "gamma"}

        def one(name: str) -> float:
            a, b = getattr(self, name), getattr(other, name)
            return a * b if name in factors else (b or a) if "_tint_" in name else a + b

        return Colour(**{f.name: one(f.name) for f in fields(self)})


BEFORE_TONE, AFTER_TONE = slice(0, 3), slice(3, None)


def hue_shift(hue: float, strength: float) -> tuple[float, ...]:
    """The colour of a hue (0 to 1 round the circle) less its own luminance, times a strength."""
    rgb = [min(max(abs((hue * 6 + turn) % 6 - 3) - 1, 0.0), 1.0) for turn in (0, 4, 2)]
    grey = sum(w * c for w, c in zip(LUMA, rgb))
    return tuple(strength * (c - grey) for c in rgb)


def tone(colour: Colour, rgb: list[Column]) -> tuple[Column, list[Column]]:
    """Factor and shifts of a splat by the luminance of its display colour: dark ones take the shadows' settings, bright ones the highlights'."""
    light = v.clamp(v.mix((LUMA,), rgb, (0.0,))[0], 0.0, 1.0)
    dark = (1 - light) * (1 - light)
    bright = light * light
    low, high = hue_shift(colour.shadow_tint_hue, colour.shadow_tint_sat), hue_shift(colour.highlight_tint_hue, colour.highlight_tint_sat)
    return 1 + colour.shadows * dark + colour.highlights * bright, [dark * a + bright * b for a, b in zip(low, high)]


def coloured(splats: DataFrame, colour: Colour, rgb: bool = False) -> DataFrame:
    """Degree-0 colour by the whole map of display colour, shn by its matrices and the splat's tone factor, but no shift. In RGB the result is clamped."""
    if colour.neutral:
        return splats
    matrix, offset = colour.affine()
    now = [F.col(c) if rgb else v.sh_to_rgb(F.col(c)) for c in COLOURS]
    factor = None
    if colour.toned:
        first = v.mix(colour.affine(BEFORE_TONE)[0], now, colour.affine(BEFORE_TONE)[1])
        factor, shift = tone(colour, first)
        after, behind = colour.affine(AFTER_TONE)
        new = v.mix(after, [c * factor + s for c, s in zip(first, shift)], behind)
    else:
        new = v.mix(matrix, now, offset)
    if rgb:
        new = [v.clamp(c, 0.0, 1.0) for c in new]
        if colour.gamma != 1:
            new = [F.pow(c, F.lit(1 / colour.gamma)) for c in new]
    out = dict(zip(COLOURS, new if rgb else [v.rgb_to_sh(c) for c in new]))
    if "shn" in splats.columns:
        # Before the colours are replaced: inside a lambda their names would mean the new ones.
        mixed = shn_mixed(F.col("shn"), matrix)
        splats = splats.withColumn("shn", mixed if factor is None else F.transform(mixed, lambda x: x * factor))
    return splats.withColumns(out)


def shn_mixed(shn: Column, matrix: g.Matrix) -> Column:
    """Each coefficient's triple times the matrix; a multiple of the identity is one multiplication."""
    k = matrix[0][0]
    if matrix == ((k, 0.0, 0.0), (0.0, k, 0.0), (0.0, 0.0, k)):
        return F.transform(shn, lambda x: x * k)
    # Places from 0; the row of the matrix follows from the place.
    at = lambda i, c: F.element_at(shn, (i - i % 3 + c + 1).cast("int"))
    row = lambda i, c: F.when(i % 3 == 0, matrix[0][c]).when(i % 3 == 1, matrix[1][c]).otherwise(matrix[2][c])
    return F.transform(shn, lambda _, i: at(i, 0) * row(i, 0) + at(i, 1) * row(i, 1) + at(i, 2) * row(i, 2))


#: Named looks, each relative to the neutral one.
PRESETS = {
    "vibrant": Colour(saturation=1.3, vibrance=1.2, contrast=1.05),
    "dramatic": Colour(contrast=1.3, shadows=-0.15, highlights=0.05, saturation=1.1),
    "bright": Colour(brightness=1.2, gamma=0.9),
    "dark": Colour(brightness=0.8, gamma=1.1),
    "warm": Colour(temperature=0.3, tint=0.05, saturation=1.05),
    "cool": Colour(temperature=-0.3, tint=-0.05, saturation=1.05),
    "cinematic": Colour(contrast=1.15, saturation=0.9, fade=0.08, shadows=-0.1, highlights=-0.05, shadow_tint_hue=0.6, shadow_tint_sat=0.15, highlight_tint_hue=0.1, highlight_tint_sat=0.1),
    "muted": Colour(saturation=0.7, vibrance=0.8, contrast=0.9, fade=0.05),
    "punchy": Colour(contrast=1.25, saturation=1.25, vibrance=1.15, shadows=-0.1, highlights=0.1),
}


def faded(splats: DataFrame, factor: float) -> DataFrame:
    """Linear opacity times a factor, clamped."""
    return splats if factor == 1 else splats.withColumn("opacity", v.clamp(F.col("opacity") * factor, 0.0, 1.0))


@dataclass(frozen=True)
class Edit:
    """A whole edit. Filters look at working values and untransformed positions."""

    filters: tuple = ()
    invert: bool = False
    transform: g.Transform = field(default_factory=g.Transform)
    colour: Colour = field(default_factory=Colour)
    opacity: float = 1.0

    def apply(self, splats: DataFrame, rgb: bool = False) -> DataFrame:
        """Of activated splats."""
        kept = filters.apply(splats, *self.filters, invert=self.invert)
        return faded(coloured(transformed(kept, self.transform, log_scales=False), self.colour, rgb), self.opacity)


class Scene:
    """A builder: steps are recorded and become one lazy plan."""

    def __init__(self, splats: DataFrame) -> None:
        self.splats = splats

    def at(self, frame: int) -> "Scene":
        return Scene(self.splats.where(F.col("frame") == frame))

    def activate(self, has_shn: bool = True) -> "Scene":
        return Scene(activated(self.splats, has_shn))

    def edit(self, edit: Edit, rgb: bool = False) -> "Scene":
        return Scene(edit.apply(self.splats, rgb))

    def store(self, has_shn: bool = True) -> "Scene":
        return Scene(stored(self.splats, has_shn))

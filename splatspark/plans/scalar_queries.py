"""Queries of scalar functions, filters and edits, keyed by their inventory number."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import bits, spaces
from ..functions import geometry as g
from ..operators import edit, filters, matching
from .registry import query, r, tidy
from .views import CHUNKS_SQL, EVENTS_SQL, LINES_SQL, SPLATS_SQL, TRACKS_SQL, chunks, event_splats, line_splats, splats, table, tracks

C0 = repr(spaces.SH_C0)
clampq = lambda x, a, b: f"greatest(least({x}, {a}), {b})"


@query(
    "X1_natural_sort",
    """SELECT page_id, url, row_number() OVER (ORDER BY array_to_string(list_transform(list_zip(string_split_regex(lower(url), '[0-9]+'),
    regexp_extract_all(url, '[0-9]+')), lambda p: p[1] || coalesce(lpad(regexp_replace(p[2], '^0+(.)', '\\1'), 20, '0'), '')), ''), page_id) AS rank FROM pages""",
)
def _(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url", bits.natural_key(F.col("url")).alias("key"))
    return matching.globally_ranked(rows, ["key", "page_id"]).select("page_id", "url", (F.col("rank") + 1).cast("bigint").alias("rank"))


@query(
    "X2_last_integer",
    """SELECT page_id, CASE WHEN len(n) > 0 THEN CAST(n[len(n)] AS BIGINT) ELSE -1 END AS number FROM (SELECT page_id,
    regexp_extract_all(regexp_replace(list_extract(string_split(url, '/'), -1), '\\.[^.]*$', ''), '[0-9]+') AS n FROM pages)""",
)
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.coalesce(bits.last_integer(F.col("url")), F.lit(-1).cast("bigint")).alias("number"))


@query("X3_sh_rgb", f"WITH {SPLATS_SQL} SELECT gid, {r(f'c0 * {C0} + 0.5', 'red')}, {r(f'(c1 * {C0} + 0.5 - 0.5) / {C0}', 'back')} FROM s")
def _(spark, d):
    c = F.col
    return tidy(splats(spark, d).select("gid", spaces.sh_to_rgb(c("c0")).alias("red"), spaces.rgb_to_sh(spaces.sh_to_rgb(c("c1"))).alias("back")))


@query("X4_log_transform", f"WITH {LINES_SQL} SELECT frame, {r('sum(sign(y - 25) * ln(1 + abs(y - 25)))', 'total', 3)} FROM l GROUP BY frame")
def _(spark, d):
    return tidy(line_splats(spark, d).groupBy("frame").agg(F.sum(spaces.log_transform(F.col("y") - 25)).alias("total")), 3)


@query("X5_inverse_log", f"WITH {SPLATS_SQL} SELECT gid, {r('sign(s0) * (exp(abs(s0)) - 1)', 'wide')} FROM s")
def _(spark, d):
    return tidy(splats(spark, d).select("gid", spaces.inverse_log_transform(F.col("s0")).alias("wide")))


_P = clampq("(x + 0.5)", "1 - 1e-6", "1e-6")


@query("X6_inverse_sigmoid", f"WITH {SPLATS_SQL} SELECT gid, {r(f'ln({_P} / (1 - {_P}))', 'logit')} FROM s")
def _(spark, d):
    return tidy(splats(spark, d).select("gid", spaces.logit(F.col("x") + 0.5).alias("logit")))


_N = "greatest(sqrt(qw*qw + qx*qx + qy*qy + qz*qz), 1e-8)"
_ACT = (
    ", ".join(f"{clampq(f'exp(s{i})', 1000.0, 1e-6)} AS s{i}" for i in range(3))
    + ", "
    + ", ".join(f"{q} / {_N} AS {q}" for q in ("qw", "qx", "qy", "qz"))
    + ", 1 / (1 + exp(-opacity)) AS opacity"
)
_A = f"a AS (SELECT gid, frame, x, y, z, {_ACT}, c0, c1, c2, shn FROM s)"
_COLS = ["x", "y", "z", "s0", "s1", "s2", "qw", "qx", "qy", "qz", "opacity", "c0", "c1", "c2"]


@query("X7_activation", f"WITH {SPLATS_SQL}, {_A} SELECT gid, {', '.join(r(c, c) for c in _COLS)} FROM a")
def _(spark, d):
    return tidy(edit.activated(splats(spark, d)).select("gid", *_COLS))


@query("X7_activation_rgb", f"WITH {SPLATS_SQL} SELECT gid, {', '.join(r(clampq(f'c{i} * {C0} + 0.5', 1.0, 0.0), f'c{i}') for i in range(3))} FROM s")
def _(spark, d):
    return tidy(edit.activated(splats(spark, d).drop("shn"), has_shn=False).select("gid", "c0", "c1", "c2"))


@query("X8_lerp", f"WITH {SPLATS_SQL} SELECT gid, {r('(1 - 0.25) * x + 0.25 * y', 'v')} FROM s")
def _(spark, d):
    return tidy(splats(spark, d).select("gid", spaces.lerp(F.col("x"), F.col("y"), F.lit(0.25)).alias("v")))


@query("X9_lerp_log", f"WITH {SPLATS_SQL} SELECT gid, {r('exp(0.75 * ln(greatest(exp(s0), 1e-8)) + 0.25 * ln(greatest(exp(s1), 1e-8)))', 'v', 9)} FROM s")
def _(spark, d):
    return tidy(splats(spark, d).select("gid", spaces.lerp_log(F.exp("s0"), F.exp("s1"), F.lit(0.25)).alias("v")), 9)


def slerp_sql(source: str, a: str, b: str, t: str, keep: str = "gid") -> str:
    """Select of w, x, y, z from a source with unit quaternions a_w.. and b_w..."""
    q = ("w", "x", "y", "z")
    dot = " + ".join(f"{a}_{k} * {b}_{k}" for k in q)
    return (
        f"SELECT {keep}, {', '.join(r(f'v{k} / greatest(sqrt(vw*vw + vx*vx + vy*vy + vz*vz), 1e-8)', k) for k in q)} FROM (SELECT *, "
        + ", ".join(f"w0 * {a}_{k} + w1 * {b}_{k} AS v{k}" for k in q)
        + f" FROM (SELECT *, CASE WHEN co > 0.9995 THEN 1 - {t} ELSE sin((1 - {t}) * acos(co)) / (CASE WHEN sin(acos(co)) < 1e-8 THEN 1.0 ELSE sin(acos(co)) END) END AS w0, "
        f"(CASE WHEN co > 0.9995 THEN {t} ELSE sin({t} * acos(co)) / (CASE WHEN sin(acos(co)) < 1e-8 THEN 1.0 ELSE sin(acos(co)) END) END) * (CASE WHEN d < 0 THEN -1.0 ELSE 1.0 END) AS w1 "
        f"FROM (SELECT *, {dot} AS d, least(abs({dot}), 1.0) AS co FROM {source})))"
    )


@query(
    "X10_slerp",
    f"WITH {SPLATS_SQL}, u AS (SELECT gid, qw / {_N} AS a_w, qx / {_N} AS a_x, qy / {_N} AS a_y, qz / {_N} AS a_z, 0.5 AS b_w, 0.5 AS b_x, 0.5 AS b_y, 0.5 AS b_z FROM s) "
    + slerp_sql("u", "a", "b", "0.3"),
)
def _(spark, d):
    q = spaces.unit([F.col(c) for c in ("qw", "qx", "qy", "qz")])
    out = spaces.slerp(q, [F.lit(0.5)] * 4, F.lit(0.3))
    return tidy(splats(spark, d).select("gid", *[c.alias(n) for n, c in zip("wxyz", out)]))


_TIME = "e AS (SELECT event_id, epoch_us(ts) / 1e6 AS t FROM events), b AS (SELECT min(t) AS lo, max(t) AS hi FROM e)"


def _times(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return rows, rows.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))


@query("X11_normalised_time", f"WITH {_TIME} SELECT event_id, {r('CASE WHEN hi = lo THEN 0 ELSE (t - lo) / (hi - lo) END', 'u', 9)}, {r('CASE WHEN hi = lo THEN 0 ELSE (t - lo) / (hi - lo) END * (hi - lo)', 'back', 3)} FROM e, b")
def _(spark, d):
    rows, bounds = _times(spark, d)
    u = spaces.normalised_time(F.col("t"), F.col("lo"), F.col("hi"))
    rows = rows.crossJoin(F.broadcast(bounds))
    back = spaces.denormalised_time(u, F.lit(0.0), F.col("hi") - F.col("lo"))
    return rows.select("event_id", (F.round(u, 9) + 0.0).alias("u"), (F.round(back, 3) + 0.0).alias("back"))


@query("X12_snap_frame", "SELECT event_id, round_even(value * 2, 0) / 2 + 0.0 AS snapped, greatest(least(value, 50.0), 10.0) AS clamped FROM events")
def _(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", (spaces.snap_frame(v, 2) + 0.0).alias("snapped"), spaces.clamp(v, 10.0, 50.0).alias("clamped"))


T = g.Transform((0.5, -1.0, 2.0), (1.2, 1.2, 1.2), (0.5, 0.5, 0.5, 0.5), (0.1, 0.2, 0.3))
U = g.Transform((0.5, -1.0, 2.0), (2.0, 0.5, 1.5), (0.9238795325112867, 0.0, 0.0, 0.3826834323650898), (0.1, 0.2, 0.3))


def _affine_sql(t: g.Transform, p=("x", "y", "z")) -> list[str]:
    local = [f"(({v} - {c}) * {s})" for v, c, s in zip(p, t.centre, t.scale)]
    return [" + ".join(f"({m!r}) * {v}" for m, v in zip(row, local)) + f" + {c} + ({mv})" for row, c, mv in zip(t.matrix, t.centre, t.move)]


@query("X14_transform", f"WITH {SPLATS_SQL} SELECT gid, " + ", ".join(r(e, n) for n, e in zip("xyz", _affine_sql(U))) + " FROM s")
def _(spark, d):
    return tidy(edit.transformed(splats(spark, d), U).select("gid", "x", "y", "z"))


@query("X15_inverse_transform", f"WITH {SPLATS_SQL} SELECT gid, {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')} FROM s")
def _(spark, d):
    there = edit.transformed(splats(spark, d), U)
    back = U.inverse_points([F.col(c) for c in "xyz"])
    return tidy(there.select("gid", *[c.alias(n) for n, c in zip("xyz", back)]))


_Q = ("qw", "qx", "qy", "qz")


@query(
    "X16_quaternion_product",
    f"WITH {SPLATS_SQL} SELECT gid, {r('0.5 * (qw - qx - qy - qz)', 'qw')}, {r('0.5 * (qx + qw + qz - qy)', 'qx')}, {r('0.5 * (qy - qz + qw + qx)', 'qy')}, {r('0.5 * (qz + qy - qx + qw)', 'qz')} FROM s",
)
def _(spark, d):
    return tidy(edit.transformed(splats(spark, d), T).select("gid", *_Q))


@query(
    "X16_quaternion_matrix",
    f"WITH {SPLATS_SQL}, {_A} SELECT gid, {r('1 - 2 * (qy*qy + qz*qz)', 'm00')}, {r('2 * (qx*qy - qw*qz)', 'm01')}, {r('2 * (qx*qz + qw*qy)', 'm02')}, {r('2 * (qy*qz + qw*qx)', 'm21')} FROM a",
)
def _(spark, d):
    m = g.unit_quaternion_matrix([F.col(c) for c in _Q])
    return tidy(edit.activated(splats(spark, d)).select("gid", m[0][0].alias("m00"), m[0][1].alias("m01"), m[0][2].alias("m02"), m[2][1].alias("m21")))


@query("X17_scale_under_transform", f"WITH {SPLATS_SQL} SELECT gid, " + ", ".join(r(f"s{i} + ln(1.2)", f"s{i}") for i in range(3)) + " FROM s")
def _(spark, d):
    return tidy(edit.transformed(splats(spark, d), T).select("gid", "s0", "s1", "s2"))


@query("X18_opacity_scale", f"WITH {SPLATS_SQL}, {_A} SELECT gid, {r('least(opacity * 1.6, 1.0)', 'opacity')} FROM a")
def _(spark, d):
    return tidy(edit.faded(edit.activated(splats(spark, d)), 1.6).select("gid", "opacity"))


_L = clampq("o", "1 - 1e-6", "1e-6")


@query("X20_export_normalise", f"WITH {SPLATS_SQL}, o AS (SELECT gid, s0, CASE WHEN gid % 4 = 0 THEN 0.0 ELSE 1 / (1 + exp(-opacity)) END AS o FROM s) SELECT gid, {r('s0', 's0')}, CASE WHEN o <= 0 THEN -CAST('inf' AS DOUBLE) ELSE round(ln({_L} / (1 - {_L})), 6) END AS opacity FROM o")
def _(spark, d):
    rows = edit.activated(splats(spark, d)).withColumn("opacity", F.when(F.col("gid") % 4 == 0, 0.0).otherwise(F.col("opacity")))
    out = edit.stored(rows).select("gid", (F.round("s0", 6) + 0.0).alias("s0"), "opacity")
    return out.withColumn("opacity", F.when(F.col("opacity") == float("-inf"), F.col("opacity")).otherwise(F.round("opacity", 6)))


@query("X21_brightness", f"WITH {SPLATS_SQL} SELECT gid, {r(f'((c0 * {C0} + 0.5) * 0.7 - 0.5) / {C0}', 'c0')}, {r('shn[1] * 0.7', 'first')}, {r('shn[45] * 0.7', 'last')} FROM s")
def _(spark, d):
    out = edit.coloured(splats(spark, d), edit.Colour(brightness=0.7))
    return tidy(out.select("gid", "c0", F.element_at("shn", 1).alias("first"), F.element_at("shn", 45).alias("last")))


LOOK = edit.Colour(temperature=0.2, tint=-0.1, brightness=1.1, contrast=1.2, saturation=0.8, hue=30.0, fade=0.1)


def _look_sql(look: edit.Colour, shn: int = 0) -> list[str]:
    """Step by step, as nested expressions over display colour; or the same without offsets, over a triple of shn."""
    c = [f"shn[{shn + i}]" for i in range(3)] if shn else [f"(c{i} * {C0} + 0.5)" for i in range(3)]
    half = 0 if shn else 0.5
    gains = (1 + 0.3 * look.temperature, 1 - 0.3 * look.tint, 1 - 0.3 * look.temperature)
    c = [f"({x} * {m!r} * {look.brightness})" for x, m in zip(c, gains)]
    c = [f"(({x} - {half}) * {look.contrast} + {half})" for x in c]
    grey = f"(0.299 * {c[0]} + 0.587 * {c[1]} + 0.114 * {c[2]})"
    c = [f"({grey} + ({x} - {grey}) * {look.saturation})" for x in c]
    co, third, root = math.cos(math.radians(look.hue)), (1 - math.cos(math.radians(look.hue))) / 3, math.sin(math.radians(look.hue)) / math.sqrt(3)
    c = [f"({co!r} * {c[i]} + {third!r} * ({c[0]} + {c[1]} + {c[2]}) + {root!r} * ({c[(i + 2) % 3]} - {c[(i + 1) % 3]}))" for i in range(3)]
    return [f"({x} * (1 - {look.fade}) + {half} * {look.fade})" for x in c]


@query(
    "X22_colour",
    f"WITH {SPLATS_SQL} SELECT gid, " + ", ".join(r(f"({e} - 0.5) / {C0}", f"c{i}") for i, e in enumerate(_look_sql(LOOK))) + ", " + ", ".join(r(e, f"h{i}") for i, e in enumerate(_look_sql(LOOK, 4))) + " FROM s",
)
def _(spark, d):
    out = edit.coloured(splats(spark, d), LOOK)
    return tidy(out.select("gid", "c0", "c1", "c2", *[F.element_at("shn", 4 + i).alias(f"h{i}") for i in range(3)]))


@query(
    "X22_colour_rgb_gamma",
    f"WITH {SPLATS_SQL} SELECT gid, " + ", ".join(r(f"pow(greatest(least(({clampq(f'c{i} * {C0} + 0.5', 1.0, 0.0)} - 0.5) * 1.3 + 0.5, 1.0), 0.0), 1 / 2.2)", f"c{i}") for i in range(3)) + " FROM s",
)
def _(spark, d):
    rows = edit.activated(splats(spark, d).drop("shn"), has_shn=False)
    return tidy(edit.coloured(rows, edit.Colour(contrast=1.3, gamma=2.2), rgb=True).select("gid", "c0", "c1", "c2"))


_LOOKS_SQL = """(VALUES
    ('vibrant', 0.0, 0.0, 1.0, 1.05, 1.3, 1.2, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ('dramatic', 0.0, 0.0, 1.0, 1.3, 1.1, 1.0, 1.0, -0.15, 0.05, 0.0, 0.0, 0.0, 0.0, 0.0),
    ('bright', 0.0, 0.0, 1.2, 1.0, 1.0, 1.0, 0.9, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ('dark', 0.0, 0.0, 0.8, 1.0, 1.0, 1.0, 1.1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ('warm', 0.3, 0.05, 1.0, 1.0, 1.05, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ('cool', -0.3, -0.05, 1.0, 1.0, 1.05, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ('cinematic', 0.0, 0.0, 1.0, 1.15, 0.9, 1.0, 1.0, -0.1, -0.05, 0.08, 0.6, 0.15, 0.1, 0.1),
    ('muted', 0.0, 0.0, 1.0, 0.9, 0.7, 0.8, 1.0, 0.0, 0.0, 0.05, 0.0, 0.0, 0.0, 0.0),
    ('punchy', 0.0, 0.0, 1.0, 1.25, 1.25, 1.15, 1.0, -0.1, 0.1, 0.0, 0.0, 0.0, 0.0, 0.0)
) p(name, temperature, tint, brightness, contrast, saturation, vibrance, gamma, shadows, highlights, fade, shadow_tint_hue, shadow_tint_sat, highlight_tint_hue, highlight_tint_sat)"""
_FACTORS = ("brightness", "contrast", "saturation", "vibrance", "gamma")
_SHIFTS = ("temperature", "tint", "shadows", "highlights", "fade")
_TINTS = ("shadow_tint_hue", "shadow_tint_sat", "highlight_tint_hue", "highlight_tint_sat")
_SETTINGS = (*_FACTORS, *_SHIFTS, *_TINTS)


def _composed(name: str) -> str:
    a, b = f"a.{name}", f"b.{name}"
    return f"{a} * {b}" if name in _FACTORS else f"{a} + {b}" if name in _SHIFTS else f"CASE WHEN {b} <> 0 THEN {b} ELSE {a} END"


@query("X23_compose_colours", f"WITH k AS (SELECT * FROM {_LOOKS_SQL}) SELECT a.name AS first, b.name AS second, " + ", ".join(r(f"CAST({_composed(n)} AS DOUBLE)", n) for n in _SETTINGS) + " FROM k a, k b")
def _(spark, d):
    rows = [(a, b, *[float(getattr(x.then(y), n)) for n in _SETTINGS]) for a, x in edit.PRESETS.items() for b, y in edit.PRESETS.items()]
    return tidy(spark.createDataFrame(rows, "first string, second string, " + ", ".join(f"{n} double" for n in _SETTINGS)))


@query("X24_presets", "SELECT name, " + ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in _SETTINGS) + f" FROM {_LOOKS_SQL}")
def _(spark, d):
    return spark.createDataFrame([(k, *[float(getattr(c, n)) for n in _SETTINGS]) for k, c in edit.PRESETS.items()], "name string, " + ", ".join(f"{n} double" for n in _SETTINGS))


TONED = edit.Colour(exposure=0.25, contrast=1.1, shadows=-0.3, highlights=0.2, vibrance=1.4, saturation=0.9, fade=0.05, shadow_tint_hue=0.5, shadow_tint_sat=0.2)


@query(
    "X22_tone",
    f"WITH {SPLATS_SQL}, e AS (SELECT gid, shn[4] AS h0, shn[5] AS h1, shn[6] AS h2, " + ", ".join(f"((c{i} * {C0} + 0.5) * pow(2, 0.25) - 0.5) * 1.1 + 0.5 AS e{i}" for i in range(3)) + " FROM s), "
    f"l AS (SELECT *, {clampq('0.299 * e0 + 0.587 * e1 + 0.114 * e2', 1.0, 0.0)} AS l FROM e), f AS (SELECT *, 1 - 0.3 * pow(1 - l, 2) + 0.2 * pow(l, 2) AS f, 0.2 * pow(1 - l, 2) AS k FROM l), "
    # Hue 0.5 is cyan, whose luminance is 0.701.
    "t AS (SELECT gid, f, h0, h1, h2, e0 * f - 0.701 * k AS t0, e1 * f + 0.299 * k AS t1, e2 * f + 0.299 * k AS t2 FROM f), "
    "g AS (SELECT *, 0.299 * t0 + 0.587 * t1 + 0.114 * t2 AS g, 0.299 * h0 + 0.587 * h1 + 0.114 * h2 AS hg FROM t) SELECT gid, "
    + ", ".join(r(f"(((g + (t{i} - g) * 0.9 * 1.2) * 0.95 + 0.5 * 0.05) - 0.5) / {C0}", f"c{i}") for i in range(3))
    + ", "
    + ", ".join(r(f"(hg + (h{i} - hg) * 0.9 * 1.2) * 0.95 * pow(2, 0.25) * 1.1 * f", f"h{i}") for i in range(3))
    + " FROM g",
)
def _(spark, d):
    """Exposure, vibrance, shadows, highlights and a tint of the shadows."""
    out = edit.coloured(splats(spark, d), TONED)
    return tidy(out.select("gid", "c0", "c1", "c2", *[F.element_at("shn", 4 + i).alias(f"h{i}") for i in range(3)]))


_Q8 = lambda x, lo, hi: f"CAST(round_even(greatest(least(({x} - ({lo})) / (({hi}) - ({lo})), 1.0), 0.0) * 219, 0) AS INTEGER) + 16"
_Q16 = lambda x, lo, hi: f"CAST(floor(greatest(least(({x} - ({lo})) / (({hi}) - ({lo})), 1.0), 0.0) * 56319) AS INTEGER)"


@query("X25_quantise8", f"WITH {SPLATS_SQL} SELECT gid, {_Q8('c0', -2.0, 4.0)} AS q0, {_Q8('opacity', -6.0, 12.0)} AS qo FROM s")
def _(spark, d):
    return splats(spark, d).select("gid", spaces.quantise8(F.col("c0"), F.lit(-2.0), F.lit(4.0)).alias("q0"), spaces.quantise8(F.col("opacity"), F.lit(-6.0), F.lit(12.0)).alias("qo"))


@query("X26_quantise16", f"WITH {SPLATS_SQL}, q AS (SELECT gid, {_Q16('x', -1.0, 1.0)} AS q FROM s) SELECT gid, q, CAST(greatest(least(q // 256, 219), 0) + 16 AS INTEGER) AS hi, CAST(q % 256 AS INTEGER) AS lo FROM q")
def _(spark, d):
    q = spaces.quantise16(F.col("x"), F.lit(-1.0), F.lit(1.0))
    return splats(spark, d).select("gid", q.alias("q")).select("gid", "q", spaces.high_byte(F.col("q")).alias("hi"), spaces.low_byte(F.col("q")).alias("lo"))


@query("X27_snap_low", f"WITH {SPLATS_SQL}, q AS (SELECT gid, CAST({_Q16('x', -1.0, 1.0)} % 256 AS INTEGER) AS lo FROM s) SELECT gid, CAST(((lo + 3) // 7 * 7) % 256 AS INTEGER) AS k7, CAST(((lo + 32) // 64 * 64) % 256 AS INTEGER) AS k64 FROM q")
def _(spark, d):
    rows = splats(spark, d).select("gid", spaces.low_byte(spaces.quantise16(F.col("x"), F.lit(-1.0), F.lit(1.0))).alias("lo"))
    return rows.select("gid", spaces.snap_low(F.col("lo"), 7).alias("k7"), spaces.snap_low(F.col("lo"), 64).alias("k64"))


@query("X28_dequantise8", f"WITH {SPLATS_SQL} SELECT gid, {r('((' + _Q8('c0', -2.0, 4.0) + ') - 16) / 219.0 * 6.0 - 2.0', 'c0')} FROM s")
def _(spark, d):
    low, high = F.lit(-2.0), F.lit(4.0)
    return tidy(splats(spark, d).select("gid", spaces.dequantise8(spaces.quantise8(F.col("c0"), low, high), low, high).alias("c0")))


@query("X29_dequantise16", f"WITH {SPLATS_SQL} SELECT gid, {r(_Q16('x', -1.0, 1.0) + ' / 56319.0 * 2.0 - 1.0', 'x')} FROM s")
def _(spark, d):
    low, high = F.lit(-1.0), F.lit(1.0)
    q = spaces.quantise16(F.col("x"), low, high)
    return tidy(splats(spark, d).select("gid", spaces.dequantise16(spaces.high_byte(q), spaces.low_byte(q), low, high).alias("x")))


@query("X30_companding", f"WITH {SPLATS_SQL}, {_A} SELECT gid, {r('asin(greatest(least(qw, 0.9999), -0.9999)) / (pi() / 2)', 'v')}, {r('greatest(least(qw, 0.9999), -0.9999)', 'back')} FROM a")
def _(spark, d):
    v = spaces.compand(F.col("qw"))
    return tidy(edit.activated(splats(spark, d)).select("gid", v.alias("v"), spaces.expand(v).alias("back")))


@query("X31_ycbcr", f"WITH {SPLATS_SQL} SELECT gid, {r('0.299*c0 + 0.587*c1 + 0.114*c2', 'luma')}, {r('-0.168736*c0 - 0.331264*c1 + 0.5*c2', 'cb')}, {r('0.299*c0 + 0.587*c1 + 0.114*c2 + 1.402 * (0.5*c0 - 0.418688*c1 - 0.081312*c2)', 'red')} FROM s")
def _(spark, d):
    ycc = spaces.mix(spaces.TO_YCBCR, [F.col(c) for c in ("c0", "c1", "c2")])
    return tidy(splats(spark, d).select("gid", ycc[0].alias("luma"), ycc[1].alias("cb"), spaces.mix(spaces.FROM_YCBCR, ycc)[0].alias("red")))


@query("X32_clip", f"WITH {SPLATS_SQL} SELECT gid, {r('greatest(least(qw, 1.0), -1.0)', 'qw')}, {r('greatest(least(opacity, 12.0), -6.0)', 'opacity')}, {r('greatest(least(c0, 4.0), -2.0)', 'c0')} FROM s")
def _(spark, d):
    c = F.col
    return tidy(splats(spark, d).select("gid", spaces.clamp(c("qw"), *spaces.QUAT_CLIP).alias("qw"), spaces.clamp(c("opacity"), *spaces.OPACITY_CLIP).alias("opacity"), spaces.clamp(c("c0"), *spaces.COLOUR_CLIP).alias("c0")))


def spread_sql(v: str, width: int, step: int) -> str:
    return " + ".join(f"((({v}) >> {i}) & 1) * {1 << (step * i)}" for i in range(width))


def morton_sql(x: str, y: str, z: str) -> str:
    return f"CAST(({spread_sql(x, 10, 3)}) + 2 * ({spread_sql(y, 10, 3)}) + 4 * ({spread_sql(z, 10, 3)}) AS BIGINT)"


@query("X33_morton3", f"SELECT o_orderkey, {morton_sql('o_orderkey % 1024', 'o_custkey % 1024', '(o_orderkey * 7) % 1024')} AS code FROM orders")
def _(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", bits.morton3(k % 1024, c % 1024, (k * 7) % 1024).alias("code"))


@query("X34_morton2", f"SELECT o_orderkey, CAST(({spread_sql('o_orderkey % 65536', 16, 2)}) + 2 * ({spread_sql('(o_custkey * 37) % 65536', 16, 2)}) AS BIGINT) AS code FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", bits.morton2(F.col("o_orderkey") % 65536, (F.col("o_custkey") * 37) % 65536).alias("code"))


@query("X35_composite_code", f"SELECT o_orderkey, ({morton_sql('o_orderkey % 16', 'o_custkey % 16', '3')} << 12) | (o_custkey % 4096) AS code FROM orders")
def _(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", bits.composite(bits.morton3(k % 16, c % 16, F.lit(3)), c % 4096).alias("code"))


@query("X36_atlas_geometry", f"WITH {EVENTS_SQL} SELECT frame, count(*) AS n, CAST(ceil(ceil(sqrt(count(*))) / 2) * 2 AS BIGINT) AS side, CAST(ceil(ceil(sqrt(count(*))) / 2) * 10 AS BIGINT) AS width, CAST(ceil(ceil(sqrt(count(*))) / 2) * 6 AS BIGINT) AS height FROM v GROUP BY frame")
def _(spark, d):
    side = (F.ceil(F.ceil(F.sqrt("n")) / 2) * 2).cast("bigint")
    rows = event_splats(spark, d).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("frame", "n", side.alias("side"), (side * 5).alias("width"), (side * 3).alias("height"))


@query("X38_presence", f"WITH {EVENTS_SQL} SELECT gid, CASE WHEN active THEN 16 ELSE 235 END AS sample, active AS back FROM v")
def _(spark, d):
    rows = event_splats(spark, d).select("gid", F.when(F.col("active"), 16).otherwise(235).alias("sample"))
    back = F.when(F.col("sample") == 16, True).when(F.col("sample") == 235, False).otherwise(F.raise_error(F.lit("presence sample")).cast("boolean"))
    return rows.withColumn("back", back)


@query("X39_byte_codes", "SELECT o_orderkey, ((o_orderkey - o_custkey) % 256 + 256) % 256 AS delta, CASE WHEN o_orderkey < o_custkey THEN 2 * (o_custkey - o_orderkey) - 1 ELSE 2 * (o_orderkey - o_custkey) END AS zigzag, o_orderkey // 256 AS hi, o_orderkey % 256 AS lo FROM orders")
def _(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", bits.delta_byte(k, c).alias("delta"), bits.zigzag(k - c).alias("zigzag"), F.floor(k / 256).alias("hi"), (k % 256).alias("lo"))


@query("X40_rice", "SELECT frame, min_by(k, struct_pack(bits, k)) AS best_k, min(bits) AS bits FROM (SELECT CAST(l_linenumber AS BIGINT) AS frame, k, CAST(sum((CAST(floor(l_quantity * 7) AS BIGINT) >> k) + 1 + k) AS BIGINT) AS bits FROM lineitem, (SELECT CAST(range AS INTEGER) AS k FROM range(9)) GROUP BY 1, 2) GROUP BY frame")
def _(spark, d):
    v = F.floor(F.col("l_quantity") * 7)
    sums = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("bigint").alias("frame")).agg(*[F.sum(bits.rice_bits(v, k)).alias(f"k{k}") for k in range(9)])
    long = sums.select("frame", F.explode(F.array(*[F.struct(F.col(f"k{k}").alias("bits"), F.lit(k).alias("k")) for k in range(9)])).alias("c"))
    return long.groupBy("frame").agg(F.min("c").alias("c")).select("frame", F.col("c.k").alias("best_k"), F.col("c.bits").cast("bigint").alias("bits"))


@query("X41_base_n", "SELECT o_orderkey, (o_orderkey % 6) * 36 + (o_custkey % 6) * 6 + (o_orderkey // 6) % 6 AS packed, o_orderkey % 6 AS a, o_custkey % 6 AS b, (o_orderkey // 6) % 6 AS c FROM orders")
def _(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, d, "orders").select("o_orderkey", bits.pack_base(k % 6, c % 6, F.floor(k / 6) % 6, 6).alias("packed"))
    return rows.select("o_orderkey", "packed", *[x.alias(n) for n, x in zip("abc", bits.unpack_base(F.col("packed"), 6))])


@query("X42_key_flag", "SELECT o_orderkey, o_orderkey % 4 = 0 AS is_key, o_orderkey AS size FROM orders")
def _(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", F.when(k % 4 == 0, k.bitwiseOR(F.lit(bits.KEY_FLAG).cast("bigint"))).otherwise(k).alias("word"))
    return rows.select("o_orderkey", bits.is_key_frame(F.col("word")).alias("is_key"), bits.payload_size(F.col("word")).alias("size"))


@query("X43_legacy_degree", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND (o_custkey % 2 = 0 OR o_orderkey % 5 = 0) THEN 0 ELSE CAST(o_orderkey % 4 AS INTEGER) END AS degree FROM orders")
def _(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    first, flag, offset = k % 3 == 0, c % 2 != 0, k % 5 != 0
    return table(spark, d, "orders").select("o_orderkey", F.when(first & ~(flag & offset), 0).otherwise((k % 4).cast("int")).alias("degree"))


@query("X45_circular_distance", f"WITH {LINES_SQL} SELECT frame, {r('avg(1 - cos(2 * pi() * (floor(x * 9) % 256) / 256))', 'circular')}, {r('avg(abs(y * 4 - round_even(y * 4, 0)))', 'grid')} FROM l GROUP BY frame")
def _(spark, d):
    low = F.floor(F.col("x") * 9) % 256
    return tidy(line_splats(spark, d).groupBy("frame").agg(F.avg(1 - F.cos(2 * math.pi * low / 256)).alias("circular"), F.avg(F.abs(F.col("y") * 4 - F.rint(F.col("y") * 4))).alias("grid")))


_GOLDEN = math.pi * (3 - math.sqrt(5))


@query(
    "X49_orbit_cameras",
    f"WITH {SPLATS_SQL}, b AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)) AS extent FROM s) "
    f"SELECT range AS camera, {r(f'cx + 1.5 * extent * sqrt(1 - pow(1 - 2 * (range + 0.5) / 32, 2)) * cos({_GOLDEN!r} * range)', 'x')}, {r('cy + 1.5 * extent * (1 - 2 * (range + 0.5) / 32)', 'y')}, {r(f'cz + 1.5 * extent * sqrt(1 - pow(1 - 2 * (range + 0.5) / 32, 2)) * sin({_GOLDEN!r} * range)', 'z')} FROM range(32), b",
)
def _(spark, d):
    s = splats(spark, d)
    extent = F.sqrt(sum(((F.max(c) - F.min(c)) * (F.max(c) - F.min(c)) for c in "yz"), (F.max("x") - F.min("x")) * (F.max("x") - F.min("x"))))
    bounds = s.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"), extent.alias("extent"))
    i = F.col("id")
    up = 1 - 2 * (i + 0.5) / 32
    ring = F.sqrt(1 - up * up)
    at = lambda c, u: (F.col(c) + 1.5 * F.col("extent") * u)
    rows = spark.range(32).crossJoin(F.broadcast(bounds))
    return tidy(rows.select(i.alias("camera"), at("cx", ring * F.cos(i * _GOLDEN)).alias("x"), at("cy", up).alias("y"), at("cz", ring * F.sin(i * _GOLDEN)).alias("z")))


@query("X50_sh_layout", f"WITH {SPLATS_SQL} SELECT gid, CAST(len(shn) // 3 AS INTEGER) AS coefficients, CAST(sqrt(len(shn) // 3 + 1) - 1 AS INTEGER) AS degree, CAST(len(shn[1:24]) AS INTEGER) AS kept, {r('shn[24]', 'last')} FROM s")
def _(spark, d):
    n = F.size("shn")
    kept = F.when(n >= 24, F.slice("shn", 1, 24)).otherwise(F.raise_error(F.lit("frame with too few coefficients")).cast("array<double>"))
    rows = splats(spark, d).select("gid", (n / 3).cast("int").alias("coefficients"), (F.sqrt(n / 3 + 1) - 1).cast("int").alias("degree"), kept.alias("kept"))
    return tidy(rows.select("gid", "coefficients", "degree", F.size("kept").alias("kept"), F.element_at("kept", -1).alias("last")))


@query("X51_reshape", f"WITH {SPLATS_SQL} SELECT gid, k AS coefficient, {r('shn[3 * k + 1]', 'red')}, {r('shn[3 * k + 3]', 'blue')} FROM s, (SELECT CAST(range AS INTEGER) AS k FROM range(15))")
def _(spark, d):
    at = lambda c: F.element_at("shn", F.col("coefficient") * 3 + c)
    rows = splats(spark, d).select("gid", "shn", F.explode(F.sequence(F.lit(0), (F.size("shn") / 3 - 1).cast("int"))).alias("coefficient"))
    return tidy(rows.select("gid", "coefficient", at(1).alias("red"), at(3).alias("blue")))


@query("X52_ui_frame", "SELECT event_id, CAST(floor(value / 100 * 11) AS BIGINT) AS continuous, CAST(round_even(value / 100 * 11, 0) AS BIGINT) AS discrete, CAST(round_even(value * 24, 0) AS BIGINT) AS frame_at FROM events")
def _(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.floor(v / 100 * 11).alias("continuous"), F.rint(v / 100 * 11).cast("bigint").alias("discrete"), F.rint(v * 24).cast("bigint").alias("frame_at"))


@query("X54_displacement_proxy", f"WITH {SPLATS_SQL}, {_A}, m AS (SELECT sum(opacity * opacity * (c0*c0 + c1*c1 + c2*c2) * 1e-4 / (2 * greatest(pow(least(s0, s1, s2), 2), 1e-12))) / 262144 AS mse FROM a) SELECT {r('mse', 'mse')}, {r('-10 * log10(greatest(mse, 1e-10))', 'psnr')} FROM m")
def _(spark, d):
    a = edit.activated(splats(spark, d))
    c = [F.col(x) for x in ("c0", "c1", "c2")]
    least = F.least("s0", "s1", "s2")
    error = F.col("opacity") * F.col("opacity") * (c[0] * c[0] + c[1] * c[1] + c[2] * c[2]) * 1e-4 / (2 * F.greatest(least * least, F.lit(1e-12)))
    return tidy(a.agg((F.sum(error) / 262144).alias("mse")).withColumn("psnr", -10 * F.log10(F.greatest("mse", F.lit(1e-10)))))


# Filters

def _filter(name: str, where: str, *shapes, invert: bool = False) -> None:
    @query(name, f"WITH {SPLATS_SQL} SELECT gid, {r('x', 'x')} FROM s WHERE {where}")
    def _(spark, d):
        return tidy(filters.apply(splats(spark, d), *shapes, invert=invert).select("gid", "x"))


_SPHERE = filters.Sphere((0.05, 0.0, -0.05), 0.22)
_SPHERE_SQL = f"pow(x - 0.05, 2) + y * y + pow(z + 0.05, 2) <= {0.22**2!r}"
_TURN = (0.0, 0.0, math.pi / 6)
_CO, _SI = math.cos(math.pi / 6), math.sin(math.pi / 6)
_LX, _LY = f"({_CO!r} * x + {_SI!r} * y)", f"(-{_SI!r} * x + {_CO!r} * y)"
_filter("F1_opacity_range", "opacity BETWEEN -1 AND 2", filters.opacity_range(-1.0, 2.0))
_filter("F2_scale_range", "greatest(s0, s1, s2) <= -4.8", filters.scale_range(high=-4.8))
_filter("F3_sphere", _SPHERE_SQL, _SPHERE)
_filter("F4_box", "x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.2 AND 0.1 AND z BETWEEN -0.1 AND 0.3", filters.Box((-0.1, -0.2, -0.1), (0.1, 0.1, 0.3)))
_filter("F4_box_turned", f"abs({_LX}) <= 0.1 AND abs({_LY}) <= 0.2 AND abs(z) <= 0.15", filters.Box((-0.1, -0.2, -0.15), (0.1, 0.2, 0.15), _TURN))
_filter("F5_ellipsoid", f"pow({_LX} / 0.3, 2) + pow({_LY} / 0.1, 2) + pow(z / 0.2, 2) <= 1", filters.Ellipsoid((0.0, 0.0, 0.0), (0.3, 0.1, 0.2), _TURN))
_filter("F6_frustum", f"0.5 - z BETWEEN 0.2 AND 0.6 AND abs(y) <= (0.5 - z) * {math.tan(0.2)!r} AND abs(x) <= (0.5 - z) * {math.tan(0.2) * 1.5!r}", filters.Frustum((0.0, 0.0, 0.5), fov=0.4, aspect=1.5, near=0.2, far=0.6))
_filter("F7_invert", f"NOT ({_SPHERE_SQL} AND opacity >= 0)", _SPHERE, filters.opacity_range(low=0.0), invert=True)
_filter("F8_conjunction", f"{_SPHERE_SQL} AND opacity >= -1 AND greatest(s0, s1, s2) <= -4.7", _SPHERE, filters.opacity_range(low=-1.0), filters.scale_range(high=-4.7), filters.Sphere())
_filter("F20_visible_proxy", "opacity >= -3", filters.opacity_range(low=-3.0))


@query("F11_world_sphere", f"WITH {SPLATS_SQL} SELECT gid FROM s WHERE pow({_affine_sql(U)[0]} - 0.4, 2) + pow({_affine_sql(U)[1]} + 0.9, 2) + pow({_affine_sql(U)[2]} - 1.9, 2) <= 0.16")
def _(spark, d):
    """A filter on transformed positions, rewritten to one on stored ones."""
    return filters.apply(splats(spark, d), filters.to_local(filters.Sphere((0.4, -0.9, 1.9), 0.4), U)).select("gid")


@query("F11_world_box", f"WITH {SPLATS_SQL} SELECT gid FROM s WHERE ({_affine_sql(T)[0]}) BETWEEN 0.4 AND 0.9 AND ({_affine_sql(T)[1]}) BETWEEN -1.2 AND -0.6 AND ({_affine_sql(T)[2]}) BETWEEN 2.0 AND 2.6")
def _(spark, d):
    return filters.apply(splats(spark, d), filters.to_local(filters.Box((0.4, -1.2, 2.0), (0.9, -0.6, 2.6)), T)).select("gid")


@query("F12_active", f"WITH {TRACKS_SQL} SELECT frame, count(*) AS n FROM t WHERE active GROUP BY frame")
def _(spark, d):
    return filters.active_only(tracks(spark, d)).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))


@query("F13_finite", f"WITH {TRACKS_SQL} SELECT frame, {r('sum(x)', 'total')} FROM t GROUP BY frame")
def _(spark, d):
    return tidy(filters.require_finite(tracks(spark, d), ("x", "y", "z")).groupBy("frame").agg(F.sum("x").alias("total")))


@query("F14_sanitise", f"WITH {TRACKS_SQL} SELECT gid, frame, {r('CASE WHEN active THEN x ELSE 0 END', 'x')}, {r('CASE WHEN active THEN qw ELSE 1 END', 'qw')} FROM t")
def _(spark, d):
    return tidy(filters.sanitised(tracks(spark, d), ("x", "qw")).select("gid", "frame", "x", "qw"))


@query("F15_lifetime_prune", f"WITH {EVENTS_SQL} SELECT CAST(y AS BIGINT) AS owner, count(*) AS n FROM v WHERE y IN (SELECT y FROM v WHERE active) GROUP BY y")
def _(spark, d):
    rows = event_splats(spark, d).select(F.col("y").cast("bigint").alias("gid"), "active")
    return filters.ever_active(rows).groupBy(F.col("gid").alias("owner")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "F16_lossy_prune",
    f"WITH {TRACKS_SQL}, f AS (SELECT gid, max(1 / (1 + exp(-opacity))) AS a, max(exp(greatest(s0, s1, s2))) AS sc, max(exp(s0 + s1 + s2)) AS vol FROM t WHERE active GROUP BY gid), "
    "c AS (SELECT quantile_cont(a * vol, 0.005) AS cut FROM f) SELECT gid, count(*) AS n FROM t WHERE gid IN (SELECT gid FROM f, c WHERE a >= 0.1 AND sc >= 1e-3 AND a * vol >= cut) GROUP BY gid",
)
def _(spark, d):
    return filters.pruned(tracks(spark, d)).groupBy("gid").agg(F.count(F.lit(1)).alias("n"))


# The edit chain

def flagship(spark, d):
    """At frame 3, splats in a sphere with an opacity of 0.1 or more, scaled, moved, dimmed: position, colour, opacity."""
    whole = edit.Edit((_SPHERE, filters.opacity_range(low=0.1)), transform=T, colour=edit.Colour(brightness=0.7), opacity=0.6)
    return tidy(edit.Scene(splats(spark, d)).at(3).activate().edit(whole).splats.select("gid", "x", "y", "z", "s0", "c0", "opacity"))


query(
    "Q1_edit_chain",
    f"WITH {SPLATS_SQL}, {_A} SELECT gid, " + ", ".join(r(e, n) for n, e in zip("xyz", _affine_sql(T))) + f", {r('s0 * 1.2', 's0')}, {r(f'((c0 * {C0} + 0.5) * 0.7 - 0.5) / {C0}', 'c0')}, {r('least(opacity * 0.6, 1.0)', 'opacity')} FROM a WHERE frame = 3 AND {_SPHERE_SQL} AND opacity >= 0.1",
)(flagship)


@query("S15_frame_to_chunk", f"WITH {TRACKS_SQL}, {CHUNKS_SQL} SELECT gid, frame, chunk_id FROM t JOIN k ON frame BETWEEN start_frame AND end_frame")
def _(spark, d):
    # Chunks are at most one a frame: the table is bounded by the length of a scene, and is checked before it is broadcast.
    k = chunks(spark)
    k = F.broadcast(k) if k.count() <= 100_000 else k
    return tracks(spark, d).join(k, F.col("frame").between(F.col("start_frame"), F.col("end_frame"))).select("gid", "frame", "chunk_id")

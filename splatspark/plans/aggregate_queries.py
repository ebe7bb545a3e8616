"""Queries of aggregates, keyed by their inventory number."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import spaces
from ..operators import bounds
from .registry import query, r, tidy
from .scalar_queries import C0, _A, _N
from .views import EVENTS_SQL, LINES_SQL, SPLATS_SQL, TRACKS_SQL, event_splats, line_splats, splats, table, tracks


def _box_sql(a: str, digits: int = 6) -> str:
    lo, hi = f"(l{a} - 0.1 * (h{a} - l{a}))", f"(h{a} + 0.1 * (h{a} - l{a}))"
    return ", ".join(r(e, f"{n}_{a}", digits) for e, n in ((lo, "min"), (hi, "max"), (f"({lo} + {hi}) / 2", "centre"), (f"{hi} - {lo}", "size")))


_PCT = ", ".join(f"quantile_cont({a}, 0.05) AS l{a}, quantile_cont({a}, 0.95) AS h{a}" for a in "xyz")


@query("A1_scene_bounds", f"WITH {LINES_SQL}, p AS (SELECT {_PCT} FROM l) SELECT {', '.join(map(_box_sql, 'xyz'))} FROM p")
def _(spark, d):
    return tidy(bounds.scene_bounds(line_splats(spark, d)))


@query("A1_scene_bounds_by_frame", f"WITH {LINES_SQL}, p AS (SELECT frame, {_PCT} FROM l GROUP BY frame) SELECT frame, {', '.join(_box_sql(a, 4) for a in 'xyz')} FROM p")
def _(spark, d):
    return tidy(bounds.scene_bounds(line_splats(spark, d), by=("frame",)), 4)


@query("A2_bounding_sphere", f"WITH {LINES_SQL}, c AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM l) SELECT {r('min(cx)', 'centre_x')}, {r('min(cy)', 'centre_y')}, {r('min(cz)', 'centre_z')}, {r('quantile_cont(sqrt(pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2)), 0.95) * 1.1', 'radius')} FROM l, c")
def _(spark, d):
    return tidy(bounds.bounding_sphere(line_splats(spark, d)))


@query("A3_layer_bounds", f"WITH {LINES_SQL} SELECT frame, " + ", ".join(f"{r(f'min({a})', f'min_{a}')}, {r(f'max({a})', f'max_{a}')}" for a in "xyz") + f", {r('sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)) / 2', 'radius')} FROM l GROUP BY frame")
def _(spark, d):
    return tidy(bounds.layer_bounds(line_splats(spark, d), "frame"))


@query("A4_centroid", f"WITH {LINES_SQL} SELECT {r('avg(x) FILTER (WHERE z <= 5)', 'x')}, {r('avg(y) FILTER (WHERE z <= 5)', 'y')}, {r('avg(z) FILTER (WHERE z <= 5)', 'z')}, count(*) FILTER (WHERE z <= 5) AS kept, count(*) AS total, {r('100.0 * count(*) FILTER (WHERE z <= 5) / count(*)', 'percent')} FROM l")
def _(spark, d):
    return tidy(bounds.centroid(line_splats(spark, d), F.col("z") <= 5))


@query("A5_max_scale", f"WITH {SPLATS_SQL} SELECT {r('quantile_cont(v, 0.995)', 'max_scale', 9)} FROM (SELECT unnest([exp(s0), exp(s1), exp(s2)]) AS v FROM s WHERE frame = (SELECT min(frame) FROM s))")
def _(spark, d):
    return tidy(bounds.recommended_max_scale(splats(spark, d)), 9)


_LOG = lambda a: f"sign({a}) * ln(1 + abs({a}))"
_ASIN = lambda q: f"asin(greatest(least({q}, 0.9999), -0.9999)) / (pi() / 2)"
_RANGE = {**{a: _LOG(a) for a in "xyz"}, **{c: c for c in ("s0", "s1", "s2")}, **{q: _ASIN(q) for q in ("qw", "qx", "qy", "qz")}, "opacity": "greatest(least(opacity, 12.0), -6.0)", **{c: f"greatest(least({c}, 4.0), -4.0)" for c in ("c0", "c1", "c2")}}


@query("A6_ranges", f"WITH {TRACKS_SQL} SELECT " + ", ".join(f"{r(f'min({e})', f'min_{c}')}, {r(f'max({e})', f'max_{c}')}" for c, e in _RANGE.items()) + " FROM t WHERE active")
def _(spark, d):
    return tidy(bounds.ranges(tracks(spark, d)))


@query(
    "A7_auto_step",
    f"WITH {TRACKS_SQL}, e AS (SELECT greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS extent FROM t WHERE active), "
    "m AS (SELECT quantile_disc(v, 0.5) AS median FROM (SELECT unnest([exp(s0), exp(s1), exp(s2)]) AS v FROM t WHERE active AND frame < 5)), "
    "w AS (SELECT median, extent, greatest(least(round_even(0.2 * 56319 * median / extent, 0), 127.0), 3.0) AS wanted FROM m, e) "
    f"SELECT {r('median', 'median')}, {r('extent', 'extent')}, CAST(wanted AS INTEGER) AS wanted, (SELECT min(struct_pack(d := abs(k - wanted), k := k)).k FROM (SELECT unnest({list(bounds.SAFE_STEPS)}) AS k)) AS step FROM w",
)
def _(spark, d):
    return tidy(bounds.auto_step(tracks(spark, d)))


@query("A8_lifetime_max", f"WITH {TRACKS_SQL} SELECT gid, {r('max(opacity)', 'opacity')}, {r('max(exp(s0))', 'scale')}, {r('max(exp(s0 + s1 + s2))', 'volume', 9)} FROM t WHERE active GROUP BY gid")
def _(spark, d):
    rows = tracks(spark, d).where("active").groupBy("gid").agg(F.max("opacity").alias("opacity"), F.max(F.exp("s0")).alias("scale"), F.round(F.max(F.exp(F.col("s0") + F.col("s1") + F.col("s2"))), 9).alias("volume"))
    return rows.select("gid", (F.round("opacity", 6) + 0.0).alias("opacity"), F.round("scale", 6).alias("scale"), "volume")


@query("A9_ever_active", f"WITH {EVENTS_SQL} SELECT CAST(y AS BIGINT) AS owner, bool_or(active) AS alive FROM v GROUP BY y")
def _(spark, d):
    return event_splats(spark, d).groupBy(F.col("y").cast("bigint").alias("owner")).agg(F.bool_or("active").alias("alive"))


@query("A10_distinct_low", f"WITH {LINES_SQL} SELECT frame, count(DISTINCT CAST(floor(y * 100) AS BIGINT) % 256) AS low_bytes FROM l GROUP BY frame")
def _(spark, d):
    return line_splats(spark, d).groupBy("frame").agg(F.count_distinct(F.floor(F.col("y") * 100) % 256).alias("low_bytes"))


@query("A11_frame_counts", f"WITH {LINES_SQL}, c AS (SELECT frame, count(*) AS n FROM l GROUP BY frame) SELECT count(DISTINCT n) AS sizes, min(n) AS least, max(n) AS most, (max(n) + 3) // 4 * 4 AS target FROM c")
def _(spark, d):
    n = line_splats(spark, d).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count_distinct("n").alias("sizes"), F.min("n").alias("least"), F.max("n").alias("most"), (F.floor((F.max("n") + 3) / 4) * 4).alias("target"))


@query(
    "A12_stability",
    f"WITH {TRACKS_SQL}, z AS (SELECT gid, x AS x0, y AS y0 FROM t WHERE frame = 0 AND active), m AS (SELECT max(greatest(abs(x0), abs(y0))) AS most FROM z), "
    f"d AS (SELECT frame, avg((abs(x - x0) + abs(y - y0)) / 2) AS diff FROM t JOIN z USING (gid) WHERE active AND frame > 0 GROUP BY frame) SELECT {r('max(diff)', 'worst')}, bool_and(diff < 0.01 * most) AS stable FROM d, m",
)
def _(spark, d):
    t = tracks(spark, d).where("active")
    first = t.where("frame = 0").select("gid", F.col("x").alias("x0"), F.col("y").alias("y0"))
    most = first.agg(F.max(F.greatest(F.abs("x0"), F.abs("y0"))).alias("most"))
    diff = t.where("frame > 0").join(first, "gid").groupBy("frame").agg(F.avg((F.abs(F.col("x") - F.col("x0")) + F.abs(F.col("y") - F.col("y0"))) / 2).alias("diff"))
    return tidy(diff.crossJoin(F.broadcast(most)).agg(F.max("diff").alias("worst"), F.bool_and(F.col("diff") < 0.01 * F.col("most")).alias("stable")))


@query("A13_block_centroids", f"WITH {LINES_SQL} SELECT CAST(floor(x / 10) AS BIGINT) AS bx, CAST(floor(y / 20) AS BIGINT) AS by, {r('avg(x)', 'x')}, {r('avg(y)', 'y')}, {r('avg(z)', 'z')}, count(*) AS n, count(*) > 500 AS over FROM l GROUP BY 1, 2")
def _(spark, d):
    """Centroids of blocks, counts against a capacity."""
    block = [F.floor(F.col("x") / 10).alias("bx"), F.floor(F.col("y") / 20).alias("by")]
    n = F.count(F.lit(1))
    return tidy(line_splats(spark, d).groupBy(*block).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), n.alias("n"), (n > 500).alias("over")))


@query("A19_psnr", f"WITH {SPLATS_SQL}, e AS (SELECT frame, avg(pow(c0 - round_even(c0 * 8, 0) / 8, 2)) AS mse FROM s GROUP BY frame) SELECT frame, {r('CASE WHEN mse <= 0 THEN 99.0 ELSE -10 * log10(mse) END', 'psnr')} FROM e")
def _(spark, d):
    diff = F.col("c0") - F.rint(F.col("c0") * 8) / 8
    return tidy(splats(spark, d).groupBy("frame").agg(bounds.psnr(F.avg(diff * diff)).alias("psnr")))


@query(
    "A20_distribution",
    f"WITH {LINES_SQL}, v AS (SELECT unnest([struct_pack(channel := 'x', value := x), struct_pack(channel := 'y', value := y), struct_pack(channel := 'z', value := z)]) AS p FROM l) "
    f"SELECT p.channel AS channel, {r('min(p.value)', 'least')}, {r('max(p.value)', 'most')}, {r('avg(p.value)', 'mean')}, {r('stddev_pop(p.value)', 'deviation')}, {r('quantile_cont(p.value, 0.01)', 'p1')}, {r('quantile_cont(p.value, 0.5)', 'p50')}, {r('quantile_cont(p.value, 0.99)', 'p99')}, "
    f"{r('1 - (quantile_cont(p.value, 0.999) - quantile_cont(p.value, 0.001)) / (max(p.value) - min(p.value))', 'waste')} FROM v GROUP BY 1",
)
def _(spark, d):
    """Report per channel with the share of the range that is hardly used."""
    return tidy(bounds.distribution(line_splats(spark, d), ("x", "y", "z")))


@query("A22_worst_frames", f"WITH {LINES_SQL}, f AS (SELECT frame, min(y) AS lo, max(y) AS hi FROM l GROUP BY frame) SELECT {r('min(lo)', 'lo')}, {r('max(hi)', 'hi')}, (SELECT max(frame) FROM f WHERE lo = (SELECT min(lo) FROM f)) AS lo_frame, (SELECT max(frame) FROM f WHERE hi = (SELECT max(hi) FROM f)) AS hi_frame FROM f")
def _(spark, d):
    f = line_splats(spark, d).groupBy("frame").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    low = F.min_by("frame", F.struct("lo", -F.col("frame")))
    return tidy(f.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), low.alias("lo_frame"), F.max_by("frame", F.struct("hi", "frame")).alias("hi_frame")))


@query(
    "A23_chunk_residual",
    f"WITH {TRACKS_SQL}, m AS (SELECT frame // 4 AS chunk_id, abs(x - avg(x) OVER (PARTITION BY frame // 4, gid)) AS d FROM t), w AS (SELECT chunk_id, max(d) AS most FROM m GROUP BY 1) "
    f"SELECT CAST(m.chunk_id AS INTEGER) AS chunk_id, {r('avg(d)', 'mean')}, {r('max(d)', 'most')}, {r('100.0 * count(*) FILTER (WHERE d > most / 2 + 1e-9) / count(*)', 'over_half')} FROM m JOIN w USING (chunk_id) GROUP BY 1",
)
def _(spark, d):
    w = W.partitionBy("chunk_id", "gid")
    t = tracks(spark, d).withColumn("chunk_id", F.floor(F.col("frame") / 4).cast("int"))
    m = t.select("chunk_id", F.abs(F.col("x") - F.avg("x").over(w)).alias("d"))
    most = m.groupBy("chunk_id").agg(F.max("d").alias("limit"))
    return tidy(m.join(most, "chunk_id").groupBy("chunk_id").agg(F.avg("d").alias("mean"), F.max("d").alias("most"), (100.0 * F.count_if(F.col("d") > F.col("limit") / 2 + 1e-9) / F.count(F.lit(1))).alias("over_half")))


@query("A24_frame_difference", f"WITH {TRACKS_SQL}, d AS (SELECT frame, abs(x - lag(x) OVER (PARTITION BY gid ORDER BY frame)) AS d FROM t) SELECT frame, {r('avg(d)', 'mean')}, {r('max(d)', 'most')}, {r('quantile_cont(d, 0.99)', 'p99')}, {r('100.0 * count(*) FILTER (WHERE d > 0.01) / count(*)', 'moved')} FROM d WHERE d IS NOT NULL GROUP BY frame")
def _(spark, d):
    step = F.abs(F.col("x") - F.lag("x").over(W.partitionBy("gid").orderBy("frame")))
    rows = tracks(spark, d).select("frame", step.alias("d")).where("d is not null")
    return tidy(rows.groupBy("frame").agg(F.avg("d").alias("mean"), F.max("d").alias("most"), F.percentile("d", 0.99).alias("p99"), (100.0 * F.count_if(F.col("d") > 0.01) / F.count(F.lit(1))).alias("moved")))


@query(
    "A25_error_by_visibility",
    f"WITH {SPLATS_SQL}, e AS (SELECT CASE WHEN opacity >= -3 THEN 'visible' ELSE 'invisible' END AS kind, abs(c0 - round_even(c0 * 8, 0) / 8) AS e FROM s) "
    f"SELECT coalesce(kind, 'all') AS kind, count(*) AS n, {r('quantile_cont(e, 0.5)', 'p50')}, {r('quantile_cont(e, 0.99)', 'p99')}, {r('100.0 * count(*) FILTER (WHERE e > 0.05) / count(*)', 'over')} FROM e GROUP BY ROLLUP (kind)",
)
def _(spark, d):
    kind = F.when(F.col("opacity") >= -3, "visible").otherwise("invisible")
    e = splats(spark, d).select(kind.alias("kind"), F.abs(F.col("c0") - F.rint(F.col("c0") * 8) / 8).alias("e"))
    rows = e.rollup("kind").agg(F.count(F.lit(1)).alias("n"), (100.0 * F.count_if(F.col("e") > 0.05) / F.count(F.lit(1))).alias("over")).withColumn("kind", F.coalesce("kind", F.lit("all")))
    ends = bounds.overall(e, {k: F.when(F.lit(k == "all") | (F.col("kind") == k), F.col("e")) for k in ("visible", "invisible", "all")}, (0.5, 0.99))
    ends = ends.select(F.col("channel").alias("kind"), *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("p50", "p99"))])
    return tidy(rows.join(F.broadcast(ends), "kind").select("kind", "n", "p50", "p99", "over"))


@query("A26_entropy", f"WITH {LINES_SQL}, c AS (SELECT frame, CAST(floor(y * 100) AS BIGINT) % 256 AS b, count(*) AS n FROM l GROUP BY 1, 2), t AS (SELECT frame, b, n, sum(n) OVER (PARTITION BY frame) AS total FROM c) SELECT frame, {r('-sum(n / total * log2(n / total))', 'bits')}, count(*) AS \"values\" FROM t GROUP BY frame")
def _(spark, d):
    return tidy(bounds.entropy(line_splats(spark, d), F.floor(F.col("y") * 100) % 256, "frame"))


@query("A27_snap_rate", f"WITH {LINES_SQL}, b AS (SELECT frame, CAST(floor(y * 100) AS BIGINT) % 256 AS b FROM l) SELECT frame, {r('avg(CASE WHEN b <= 2 OR b >= 254 THEN 1.0 ELSE 0.0 END)', 'rate')} FROM b GROUP BY frame")
def _(spark, d):
    b = F.floor(F.col("y") * 100) % 256
    return tidy(line_splats(spark, d).groupBy("frame").agg(F.avg(((b <= 2) | (b >= 254)).cast("double")).alias("rate")))


_RGB = [f"greatest(least(c{i} * {C0} + 0.5, 1.0), 0.0)" for i in range(3)]


def _balance_sql(source: str) -> str:
    grey = "((r + g + b) / 3)"
    gr, gg, gb = (f"({grey} / ({c} + 1e-6))" for c in "rgb")
    return f"SELECT greatest(least(({gr} - {gb}) / 0.6, 1.0), -1.0) AS temperature, greatest(least((1 - {gg}) / 0.3, 1.0), -1.0) AS tint FROM {source}"


_EXPOSURE = f"(SELECT greatest(least(0.45 / (avg(v) + 1e-6), 3.0), 0.3) FROM (SELECT unnest([{', '.join(_RGB)}]) AS v FROM s))"
_CONTRAST = f"(SELECT greatest(least(0.9 / (quantile_cont(v, 0.999) - quantile_cont(v, 0.001) + 1e-6), 3.0), 0.5) FROM (SELECT unnest([{', '.join(_RGB)}]) AS v FROM s))"
_MEANS = f"(SELECT avg({_RGB[0]}) AS r, avg({_RGB[1]}) AS g, avg({_RGB[2]}) AS b FROM s)"


@query("A29_auto_exposure", f"WITH {SPLATS_SQL} SELECT {r(_EXPOSURE, 'brightness')}")
def _(spark, d):
    return tidy(bounds.auto_exposure(splats(spark, d)))


@query("A30_auto_contrast", f"WITH {SPLATS_SQL} SELECT {r(_CONTRAST, 'contrast')}")
def _(spark, d):
    return tidy(bounds.auto_contrast(splats(spark, d)))


@query("A31_white_balance", f"WITH {SPLATS_SQL} SELECT {r('temperature', 'temperature')}, {r('tint', 'tint')} FROM ({_balance_sql(_MEANS)})")
def _(spark, d):
    return tidy(bounds.white_balance(splats(spark, d)))


@query(
    "A32_white_patch",
    f"WITH {SPLATS_SQL}, c AS (SELECT gid, {_RGB[0]} AS r, {_RGB[1]} AS g, {_RGB[2]} AS b FROM s), k AS (SELECT *, row_number() OVER (ORDER BY r + g + b DESC, gid) AS n FROM c), "
    f"p AS (SELECT avg(r) AS r, avg(g) AS g, avg(b) AS b FROM k WHERE n <= (SELECT greatest(1, CAST(floor(0.01 * count(*)) AS BIGINT)) FROM s)) SELECT {r('temperature', 'temperature')}, {r('tint', 'tint')} FROM ({_balance_sql('p')})",
)
def _(spark, d):
    return tidy(bounds.white_patch(splats(spark, d)))


@query("A33_auto_enhance", f"WITH {SPLATS_SQL} SELECT {r(f'1 + 0.5 * ({_EXPOSURE} - 1)', 'brightness')}, {r(f'1 + 0.5 * ({_CONTRAST} - 1)', 'contrast')}, {r('temperature * 0.25', 'temperature')}, {r('tint * 0.5', 'tint')} FROM ({_balance_sql(_MEANS)})")
def _(spark, d):
    return tidy(bounds.auto_enhance(splats(spark, d)))


@query("A34_histogram", f"WITH {SPLATS_SQL} SELECT CAST(least(floor({_RGB[0]} * 64), 63) AS BIGINT) AS bin, count(*) AS n FROM s GROUP BY 1")
def _(spark, d):
    red = spaces.clamp(spaces.sh_to_rgb(F.col("c0")), 0.0, 1.0)
    return splats(spark, d).groupBy(F.least(F.floor(red * 64), F.lit(63)).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("A36_decode_budget", f"WITH {LINES_SQL}, c AS (SELECT frame, count(*) AS n FROM l GROUP BY frame) SELECT count(*) AS frames, max(n) AS most, count(*) * max(n) * 256 AS bytes, count(*) * max(n) * 256 <= 8589934592 AND count(*) <= 10000 AND max(n) <= 5000000 AS fits FROM c")
def _(spark, d):
    c = line_splats(spark, d).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))
    row = c.agg(F.count(F.lit(1)).alias("frames"), F.max("n").alias("most")).withColumn("bytes", F.col("frames") * F.col("most") * 256)
    return row.withColumn("fits", (F.col("bytes") <= 8589934592) & (F.col("frames") <= 10000) & (F.col("most") <= 5_000_000))


@query("A37_health", "SELECT user_id, max(CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) AS severity FROM events GROUP BY user_id")
def _(spark, d):
    level = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    return table(spark, d, "events").groupBy("user_id").agg(F.max(level).alias("severity"))


@query("A40_scene_centroid", f"WITH {LINES_SQL} SELECT {r('avg(x)', 'x')}, {r('avg(y)', 'y')}, {r('avg(z)', 'z')} FROM l")
def _(spark, d):
    return tidy(line_splats(spark, d).agg(*[F.avg(a).alias(a) for a in "xyz"]))


@query("A42_size_breakdown", f"SELECT event_type AS section, CAST(sum(length(props)) AS BIGINT) AS bytes, {r('100.0 * sum(length(props)) / sum(sum(length(props))) OVER ()', 'percent')} FROM events GROUP BY event_type")
def _(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("section")).agg(F.sum(F.length("props")).cast("bigint").alias("bytes"))
    total = rows.agg(F.sum("bytes").alias("total"))
    return tidy(rows.crossJoin(F.broadcast(total)).select("section", "bytes", (100.0 * F.col("bytes") / F.col("total")).alias("percent")))


@query("S30_folder_stats", "SELECT regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, count(*) AS files, CAST(sum(length(html)) AS BIGINT) AS size FROM pages GROUP BY 1")
def _(spark, d):
    return table(spark, d, "pages").groupBy(F.regexp_extract("url", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.char_length("html")).cast("bigint").alias("size"))

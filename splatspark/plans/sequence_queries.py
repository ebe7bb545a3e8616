"""Queries of time, joins, windows, orders and layers, keyed by their inventory number."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bits, spaces
from ..operators import edit, layers, matching, sequences, timeline
from .registry import query, r, tidy
from .scalar_queries import _N, _Q8, _Q16, morton_sql, slerp_sql
from .views import CHUNKS_SQL, EVENTS_SQL, LINES_SQL, SPLATS_SQL, TRACKS_SQL, chunks, event_splats, line_splats, splats, table, tracks

# Interpolation: tracks with frames of their own values


def _moving(spark, d):
    """Working values that change from frame to frame in every attribute."""
    f = F.col("frame")
    rows = edit.activated(tracks(spark, d)).drop("active")
    turn = spaces.unit([F.col("qw") + f, F.col("qx"), F.col("qy") - 0.5 * f, F.col("qz")])
    return rows.withColumns({"s0": F.col("s0") * (1 + f), "opacity": F.col("opacity") / (1 + f), "c0": F.col("c0") + f, **dict(zip(("qw", "qx", "qy", "qz"), turn))})


_M = "greatest(sqrt(pow(qw / n + frame, 2) + pow(qx / n, 2) + pow(qy / n - 0.5 * frame, 2) + pow(qz / n, 2)), 1e-8)"
_MOVING = (
    f"{TRACKS_SQL}, n AS (SELECT *, {_N} AS n FROM t), m AS (SELECT gid, frame, x, exp(s0) * (1 + frame) AS s0, 1 / (1 + exp(-opacity)) / (1 + frame) AS opacity, c0 + frame AS c0, "
    f"(qw / n + frame) / {_M} AS w, qx / n / {_M} AS qx, (qy / n - 0.5 * frame) / {_M} AS qy, qz / n / {_M} AS qz FROM n), "
    "p AS (SELECT a.gid, a.x AS xa, b.x AS xb, a.s0 AS sa, b.s0 AS sb, a.opacity AS oa, b.opacity AS ob, a.c0 AS ca, b.c0 AS cb, a.w AS a_w, a.qx AS a_x, a.qy AS a_y, a.qz AS a_z, b.w AS b_w, b.qx AS b_x, b.qy AS b_y, b.qz AS b_z FROM m a JOIN m b ON a.gid = b.gid AND a.frame = 2 AND b.frame = 7)"
)


@query(
    "J1_interpolate",
    f"WITH {_MOVING}, lerped AS (SELECT gid, {r('0.7 * xa + 0.3 * xb', 'px')}, {r('exp(0.7 * ln(greatest(sa, 1e-8)) + 0.3 * ln(greatest(sb, 1e-8)))', 's0')}, {r('0.7 * oa + 0.3 * ob', 'opacity')}, {r('0.7 * ca + 0.3 * cb', 'c0')} FROM p), q AS ({slerp_sql('p', 'a', 'b', '0.3')}) SELECT * FROM lerped JOIN q USING (gid)",
)
def _(spark, d):
    out = timeline.interpolated(_moving(spark, d), 2, 7, 0.3)
    return tidy(out.select("gid", F.col("x").alias("px"), "s0", "opacity", "c0", F.col("qw").alias("w"), F.col("qx").alias("x"), F.col("qy").alias("y"), F.col("qz").alias("z")))


@query("J2_nearest_method", f"WITH {TRACKS_SQL} SELECT gid, {r('x', 'x')} FROM t WHERE frame = 7")
def _(spark, d):
    return tidy(timeline.interpolated(tracks(spark, d), 2, 7, 0.6, method="nearest").select("gid", "x"))


_KEYS = "k AS (SELECT event_id AS key, epoch_us(ts) / 1e6 AS kt FROM events WHERE event_type = 'purchase'), e AS (SELECT event_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type <> 'purchase')"


def _keys(spark, d):
    e = table(spark, d, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "event_type")
    return e.where("event_type <> 'purchase'").select("event_id", "t"), e.where("event_type = 'purchase'").select(F.col("event_id").alias("key"), F.col("t").alias("kt"))


_SURROUND = (
    f"WITH {_KEYS}, b AS (SELECT event_id, t, key AS kb, kt AS tb FROM e ASOF LEFT JOIN k ON t >= kt), a AS (SELECT event_id, key AS ka, kt AS ta FROM e ASOF LEFT JOIN k ON t <= kt), "
    "j AS (SELECT event_id, t, coalesce(kb, ka) AS kb, coalesce(tb, ta) AS tb, coalesce(ka, kb) AS ka, coalesce(ta, tb) AS ta FROM b JOIN a USING (event_id)), "
    "s AS (SELECT event_id, kb AS key_before, CASE WHEN t = tb THEN kb ELSE ka END AS key_after, CASE WHEN ta = tb THEN 0.0 ELSE greatest(0.0, (t - tb) / (ta - tb)) END AS share FROM j)"
)


@query("J3_surrounding_keys", _SURROUND + f" SELECT event_id, key_before, key_after, {r('share', 'share')} FROM s")
def _(spark, d):
    return tidy(timeline.surrounding(*_keys(spark, d)).select("event_id", "key_before", "key_after", "share"))


@query("J4_nearest_key", _SURROUND + " SELECT event_id, CASE WHEN share <= 0.5 THEN key_before ELSE key_after END AS key FROM s")
def _(spark, d):
    return timeline.nearest(*_keys(spark, d)).select("event_id", "key")


@query("J5_integer_keys", f"SELECT event_id, CAST(floor(value) AS BIGINT) AS frame_before, CAST(CASE WHEN value - floor(value) < 1e-6 THEN floor(value) ELSE floor(value) + 1 END AS BIGINT) AS frame_after, {r('CASE WHEN value - floor(value) < 1e-6 THEN 0.0 ELSE value - floor(value) END', 'share')} FROM events")
def _(spark, d):
    return tidy(timeline.integer_keyframes(table(spark, d, "events").select("event_id", F.col("value").alias("t"))).drop("t"))


@query("J9_leftover_fill", "WITH f AS (SELECT c_custkey AS slot, row_number() OVER (ORDER BY c_custkey) AS n FROM customer), u AS (SELECT o_orderkey AS row_id, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) SELECT slot, row_id FROM f JOIN u USING (n)")
def _(spark, d):
    """The i-th free slot takes the i-th row left over, over whole tables: ranks are taken inside ranges of the order."""
    free = matching.globally_ranked(table(spark, d, "customer").select(F.col("c_custkey").alias("slot")), ["slot"], "n")
    left = matching.globally_ranked(table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id")), ["row_id"], "n")
    return free.join(left, "n").select("slot", "row_id")


@query("J10_conform", f"WITH {TRACKS_SQL}, a AS (SELECT * FROM t WHERE frame = 3 AND active), b AS (SELECT * FROM t WHERE frame = 4 AND active) SELECT a.gid, {r('coalesce(b.x, a.x)', 'x')}, b.gid IS NOT NULL AS active FROM a LEFT JOIN b USING (gid)")
def _(spark, d):
    t = tracks(spark, d).where("active")
    slots = t.where("frame = 3").select("gid", F.col("x").alias("x0"))
    now = t.where("frame = 4").select("gid", F.col("x").alias("x1"))
    return tidy(slots.join(now, "gid", "left").select("gid", F.coalesce("x1", "x0").alias("x"), F.col("x1").isNotNull().alias("active")))


@query("J16_keep_gather", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def _(spark, d):
    keep = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(keep, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("J17_unmatched", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("J18_layer_lookup", "SELECT s_suppkey, n_name AS layer FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark, d):
    return table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("layer"))


@query("R1_playback", "SELECT range AS tick, CAST(range % 12 AS INTEGER) AS frame FROM range(100)")
def _(spark, d):
    return timeline.played(spark, 12, 100)


@query("R2_resample", "SELECT CAST(range AS INTEGER) AS out_frame, round(0.5 + range * 0.7, 6) + 0.0 AS t FROM range(15)")
def _(spark, d):
    return tidy(timeline.resampled(spark, 0.5, 10.4, 0.7))


# Windows


def _code_sql(source: str, by: str = "PARTITION BY frame") -> str:
    unit = lambda c: f"CAST(least(greatest(floor(CASE WHEN max({c}) OVER ({by}) > min({c}) OVER ({by}) THEN ({c} - min({c}) OVER ({by})) / (max({c}) OVER ({by}) - min({c}) OVER ({by})) ELSE 0 END * 1023), 0), 1023) AS BIGINT)"
    return f"i AS (SELECT *, {unit('x')} AS ix, {unit('y')} AS iy, {unit('z')} AS iz FROM {source}), m AS (SELECT *, {morton_sql('ix', 'iy', 'iz')} AS code FROM i)"


@query("W1_morton_rank", f"WITH {EVENTS_SQL}, {_code_sql('v')} SELECT gid, frame, code, CAST(row_number() OVER (PARTITION BY frame ORDER BY code, gid) - 1 AS INTEGER) AS rank FROM m")
def _(spark, d):
    rows = sequences.morton_codes(event_splats(spark, d).select("gid", "frame", "x", "y", "z"))
    return sequences.ranked(rows, ["frame"], ["code", "gid"]).select("gid", "frame", "code", "rank")


@query(
    "W2_refined_rank",
    f"WITH {EVENTS_SQL}, w AS (SELECT gid, frame, floor(x / 25) AS x, floor(y / 50) AS y, floor(z / 21600) AS z, x AS px, y AS py, z AS pz FROM v), {_code_sql('w')}, c AS (SELECT *, count(*) OVER (PARTITION BY frame, code) AS n FROM (SELECT gid, frame, code, px AS x, py AS y, pz AS z FROM m)), "
    + _code_sql("c", "PARTITION BY frame, code").replace("i AS", "i2 AS").replace("m AS", "m2 AS").replace("FROM i)", "FROM i2)").replace("AS code FROM", "AS code2 FROM")
    + " SELECT gid, frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY code, CASE WHEN n > 8 THEN code2 ELSE 0 END, gid) - 1 AS INTEGER) AS rank FROM m2",
)
def _(spark, d):
    rows = event_splats(spark, d)
    coarse = rows.select("gid", "frame", F.floor(F.col("x") / 25).alias("x"), F.floor(F.col("y") / 50).alias("y"), F.floor(F.col("z") / 21600).alias("z"), F.struct("x", "y", "z").alias("p"))
    codes = sequences.morton_codes(coarse).select("gid", "frame", "code", "p.x", "p.y", "p.z")
    return sequences.ranked(sequences.refined_codes(codes, crowd=8), ["frame"], ["code", "code2", "gid"]).select("gid", "frame", "rank")


@query("W3_global_rank", f"WITH {EVENTS_SQL}, {_code_sql('v', '')} SELECT gid, code, row_number() OVER (ORDER BY code, gid) - 1 AS rank FROM m")
def _(spark, d):
    rows = sequences.morton_codes(event_splats(spark, d).select("gid", "frame", "x", "y", "z"), per_frame=False)
    return sequences.ranked_in_buckets(rows, [], F.shiftright("code", 20), ["code", "gid"]).select("gid", "code", "rank")


@query(
    "W4_stable_order",
    f"WITH {TRACKS_SQL}, f AS (SELECT frame // 4 AS frame, gid, min_by(struct_pack(x, y, z), t.frame) AS p FROM t WHERE active GROUP BY 1, 2), g AS (SELECT gid, frame, p.x AS x, p.y AS y, p.z AS z FROM f), {_code_sql('g')} SELECT CAST(frame AS INTEGER) AS chunk_id, gid, CAST(row_number() OVER (PARTITION BY frame ORDER BY code, gid) - 1 AS INTEGER) AS rank FROM m",
)
def _(spark, d):
    return sequences.stable_order(sequences.by_chunk(tracks(spark, d)))


_QT = f"q AS (SELECT gid, frame, frame // 4 AS c, active, {_Q8('x', -1.0, 1.0)} AS q FROM t)"


def _quantised(spark, d):
    rows = sequences.by_chunk(tracks(spark, d))
    return rows.select("gid", "frame", "chunk_id", "active", spaces.quantise8(F.col("x"), F.lit(-1.0), F.lit(1.0)).alias("q"))


@query(
    "W5_key_snap",
    f"WITH {TRACKS_SQL}, {_QT}, f AS (SELECT *, first_value(q) OVER w AS q0, first_value(active) OVER w AS a0, coalesce(lag(active) OVER w, active) AS a1 FROM q WINDOW w AS (PARTITION BY c, gid ORDER BY frame)) SELECT gid, frame, CASE WHEN active AND a0 AND a1 AND abs(q - q0) <= 3 THEN q0 ELSE q END AS q FROM f",
)
def _(spark, d):
    return sequences.snapped_to_key(_quantised(spark, d), "q", 3).select("gid", "frame", "q")


@query(
    "W6_inactive_reuse",
    f"WITH {TRACKS_SQL}, {_QT}, f AS (SELECT gid, frame, last_value(CASE WHEN active THEN q END IGNORE NULLS) OVER (PARTITION BY c, gid ORDER BY frame) AS back, first_value(CASE WHEN active THEN q END IGNORE NULLS) OVER (PARTITION BY c, gid ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ahead, first_value(q) OVER (PARTITION BY c, gid ORDER BY frame) AS q0 FROM q) SELECT gid, frame, coalesce(back, ahead, q0) AS q FROM f",
)
def _(spark, d):
    return sequences.filled_inactive(_quantised(spark, d), "q").select("gid", "frame", "q")


@query("W7_offsets", "SELECT o_orderkey, l_linenumber, l_partkey, CAST(coalesce(sum(l_suppkey) OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT l_orderkey AS o_orderkey, * FROM lineitem)")
def _(spark, d):
    rows = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return sequences.offsets(rows, ["o_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], "l_suppkey").select("o_orderkey", "l_linenumber", "l_partkey", "offset")


_LBL = "b AS (SELECT gid, frame, frame // 4 AS c, (gid * 7 + frame * 13) % 256 AS label FROM t)"


def _labels(spark, d):
    return sequences.by_chunk(tracks(spark, d)).select("gid", "frame", "chunk_id", ((F.col("gid") * 7 + F.col("frame") * 13) % 256).alias("label"))


@query("W8_xor_to_key", f"WITH {TRACKS_SQL}, {_LBL} SELECT gid, frame, CASE WHEN frame % 4 = 0 THEN label ELSE xor(label, first_value(label) OVER (PARTITION BY c, gid ORDER BY frame)) END AS label FROM b")
def _(spark, d):
    return sequences.xor_to_key(_labels(spark, d), "label").select("gid", "frame", "label")


@query("W9_chains", f"WITH {TRACKS_SQL}, {_LBL} SELECT gid, frame, list_reduce(list(label) OVER (PARTITION BY c, gid ORDER BY frame), lambda p, q: xor(p, q)) AS xored, CAST(sum(label) OVER (PARTITION BY c, gid ORDER BY frame) AS BIGINT) % 256 AS summed FROM b")
def _(spark, d):
    rows = _labels(spark, d).withColumns({"xored": F.col("label"), "summed": F.col("label")})
    return sequences.delta_chain(sequences.xor_chain(rows, "xored"), "summed").select("gid", "frame", "xored", "summed")


@query("W10_spatial_delta", f"WITH {EVENTS_SQL}, {_code_sql('v')} SELECT gid, frame, {r('x - lag(x, 1, x) OVER (PARTITION BY frame ORDER BY code, gid)', 'delta')} FROM m")
def _(spark, d):
    rows = sequences.morton_codes(event_splats(spark, d).select("gid", "frame", "x", "y", "z"))
    before = F.coalesce(F.lag("x").over(W.partitionBy("frame").orderBy("code", "gid")), F.col("x"))
    return tidy(rows.select("gid", "frame", (F.col("x") - before).alias("delta")))


@query("W11_chunks", f"WITH {TRACKS_SQL}, {CHUNKS_SQL} SELECT chunk_id, start_frame, end_frame, count(*) AS n FROM t JOIN k ON frame BETWEEN start_frame AND end_frame GROUP BY ALL")
def _(spark, d):
    n = sequences.by_chunk(tracks(spark, d)).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    return chunks(spark).join(n, "chunk_id").select("chunk_id", "start_frame", "end_frame", "n")


@query("W12_key_frames", f"WITH {TRACKS_SQL}, f AS (SELECT DISTINCT frame, CAST(frame // 4 AS INTEGER) AS chunk_id FROM t) SELECT frame, chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY frame) = 1 AS is_key FROM f")
def _(spark, d):
    f = sequences.by_chunk(tracks(spark, d)).select("frame", "chunk_id").distinct()
    return f.withColumn("is_key", F.row_number().over(W.partitionBy("chunk_id").orderBy("frame")) == 1)


@query("W13_consecutive_dedup", "SELECT user_id, event_id, k FROM (SELECT user_id, event_id, CAST(floor(value / 25) AS BIGINT) AS k, lag(CAST(floor(value / 25) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> k")
def _(spark, d):
    rows = table(spark, d, "events").withColumn("k", F.floor(F.col("value") / 25))
    before = F.lag("k").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return rows.withColumn("p", before).where("p is null or p <> k").select("user_id", "event_id", "k")


@query("W14_global_dedup", "SELECT DISTINCT user_id, CAST(floor(value / 25) AS BIGINT) AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("user_id", F.floor(F.col("value") / 25).alias("k")).dropDuplicates()


@query("R11_lifetimes", f"WITH {TRACKS_SQL}, g AS (SELECT gid, frame, frame - row_number() OVER (PARTITION BY gid ORDER BY frame) AS g FROM t WHERE active) SELECT gid, min(frame) AS first_frame, max(frame) AS last_frame FROM g GROUP BY gid, g")
def _(spark, d):
    return sequences.runs(tracks(spark, d))


@query("R6_latest_wins", "SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))


@query("R7_event_history", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) WHERE n <= 10")
def _(spark, d):
    """The last ten events of each type: the bounded history, which is the feature."""
    n = F.row_number().over(W.partitionBy("event_type").orderBy(F.col("event_id").desc()))
    return table(spark, d, "events").select("event_type", "event_id", n.alias("n")).where("n <= 10").drop("n")


# Orders, top-k, padding, layers


@query("T2_layer_order", "SELECT s_suppkey, row_number() OVER (ORDER BY n_regionkey, s_nationkey, s_suppkey) - 1 AS draw FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark, d):
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey", "s_nationkey")
    return sequences.ranked_in_buckets(rows, [], F.col("n_regionkey"), ["n_regionkey", "s_nationkey", "s_suppkey"], "draw").select("s_suppkey", "draw")


@query("T3_block_order", f"WITH {EVENTS_SQL}, {_code_sql('v')}, b AS (SELECT gid, frame, code, floor(x / 50) * 10 + floor(y / 100) AS block FROM m) SELECT gid, frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY block, code, gid) - 1 AS INTEGER) AS rank FROM b")
def _(spark, d):
    rows = sequences.morton_codes(event_splats(spark, d).select("gid", "frame", "x", "y", "z"))
    rows = rows.withColumn("block", F.floor(F.col("x") / 50) * 10 + F.floor(F.col("y") / 100))
    return sequences.ranked(rows, ["frame"], ["block", "code", "gid"]).select("gid", "frame", "rank")


@query("T4_brightest", f"WITH {SPLATS_SQL} SELECT gid, {r('c0 + c1 + c2', 'brightness')} FROM s ORDER BY c0 + c1 + c2 DESC, gid LIMIT 25")
def _(spark, d):
    """Top 25: the limit is the feature."""
    rows = splats(spark, d).select("gid", (F.col("c0") + F.col("c1") + F.col("c2")).alias("brightness"))
    return tidy(rows.orderBy(F.col("brightness").desc(), "gid").limit(25))


@query(
    "T7_padding",
    f"WITH {EVENTS_SQL}, k AS (SELECT frame, gid, active, row_number() OVER (PARTITION BY frame ORDER BY gid) - 1 AS rank FROM v), n AS (SELECT frame, count(*) AS n, max_by(gid, rank) AS g FROM k GROUP BY frame), "
    "p AS (SELECT unnest(range(n, 40)) AS rank, frame, g FROM n WHERE n < 40) SELECT frame, gid, active, CAST(rank AS INTEGER) AS rank FROM k WHERE rank < 40 UNION ALL SELECT frame, g, false, CAST(rank AS INTEGER) FROM p",
)
def _(spark, d):
    return sequences.padded(sequences.ranked(event_splats(spark, d).select("frame", "gid", "active"), ["frame"], ["gid"]), 40)


@query("T8_atlas_cells", "SELECT o_orderkey, ((o_orderkey // 64) // 4) * 8 + ((o_orderkey % 64 >> 1) & 1) + 2 * ((o_orderkey % 64 >> 3) & 1) + 4 * ((o_orderkey % 64 >> 5) & 1) AS cell_row, (o_orderkey // 64) % 4 * 8 + (o_orderkey % 64 & 1) + 2 * ((o_orderkey % 64 >> 2) & 1) + 4 * ((o_orderkey % 64 >> 4) & 1) AS cell_column FROM orders")
def _(spark, d):
    cell = sequences.atlas_cell(F.col("o_orderkey"), 32, 8)
    return table(spark, d, "orders").select("o_orderkey", cell[0].alias("cell_row"), cell[1].alias("cell_column"))


@query("T9_first_n", f"WITH {EVENTS_SQL} SELECT frame, gid FROM (SELECT frame, gid, row_number() OVER (PARTITION BY frame ORDER BY gid) AS n FROM v) WHERE n <= 5")
def _(spark, d):
    """The first five of each frame: the slice is the feature."""
    return sequences.ranked(event_splats(spark, d).select("frame", "gid"), ["frame"], ["gid"]).where("rank < 5").drop("rank")


@query("U1_layer_merge", f"SELECT n_regionkey AS z_order, s_nationkey AS layer_id, s_suppkey AS gid, {r('s_acctbal / 1000 * (0.5 + n_regionkey * 0.1)', 'opacity')} FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 3")
def _(spark, d):
    dim = table(spark, d, "nation").select(F.col("n_nationkey").alias("layer_id"), (F.col("n_regionkey") != 3).alias("visible"), F.col("n_regionkey").alias("z_order"), (0.5 + F.col("n_regionkey") * 0.1).alias("opacity_multiplier"))
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("gid"), F.col("s_nationkey").alias("layer_id"), (F.col("s_acctbal") / 1000).alias("opacity"))
    return tidy(layers.merged(rows, dim).select("z_order", "layer_id", "gid", "opacity"))


@query("F17_layer_frames", "SELECT n_nationkey AS layer_id, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 3 AND 10 BETWEEN n_nationkey AND n_nationkey + 8 GROUP BY 1")
def _(spark, d):
    k = F.col("n_nationkey")
    dim = table(spark, d, "nation").select(k.alias("layer_id"), (F.col("n_regionkey") != 3).alias("visible"), F.lit(0).alias("z_order"), F.lit(1.0).alias("opacity_multiplier"), k.alias("first_frame"), (k + 8).alias("last_frame"))
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("gid"), F.col("s_nationkey").alias("layer_id"), F.lit(1.0).alias("opacity"))
    return layers.merged(rows, dim, frame=10).groupBy("layer_id").agg(F.count(F.lit(1)).alias("n"))


@query("U2_static_prefix", f"WITH {SPLATS_SQL} SELECT gid, CASE WHEN gid % 3 = 0 THEN 0 ELSE 1 END AS part, 45 AS size, {r('CASE WHEN gid % 3 = 0 THEN 0.0 ELSE shn[30] END', 'late')} FROM s")
def _(spark, d):
    s = splats(spark, d).select("gid", "shn")
    static = s.where("gid % 3 = 0").withColumn("shn", F.slice("shn", 1, 24))
    out = layers.with_static(static, s.where("gid % 3 <> 0"), 45)
    return tidy(out.select("gid", "part", F.size("shn").alias("size"), F.element_at("shn", 30).alias("late")))


@query("U3_concatenate", f"WITH {TRACKS_SQL} SELECT frame, count(*) AS n FROM t GROUP BY frame")
def _(spark, d):
    t = tracks(spark, d)
    return layers.concatenated([t.where(F.col("frame") == i) for i in range(12)]).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))


@query("S9_frame_at_time", f"WITH {SPLATS_SQL} SELECT gid, frame FROM s WHERE frame = CAST(round_even(0.55 * 9, 0) AS INTEGER)")
def _(spark, d):
    return splats(spark, d).where(F.col("frame") == F.rint(F.lit(0.55) * 9).cast("int")).select("gid", "frame")


@query(
    "C1_codec_round_trip",
    f"WITH {TRACKS_SQL}, l AS (SELECT gid, frame, x, sign(x) * ln(1 + abs(x)) AS v FROM t WHERE active), b AS (SELECT min(v) AS lo, max(v) AS hi FROM l), q AS (SELECT gid, frame, x, lo, hi, {_Q16('v', 'lo', 'hi')} / 56319.0 * (hi - lo) + lo AS w FROM l, b), "
    f"e AS (SELECT frame, abs(x - sign(w) * (exp(abs(w)) - 1)) AS e FROM q) SELECT frame, {r('max(e)', 'worst', 9)}, {r('-10 * log10(greatest(avg(e * e), 1e-300))', 'psnr', 3)} FROM e GROUP BY frame",
)
def _(spark, d):
    """Ranges, 16-bit quantisation, dequantisation and the error of positions."""
    rows = tracks(spark, d).where("active").select("gid", "frame", "x", spaces.log_transform(F.col("x")).alias("v"))
    box = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    q = spaces.quantise16(F.col("v"), F.col("lo"), F.col("hi"))
    w = spaces.inverse_log_transform(spaces.dequantise16(spaces.high_byte(q), spaces.low_byte(q), F.col("lo"), F.col("hi")))
    e = rows.crossJoin(F.broadcast(box)).select("frame", F.abs(F.col("x") - w).alias("e"))
    out = e.groupBy("frame").agg(F.max("e").alias("worst"), F.avg(F.col("e") * F.col("e")).alias("mse"))
    return out.select("frame", (F.round("worst", 9) + 0.0).alias("worst"), (F.round(-10 * F.log10(F.greatest("mse", F.lit(1e-300))), 3) + 0.0).alias("psnr"))

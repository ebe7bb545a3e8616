"""Queries of matching, palettes, payloads, sources, sinks and streams, keyed by their inventory number."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import functions as F

from ..operators import matching, palette, payloads, sequences
from ..sources import container, documents, generated, ply
from ..streaming import streams
from .registry import query, r, tidy
from .views import EVENTS_SQL, SPLATS_SQL, TRACKS_SQL, event_splats, splats, table, tracks

# Matching: embeddings of even ids are the frame before, of odd ids the current one.

_AB = f"{SPLATS_SQL}, a AS (SELECT gid AS cur, x, y, z, c0, c1, c2, s0, s1, s2 FROM s WHERE gid % 2 = 1), b AS (SELECT gid AS prev, x AS px, y AS py, z AS pz, c0 AS p0, c1 AS p1, c2 AS p2, s0 AS t0, s1 AS t1, s2 AS t2 FROM s WHERE gid % 2 = 0)"
_D2 = "(x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)"


def _sides(spark, d):
    s = splats(spark, d)
    return s.where("gid % 2 = 1").withColumnRenamed("gid", "cur"), s.where("gid % 2 = 0").withColumnRenamed("gid", "prev")


@query("J8_nearest_neighbour", f"WITH {_AB} SELECT cur, min_by(prev, struct_pack(d := {_D2}, prev := prev)) AS prev, {r(f'min({_D2})', 'd2', 9)} FROM a, b GROUP BY cur")
def _(spark, d):
    return tidy(matching.neighbours(*_sides(spark, d)).select("cur", "prev", "d2"), 9)


PASSES = range(1, 11)


def _pass_sql(n: int) -> str:
    before = "" if n == 1 else "WHERE " + " AND ".join(f"cur NOT IN (SELECT cur FROM w{i}) AND prev NOT IN (SELECT prev FROM w{i})" for i in range(1, n))
    return (
        f"n{n} AS MATERIALIZED (SELECT cur, min(struct_pack(d := {_D2}, prev := prev)) AS m FROM a, b {before} GROUP BY cur), "
        f"w{n} AS MATERIALIZED (SELECT m.prev AS prev, min(struct_pack(d := m.d, cur := cur)).cur AS cur, min(m.d) AS d2, CAST({n} AS INTEGER) AS pass FROM n{n} GROUP BY m.prev)"
    )


@query("J6_slot_matching", f"WITH {_AB}, {', '.join(map(_pass_sql, PASSES))} SELECT cur, prev, {r('d2', 'd2', 9)}, pass FROM ({' UNION ALL '.join(f'SELECT * FROM w{n}' for n in PASSES)})")
def _(spark, d):
    return tidy(matching.matched(*_sides(spark, d), passes=len(PASSES)).select("cur", "prev", "d2", "pass"), 9)


@query(
    "J7_vacant_slots",
    f"WITH {_AB}, n AS (SELECT *, {_D2} AS d2 FROM a, b), k AS (SELECT *, row_number() OVER (PARTITION BY cur ORDER BY d2, prev) AS nth FROM n), t AS (SELECT *, max(d2) OVER (PARTITION BY cur) AS far FROM k WHERE nth <= 8), "
    "c AS (SELECT cur, prev, d2 / greatest(far, 1e-12) + 0.1 * ((c0 - p0) * (c0 - p0) + (c1 - p1) * (c1 - p1) + (c2 - p2) * (c2 - p2)) + 0.1 * ((s0 - t0) * (s0 - t0) + (s1 - t1) * (s1 - t1) + (s2 - t2) * (s2 - t2)) AS cost FROM t), "
    f"m AS (SELECT cur, min(struct_pack(cost := cost, prev := prev)) AS m FROM c GROUP BY cur) SELECT min(struct_pack(cost := m.cost, cur := cur)).cur AS cur, m.prev AS prev, {r('min(m.cost)', 'cost', 9)} FROM m GROUP BY m.prev",
)
def _(spark, d):
    return tidy(matching.vacant_slots(*_sides(spark, d)).select("cur", "prev", "cost"), 9)


@query("J14_block_assignment")
def _(spark, d):
    rows = splats(spark, d)
    n = rows.count()
    centroids = [(0.1 * i, 0.1 * j, 0.0) for i in (-1, 0, 1) for j in (-1, 1)]
    return matching.assigned_blocks(rows, centroids, math.ceil(n / 6) + 2)


# Palette


@query(
    "A15_histogram",
    f"WITH {SPLATS_SQL}, v AS (SELECT gid, c0 AS v FROM s), b AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM v), "
    "k AS (SELECT v, n, (v - lo) / (hi - lo) AS u, row_number() OVER (ORDER BY v, gid) - 1 AS rank, greatest(0.5, least(0.999, 1 - (q3 - q1) / (hi - lo))) AS beta FROM v, b) "
    f"SELECT CAST(least(floor((beta * rank / n + (1 - beta) * u) * least(512, n)), least(512, n) - 1) AS BIGINT) AS bin, count(*) AS n, {r('sum(v)', 'total')} FROM k GROUP BY 1",
)
def _(spark, d):
    return tidy(palette.histogram(splats(spark, d).select(F.col("gid").alias("id"), F.col("c0").alias("value"))))


@query("A16_codebook")
def _(spark, d):
    """The optimal scalar codebook of a channel."""
    book = palette.codebook(splats(spark, d).select(F.col("gid").alias("id"), F.col("c0").alias("value")), codes=16)
    return spark.createDataFrame(list(enumerate(book)), "code int, value double")


_BOOK = [round(-3 + 6 * i / 15, 6) for i in range(16)]
_MID = [(a + b) / 2 for a, b in zip(_BOOK, _BOOK[1:])]


@query("J12_scalar_codes", f"WITH {SPLATS_SQL} SELECT gid, CAST(len(list_filter({_MID!r}, lambda m: m <= c0)) AS INTEGER) AS code FROM s")
def _(spark, d):
    return palette.coded(splats(spark, d).select("gid", "c0"), "c0", _BOOK).select("gid", "code")


@query("J13_nearest_centroid", f"WITH {SPLATS_SQL}, c AS (SELECT CAST(gid AS INTEGER) AS label, shn AS p FROM s WHERE gid < 8), d AS (SELECT gid, label, list_sum(list_transform(list_zip(shn, p), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS d2 FROM s, c) SELECT gid, min_by(label, struct_pack(d2 := round(d2, 12), label := label)) AS label, {r('min(d2)', 'd2')} FROM d GROUP BY gid")
def _(spark, d):
    s = splats(spark, d)
    first = s.where("gid < 8").orderBy("gid").collect()
    return tidy(palette.labelled(s, np.array([x.shn for x in first])))


@query("J11_palette_expand", f"WITH {SPLATS_SQL} SELECT gid, round({_BOOK!r}[CAST((gid % 5 * 3 + 1) % 16 AS INTEGER) + 1], 6) + 0.0 AS second, round({_BOOK!r}[CAST((gid % 5 * 3 + 44) % 16 AS INTEGER) + 1], 6) + 0.0 AS last FROM s")
def _(spark, d):
    centroids = spark.createDataFrame([(k, [(k * 3 + i) % 16 for i in range(45)]) for k in range(5)], "label int, codes array<int>")
    out = palette.expanded(splats(spark, d).select("gid", (F.col("gid") % 5).cast("int").alias("label")), centroids, _BOOK)
    return tidy(out.select("gid", F.element_at("shn", 2).alias("second"), F.element_at("shn", 45).alias("last")))


@query("A17_kmeans")
def _(spark, d):
    s = splats(spark, d)
    return palette.labelled(s, palette.trained(s, max(64, s.count() // 10), rounds=20))


# Payloads


def _low(spark, d):
    low = lambda c, m: (F.floor(F.abs(F.col(c)) * 40) % m).cast("int")
    rows = sequences.ranked(event_splats(spark, d).select("frame", "gid", "x", "y", "z"), ["frame"], ["gid"])
    return rows.select("frame", F.col("rank").cast("bigint").alias("rank"), low("x", 6).alias("lx"), low("y", 6).alias("ly"), F.when(F.col("frame") % 2 == 0, low("z", 6)).otherwise(low("z", 256)).alias("lz"))


@query("K11_low_payload", f"WITH {EVENTS_SQL} SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY gid) - 1 AS rank, CAST(floor(abs(x) * 40) % 6 AS INTEGER) AS lx, CAST(floor(abs(y) * 40) % 6 AS INTEGER) AS ly, CAST(floor(abs(z) * 40) % CASE WHEN frame % 2 = 0 THEN 6 ELSE 256 END AS INTEGER) AS lz FROM v")
def _(spark, d):
    """Low bytes to compressed frames and back."""
    return payloads.low_bytes(payloads.low_payloads(_low(spark, d)))


def _label_rows(spark, d):
    rows = sequences.by_chunk(tracks(spark, d)).select("chunk_id", "frame", F.col("gid").alias("rank"), ((F.col("gid") * 7 + F.col("frame")) % 65536).cast("int").alias("label"))
    return rows


@query("K12_label_payload", f"WITH {TRACKS_SQL} SELECT CAST(frame // 4 AS INTEGER) AS chunk_id, frame, count(*) AS n, CAST(sum((gid * 7 + frame) % 65536) AS BIGINT) AS total, true AS small FROM t GROUP BY 1, 2")
def _(spark, d):
    """Payloads by frame: what they decode to, and that they are smaller than two bytes a splat and a frame's overhead."""
    made = payloads.label_payloads(_label_rows(spark, d))
    back = payloads.labels(made).groupBy("chunk_id", "frame").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("total"))
    return back.join(made, ["chunk_id", "frame"]).select("chunk_id", "frame", "n", "total", (F.length("payload") <= 2 * F.col("n") + 32).alias("small"))


@query("A28_compressed_sizes")
def _(spark, d):
    return payloads.compressed_sizes(_low(spark, d), "lz")


@query("T5_grid_sort", f"WITH {EVENTS_SQL} SELECT frame, count(*) AS n, count(*) - 1 AS most, true AS whole, true AS lowered FROM v GROUP BY frame")
def _(spark, d):
    """Every row of a frame has a cell of its own, and neighbours in the grid are no less alike than before."""
    out = payloads.grid_sorted(event_splats(spark, d).select("frame", "gid", "x", "y", "z"))
    n = F.count(F.lit(1))
    return out.groupBy("frame").agg(n.alias("n"), F.max("cell").alias("most"), (F.count_distinct("cell") == n).alias("whole"), F.bool_and(F.col("after") <= F.col("before")).alias("lowered"))


@query("T6_swap_refinement", f"WITH {TRACKS_SQL}, g AS (SELECT DISTINCT CAST(frame // 4 AS INTEGER) AS chunk_id, gid FROM t) SELECT chunk_id, count(*) AS n, true AS whole, true AS lowered FROM g GROUP BY chunk_id")
def _(spark, d):
    rows = sequences.by_chunk(tracks(spark, d)).groupBy("chunk_id", "gid").agg(F.min_by("x", "frame").alias("value")).withColumn("rank", F.col("gid"))
    n = F.count(F.lit(1))
    return payloads.swapped(rows).groupBy("chunk_id").agg(n.alias("n"), ((F.count_distinct("rank") == n) & (F.min("rank") == 0) & (F.max("rank") == n - 1)).alias("whole"), F.bool_and(F.col("after") <= F.col("before")).alias("lowered"))


# Sources and sinks


@query("S3_ply_round_trip", f"WITH {SPLATS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY gid) - 1 AS n FROM s) SELECT frame, n AS gid, {r('CAST(CAST(x AS FLOAT) AS DOUBLE)', 'x')}, {r('CAST(CAST(s0 AS FLOAT) AS DOUBLE)', 's0')}, {r('CAST(CAST(opacity AS FLOAT) AS DOUBLE)', 'opacity', 4)}, {r('CAST(CAST(shn[2] AS FLOAT) AS DOUBLE)', 'green')}, {r('CAST(CAST(shn[45] AS FLOAT) AS DOUBLE)', 'last')} FROM k")
def _(spark, d):
    """Frames to PLY bytes and back."""
    back = ply.parsed(ply.rendered(splats(spark, d)))
    out = back.select("frame", "gid", "x", "s0", (F.round("opacity", 4) + 0.0).alias("o"), F.element_at("shn", 2).alias("green"), F.element_at("shn", 45).alias("last"))
    return tidy(out).withColumnRenamed("o", "opacity")


def _container(n_splats: int = 10, frames: int = 12, flags: int = container.LOW_COLUMNS) -> tuple[bytes, np.ndarray]:
    """A small container whose low bytes follow from frame, row and axis."""
    import zstandard

    f, i, a = np.meshgrid(np.arange(frames), np.arange(n_splats), np.arange(3), indexing="ij")
    low = ((7 * f + 3 * i + 11 * a) % 256).astype(np.uint8)
    chunks = np.array([(s, min(s + 3, frames - 1), 0, 0) for s in range(0, frames, 4)], container.CHUNK)
    index = np.array([(100 * k, (50 + k) | (container.KEY_FLAG if k % 4 == 0 else 0)) for k in range(frames)], container.FRAME)
    sent = low.copy()
    if flags & container.LOW_XOR:
        sent[1:] ^= low[:-1]
        sent[::4] = low[::4]
    blobs = [zstandard.ZstdCompressor().compress((x.T if flags & container.LOW_COLUMNS else x).tobytes()) for x in sent]
    fields = {"n_splats": n_splats, "n_frames": frames, "n_chunks": len(chunks), "chunk_size": 4, "atlas_side": 4, "codec": b"vp09"}
    return container.assemble(fields, np.zeros(1, container.RANGES), chunks, index, blobs, b"v" * 64, flags), low


def _files(spark):
    rows = [(str(k), bytearray(_container(flags=f)[0])) for k, f in enumerate((0, container.LOW_COLUMNS, container.LOW_COLUMNS | container.LOW_XOR))]
    return spark.createDataFrame(rows, "path string, content binary")


@query("S13_container_header", "SELECT CAST(range AS VARCHAR) AS path, 'vp09' AS codec, 3::BIGINT AS version, 10::BIGINT AS n_splats, 12::BIGINT AS n_frames, 3::BIGINT AS n_chunks, 128::BIGINT AS ranges_offset, 240::BIGINT AS chunk_index_offset, 288::BIGINT AS frame_index_offset, 384::BIGINT AS low_offset FROM range(3)")
def _(spark, d):
    """Sections laid out one after another."""
    return container.headers(spark, _files(spark)).select("path", "codec", "version", "n_splats", "n_frames", "n_chunks", "ranges_offset", "chunk_index_offset", "frame_index_offset", "low_offset")


@query("S18_byte_ranges", "SELECT CAST(f.range AS INTEGER) AS frame, CAST(f.range // 4 AS INTEGER) AS chunk_id, 100 * f.range AS \"offset\", 50 + f.range AS size, f.range % 4 = 0 AS is_key, 50 + f.range AS length FROM range(12) f")
def _(spark, d):
    rows = container.frame_index(_files(spark)).where("path = '1'")
    return rows.select("frame", "chunk_id", "offset", "size", "is_key", (F.col("to_byte") - F.col("from_byte")).alias("length"))


@query("S16_low_layouts", "SELECT CAST(p.range AS VARCHAR) AS path, CAST(f.range AS INTEGER) AS frame, i.range AS rank, CAST((7 * f.range + 3 * i.range) % 256 AS INTEGER) AS lx, CAST((7 * f.range + 3 * i.range + 11) % 256 AS INTEGER) AS ly, CAST((7 * f.range + 3 * i.range + 22) % 256 AS INTEGER) AS lz FROM range(3) p, range(12) f, range(10) i")
def _(spark, d):
    """Rows, columns, and XOR with the frame before."""
    return container.low_rows(_files(spark))


def _metadata() -> str:
    wide = {"means_min": [-1, -2, -3], "means_max": 1.5, "scales_min": -9, "scales_max": [1, 2, 3], "opacities_min": -6, "opacities_max": 12, "quats_min": -1, "quats_max": 1, "sh0_min": -2, "sh0_max": 4}
    return json.dumps({"total_frames": 8, "total_chunks": 2, "chunk_size": 4, "chunks": [{"chunk_id": k, "start_frame": 4 * k, "end_frame": 4 * k + 3, "n_frames": 4, "gaussian_count": 100 + k, "ranges": wide} for k in range(2)]})


@query("S22_chunk_metadata", "SELECT CAST(range AS INTEGER) AS chunk_id, CAST(4 * range AS INTEGER) AS start_frame, CAST(4 * range + 3 AS INTEGER) AS end_frame, 100 + range AS n_splats, -2.0::DOUBLE AS min_y, 1.5::DOUBLE AS max_z, 3.0::DOUBLE AS scale_z FROM range(2)")
def _(spark, d):
    rows = documents.chunk_metadata(spark.createDataFrame([("m.json", _metadata())], "path string, text string"))
    return rows.select("chunk_id", "start_frame", "end_frame", "n_splats", rows.means_min[1].alias("min_y"), rows.means_max[2].alias("max_z"), rows.scales_max[2].alias("scale_z"))


def _unit_sql(k: int) -> str:
    u = f"((gid * 1103515245 + {(k + 1) * 747796405 + 42 * 2654435 + 97}) % 2147483647)"
    u = f"(({u} * {u} + {k + 1} * 40503) % 2147483647)"
    return f"(({u} * 48271 % 2147483647) / 2147483647.0)"


@query(
    "S23_generated_scene",
    f"SELECT gid, CAST(f.range AS INTEGER) AS frame, {r(f'{_unit_sql(0)} * 2 - 1', 'x')}, {r(f'{_unit_sql(1)} * 2 - 1 + 0.1 * sin(2 * pi() * f.range / 12 + {_unit_sql(0)} * 2 - 1)', 'y')}, "
    f"{r(f'{_unit_sql(2)} * 2 - 1', 'z')}, {r(f'{_unit_sql(3)} * 2 - 5', 's0')}, {r(f'{_unit_sql(4)} * 10 - 3', 'opacity')} FROM (SELECT range AS gid FROM range(500)), range(12) f",
)
def _(spark, d):
    return tidy(generated.oscillating(spark, 500, 12))


@query("K6_json_sink", f"WITH {SPLATS_SQL} SELECT frame, least(count(*), 20) AS n_splats, round_even(min_by(x, gid), 3) AS first_x FROM s GROUP BY frame")
def _(spark, d):
    doc = documents.frame_documents(splats(spark, d), precision=3, most=20)
    got = F.from_json("json", "n_splats bigint, means array<array<double>>")
    return doc.select("frame", got["n_splats"].alias("n_splats"), got["means"][0][0].alias("first_x"))


@query("T1_frame_order", "SELECT 'frame_' || n || '.PLY' AS path, row_number() OVER (ORDER BY n) - 1 AS frame FROM (SELECT DISTINCT user_id AS n FROM events)")
def _(spark, d):
    """Files named by number, in their natural order."""
    from ..functions import bits

    paths = table(spark, d, "events").select(F.concat(F.lit("frame_"), F.col("user_id").cast("string"), F.lit(".PLY")).alias("path")).distinct()
    ranked = matching.globally_ranked(paths.withColumn("key", bits.natural_key(F.col("path"))), ["key"], "frame")
    return ranked.select("path", F.col("frame").cast("bigint").alias("frame"))


# Streams


@query("R3_tumbling_stream", f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, {r('sum(value)', 'total', 3)} FROM events GROUP BY 1, 2")
def _(spark, d):
    out = streams.drained(streams.tumbling(streams.event_stream(spark, d)))
    return tidy(out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")), 3)


@query("E1_sliding_stream", "SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1")
def _(spark, d):
    """An extension: sliding windows in event time."""
    return streams.drained(streams.sliding(streams.event_stream(spark, d))).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("R6_latest_stream", "SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def _(spark, d):
    return streams.drained(streams.latest(streams.event_stream(spark, d)))


@query("R12_repeat_frames", "SELECT event_id, user_id FROM events")
def _(spark, d):
    return streams.drained(streams.distinct_frames(streams.event_stream(spark, d)), "append").select("event_id", "user_id")


_BREAKER_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type = 'error' AS failed, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS event_id, 'closed' AS met, 'closed' AS state, 0 AS bad, 0 AS good, CAST(0 AS DOUBLE) AS last FROM e
  UNION ALL
  SELECT user_id, n, event_id, met,
    CASE WHEN failed AND met = 'half_open' THEN 'open' WHEN failed AND met = 'closed' AND bad >= 2 THEN 'open' WHEN NOT failed AND met = 'half_open' AND good >= 1 THEN 'closed' ELSE met END,
    CASE WHEN failed AND met = 'closed' THEN bad + 1 WHEN NOT failed AND (met = 'closed' OR met = 'half_open' AND good >= 1) THEN 0 ELSE bad END,
    CASE WHEN NOT failed AND met = 'half_open' THEN good + 1 ELSE good END,
    CASE WHEN failed THEN t ELSE last END
  FROM (SELECT e.user_id, e.n, e.event_id, e.failed, e.t, s.bad, s.last, CASE WHEN s.state = 'open' AND e.t - s.last >= 60 THEN 'half_open' ELSE s.state END AS met,
    CASE WHEN s.state = 'open' AND e.t - s.last >= 60 THEN 0 ELSE s.good END AS good FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
) SELECT user_id, event_id, met, state FROM s WHERE n > 0"""


@query("R8_breaker_batch", _BREAKER_SQL)
def _(spark, d):
    return streams.breaker_batch(table(spark, d, "events"))


@query("R8_breaker_stream", _BREAKER_SQL)
def _(spark, d):
    return streams.drained(streams.breaker_stream(streams.event_stream(spark, d)), "append")


@query("R4_matcher_stream")
def _(spark, d):
    e = streams.event_stream(spark, d)
    frames = e.select((F.col("event_id") % 7).alias("scene"), F.floor(F.col("event_id") / 70).cast("int").alias("frame"), F.floor(F.col("event_id") / 280).cast("int").alias("chunk_id"), F.col("event_id").alias("gid"), (F.col("value") / 100).alias("x"), (F.col("user_id") % 10 / 10).alias("y"), (F.col("event_id") * 7 % 13 / 13).alias("z"))
    return streams.drained(streams.matcher_stream(frames), "append")

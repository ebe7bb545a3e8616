"""Further inventory numbers: scans by frame and chunk, label payloads, validation, ratios."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import spaces
from ..operators import bounds, edit, filters, palette, payloads, sequences, timeline
from ..sources import container, ply
from .codec_queries import _label_rows
from .registry import query, r, tidy
from .scalar_queries import _SPHERE, _SPHERE_SQL, C0
from .views import EVENTS_SQL, LINES_SQL, SPLATS_SQL, TRACKS_SQL, event_splats, line_splats, splats, table, tracks


@query("S10_frame_range", f"WITH {TRACKS_SQL} SELECT frame, count(*) AS n FROM t WHERE frame BETWEEN 7 AND 11 GROUP BY frame")
def _(spark, d):
    low, high = timeline.clamped_range(7, 99, 12)
    return tracks(spark, d).where(F.col("frame").between(low, high)).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))


@query("S14_chunk_scan", f"WITH {TRACKS_SQL} SELECT gid, frame, {r('x', 'x')} FROM t WHERE frame // 4 = 1")
def _(spark, d):
    """Random access: the chunk's frames, as a predicate on the stored frame number."""
    return tidy(tracks(spark, d).where(F.col("frame").between(4, 7)).select("gid", "frame", "x"))


@query("S17_label_decode", f"WITH {TRACKS_SQL} SELECT CAST(frame // 4 AS INTEGER) AS chunk_id, frame, gid AS rank, CAST((gid * 7 + frame) % 65536 AS INTEGER) AS label FROM t")
def _(spark, d):
    """Labels to compressed frames, XOR with the chunk's first, and back."""
    return payloads.labels(payloads.label_payloads(_label_rows(spark, d)))


@query("S20_static_track", "SELECT 9::BIGINT AS n_splats, 3::BIGINT AS atlas_side, 0::BIGINT AS sh_bands, 27::BIGINT AS low_bytes, 5::BIGINT AS video_bytes")
def _(spark, d):
    got = container.static_track(container.make_static_track(9, 3, np.zeros(1, container.RANGES), b"l" * 27, b"video"))
    row = (got["n_splats"], got["atlas_side"], got["sh_bands"], len(got["low"]), len(got["video"]))
    return spark.createDataFrame([row], "n_splats bigint, atlas_side bigint, sh_bands bigint, low_bytes bigint, video_bytes bigint")


@query("S6_format_detection", f"WITH {SPLATS_SQL} SELECT frame, count(*) AS n, CAST(14 + 45 AS BIGINT) AS properties FROM s GROUP BY frame")
def _(spark, d):
    """The header alone tells a file's layout."""
    return ply.layouts(ply.rendered(splats(spark, d)))


@query("K3_export_frame", f"WITH {SPLATS_SQL} SELECT gid, isinf(CASE WHEN gid % 4 = 0 THEN -CAST('inf' AS DOUBLE) ELSE opacity END) AS invisible, {r('s1', 's1', 4)} FROM s")
def _(spark, d):
    """Exactly invisible splats stay so through the file's bytes."""
    rows = edit.activated(splats(spark, d)).withColumn("opacity", F.when(F.col("gid") % 4 == 0, 0.0).otherwise(F.col("opacity"))).drop("frame")
    files = ply.rendered(edit.stored(rows).withColumn("frame", F.lit(0)))
    back = ply.parsed(files)
    ids = sequences.ranked(rows.select("gid", F.lit(0).alias("frame")), ["frame"], ["gid"]).select("gid", F.col("rank").cast("bigint").alias("n"))
    return tidy(back.withColumnRenamed("gid", "n").join(ids, "n").select("gid", (F.col("opacity") == float("-inf")).alias("invisible"), "s1"), 4).select("gid", "invisible", (F.round("s1", 4) + 0.0).alias("s1"))


@query("K5_sink_count", f"WITH {SPLATS_SQL} SELECT count(DISTINCT frame) AS frames, count(*) AS splats FROM s")
def _(spark, d):
    return splats(spark, d).agg(F.count_distinct("frame").alias("frames"), F.count(F.lit(1)).alias("splats"))


@query("X13_frame_count", "SELECT CAST(floor(max(value) - min(value)) * 1 + 1 AS BIGINT) AS discrete, CAST(floor((max(value) - min(value)) * 30) AS BIGINT) AS continuous FROM events")
def _(spark, d):
    span = F.max("value") - F.min("value")
    return table(spark, d, "events").agg((F.floor(span) + 1).alias("discrete"), F.floor(span * 30).alias("continuous"))


@query("X19_layer_opacity", "SELECT s_suppkey, round(s_acctbal * 0.5, 6) + 0.0 AS opacity FROM supplier")
def _(spark, d):
    return tidy(table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") * 0.5).alias("opacity")))


@query("X37_atlas_address", "SELECT o_orderkey, c AS channel, ((c // 5) * 128 + (o_orderkey // 128) % 128) * 640 + (c % 5) * 128 + o_orderkey % 128 AS cell FROM orders, (SELECT CAST(range AS INTEGER) AS c FROM range(15))")
def _(spark, d):
    k, c = F.col("o_orderkey"), F.col("channel")
    rows = table(spark, d, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("channel"))
    row, column = F.floor(c / 5) * 128 + F.floor(k / 128) % 128, (c % 5) * 128 + k % 128
    return rows.select("o_orderkey", "channel", (row * 640 + column).alias("cell"))


@query("X44_scale_parts", "SELECT round(pow(2.0 * 0.5 * 3.375, 1.0 / 3), 9) AS main, round(2.0 / pow(2.0 * 0.5 * 3.375, 1.0 / 3), 9) AS x")
def _(spark, d):
    main, parts = g.scale_parts((2.0, 0.5, 3.375))
    return spark.createDataFrame([(round(main, 9), round(parts[0], 9))], "main double, x double")


@query("X53_time_index", "SELECT event_id, CAST(round_even(value / 100 * 99, 0) AS BIGINT) AS frame, round(round_even(value / 100 * 99, 0) / 99, 9) + 0.0 AS t FROM events")
def _(spark, d):
    i = F.rint(F.col("value") / 100 * 99)
    return table(spark, d, "events").select("event_id", i.cast("bigint").alias("frame"), (F.round(i / 99, 9) + 0.0).alias("t"))


@query("A14_block_capacity", f"WITH {LINES_SQL}, b AS (SELECT CAST(floor(x / 10) AS BIGINT) AS block, count(*) AS n FROM l GROUP BY 1), c AS (SELECT sum(n) // count(*) AS cap FROM b) SELECT block, n, CAST(greatest(n - cap, 0) AS BIGINT) AS evicted FROM b, c")
def _(spark, d):
    b = line_splats(spark, d).groupBy(F.floor(F.col("x") / 10).alias("block")).agg(F.count(F.lit(1)).alias("n"))
    cap = b.agg(F.floor(F.sum("n") / F.count(F.lit(1))).alias("cap"))
    return b.crossJoin(F.broadcast(cap)).select("block", "n", F.greatest(F.col("n") - F.col("cap"), F.lit(0)).cast("bigint").alias("evicted"))


@query("A18_palette_size", f"WITH {LINES_SQL} SELECT frame, CAST(least(greatest(64, count(*) // 10), 65535) AS BIGINT) AS size FROM l GROUP BY frame")
def _(spark, d):
    n = F.count(F.lit(1))
    assert palette.palette_size(10_000) == 1000 and palette.blocked_size(65) == 128
    return line_splats(spark, d).groupBy("frame").agg(F.least(F.greatest(F.lit(64), F.floor(n / 10)), F.lit(palette.MAX_CENTROIDS)).cast("bigint").alias("size"))


@query("A35_keep_ratio", f"WITH {SPLATS_SQL} SELECT count(*) FILTER (WHERE {_SPHERE_SQL}) AS kept, count(*) AS total, {r(f'100.0 * count(*) FILTER (WHERE {_SPHERE_SQL}) / count(*)', 'percent')} FROM s")
def _(spark, d):
    return tidy(bounds.centroid(splats(spark, d), filters.predicate(_SPHERE)).select("kept", "total", "percent"))


@query("R5_state_reset", f"WITH {TRACKS_SQL} SELECT gid, frame, CAST(count(*) OVER (PARTITION BY frame // 4, gid ORDER BY frame) AS BIGINT) AS age FROM t WHERE active")
def _(spark, d):
    """State that begins anew with each group of pictures: active frames so far."""
    rows = sequences.by_chunk(tracks(spark, d)).where("active")
    return rows.select("gid", "frame", F.count(F.lit(1)).over(W.partitionBy("chunk_id", "gid").orderBy("frame")).alias("age"))


@query("R10_health_ring", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 100")
def _(spark, d):
    """The last hundred states of each component: the ring's size is the feature."""
    n = F.row_number().over(W.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    return table(spark, d, "events").withColumn("n", n).where("n <= 100").select("user_id", "event_id", "event_type")


@query("F10_filter_is_active", "SELECT * FROM (VALUES ('sphere', true), ('any sphere', false), ('box', true), ('range', true), ('no range', false)) t(name, active)")
def _(spark, d):
    shapes = {"sphere": _SPHERE, "any sphere": filters.Sphere(), "box": filters.Box((0.0, 0.0, 0.0), (1.0, 1.0, 1.0)), "range": filters.opacity_range(0.0), "no range": filters.opacity_range()}
    return spark.createDataFrame([(n, not s.neutral) for n, s in shapes.items()], "name string, active boolean")


@query("F18_export_validation", f"WITH {EVENTS_SQL} SELECT frame, count(*) AS n, count(*) > 0 AND bool_and(x IS NOT NULL AND isfinite(x)) AS valid FROM v GROUP BY frame")
def _(spark, d):
    good = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))
    return event_splats(spark, d).groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.bool_and(good).alias("valid"))


@query("A21_clip_counts", f"WITH {SPLATS_SQL} SELECT frame, count(*) FILTER (WHERE c0 < -2 OR c0 > 4) AS colour, count(*) FILTER (WHERE opacity < -6 OR opacity > 12) AS opacity, {r(f'avg(c0 * {C0} + 0.5)', 'red')} FROM s GROUP BY frame")
def _(spark, d):
    out = lambda c, clip: F.count_if((F.col(c) < clip[0]) | (F.col(c) > clip[1]))
    return tidy(splats(spark, d).groupBy("frame").agg(out("c0", spaces.COLOUR_CLIP).alias("colour"), out("opacity", spaces.OPACITY_CLIP).alias("opacity"), F.avg(spaces.sh_to_rgb(F.col("c0"))).alias("red")))

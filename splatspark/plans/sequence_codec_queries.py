"""Queries of whole sequences through the codec, against values quantised in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bounds, sequence_codec
from .aggregate_queries import _RANGE
from .registry import query, r, tidy
from .scalar_queries import _Q8, _Q16
from .views import TRACKS_SQL, tracks

_BOX = ", ".join(f"min({e}) AS min_{c}, max({e}) AS max_{c}" for c, e in _RANGE.items())


def _rows(stored: str) -> str:
    """Bytes by the ranges, values by the ranges as they are stored: doubles, or 32-bit numbers in a file."""
    end = lambda e, c: f"CAST(CAST({e}_{c} AS {stored}) AS DOUBLE)"
    back = lambda q, steps, c: f"({q}) / {steps} * ({end('max', c)} - {end('min', c)}) + {end('min', c)}"
    x = back(_Q16(_RANGE["x"], "min_x", "max_x"), 56319.0, "x")
    rest = ", ".join(f"{back('(' + _Q8(_RANGE[c], f'min_{c}', f'max_{c}') + ') - 16', 219.0, c)} AS w_{c}" for c in ("s0", "qw", "opacity", "c0"))
    return (
        f"WITH {TRACKS_SQL}, b AS (SELECT {_BOX} FROM t WHERE active), d AS (SELECT gid, frame, {x} AS wx, {rest} FROM t, b WHERE active) "
        f"SELECT gid, frame, {r('sign(wx) * (exp(abs(wx)) - 1)', 'x')}, {r('w_s0', 's0')}, {r('sin(w_qw * pi() / 2)', 'qw')}, {r('w_opacity', 'opacity')}, {r('w_c0', 'c0')} FROM d"
    )


SHOWN = ("gid", "frame", "x", "s0", "qw", "opacity", "c0")


def _parts(spark, d):
    rows = tracks(spark, d)
    order = sequence_codec.ranks(rows)
    return rows, bounds.ranges(rows), order, order.count()


@query("S19_sequence_decode", _rows("DOUBLE"))
def _(spark, d):
    """Ranges, ranks, bytes and compressed frames, and from these all splats back."""
    rows, ranges, order, n = _parts(spark, d)
    back = sequence_codec.decoded(sequence_codec.encoded(rows, ranges, order, n), ranges)
    return tidy(back.where("active").join(order, "rank").select(*SHOWN))


@query("S19_frame_decode", _rows("FLOAT") + " WHERE frame BETWEEN 4 AND 6")
def _(spark, d):
    """Frames by index from a container file, whose ranges are 32-bit numbers."""
    rows, ranges, order, n = _parts(spark, d)
    frames = sequence_codec.encoded(rows, ranges, order, n).withColumn("path", F.lit("a"))
    back = sequence_codec.read(sequence_codec.files(frames, ranges), 4, 6)
    return tidy(back.where("active").join(order, "rank").select(*SHOWN))


@query("K9_container_sizes", f"WITH {TRACKS_SQL}, n AS (SELECT count(DISTINCT gid) AS n FROM t WHERE active) SELECT 'a' AS path, n AS n_splats, 12::BIGINT AS n_frames, 3::BIGINT AS n_chunks, 128::BIGINT AS ranges_offset, 240::BIGINT AS chunk_index_offset, 288::BIGINT AS frame_index_offset, 384::BIGINT AS low_offset, true AS covered FROM n")
def _(spark, d):
    """A container made of the splats: its sections follow one another, and its frames cover the video without gaps."""
    from ..sources import container

    rows, ranges, order, n = _parts(spark, d)
    made = sequence_codec.files(sequence_codec.encoded(rows, ranges, order, n).withColumn("path", F.lit("a")), ranges)
    index = container.frame_index(made).groupBy("path").agg((F.max(F.col("offset") + F.col("size")) == F.sum("size")).alias("covered"))
    head = container.headers(spark, made).select("path", "n_splats", "n_frames", "n_chunks", "ranges_offset", "chunk_index_offset", "frame_index_offset", "low_offset")
    return head.join(index, "path")


@query(
    "P2_evaluate_batch",
    f"WITH {TRACKS_SQL}, k AS (SELECT range * 0.3 AS t FROM range(40)), n AS (SELECT t, least(t, 11.0) AS u FROM k), m AS (SELECT t, CAST(floor(u) AS INTEGER) AS a, u - floor(u) AS share FROM n) "
    f"SELECT m.t::DOUBLE AS t, p.gid, {r('p.x + share * (q.x - p.x)', 'x')}, {r('p.c0 + share * (q.c0 - p.c0)', 'c0')} FROM m JOIN t p ON p.frame = m.a JOIN t q ON q.gid = p.gid AND q.frame = least(m.a + 1, 11)",
)
def _(spark, d):
    """A continuous source at many times, in one plan; behind the last frame it stands still."""
    from ..sources.plugins import TableSource

    times = spark.range(40).select((F.col("id") * 0.3).alias("t"))
    out = TableSource(tracks(spark, d), 12).evaluate_batch(times)
    return tidy(out.select("t", "gid", "x", "c0"))


@query("P6_hash_order", f"WITH {TRACKS_SQL} SELECT frame, count(*) AS n, count(*) - 1 AS most, true AS whole FROM t GROUP BY frame")
def _(spark, d):
    """An order by its name gives each row of a frame a place of its own."""
    from ..sources.plugins import ordered

    ranks = ordered(tracks(spark, d).select("frame", "gid", "x", "y", "z"), "hash").withColumn("rank", F.col("rank").cast("bigint"))
    return ranks.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("most"), (F.count_distinct("rank") == F.count(F.lit(1))).alias("whole"))

"""Closed forms, invariants and round trips of operators."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from splatspark.functions import bits, spaces
from splatspark.functions import geometry as g
from splatspark.operators import bounds, edit, filters, matching, palette, payloads, sequences, timeline
from splatspark.plans.views import splats, tracks
from splatspark.sources import container, generated, ply
from splatspark.sources.registry import REGISTRY, Registry, coerced, configured, retry_delay

SF = "/root/testdata/sf0.001"


def test_natural_order(spark):
    names = ["frame_10.ply", "Frame_2.ply", "frame_1.ply", "a", "A1b2", "a1B10", "", "007", "7a", "x"]
    import re

    key = lambda s: [int(p) if p.isdigit() else p.lower() for p in re.split(r"(\d+)", s)]
    rows = spark.createDataFrame([(n,) for n in names], "n string").withColumn("k", bits.natural_key(F.col("n"))).collect()
    assert [r.n for r in sorted(rows, key=lambda r: (r.k, r.n))] == [n for n in sorted(names, key=lambda n: (key(n), n))]


def test_rotations():
    rng = random.Random(1)
    for _ in range(50):
        q = [rng.gauss(0, 1) for _ in range(4)]
        m = g.quaternion_matrix(q)
        assert np.allclose(np.array(m) @ np.array(m).T, np.eye(3))
        back = np.array(g.matrix_quaternion(m))
        unit = np.array(q) / np.linalg.norm(q)
        assert np.allclose(back, unit) or np.allclose(back, -unit)
        v = g.quaternion_axis_angle(q)
        assert np.allclose(g.quaternion_matrix(g.axis_angle_quaternion(v)), m)
        t = g.Transform(tuple(rng.random() for _ in range(3)), (2.0, 0.5, 3.0), tuple(q), (1.0, 2.0, 3.0))
        p = [rng.random() for _ in range(3)]
        assert np.allclose(t.inverse_points(t.points(p)), p)
    assert g.wxyz(g.xyzw((1, 2, 3, 4))) == (1, 2, 3, 4)
    assert np.allclose(g.quaternion_matrix(g.euler_quaternion(0, 0, math.pi / 2)), [[0, -1, 0], [1, 0, 0], [0, 0, 1]])


@pytest.mark.parametrize("shape", [filters.Sphere((0.1, 0.0, 0.0), 0.2), filters.Ellipsoid((0.1, 0.0, 0.0), (0.2, 0.1, 0.3), (0.1, 0.2, 0.3)), filters.Box((-0.1, -0.2, -0.1), (0.2, 0.1, 0.2), (0.3, 0.0, 0.1)), filters.Frustum((0.0, 0.0, 0.6), (0.1, 0.0, 0.0), 0.8, 1.2, 0.2, 0.9)])
def test_filters_are_rewritten_below_transforms(spark, shape):
    s = splats(spark, SF)
    t = g.Transform((0.3, -0.2, 0.1), (1.5, 1.5, 1.5), (0.9, 0.1, 0.2, -0.3), (0.1, 0.2, 0.3))
    world = edit.transformed(s, t).where(shape.predicate())
    local = s.where(filters.to_local(shape, t).predicate())
    want = {r.gid for r in world.collect()}
    assert want == {r.gid for r in local.collect()} and want


def test_edit_closed_form(spark):
    s = edit.activated(splats(spark, SF))
    whole = edit.Edit(transform=g.Transform((1.0, 2.0, 3.0), (1.2, 1.2, 1.2)), colour=edit.Colour(brightness=0.7), opacity=0.6)
    before = {r.gid: r for r in s.collect()}
    for r in whole.apply(s).collect():
        b = before[r.gid]
        assert math.isclose(r.y, 1.2 * b.y + 2, abs_tol=1e-9) and math.isclose(r.s1, 1.2 * b.s1, rel_tol=1e-9) and math.isclose(r.opacity, 0.6 * b.opacity, rel_tol=1e-9)
        assert math.isclose(r.c0 * spaces.SH_C0 + 0.5, 0.7 * (b.c0 * spaces.SH_C0 + 0.5), abs_tol=1e-9) and math.isclose(r.shn[7], 0.7 * b.shn[7], abs_tol=1e-12)
    assert edit.Edit().apply(s).sameSemantics(s)


def test_pushdown(spark):
    plan = filters.apply(splats(spark, SF), filters.opacity_range(low=0.0)).select("gid")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and "Exchange" not in plan


def test_quantisation_error(spark):
    rows = spark.range(2000).select((F.rand(3) * 6 - 2).alias("v"))
    low, high = F.lit(-2.0), F.lit(4.0)
    q = spaces.quantise16(F.col("v"), low, high)
    e8 = F.max(F.abs(F.col("v") - spaces.dequantise8(spaces.quantise8(F.col("v"), low, high), low, high)))
    e16 = F.max(F.abs(F.col("v") - spaces.dequantise16(spaces.high_byte(q), spaces.low_byte(q), low, high)))
    r = rows.agg(e8.alias("a"), e16.alias("b")).first()
    assert r.a <= 6 / 219 / 2 + 1e-12 and r.b <= 6 / 56319 + 1e-12


def test_inactive_rows_don_t_matter(spark):
    t = tracks(spark, SF)
    far = t.withColumn("x", F.when(F.col("active"), F.col("x")).otherwise(1e9))
    assert bounds.ranges(t).collect() == bounds.ranges(far).collect()
    with pytest.raises(Exception, match="finite"):
        filters.require_finite(t.withColumn("x", F.lit(float("nan"))), ("x",)).agg(F.sum("x")).collect()


def test_matching(spark):
    rng = np.random.default_rng(4)
    a, b = rng.random((60, 3)), rng.random((50, 3))
    frame = lambda p, n: spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], f"{n} bigint, x double, y double, z double")
    d2 = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    got = matching.neighbours(frame(a, "cur"), frame(b, "prev"), k=3, width=0.05).collect()
    assert {(r.cur, r.nth): r.prev for r in got} == {(i, n + 1): int(j) for i in range(60) for n, j in enumerate(np.argsort(d2[i], kind="stable")[:3])}
    pairs = matching.matched(frame(a, "cur"), frame(b, "prev"), passes=40, width=0.2).collect()
    assert len({r.cur for r in pairs}) == len({r.prev for r in pairs}) == len(pairs) == 50
    blocks = matching.assigned_blocks(frame(a, "cur").withColumnRenamed("cur", "gid"), [(0.2, 0.2, 0.2), (0.8, 0.8, 0.8), (0.1, 0.9, 0.5)], 20).collect()
    assert len({r.gid for r in blocks}) == 60 and max(sum(r.block == k for r in blocks) for k in range(3)) <= 20


def test_codebook_is_optimal():
    rng = np.random.default_rng(5)
    values = np.sort(rng.normal(size=9))
    counts = np.ones(9)

    def cost(cuts):
        return sum(((p - p.mean()) ** 2).sum() for p in np.split(values, cuts))

    from itertools import combinations

    best = min(cost(list(c)) for c in combinations(range(1, 9), 2))
    book = palette.optimal_codebook(counts, values, 3)
    assert math.isclose(((values[:, None] - book[None]) ** 2).min(axis=1).sum(), best, rel_tol=1e-9)


def test_kmeans_lowers_the_error(spark):
    s = splats(spark, SF).select("gid", "shn")
    start = palette.trained(s, 8, rounds=0)
    done = palette.trained(s, 8, rounds=4)
    error = lambda c: palette.labelled(s, c).agg(F.sum("d2")).first()[0]
    assert error(done) < error(start)


def test_randomised_orders(spark):
    rows = tracks(spark, SF).where("frame < 2").select("frame", "gid", "x", "y", "z")
    cells = payloads.grid_sorted(rows).collect()
    assert all(sorted(r.cell for r in cells if r.frame == f) == list(range(500)) for f in (0, 1))
    assert all(r.after < 0.8 * r.before for r in cells)
    chain = rows.select(F.col("frame").alias("chunk_id"), "gid", F.col("gid").alias("rank"), F.col("x").alias("value"))
    out = payloads.swapped(chain).collect()
    assert all(sorted(r["rank"] for r in out if r.chunk_id == f) == list(range(500)) for f in (0, 1)) and all(r.after < r.before for r in out)


def test_ranks_in_buckets(spark):
    rows = spark.range(500).select("id", (F.col("id") * 37 % 101).alias("v"))
    a = sequences.ranked_in_buckets(rows, [], F.floor(F.col("v") / 10), ["v", "id"]).select("id", "rank")
    assert [r.id for r in a.orderBy("rank").collect()] == sorted(range(500), key=lambda i: (i * 37 % 101, i))


def test_times():
    assert timeline.export_times(0, 2, 1) == [0, 1, 2] and timeline.export_times(1, 1, 1) == [1]
    assert [round(t, 6) for t in timeline.overshooting_times(2, 0, 0.7)] == [0.0, 0.7, 1.4, 2.1]
    for bad in (0, 1e-6):
        with pytest.raises(ValueError):
            timeline.export_times(0, 1, bad)
    assert timeline.TimeDomain(0, 2, True).frames == 60 and timeline.TimeDomain(0, 2).clamp(5) == 2


def test_surrounding_edges(spark):
    times = spark.createDataFrame([(t,) for t in (-1.0, 0.0, 0.5, 1.0, 3.0)], "t double")
    keys = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 1.0), (3, 2.0)], "key bigint, kt double")
    got = {r.t: (r.key_before, r.key_after, r.share) for r in timeline.surrounding(times, keys).collect()}
    assert got == {-1.0: (0, 0, 0.0), 0.0: (0, 0, 0.0), 0.5: (0, 1, 0.5), 1.0: (2, 2, 0.0), 3.0: (3, 3, 0.0)}


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_surrounding_reads_a_bucket_once(spark):
    """All rows in one bucket: frames over them grow row by row. A frame up to the end may stand over the buckets' ends only."""
    rng = random.Random(6)
    times = [(i, rng.choice([None, *range(300)])) for i in range(600)]
    keys = [(i, rng.choice([None, *range(20, 280)])) for i in range(150)]
    t = spark.createDataFrame([(i, x if x is None else x / 4) for i, x in times], "id bigint, t double")
    k = spark.createDataFrame([(i, x if x is None else x / 4) for i, x in keys], "key bigint, kt double")
    for buckets in (1, 256):
        found = timeline.surrounding(t, k, buckets=buckets)
        frames = re.findall(r"(\w+)#\d+L? (?:ASC NULLS FIRST|DESC NULLS LAST), specifiedwindowframe\(RowFrame, (\S+ \S+)", plan(found))
        assert len(frames) == 4 and {x[0] for x in frames if "unboundedfollowing" in x[1]} == {"_bucket"}
        got = {r.id: (r.key_before, r.key_after, r.share) for r in found.collect()}
        known = [(x / 4, i) for i, x in keys if x is not None]
        for i, x in times:
            if x is None:
                assert got[i] == (None, None, 0.0)
                continue
            before, after = [p for p in known if p[0] <= x / 4], [p for p in known if p[0] > x / 4]
            b = max(before) if before else min(after)
            a = b if b[0] == x / 4 or not after else min(after)
            share = 0.0 if a[0] == b[0] else (x / 4 - b[0]) / (a[0] - b[0])
            assert got[i] == (b[1], a[1], share)


def test_nearest_in_one_bucket(spark):
    """A time far off puts all others in one bucket; of two key frames as near, the earlier."""
    t = spark.range(4000).select((F.col("id") / 8).alias("t")).union(spark.createDataFrame([(1e9,), (None,)], "t double"))
    k = spark.range(250).select(F.col("id").alias("key"), (F.col("id") * 2.0).alias("kt"))
    found = timeline.nearest(t, k)
    assert "currentrow$(), unboundedfollowing$()" not in plan(found)
    got = {r.t: r.key for r in found.collect()}
    assert got.pop(1e9) == 249 and got.pop(None) is None
    assert got == {i / 8: min(249, math.ceil(i / 16 - 0.5)) for i in range(4000)}


def test_interpolation_needs_both(spark):
    s = tracks(spark, SF).drop("active").where("frame <> 1 or gid <> 3")
    with pytest.raises(Exception, match="missing"):
        timeline.interpolated(s, 0, 1, 0.5).agg(F.sum("gid")).collect()
    with pytest.raises(ValueError):
        timeline.interpolated(s, 0, 1, 0.5, linear_scales=False)


def test_ply_files(spark, tmp_path):
    s = splats(spark, SF).where("frame < 3")
    path = str(tmp_path / "out")
    REGISTRY.write(s, path, name="ply")
    back = REGISTRY.read(spark, path, name="ply")
    assert {(r.frame, r["count"]) for r in back.groupBy("frame").count().collect()} == {(r.frame, r["count"]) for r in s.groupBy("frame").count().collect()}
    with pytest.raises(Exception):
        ply.write(s, path)  # nothing is overwritten
    with pytest.raises(ValueError):
        ply.parse(b"no")
    with pytest.raises(ValueError):
        ply.write(s.limit(0), path)


def test_container_is_checked():
    from splatspark.plans.codec_queries import _container

    data, low = _container()
    got = dict(container.low_planes(data, container.read_header(data)))
    assert all((got[f] == low[f]).all() for f in range(12))
    for at, value in ((0, 88), (4, 2), (24, 0), (30, 64), (8, 200)):
        bad = bytearray(data)
        bad[at] = value
        with pytest.raises(ValueError):
            container.read_header(bytes(bad))
    with pytest.raises(ValueError):
        container.read_header(data[:50])


def test_registry():
    assert REGISTRY.find("/a/b.PLY").name == "ply"
    with pytest.raises(LookupError):
        Registry().find("x.y")
    assert coerced("1, 2".replace(" ", ""), list[int]) == [1, 2] and coerced("x", int | str) == "x" and coerced(None, int | None) is None
    with pytest.raises(ValueError):
        coerced(1.5, int)
    assert configured(timeline.TimeDomain, {"low": "0", "high": 2, "continuous": "true"}).frames == 60
    assert retry_delay(10, jitter=0) == 30 and 0.75 <= retry_delay(1) <= 1.25


def test_generated_scene_doesn_t_depend_on_partitions(spark):
    a = generated.oscillating(spark, 50, 3).collect()
    b = generated.oscillating(spark, 50, 3).repartition(7).orderBy("gid", "frame").collect()
    assert sorted(a) == sorted(b)


def test_static_track_is_checked():
    data = container.make_static_track(9, 3, np.zeros(1, container.RANGES), b"l" * 27, b"video", masks=True)
    assert container.static_track(data)["video"] == b"video"
    for at, value in ((0, 65), (4, 2), (8, 200), (16, 5), (20, 64), (24, 65), (48, 9)):
        bad = bytearray(data)
        bad[at] = value
        with pytest.raises(ValueError):
            container.static_track(bytes(bad))
    with pytest.raises(ValueError):
        container.static_track(data[:100])


def test_frame_ranges():
    assert timeline.clamped_range(None, 0, 5) == (0, 0) and timeline.clamped_range(-3, 99, 5) == (0, 4)
    with pytest.raises(ValueError):
        timeline.clamped_range(7, 9, 5)

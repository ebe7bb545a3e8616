from pyspark.sql import functions as F

from splatspark.plans.views import table
from splatspark.streaming import streams

SF = "/root/testdata/sf0.001"


def test_breaker_stream_equals_batch(spark):
    batch = streams.breaker_batch(table(spark, SF, "events")).collect()
    assert sorted(batch) == sorted(streams.drained(streams.breaker_stream(streams.event_stream(spark, SF)), "append").collect())
    assert {r.state for r in batch} <= {"open", "closed", "half_open"}


def test_breaker_states():
    b, state, met = streams.Breaker(2, 1, 10.0), streams.START, []
    for failed, t in ((True, 0), (True, 1), (True, 5), (False, 20), (True, 21), (True, 22)):
        state, m = b.step(state, failed, t)
        met.append((m, state[0]))
    assert met == [("closed", "closed"), ("closed", "open"), ("open", "open"), ("half_open", "closed"), ("closed", "closed"), ("closed", "open")]


def test_sessions(spark):
    got = streams.drained(streams.sessions(streams.event_stream(spark, SF)), "append")
    assert got.agg(F.sum("n")).first()[0] <= table(spark, SF, "events").count()


def test_matcher_is_a_permutation(spark):
    e = streams.event_stream(spark, SF)
    frames = e.select(F.lit(1).cast("bigint").alias("scene"), F.floor(F.col("event_id") / 50).cast("int").alias("frame"), F.lit(0).alias("chunk_id"), F.col("event_id").alias("gid"), F.col("value").alias("x"), (F.col("user_id") % 10).cast("double").alias("y"), F.lit(0.0).alias("z"))
    rows = streams.drained(streams.matcher_stream(frames), "append").collect()
    for f in {r.frame for r in rows}:
        assert sorted(r.slot for r in rows if r.frame == f) == list(range(50))


def test_matching_in_space():
    import numpy as np

    from splatspark.streaming.streams import claimed, conformed, nearest

    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (40, 60), (60, 40), (30, 30)):
        # Few values on each axis, so that there are ties.
        a, b = rng.integers(0, 5, (n, 3)).astype(float), rng.integers(0, 5, (m, 3)).astype(float)
        d2 = ((a[:, None] - b[None]) ** 2).sum(axis=2)
        who, best = nearest(a, b)
        assert who.tolist() == d2.argmin(axis=1).tolist() and best.tolist() == d2.min(axis=1).tolist()
        want, free = {}, set(range(m))
        for _ in range(10):
            claims = {}
            for i in range(n):
                if i not in want and free:
                    slot = min(free, key=lambda j: (d2[i, j], j))
                    claims[slot] = min(claims.get(slot, (np.inf, n)), (d2[i, slot], i))
            want |= {i: slot for slot, (_, i) in claims.items()}
            free -= set(claims)
        assert claimed(a, b).tolist() == [want.get(i, -1) for i in range(n)]
        chosen, slots, active = conformed(a, b, rng.random(m) < 0.7)
        assert len(set(chosen)) == n and active.sum() == n and len(slots) == max(n, m)
        assert (slots[chosen] == a).all()
        left = np.setdiff1d(np.arange(m), chosen)
        assert (slots[left] == b[left]).all() and not active[left].any()

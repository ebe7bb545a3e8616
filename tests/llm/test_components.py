import random

import numpy as np
import pytest

from splatspark.llm import components


def links(seed=3):
    """Paths, stars, rings and loose pairs among scattered numbers; loops, repeats, both directions and nulls."""
    rng = random.Random(seed)
    names = [rng.getrandbits(63) - (1 << 62) for _ in range(400)]
    pairs = [(names[i], names[i + 1]) for i in range(150)] + [(names[200], names[i]) for i in range(201, 260)]
    pairs += [(names[i], names[(i + 1) % 40 + 300]) for i in range(300, 340)] + [(names[i], names[i + 1]) for i in range(350, 399, 2)]
    pairs += [(b, a) for a, b in pairs[::3]] + pairs[::5] + [(names[0], names[0])]
    rng.shuffle(pairs)
    return pairs


def plain(pairs):
    label = {x: x for p in pairs if p[0] != p[1] for x in p}
    while moved := [(a, b) for a, b in pairs if a != b and label[a] != label[b]]:
        for a, b in moved:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("task_links, broadcast_links", [(500_000, 500_000), (-1, 500_000), (-1, -1)])
def test_labels(spark, monkeypatch, task_links, broadcast_links):
    monkeypatch.setattr(components, "TASK_LINKS", task_links)
    monkeypatch.setattr(components, "BROADCAST_LINKS", broadcast_links)
    pairs = links()
    table = spark.createDataFrame([*pairs, (None, 1), (None, None)], "a bigint, b bigint").repartition(5)
    rows = components.component_labels(table).collect()
    assert {r.vertex: r.label for r in rows} == plain(pairs) and len(rows) == len(plain(pairs))
    assert components.component_labels(table.limit(0)).count() == 0


def test_few_links_are_not_shuffled(spark, monkeypatch):
    """Each round of stars was some five shuffles, whatever the number of links."""
    monkeypatch.setattr(components, "_large_star", lambda *a: pytest.fail("a round of stars"))
    table = spark.createDataFrame(links(), "a bigint, b bigint")
    assert {r.vertex: r.label for r in components.component_labels(table).collect()} == plain(links())


def test_least_reachable():
    rng = np.random.default_rng(4)
    for n in (1, 30, 300, 3000):
        a, b = rng.integers(-n, n, (2, n))
        vertices, labels = components.least_reachable(a, b)
        want = plain(list(zip(a.tolist(), b.tolist())))
        got = dict(zip(vertices.tolist(), labels.tolist()))
        assert all(got[x] == want.get(x, x) for x in got) and set(want) <= set(got)

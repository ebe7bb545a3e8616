import re

import numpy as np
import pytest
import xxhash
from texts import frame, rows

from splatspark.llm import components, simhash
from splatspark.llm.components import component_labels


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(pairs):
    """pairs: (id, fingerprint); the least id reachable, by repeated relabelling."""
    fps = np.array([f for _, f in pairs], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    ids = np.array([np.inf if i is None else i for i, _ in pairs])
    while True:
        least = np.where(near, ids[None, :], np.inf).min(axis=1)
        if (least == ids).all():
            return ids.tolist()
        ids = least


def test_against_brute_force(spark):
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(frame(spark)).collect()), key=str)
    pairs = [(r[0], plain_fingerprint(r[1])) for r in rows()]
    want = sorted(((i, simhash._signed(f), None if c == np.inf else int(c)) for (i, f), c in zip(pairs, plain_components(pairs))), key=str)
    assert got == want


@pytest.mark.parametrize("shard_rows, broadcast_links", [(4096, 500_000), (40, -1)])
def test_dense_groups(spark, monkeypatch, shard_rows, broadcast_links):
    """Chains and clusters of fingerprints, shards cut into chunks, and links too many to broadcast."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(components, "BROADCAST_LINKS", broadcast_links)
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = {int(x) for x in seeds} | {0}
    for s in seeds[:3]:
        x = int(s)
        for _ in range(150):
            x ^= 1 << int(rng.integers(64))
            fps.add(x)
            fps.add(int(s) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    fps = sorted(fps)
    frame_ = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp bigint")
    links = simhash.fingerprint_links(frame_)
    label = {r.vertex: r.label for r in component_labels(links).collect()}
    pairs = list(enumerate(fps))
    want = plain_components(pairs)
    mine = [label.get(simhash._signed(f), simhash._signed(f)) for f in fps]
    assert len(set(mine)) == len(set(want)) == len(set(zip(mine, want)))


def test_vantage_tree_matches_pairs():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fps = np.unique(np.concatenate([centre[i % 4 : i % 4 + 1] ^ (np.uint64(1) << rng.integers(0, 64, 1).astype(np.uint64)) for i in range(3000)] + [rng.integers(0, 2**63, 1500, dtype=np.uint64)]))
    forest = simhash._Forest()
    simhash.link_shard(fps, 4, forest)
    want = plain_components(list(enumerate(fps.tolist())))
    mine = [forest.root(x) for x in fps.tolist()]
    assert len(set(mine)) == len(set(want)) == len(set(zip(mine, want)))


def test_more_blocks_for_more_rows():
    assert [simhash._blocks(n, 4) for n in (10, 10**6, 10**9, 10**12)] == [5, 6, 7, 8]
    assert all(len({bin(m).count("1") for m in simhash._masks(n, 4)}) <= 4 for n in (5, 6, 7, 8))


def test_one_of_each_group(spark):
    docs = frame(spark)
    kept = simhash.one_of_each_group(docs, 4)
    assert kept.columns == docs.columns
    pairs = [(r[0], plain_fingerprint(r[1])) for r in rows()]
    want = [i for (i, _), c in zip(pairs, plain_components(pairs)) if i is None or i == c]
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in kept.collect())
    assert simhash.one_of_each_group(frame(spark, []), 4, broadcast_rows=-1).count() == 0
    assert sorted(str(r.doc_id) for r in simhash.one_of_each_group(docs, 4, broadcast_rows=-1).collect()) == sorted(map(str, want))

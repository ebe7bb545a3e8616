import random

from texts import SCHEMA, frame, rows

from splatspark.llm import near_copies, simhash


def similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (x or "").lower().split()) else set() for x in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_components(data):
    label = {d[0]: d[0] for d in data}
    near = [(a[0], b[0]) for i, a in enumerate(data) for b in data[:i] if similarity(a[1], b[1]) >= 0.8]
    while moved := [(a, b) for a, b in near if label[a] != label[b]]:
        for a, b in moved:
            label[a] = label[b] = min(label[a], label[b])
    return label


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"e{rng.randrange(10**6)}"
    return out


def near_rows(seed=3):
    """Groups at all similarities about 0.8, chains, and texts that share a half."""
    rng, texts = random.Random(seed), []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(5000)}" for _ in range(rng.choice([60, 200, 700]))]
        texts += [" ".join(edited(rng, base, len(base) * k // 200)) for k in range(0, 10)]
        texts += [" ".join(base[: len(base) // 2] + [f"h{rng.randrange(5000)}" for _ in base[: len(base) // 2]]) for _ in range(4)]
        for _ in range(6):
            base = edited(rng, base, len(base) // 60)
            texts.append(" ".join(base))
    rng.shuffle(texts)
    return [(i, t, "en", "s", len(t), "x", "y", "z") for i, t in enumerate(texts)]


def test_against_brute_force(spark):
    for data in (near_rows(), [r for r in rows() if r[0] is not None]):
        got = {r.doc_id: r.component_id for r in near_copies.components(frame(spark, data).repartition(5), broadcast_rows=0).collect()}
        assert got == plain_components(data)


def test_one_of_each_group_drops_near_copies(spark):
    """At a similarity of about 0.87 fingerprints of 64 bits are more than four bits apart."""
    rng = random.Random(1)
    docs = []
    for g in range(20):
        base = [f"g{g}w{rng.randrange(9000)}" for _ in range(400)]
        docs += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[:380] + [f"e{i}" for i in range(20)]))]
    data = [(i, t, "en", "s", len(t), "x", "y", "z") for i, t in docs] + [(None, docs[0][1], *[None] * 6)]
    kept = simhash.one_of_each_group(spark.createDataFrame(data, SCHEMA))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == list(range(0, 40, 2))
    assert kept.where("doc_id is null").count() == 1
    assert simhash.one_of_each_group(frame(spark, [])).count() == 0


def test_sets_of_a_slice_are_those_of_each_text():
    texts = [r[1].encode() for r in near_rows()[:20]] + [b"", b"  ", b"a b c", b"a b c d e", b"a a a a a a a a"]
    shingles, counts = near_copies.shingle_sets(texts)
    keys = near_copies.band_keys(shingles, counts)
    assert counts[20:].tolist() == [0, 0, 1, 1, 1] and len(keys) == len(texts) - 2
    at = 0
    for i, text in enumerate(texts):
        alone, n = near_copies.shingle_sets([text])
        assert alone.tolist() == shingles[at : at + counts[i]].tolist() == sorted(set(alone.tolist()))
        at += counts[i]
        if n[0]:
            assert (near_copies.band_keys(alone, n)[0] == keys[i - 2 * (i > 20)]).all()


def test_simhash_of_sets():
    texts = [r[1].encode() for r in near_rows()[:20]] + [b"", b"a b c", b"a a a a a a a a"]
    shingles, counts = near_copies.shingle_sets(texts)
    got, at = near_copies.set_fingerprints(shingles, counts), 0
    for i, n in enumerate(counts.tolist()):
        mine = [int(x) for x in shingles[at : at + n]]
        assert int(got[i]) == sum(1 << b for b in range(64) if n and 2 * sum(x >> b & 1 for x in mine) > n)
        at += n


def test_groups_come_through_simhash(spark, monkeypatch):
    """Fingerprints are linked through vantage-point shards first; their groups are compared exactly, and sets that are less similar stay apart."""
    linked, pairs, compared = [], [], near_copies._compared
    links = simhash.fingerprint_links
    monkeypatch.setattr(simhash, "fingerprint_links", lambda *a: linked.append(a) or links(*a))
    monkeypatch.setattr(near_copies, "_compared", lambda found, *a: pairs.append(found.count()) or compared(found, *a))
    rng = random.Random(9)
    base = [f"w{rng.randrange(9000)}" for _ in range(2000)]
    docs = [" ".join(edited(rng, base, k)) for k in (0, 1, 2, 3)] + [f"a{i} b c d e f" for i in range(5)]
    data = [(i, t, "en", "s", len(t), "x", "y", "z") for i, t in enumerate(docs)]
    kept = simhash.one_of_each_group(frame(spark, data))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 4, 5, 6, 7, 8]
    assert len(linked) == 1 and pairs[0] >= 3

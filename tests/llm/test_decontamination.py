import hashlib
import random
import re

import pytest
from texts import SCHEMA

from splatspark.llm import decontamination


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items):
    words = words_of(text)
    hit, of = set(), set()
    for item, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - 12)) if w and item is not None else ():
            win = w[k : k + 13]
            for i in range(len(words) - len(win) + 1):
                if words[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    of.add(str(item))
    return (len(words), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words))


def tables():
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["Ab", "c", "é", "x1", "of"]) + str(rng.randrange(9)) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([30, 13, 14, 5, 1, 0, 40, 40])] + [(10, "Zz yy?"), (11, "zz YY"), (12, None), (None, "lost item")]
    items.append((20, items[0][1]))
    docs = [None, "", "--", "zz, yy", "zz yyy"]
    for i, (_, t) in enumerate(items):
        docs.append(text(50) + " -- " + (t or "").replace(" ", ", ").upper().replace("É", "é") + "! " + text(20 * i))
        w = (t or "").split()
        docs.append(text(5) + " " + " ".join(w[:12]) + " q " + " ".join(w[3:20]) + " " + text(400))
    data = [(i, t, None, None, None, "a", "b", "c") for i, t in enumerate(docs)]
    return data + [data[5], (None, "zz yy", None, None, None, None, None, None)], items


@pytest.mark.parametrize("block", [1 << 20, 300, 60])  # one automaton, a few, several passes
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "AUTOMATON_BYTES", block)
    data, items = tables()
    docs = spark.createDataFrame(data, SCHEMA)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.contamination_report(docs, bench).collect())
    assert got == sorted((str(d[0]), *plain(d[1], items)) for d in data)
    kept = decontamination.decontaminated(docs, bench)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d[0]) for d in data if not plain(d[1], items)[-1])


def test_offsets_are_of_the_original(spark):
    text = "Ünder: A,b!! C d e f g h i j k l m? tail"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    bench = spark.createDataFrame([("q", "a b c d e f g h i j k l m")], "item_id string, text string")
    row = decontamination.contamination(docs, bench).first()
    span = row.spans[0]
    assert text.encode()[span.from_byte : span.to_byte].decode() == "A,b!! C d e f g h i j k l m"
    assert (span.first, span.beyond, row["items"]) == (1, 14, ["q"])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in decontamination.contamination_report(docs, none).collect()] == [(2, 0, False)]
    assert decontamination.contamination_report(docs.limit(0), none).count() == 0
    assert decontamination.decontaminated(docs, none).count() == 1


def test_passes_hold_each_item_once_and_automata_are_kept(spark, monkeypatch):
    _, items = tables()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontamination, "AUTOMATON_BYTES", 60)
    passes = list(decontamination._passes(bench))
    assert len(passes) > 2 and [more for _, more in passes] == [True] * (len(passes) - 1) + [False]
    assert sorted(i for blocks, _ in passes for b in blocks for i, _ in b) == sorted(str(i) for i, t in items if i is not None and t is not None)
    built = []
    monkeypatch.setattr(decontamination, "Patterns", lambda block: built.append(block) or len(built))
    monkeypatch.setattr(decontamination, "_built", {})
    for blocks, _ in passes[:2]:
        for _ in range(5):  # batches
            [decontamination.patterns(b) for b in blocks]
    assert len(built) == sum(len({repr(b) for b in blocks}) for blocks, _ in passes[:2]) and len(decontamination._built) <= decontamination.KEPT

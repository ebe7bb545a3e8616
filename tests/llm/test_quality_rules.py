import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from texts import frame, rows

from splatspark.llm.quality_rules import Rules, measures, quality_filter, quality_measures, repeats


def plain(text, rules=Rules()):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    hit = {j for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    reach = [0] * n
    places = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    for i in range(n):
        for j in places[words[i]]:
            if i != j:
                k = reach[i]  # only a longer one counts
                if i + k < n and j + k < n and words[i : i + k + 1] == words[j : j + k + 1]:
                    while i + k < n and j + k < n and words[i + k] == words[j + k]:
                        k += 1
                    reach[i] = k
    cover = {j for i in range(n) if reach[i] >= rules.min_repeat for j in range(i, i + reach[i])}
    longest = max([0, *(r for r in reach if r >= 3)])
    base = n < rules.min_words or 100 * len(hit) > rules.max_repeat_percent * n
    bad = len(cover) > rules.max_covered * n or (longest > rules.long_repeat and longest > rules.max_longest * n)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(cover), longest, base, not (base or bad))


KEYS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "base_failed", "kept")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aAb \n#É", max_size=80), min_size=1, max_size=4))
def test_any_texts(texts):
    rules = Rules(min_words=5, min_repeat=4, long_repeat=5)
    got = measures([t.encode() for t in texts], rules)
    for i, t in enumerate(texts):
        assert tuple(got[k][i] for k in KEYS) == plain(t, rules)


def test_table(spark):
    data = rows() + [(900, "The cat sat. the cat sat. THE CAT SAT. " * 40, *[None] * 6), (901, " ".join(f"z{i * i % 977}" for i in range(9000)), *[None] * 6)]
    got = sorted((str(r.doc_id), *(r[k] for k in KEYS)) for r in quality_measures(frame(spark, data)).collect())
    assert got == sorted((str(r[0]), *plain(r[1])) for r in data)
    kept = quality_filter(frame(spark, data))
    assert kept.columns == frame(spark, data).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in data if plain(r[1])[-1])
    assert quality_measures(frame(spark, [])).count() == 0


def test_long_repeat_is_measured():
    passage = " ".join(f"p{i}" for i in range(700))
    rest = " ".join(f"q{i}" for i in range(1500))
    got = measures([f"{passage} x {rest} {passage}".encode()], Rules())
    assert got["longest_repeat"][0] == 700 and got["covered_words"][0] == 1400 and got["n_maximal_repeats"][0] == 2
    assert not got["base_failed"][0] and not got["kept"][0]


def test_more_than_a_million_different_words():
    passage = [b"p%d" % i for i in range(60)]
    text = b" ".join(passage + [b"%d" % i for i in range((1 << 20) + 10)] + passage)
    got = measures([text], Rules())
    assert [int(got[k][0]) for k in ("n_words", "longest_repeat", "covered_words", "n_repeat_words")] == [(1 << 20) + 130, 60, 120, 120]
    rng = np.random.default_rng(1)
    words, docs = rng.integers(1, 6, 3000), np.repeat(np.arange(3), 1000)
    few, many = (repeats(w, docs, 4) for w in (words, words + (1 << 20)))
    assert all((few[k] == many[k]).all() for k in few)

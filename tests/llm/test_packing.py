import zlib
from itertools import groupby

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from texts import frame, rows
from tokenizers import Tokenizer

from splatspark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text(alphabet="abÉéß'sİΣﬁ́  \u0085\x0b\x1c\n.,!<|>1", max_size=60), max_size=5))
def test_ids_are_those_of_the_tokenizer(texts):
    want = [packing.encoder(PATH).tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x, _ in packing.encoder(PATH).encode([t.encode() for t in texts])] == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdefghilmnoprstuéèß'’.,!?\"()0123456789-", min_size=1, max_size=24))
def test_ids_of_words(word):
    assert packing.encoder(PATH)._chunk_ids(word.lower().encode()) == packing.encoder(PATH).tokenizer.encode(word, add_special_tokens=False).ids


def test_ids_of_the_whole_vocabulary():
    own = packing.encoder(PATH)
    words = [t.removesuffix("</w>") for t in own.tokenizer.get_vocab() if t.removesuffix("</w>").isascii() and t.removesuffix("</w>").isalpha()]
    words += [a + b for a, b in zip(words, reversed(words))]
    want = own.tokenizer.encode_batch(words, add_special_tokens=False)
    assert [own.merged(w.lower().encode() + packing.WORD_END) for w in words] == [x.ids for x in want]


def test_sentence_ends():
    text = "First one. Pi is 3.14 here! E.g. this, by J. Smith? He said \"no.\" End"
    (ids, ends), (whole, whole_ends) = packing.encoder(PATH).encode([text.encode(), (text + " <| xy.").encode()])
    parts = [packing.encoder(PATH).tokenizer.decode(ids[a:b].tolist()) for a, b in zip([0, *ends], [*ends, len(ids)])]
    assert [p.replace(" ", "").replace("</w>", "") for p in parts] == ["firstone.", "piis3.14here!", "e.g.this,byj.smith?", 'hesaid"no."', "end"]
    assert whole_ends.tolist() == [*ends.tolist(), len(whole)] and whole[: len(ids)].tolist() == ids.tolist()


def test_a_small_cache_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 40)
    own = packing.Encoder(PATH)
    for k in range(6):
        texts = [" ".join(f"word{(i * i + 7 * k) % 61} the, Éa!! x###" for i in range(30)), "", "a b\x1cc it's '"]
        want = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x, _ in own.encode([t.encode() for t in texts])] == want
        assert len(own.number) <= 40 + 100


def check(got, data, size):
    tokenizer = Tokenizer.from_file(PATH)
    want = {}
    for r in data:
        want.setdefault(r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1])
    assert {r.doc_id for r in got} == set(want)
    by_doc = sorted(got, key=lambda r: (str(r.doc_id), r.start))
    for doc, parts in groupby(by_doc, key=lambda r: r.doc_id):
        if [x[0] for x in data].count(doc) > 1:
            continue
        ids, at = want[doc], 0
        for p in parts:
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for _, parts in groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for p in parts:
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == p.sequence_tokens <= size and p.padding == packing.padding(at, size)


@pytest.mark.parametrize("size", [2048, 64])
@pytest.mark.parametrize("block", [1 << 18, 500])
def test_every_id_lies_in_one_piece(spark, monkeypatch, size, block):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", block)
    data = rows()
    got = packing.packed(frame(spark).coalesce(2), PATH, size=size).collect()
    check(got, data, size)
    per = {r.sequence_id: r for r in got}
    assert sum(r.padding for r in per.values()) < 0.05 * sum(r.sequence_tokens for r in per.values()) + 4 * size


def test_empty(spark):
    assert packing.packed(frame(spark, []), PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 8), st.integers(0, 9)), min_size=1, max_size=12), st.sampled_from([8, 10, 16]), st.booleans())
def test_cuts_are_the_best(steps, size, open_end):
    places = np.cumsum([a for a, _ in steps]).tolist()
    penalty = [p for _, p in steps]

    def cost(cuts):
        at = [0, *cuts]
        if any(b - a > size for a, b in zip(at, at[1:])):
            return None
        return sum(packing.padding(b - a, size) + penalty[places.index(b)] for a, b in list(zip(at, at[1:]))[: len(cuts) - open_end])

    every = [[p for i, p in enumerate(places[:-1]) if m >> i & 1] + places[-1:] for m in range(1 << (len(places) - 1))]
    best = min(c for c in map(cost, every) if c is not None)
    assert cost(packing.best_cuts(places, penalty, size, open_end)) == best


def test_cuts_lie_at_sentence_or_document_ends():
    """But for stretches longer than a sequence."""
    ends, sentences = np.array([50, 130, 400]), np.array([10, 30, 60, 90, 129])
    places, penalty = packing.candidate_cuts(ends, sentences, size=64, stride=32)
    assert places.tolist() == [10, 30, 50, 60, 90, 129, 130, *range(162, 400, 32), 400]
    assert penalty.tolist() == [4, 4, 0, 4, 4, 4, 0, *[24] * 8, 0]
    places, _ = packing.candidate_cuts(ends, sentences, size=512)
    assert places.tolist() == sorted({*ends.tolist(), *sentences.tolist()})

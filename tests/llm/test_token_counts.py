import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from texts import frame, rows

from splatspark.llm import token_counts as tc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
OF = tc.counter(RANKS, public_tokenizers.PATTERN)
TEXT = st.text(alphabet="ab  \n\n's1.É", max_size=40)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 60), st.integers(0, 20), TEXT), max_size=5), st.sampled_from([1, 2, 5, 128]))
def test_edits_count_as_a_full_recount(text, edits, block):
    old, tc.BLOCK = tc.BLOCK, block
    try:
        tree = tc.TokenTree(text, OF)
        for start, length, new in edits:
            tree.edit(start, start + length, new)
            start = min(start, len(text))
            text = text[:start] + new + text[start + length :]
            assert tree.text() == text
            assert (tree.n_chars, tree.n_tokens) == (len(text), len(OF.encoding.encode_ordinary(text)))
    finally:
        tc.BLOCK = old


def test_a_long_text_is_recounted_in_part():
    text = "".join(f"word{i} " for i in range(20_000))
    tree = tc.TokenTree(text, OF)
    tree.edit(70_000, 70_010, "new words, here")
    text = text[:70_000] + "new words, here" + text[70_010:]
    assert tree.n_tokens == len(OF.encoding.encode_ordinary(text)) and tree.recounted < 400


def test_table(spark):
    docs = tc.sample_edits(frame(spark))
    edits = {r.doc_id: r.edits for r in docs.collect()}
    got = {r.doc_id: r for r in tc.edited_counts(docs, RANKS, public_tokenizers.PATTERN).collect()}
    for r in rows():
        if r[0] is None:
            continue
        text = r[1] or ""
        assert got[r[0]].n_tokens == len(OF.encoding.encode_ordinary(text))
        for e in edits[r[0]]:
            text = text[: e.start] + e.new + text[e.start + e.length :] if e.start <= len(text) else text + e.new
        assert (got[r[0]].chars_after, got[r[0]].tokens_after) == (len(text), len(OF.encoding.encode_ordinary(text)))
    assert tc.edited_counts(tc.sample_edits(frame(spark, [])), RANKS, public_tokenizers.PATTERN).count() == 0

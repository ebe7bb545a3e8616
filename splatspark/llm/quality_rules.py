"""Quality rules with a word-level suffix array per document.

A batch of documents is one array of word numbers. Suffixes are ranked by prefix doubling over the
batch, never across a document's end, and only suffixes whose prefix still repeats in their own
document are sorted again. Neighbouring suffixes give the longest common prefixes; where one
can't be extended to the left it begins a maximal repeated substring. The union of the repeats'
spans gives the covered fraction, the greatest prefix the longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class Rules:
    """A document is kept if it has ``min_words`` words, at most ``max_repeat_percent`` of them in
    repeated three-word windows, at most ``max_covered`` of them inside repeats of ``min_repeat`` words
    or more, and no repeat longer than both ``long_repeat`` words and ``max_longest`` of the document."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_repeat: int = 10
    max_covered: float = 0.5
    long_repeat: int = 50
    max_longest: float = 0.2


COLUMNS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "covered_words bigint, longest_repeat bigint, n_maximal_repeats bigint, base_failed boolean, kept boolean"
)


def _repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def _union(starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """For each of ``size`` places, whether a span covers it."""
    edges = np.bincount(starts, minlength=size + 1).astype(np.int64)
    edges -= np.bincount(starts + lengths, minlength=size + 1)
    return np.cumsum(edges)[:size] > 0


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``keys`` and, for each place in it, the place where its run of equal keys begins."""
    order = np.argsort(keys, kind="stable")
    head = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
    return order, np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))


def repeats(words: np.ndarray, docs: np.ndarray, min_repeat: int) -> dict[str, np.ndarray]:
    """Per document of a batch: words in repeated three-word windows, words in repeats of ``min_repeat`` or
    more, the longest repeat, and occurrences of maximal repeats.

    ``words``: numbers from 1, under 2**31; ``docs``: ascending document numbers from 0.
    """
    n, m = len(words), int(docs[-1]) + 1 if len(docs) else 0
    out = {k: np.zeros(m, np.int64) for k in ("window", "covered", "longest", "maximal")}
    if not n:
        return out
    ends = np.searchsorted(docs, np.arange(m), side="right")
    left = ends[docs] - np.arange(n)  # words from here to the document's end
    padded = np.concatenate((words.astype(np.int64), [0, 0]))
    one, two = np.where(left > 1, padded[1 : n + 1], 0), np.where(left > 2, padded[2 : n + 2], 0)
    if padded.max() < 1 << 20:
        keys = padded[:n] << 40 | one << 20 | two
    else:  # three numbers don't fit: pairs are ranked first
        order, heads = _ranked(padded[:n] << 32 | one)
        keys = np.empty(n, np.int64)
        keys[order] = heads
        keys = keys << 32 | two
    order, heads = _ranked(keys)
    gram = np.empty(n, np.int64)
    gram[order] = heads
    order, heads = _ranked(docs.astype(np.int64) << 32 | gram)
    rank = np.empty(n, np.int64)
    rank[order] = heads
    group = np.bincount(heads, minlength=n)
    again = group[rank] > 1
    active = np.flatnonzero(again & (left >= 3))
    if not len(active):
        return out
    out["window"] += np.bincount(docs[_union(active, np.full(len(active), 3), n)], minlength=m)
    # Doubling: ranks by the first h words, for the suffixes whose first h words repeat.
    levels, h = [rank], 3
    while len(active):
        behind = np.where(left[active] > h, rank[np.minimum(active + h, n - 1)], -1)
        order = np.lexsort((behind, rank[active]))
        active, behind = active[order], behind[order]
        old = rank[active]
        first = np.concatenate(([True], old[1:] != old[:-1]))
        new = first | np.concatenate(([True], behind[1:] != behind[:-1]))
        at = np.arange(len(active))
        rank = rank.copy()
        rank[active] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
        h *= 2
        sizes = np.diff(np.append(np.flatnonzero(new), len(active)))
        active = active[np.repeat(sizes > 1, sizes) & (left[active] >= h)]
        levels.append(rank)
    # Neighbours in suffix order, and how far they agree.
    some = np.flatnonzero(again & (left >= 3))
    some = some[np.argsort(levels[-1][some], kind="stable")]
    i, j = some[:-1], some[1:]
    same = levels[0][i] == levels[0][j]
    i, j = i[same], j[same]
    common = np.zeros(len(i), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        step, a, b = 3 << level, i + common, j + common
        fits = (left[i] - common >= step) & (left[j] - common >= step)
        fits &= levels[level][np.minimum(a, n - 1)] == levels[level][np.minimum(b, n - 1)]
        common[fits] += step
    for _ in range(2):  # what is left of a step of three
        a, b = i + common, j + common
        fits = (left[i] > common) & (left[j] > common)
        fits &= padded[np.minimum(a, n)] == padded[np.minimum(b, n)]
        common[fits] += 1
    longest = np.zeros(n + 1, np.int64)
    np.maximum.at(longest, i, common)
    np.maximum.at(longest, j, common)
    np.maximum.at(out["longest"], docs, longest[:n])
    starts = np.flatnonzero(longest[:n] >= min_repeat)
    if len(starts):
        out["covered"] += np.bincount(docs[_union(starts, longest[starts], n)], minlength=m)
        extends = (starts > 0) & (docs[starts - 1] == docs[starts]) & (longest[starts - 1] == longest[starts] + 1)
        out["maximal"] += np.bincount(docs[starts[~extends]], minlength=m)
    return out


def measures(texts: list[bytes], rules: Rules) -> dict[str, list | np.ndarray]:
    """The columns of COLUMNS for a list of texts of bounded size together."""
    words = [x.split() for x in texts]  # as they are: case tells words apart
    counts = np.fromiter(map(len, words), np.int64, len(words))
    numbers: dict[bytes, int] = {}
    number = [numbers.setdefault(w, len(numbers) + 1) for x in words for w in x]
    found = repeats(np.array(number, np.int64), np.repeat(np.arange(len(texts)), counts), rules.min_repeat)
    found = {k: np.concatenate((v, np.zeros(len(texts) - len(v), np.int64))) for k, v in found.items()}
    base_failed = (counts < rules.min_words) | (100 * found["window"] > rules.max_repeat_percent * counts)
    method_failed = (found["covered"] > rules.max_covered * counts) | (
        (found["longest"] > rules.long_repeat) & (found["longest"] > rules.max_longest * counts)
    )
    return {
        "n_words": counts,
        "word_chars": [len(x.translate(None, BLANKS).decode("utf-8", "replace")) for x in texts],
        "n_symbols": [len(x) - len(x.translate(None, SYMBOLS)) for x in texts],
        "n_dup_lines": [_repeated_lines(x) for x in texts],
        "n_repeat_words": found["window"],
        "covered_words": found["covered"],
        "longest_repeat": found["longest"],
        "n_maximal_repeats": found["maximal"],
        "base_failed": base_failed,
        "kept": ~(base_failed | method_failed),
    }


def _measured(batch: pa.RecordBatch, column: int, rules: Rules) -> pa.RecordBatch:
    parts = [measures(texts, rules) for _, _, texts in text_slices(batch.column(column))]
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([p[k] for p in parts]) if parts else [], pa.bool_() if k in ("base_failed", "kept") else pa.int64()) for k in names],
        names=names,
    )


def quality_measures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per row of ``docs``: its id and COLUMNS. A null or empty text has no words and fails the base rule;
    repeated rows are measured each; a very long text is a slice of its own and measured whole; an empty table gives an empty one; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = _measured(batch, 1, rules)
            yield pa.RecordBatch.from_arrays([batch.column(0), *got.columns], names=["doc_id", *got.schema.names])

    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"doc_id bigint, {COLUMNS}")


def quality_filter(docs: DataFrame, text_column: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; one pass, no shuffle.

    Null and empty texts have no words and go; repeated rows, rows with nulls in other columns and very long texts are judged each
    on the whole text; an empty table gives an empty one.
    """
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.fill_null(_measured(batch, at, rules).column("kept"), False))

    return docs.mapInArrow(run, docs.schema)

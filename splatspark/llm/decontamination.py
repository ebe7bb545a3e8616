"""Benchmark decontamination with one Aho-Corasick automaton.

The automaton holds every 13-word window of every normalised benchmark item (an item of fewer words is one
window), over an alphabet of one letter per different benchmark word. A document is normalised to words, every
word to its letter, and scanned once; places are mapped back to byte offsets of the original text.

The benchmark is the query set, not the corpus. Up to ``AUTOMATON_BYTES`` of its text are one automaton; a larger benchmark is dealt into blocks of
about that size with an automaton each. Up to ``KEPT`` of them are built once in a worker process and kept, and a text is read once and scanned by
all. Beyond that the documents go through several passes of KEPT blocks each, with a checkpoint between, so that the memory of
driver and workers is bounded at any size of the benchmark; the hits of all passes are united per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import TERM_TABLE, checkpointed, term_words, text_slices

WINDOW = 13
AUTOMATON_BYTES = 1 << 20
KEPT = 4

Items = list[tuple[str, bytes]]


def windows(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class Patterns:
    """The windows of a block of items and their automaton, one character for each different word of the block."""

    def __init__(self, items: Items, size: int = WINDOW) -> None:
        of: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            for w in windows(term_words(text), size):
                of.setdefault(w, set()).add(item)
        words = sorted({w for x in of for w in x})
        self.letters = {w: chr(i + 1 if i + 1 < 0xD800 else i + 0x801) for i, w in enumerate(words)}  # surrogates left out
        self.windows = {"".join(self.letters[w] for w in x): (len(x), tuple(sorted(y))) for x, y in of.items()}
        self.automaton = ahocorasick.Automaton()
        for window, value in self.windows.items():
            self.automaton.add_word(window, value)
        if self.windows:
            self.automaton.make_automaton()

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans [first, beyond) of the windows in a document, and the items they are of."""
        items: set[str] = set()
        spans: list[tuple[int, int]] = []
        if not self.windows or not words:
            return spans, items
        for end, (n, of) in self.automaton.iter("".join(map(self.letters.get, words, repeat("\0")))):
            spans.append((end + 1 - n, end + 1))
            items.update(of)
        return spans, items


_built: dict[str, Patterns] = {}


def patterns(block: Items) -> Patterns:
    """Built once in a worker process while at most KEPT different ones are in use."""
    name = hashlib.sha256(repr(block).encode()).hexdigest()
    if name not in _built:
        if len(_built) >= KEPT:
            _built.clear()
        _built[name] = Patterns(block)
    return _built[name]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Their union, ascending."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_offsets(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte offsets in the original text of spans of words."""
    if not spans:
        return []
    inside = np.frombuffer(text.translate(TERM_TABLE), np.uint8) != 32
    edges = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return [(int(starts[a]), int(ends[b - 1])) for a, b in spans]


SPAN = "array<struct<first:bigint,beyond:bigint>>"
SPAN_ARROW = pa.list_(pa.struct([(k, pa.int64()) for k in ("first", "beyond")]))


def _scanned(column: pa.Array, blocks: list[Patterns], keep: bool) -> Iterator[tuple[bytes, int, list[tuple[int, int]], set[str]]]:
    """Of each text: itself (empty where nothing was found, unless ``keep``), its number of words, the merged spans of all blocks, and the
    items they are of."""
    for _, _, texts in text_slices(column):
        for text in texts:
            words = term_words(text)
            spans: list[tuple[int, int]] = []
            items: set[str] = set()
            for of in blocks:
                found, hit = of.spans(words)
                spans += found
                items |= hit
            yield text if spans or keep else b"", len(words), merged(spans), items


def _passes(benchmark: DataFrame) -> Iterator[tuple[list[Items], bool]]:
    """Groups of up to KEPT blocks of about AUTOMATON_BYTES of text, that together are the whole benchmark, and whether more will come. One group
    is collected at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.where("item_id is not null and text is not null")
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // AUTOMATON_BYTES))
    block = F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int")
    for begin in range(0, n, KEPT):
        end = min(begin + KEPT, n)
        blocks: list[Items] = [[] for _ in range(begin, end)]
        for k, item, text in rows.where((block >= begin) & (block < end)).select(block, "item_id", "text").collect():
            blocks[k - begin].append((item, bytes(text)))
        yield [sorted(x) for x in blocks], end < n


def _free_name(name: str, taken: list[str]) -> str:
    while name.lower() in (x.lower() for x in taken):
        name += "_"
    return name


def _hits(docs: DataFrame, benchmark: DataFrame, text_column: str, finish, schema: str | StructType) -> DataFrame:
    """``docs`` through all passes. ``finish(batch, hits)`` makes a batch of the last pass's output, ``hits`` being
    (text, words, spans, items) of each row over the whole benchmark."""
    names = docs.columns
    at = names.index(text_column)
    # Between passes, spans and items ride along in two more columns.
    held = [_free_name(x, names) for x in ("spans", "items")]
    context = docs.sparkSession.sparkContext
    found, first = docs, True
    for blocks, more in _passes(benchmark):
        shared = context.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first, more=more) -> Iterator[pa.RecordBatch]:
            of = [patterns(x) for x in shared.value]
            for batch in batches:
                hits = list(_scanned(batch.column(at), of, keep=not first))
                if not first:
                    spans, items = (batch.column(i).to_pylist() for i in (-2, -1))
                    hits = [(t, n, merged(s + [(x["first"], x["beyond"]) for x in a]), i | set(b)) for (t, n, s, i), a, b in zip(hits, spans, items)]
                    batch = batch.select(names)
                if not more:
                    yield finish(batch, hits)
                    continue
                spans = pa.array([[{"first": a, "beyond": b} for a, b in s] for _, _, s, _ in hits], SPAN_ARROW)
                items = pa.array([sorted(i) for *_, i in hits], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, spans, items], names=[*names, *held])

        if more:
            carried = StructType([*docs.schema.fields, *StructType.fromDDL(f"`{held[0]}` {SPAN}, `{held[1]}` array<string>").fields])
            found, first = checkpointed(found.mapInArrow(run, carried)), False
        else:
            found = found.mapInArrow(run, schema)
    return found


COLUMNS = "doc_id bigint, n_words bigint, spans array<struct<first:bigint,beyond:bigint,from_byte:bigint,to_byte:bigint>>, items array<string>"
PLACES = pa.list_(pa.struct([(k, pa.int64()) for k in ("first", "beyond", "from_byte", "to_byte")]))


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, items) of every row of ``docs``.

    spans: the union of all windows' occurrences, by word and by byte of the original UTF-8 text; items: the sorted item
    ids whose windows occur. A null or empty text has no words, a very long one is scanned whole, a null item is left out, items of the same text
    both count, an empty benchmark hits nothing, repeated rows are scanned each; other columns are not read.
    """

    def finish(batch: pa.RecordBatch, hits: list) -> pa.RecordBatch:
        spans = [[dict(zip(("first", "beyond", "from_byte", "to_byte"), (*s, *o))) for s, o in zip(x[2], original_offsets(x[0], x[2]))] for x in hits]
        arrays = [pa.array([x[1] for x in hits], pa.int64()), pa.array(spans, PLACES), pa.array([sorted(x[3]) for x in hits], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_words", "spans", "items"])

    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return _hits(rows, benchmark, "text", finish, COLUMNS)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, first_byte.

    contaminated: some word is hit, and at least a twentieth of the words are.
    """
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["beyond"] - x["first"])
    hit = contamination(docs, benchmark).withColumn("n_hit", n_hit)
    return hit.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.array_min(F.transform("spans", lambda s: s["from_byte"])).alias("first_byte"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows, with all their columns; no shuffle.

    A null or empty text is not contaminated; repeated rows are judged each; an empty benchmark drops nothing; an empty table gives an empty one.
    """

    def finish(batch: pa.RecordBatch, hits: list) -> pa.RecordBatch:
        clean = []
        for _, n, spans, _ in hits:
            hit = sum(b - a for a, b in spans)
            clean.append(not (hit and 20 * hit >= n))
        return batch.filter(pa.array(clean, pa.bool_()))

    return _hits(docs, benchmark, text_column, finish, docs.schema)


#: DuckDB SQL for the report, without the place in the text.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bi AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bi),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
h AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM di) JOIN bw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

"""Token counts that follow edits.

A tokenizer of the byte-level kind cuts a text into pre-tokens and counts each on its own. Per document a segment tree
over blocks of pre-tokens keeps the sums of characters and tokens. An edit finds its first block by the sums of
characters, cuts the text again from a few pre-tokens before the edit until a cut behind it falls on an
old one, counts what is new and updates the sums above the touched blocks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

BLOCK = 128
CACHE_PRETOKENS = 300_000
#: A pre-token's end depends on what follows it: at most on two pre-tokens (white space before white space before
#: a word). So many are cut again before an edit.
CONTEXT = 3

_counters: dict[tuple[str, str], "Counter"] = {}


class Counter:
    """Tokens of pre-tokens, kept in a bounded cache."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def cut(self, text: str, at: int = 0) -> Iterator[str]:
        return (m[0] for m in self.pattern.finditer(text, at))

    def counts(self, pretokens: list[str]) -> list[int]:
        known = self.known
        if new := set(pretokens).difference(known):
            if len(known) + len(new) > CACHE_PRETOKENS:
                known.clear()
                new = set(pretokens)
            encode = self.encoding.encode_ordinary
            known.update((x, len(encode(x))) for x in new)
        return [known[x] for x in pretokens]


def counter(ranks_path: str, pattern: str) -> Counter:
    """One of each in a worker process."""
    if (ranks_path, pattern) not in _counters:
        _counters[ranks_path, pattern] = Counter(ranks_path, pattern)
    return _counters[ranks_path, pattern]


class TokenTree:
    """Pre-tokens of a text in blocks, and a segment tree of (characters, tokens) over the blocks."""

    def __init__(self, text: str, of: Counter) -> None:
        self.of = of
        words = of.pattern.findall(text)
        counts = of.counts(words)
        self.words = [words[i : i + BLOCK] for i in range(0, len(words), BLOCK)] or [[]]
        self.counts = [counts[i : i + BLOCK] for i in range(0, len(counts), BLOCK)] or [[]]
        self.size = 1 << (len(self.words) - 1).bit_length()
        self.chars = [0] * (2 * self.size)
        self.tokens = [0] * (2 * self.size)
        for i in range(len(self.words)):
            self.chars[self.size + i] = sum(map(len, self.words[i]))
            self.tokens[self.size + i] = sum(self.counts[i])
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.recounted = 0  # characters cut again by edits

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join("".join(x) for x in self.words)

    def _block_at(self, place: int) -> tuple[int, int]:
        """The block that holds the character at ``place`` (the last one, at the end), and the characters before it."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if place >= before + self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return min(i - self.size, len(self.words) - 1), before

    def _update(self, block: int) -> None:
        i = self.size + block
        self.chars[i], self.tokens[i] = sum(map(len, self.words[block])), sum(self.counts[block])
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _walk(self, block: int) -> Iterator[tuple[int, int, str]]:
        for b in range(block, len(self.words)):
            for k, w in enumerate(self.words[b]):
                yield b, k, w

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters [start, end) by ``new``; places beyond the text are its end."""
        start = min(max(start, 0), self.n_chars)
        end = min(max(end, start), self.n_chars)
        block, before = self._block_at(start)
        # The pre-token with the edit's start, and CONTEXT before it.
        place, k = before, 0
        for k, w in enumerate(self.words[block]):
            if place + len(w) > start:
                break
            place += len(w)
        else:
            k = len(self.words[block])
        for _ in range(CONTEXT):
            while not k and block:
                block -= 1
                k = len(self.words[block])
            if k:
                k -= 1
                place -= len(self.words[block][k])
        first, first_k, origin = block, k, place
        # Old pre-tokens from there; those that end at or behind ``end`` are where cuts may meet.
        at = origin
        walk = (x for x in self._walk(first) if x[:2] >= (first, first_k))
        head: list[str] = []
        last, last_k = first, first_k
        while at < end and (x := next(walk, None)):
            head.append(x[2])
            at += len(x[2])
            last, last_k = x[0], x[1] + 1
        joined = "".join(head)
        text = joined[: start - origin] + new + joined[end - origin :]
        behind = start - origin + len(new)  # nothing is touched from here on
        shift = len(text) - len(joined)
        pieces: list[str] = []
        cuts: dict[int, tuple[int, int]] = {}
        done = False
        while not done:
            # More old pre-tokens, until the cuts of the text so far meet an old cut with enough behind it.
            cuts[at - origin + shift] = (last, last_k)
            got: list[str] = []
            for _ in range(16):
                if (x := next(walk, None)) is None:
                    done = True
                    break
                got.append(x[2])
                at += len(x[2])
                last, last_k = x[0], x[1] + 1
                cuts[at - origin + shift] = (last, last_k)
            text += "".join(got)
            pieces, size = [], 0
            safe = len(text) if done else len(text) - sum(map(len, got[-CONTEXT:]))
            for piece in self.of.cut(text):
                if size >= behind and size in cuts and size <= safe:
                    last, last_k = cuts[size]
                    done = True
                    break
                pieces.append(piece)
                size += len(piece)
            self.recounted += size
        counts = self.of.counts(pieces)
        if last == first:
            self.words[first][first_k:last_k] = pieces
            self.counts[first][first_k:last_k] = counts
        else:
            self.words[first][first_k:] = pieces
            self.counts[first][first_k:] = counts
            for b in range(first + 1, last):
                self.words[b], self.counts[b] = [], []
                self._update(b)
            del self.words[last][:last_k]
            del self.counts[last][:last_k]
            self._update(last)
        self._update(first)


SCHEMA = "doc_id bigint, n_chars bigint, n_tokens bigint, n_edits bigint, chars_after bigint, tokens_after bigint, chars_recounted bigint"


def edited_counts(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", edits_column: str = "edits") -> DataFrame:
    """Per row of ``docs``: tokens before and after the row's edits, applied in order.

    The edits are an array of (start, length, new) in characters of the text as the edits before have left it; null edits are
    none, a null new is empty, places beyond the text mean its end. A null text is empty. Repeated rows are
    counted each; an empty table gives an empty one; other columns are not read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(ranks_path, pattern)
        for batch in batches:
            edits = batch.column(2)
            rows: list[tuple[int, ...]] = []
            for a, _, texts in text_slices(batch.column(1)):
                for i, text in enumerate(texts, a):
                    tree = TokenTree(text.decode("utf-8", "replace"), of)
                    n, k, todo = tree.n_chars, tree.n_tokens, edits[i].as_py() or []
                    for e in todo:
                        if e is not None:
                            tree.edit(e["start"] or 0, (e["start"] or 0) + (e["length"] or 0), e["new"] or "")
                    rows.append((n, k, len(todo), tree.n_chars, tree.n_tokens, tree.recounted))
            columns = [pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.col(edits_column).alias("edits"))
    return rows.mapInArrow(run, SCHEMA)


def sample_edits(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with three edits a document that follow from its id and length: a word is put in, a stretch is
    deleted and white space is put in."""
    n = F.char_length(F.coalesce("text", F.lit(""))) + 1
    at = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), n.cast("bigint"))
    edit = lambda start, length, new: F.struct(start.alias("start"), length.cast("bigint").alias("length"), F.lit(new).alias("new"))
    return docs.select(
        "doc_id", "text", F.array(edit(at(1), F.lit(0), " revised"), edit(at(2), F.pmod("doc_id", F.lit(40)), ""), edit(at(3), F.lit(1), " \n ")).alias("edits")
    )

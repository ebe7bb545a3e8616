"""Order-preserving packing of tokenised documents into sequences.

The tokens of a partition's documents lie on one line, in the order of the table. Candidate cuts are
document ends and sentence ends; only where two of these lie further apart than a sequence is long, places every
``stride`` tokens between them are candidates too. The cuts that minimise padding plus penalties for
cutting a document are found by dynamic programming:

    cost[j] = penalty[j] + min over cuts i with place[j] - place[i] <= size of cost[i] + padding(place[j] - place[i])

Padding is ``size`` less the length, except that a sequence whose length is a power of two has none. The minimum of cost[i] + place[i]
over the moving window comes from a monotone queue; the few cuts a power of two before j are looked up beforehand and
compared as well. So the work is linear in the cuts, and the cost is the true one. The line is taken in
blocks of ``BLOCK_TOKENS``; the last window of a block opens the next one, so memory is bounded by a block and the
longest document. Partitions are packed alone, without a shuffle; each leaves at most one short sequence.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import text_slices

SIZE = 2048
END_ID = 1
SENTENCE_PENALTY = 4
WORD_PENALTY = 24
STRIDE = 32
BLOCK_TOKENS = 1 << 18
CACHE_CHUNKS = 250_000

_encoders: dict[str, "Encoder"] = {}

#: Fixed value: how the tokenizer cuts normalised text.
PRETOKEN = regex.compile("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
#: Characters that the tokenizer's normaliser leaves alone but for case, none of them white space.
PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")
#: A chunk that ends a sentence; single letters and letters with dots between (e.g.) do not.
SENTENCE = re.compile("[.!?\u2026\u3002\uff01\uff1f][\"'\u201d\u2019\u00bb)\\]]*$")
ABBREVIATION = re.compile(r"\W*[^\W\d_](?:[^\W\d_]*(?:\.[^\W\d_]+)+)?\.\W*$")
#: Last bytes of what SENTENCE finds.
STOPS = {x.encode()[-1:] for x in ".!?\u2026\u3002\uff01\uff1f\"'\u201d\u2019\u00bb)]"}
CHUNK = re.compile("[^\t-\r ]+")
#: Stands for a word's end in byte strings; it is no byte of UTF-8.
WORD_END = b"\xff"


def ends_sentence(chunk: str) -> bool:
    return SENTENCE.search(chunk) is not None and ABBREVIATION.match(chunk) is None


def _byte_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary as byte strings by id, ``</w>`` as WORD_END. Ids are ranks of merges: bytes first, then bytes at a word's
    end, then each merge in its order; merging WORD_END to its byte therefore comes before all others."""
    with open(path, "rb") as f:
        model = json.load(f)["model"]
    # Bytes are written as themselves where they are printable, the others as the characters from U+0100 on, in order.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(printable))}
    merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    if any(model["vocab"]["".join(x)] != 512 + i for i, x in enumerate(merges)):
        raise ValueError(f"ids of {path} are not in the order of its merges")
    return {bytes(of[c] for c in t.removesuffix("</w>")) + WORD_END * t.endswith("</w>"): i for t, i in model["vocab"].items() if i < 512 + len(merges)}


class _Numbers(dict):
    """Numbers chunks as they come and remembers the new ones."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


class Encoder:
    """Token ids of texts, equal to those of the tokenizer on the whole text.

    The tokenizer splits at white space, and neither its normaliser nor its merges reach across it,
    so the ids of a text are those of its chunks between ASCII blanks. Ids of chunks are kept in a bounded
    cache. A chunk of plain characters is cut into words here, and each goes through the byte-pair merges alone; other chunks go to the tokenizer. A text
    with ``<|`` may hold a special token, which is sensitive to case, and goes to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.merged = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=_byte_ranks(path), special_tokens={})._core_bpe.encode_single_piece
        self._reset()

    def _reset(self) -> None:
        self.number = _Numbers()
        self.ids = array("I")
        self.starts = array("i", [0])
        self.stops = bytearray()  # 1: the chunk ends a sentence

    def _chunk_ids(self, chunk: bytes) -> list[int]:
        """Of an ASCII-lower-cased chunk."""
        if chunk.isalpha():
            return self.merged(chunk + WORD_END)
        if not chunk:
            return []
        if chunk[-1] in b".,;:!?" and chunk[:-1].isalpha():
            return self.merged(chunk[:-1] + WORD_END) + self.merged(chunk[-1:] + WORD_END)
        text = chunk.decode("utf-8", "replace")
        if not PLAIN.fullmatch(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        text = text.lower()
        words = (text,) if text.isalpha() else PRETOKEN.findall(text)
        return [i for w in words for i in self.merged(w.encode() + WORD_END)]

    def _learn(self) -> None:
        ids, new = self.ids, self.number.new
        for chunk in new:
            ids.extend(self._chunk_ids(chunk))
            self.starts.append(len(ids))
        self.stops += bytes(chunk[-1:] in STOPS and ends_sentence(chunk.decode("utf-8", "replace")) for chunk in new)
        new.clear()

    def _whole(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        text = text.decode("utf-8", "replace")
        found = self.tokenizer.encode(text, add_special_tokens=False)
        stops = {m.end() for m in CHUNK.finditer(text) if ends_sentence(m[0])}
        return np.array(found.ids, np.uint32), np.array([i + 1 for i, (_, to) in enumerate(found.offsets) if to in stops], np.int64)

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text, and the places behind the ids that end a sentence. The texts together are of bounded size."""
        if len(self.number) > CACHE_CHUNKS:
            self._reset()
        whole = {i for i, x in enumerate(texts) if b"<|" in x}
        # Chunks are told apart by Arrow, so Python sees each different one of the texts once. Empty ones (at a text's ends) have no ids.
        column = pa.array([b"" if i in whole else x for i, x in enumerate(texts)], pa.large_binary()).view(pa.large_string())
        chunks = pc.ascii_split_whitespace(pc.ascii_lower(column))
        counts = chunks.value_lengths().to_numpy()
        found = chunks.flatten().dictionary_encode()
        number = np.fromiter(map(self.number.__getitem__, found.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False)), np.int64, len(found.dictionary))
        self._learn()
        cached = pa.ListArray.from_arrays(np.array(self.starts, np.int32), np.array(self.ids, np.uint32))
        lists = cached.take(pa.array(number)).take(found.indices)
        ids = lists.flatten().to_numpy()
        beyond = lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()
        stops = beyond[np.frombuffer(bytes(self.stops), bool)[number][found.indices.to_numpy()]]
        edges = np.concatenate(([0], beyond))[np.concatenate(([0], np.cumsum(counts)))]
        ends = np.searchsorted(stops, edges, side="right")
        return [
            self._whole(text) if i in whole else (ids[edges[i] : edges[i + 1]], stops[ends[i] : ends[i + 1]] - edges[i])
            for i, text in enumerate(texts)
        ]


def encoder(path: str) -> Encoder:
    """One of each file in a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def padding(length: int, size: int = SIZE) -> int:
    return 0 if length & (length - 1) == 0 else size - length


def candidate_cuts(ends: np.ndarray, sentences: np.ndarray, size: int = SIZE, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places to cut at and the penalty of each. ``ends``: places behind the documents' last ids, the last of them the
    line's end; ``sentences``: places behind sentences."""
    soft = np.union1d(sentences, ends)
    known = np.concatenate(([0], soft))
    gaps = np.diff(known)
    long = np.flatnonzero(gaps > size)
    count = (gaps[long] - 1) // min(stride, size)
    hard = np.repeat(known[long], count) + min(stride, size) * (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + 1)
    places = np.union1d(soft, hard)
    penalty = np.full(len(places), WORD_PENALTY, np.int64)
    penalty[np.isin(places, sentences)] = SENTENCE_PENALTY
    penalty[np.isin(places, ends)] = 0
    return places, penalty


def _without_padding(at: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """(j, i), ascending: places at[j] that are a power of two behind at[i]."""
    here, back = [], []
    step = 1
    while step <= size:
        i = np.searchsorted(at, at - step)
        hit = np.flatnonzero(at[np.minimum(i, len(at) - 1)] == at - step)
        here.append(hit)
        back.append(i[hit])
        step *= 2
    j, i = np.concatenate(here), np.concatenate(back)
    order = np.lexsort((i, j))
    return j[order].tolist(), i[order].tolist()


def best_cuts(places: np.ndarray, penalty: np.ndarray, size: int = SIZE, open_end: bool = False) -> list[int]:
    """The cuts of least cost from place 0 to the last place; neighbouring places lie at most ``size`` apart. Of equal costs, the
    longer last sequence is taken. With ``open_end`` more will follow, and the last sequence costs nothing yet."""
    line = np.concatenate(([0], np.asarray(places, np.int64)))
    exact_j, exact_i = _without_padding(line, size)
    exact_j.append(len(line))
    at, fee = line.tolist(), np.asarray(penalty).tolist()
    cost, back = [0], [0]
    value = [0]  # cost + place of each cut
    queue: deque[int] = deque([0])
    k = 0
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0]] < here - size:
            queue.popleft()
        of = queue[0]
        best = value[of] + size - here
        while exact_j[k] == j:
            i = exact_i[k]
            if cost[i] < best or cost[i] == best and i < of:
                best, of = cost[i], i
            k += 1
        best += fee[j - 1]
        cost.append(best)
        back.append(of)
        mine = best + here
        value.append(mine)
        while queue and value[queue[-1]] > mine:
            queue.pop()
        queue.append(j)
    if open_end:
        first = bisect_left(at, at[-1] - size)
        back[-1] = min(range(first, len(at) - 1), key=cost.__getitem__)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


PIECE = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
    "sequence_tokens bigint, padding bigint"
)
NAMES = [x.split()[0] for x in PIECE.split(", ")]


class _Line:
    """Documents of a partition on one line of tokens, cut into sequences block by block."""

    def __init__(self, partition: int, size: int) -> None:
        self.next_id = partition << 40
        self.size = size
        self.ids: list[np.ndarray] = []
        self.sentences: list[np.ndarray] = []
        self.held: list[tuple[int | None, int, int, int]] = []  # doc_id, ids before these, these, all of the document
        self.tokens = 0

    def add(self, doc: int | None, ids: np.ndarray, sentences: np.ndarray) -> None:
        self.ids += (ids, np.array([END_ID], np.uint32))
        self.sentences.append(sentences + self.tokens)
        self.held.append((doc, 0, len(ids) + 1, len(ids) + 1))
        self.tokens += len(ids) + 1

    def flush(self, last: bool) -> pa.RecordBatch | None:
        """The pieces of all windows but the last, or of all."""
        if not self.tokens:
            return None
        ids = np.concatenate(self.ids)
        ends = np.cumsum([n for _, _, n, _ in self.held])
        sentences = np.concatenate(self.sentences)
        cuts = best_cuts(*candidate_cuts(ends, sentences, self.size), self.size, open_end=not last)
        keep = len(cuts) if last else len(cuts) - 1
        rows: list[tuple] = []
        begin, left, held = 0, [], iter(self.held)
        doc, before, n, total = next(held)
        for cut in cuts[:keep]:
            offset, length = 0, cut - begin
            while begin < cut:
                take = min(n, cut - begin)
                crc = zlib.crc32(ids[begin : begin + take].astype("<u4", copy=False))
                rows.append((doc, before, take, crc, total, self.next_id, offset, length, padding(length, self.size)))
                begin, before, n, offset = begin + take, before + take, n - take, offset + take
                if not n:
                    doc, before, n, total = next(held, (None, 0, 0, 0))
            self.next_id += 1
        if n:
            left.append((doc, before, n, total))
        left += held
        self.ids, self.held, self.tokens = [ids[begin:]], left, len(ids) - begin
        self.sentences = [sentences[sentences > begin] - begin]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=NAMES) if rows else None


def packed(
    docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", size: int = SIZE
) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and the sequence's tokens and padding.

    A null or empty text is its end id alone. A very long text is encoded whole. Rows with equal or null ids are packed like any other. The order is
    that of the table's partitions; a sequence id is the partition's number times 2**40 plus a
    running number. An empty table gives no pieces; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = encoder(tokenizer_path)
        context = TaskContext.get()
        line = _Line(context.partitionId() if context else 0, size)
        for batch in batches:
            docs_of = batch.column(0).to_pylist()
            for a, b, texts in text_slices(batch.column(1)):
                for doc, (ids, sentences) in zip(docs_of[a:b], found.encode(texts)):
                    line.add(doc, ids, sentences)
                    if line.tokens >= BLOCK_TOKENS and (out := line.flush(last=False)):
                        yield out
        if out := line.flush(last=True):
            yield out

    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, PIECE)

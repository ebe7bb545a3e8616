"""SimHash near-duplicates through vantage-point shards.

Fingerprints are compared under Hamming distance. A vantage-point tree puts a fingerprint into
shards by its distance to vantage points; for a pair within ``max_bits`` the triangle inequality
bounds how far their distances to any vantage point can differ, so other branches are pruned.

On whole 64-bit fingerprints these bounds prune little, as distances crowd around 32: such a tree alone compares over half of all
pairs (README has figures), which no large table can bear. So two levels are used:

* The top levels split the 64 bits into ``n`` disjoint blocks. Block distances add up to the
  whole distance, so a pair within ``max_bits`` has distance zero on some ``n - max_bits`` blocks.
  One tree is grown for each such choice of blocks, under the Hamming distance on those blocks;
  there the triangle bound is zero, every vantage ring is a branch of its own, and a fingerprint
  lands in exactly one shard of each tree. ``n`` follows the number of distinct fingerprints
  so that shards stay small at any size; every choice is exact.
* Inside a shard, distances of whole fingerprints to a vantage fingerprint split it at the median;
  the inner half also takes the fingerprints up to ``max_bits`` beyond the boundary, so pairs across
  it are found there. Leaves are compared pair by pair; a shard of up to ``LEAF_ROWS`` is a leaf.

Shards of more than ``SHARD_ROWS`` fingerprints are cut into chunks, and each pair of chunks is
a task of its own. A shard returns a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank_words, checkpointed, text_slices
from .components import component_labels
from .near_copies import BROADCAST_IDS, components

SHINGLE = 4
MAX_BITS = 4
VANTAGE_POINTS = 16
SHARD_ROWS = 4096
LEAF_ROWS = 256
ROWS_PER_SHARD = 64


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the XXH64 values (seed 42) of the word shingles."""
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    stops = (ends - 1)[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops)], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(blank_words(x)) for _, _, texts in text_slices(batch.column(1)) for x in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], names=["doc_id", "fp"]
        )


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp bigint) of every row; a null or empty text has fingerprint zero."""
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def _blocks(rows: int, max_bits: int) -> int:
    """The least number of blocks for which shards of evenly spread fingerprints stay small."""
    n = max_bits + 1
    while rows > ROWS_PER_SHARD * 2 ** (64 * (n - max_bits) // n) and n < max_bits + 4:
        n += 1
    return n


def _masks(n: int, max_bits: int) -> list[int]:
    """For each choice of n - max_bits of n blocks, the bits in them."""
    edges = [64 * i // n for i in range(n + 1)]
    block = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(n)]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(n), n - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _shards(distinct: DataFrame, max_bits: int, rows: int) -> DataFrame:
    """(shard, fp): every fingerprint once per tree. A shard is a tree and the rings around its vantage points."""
    rng = random.Random(42)
    vantage = [rng.getrandbits(64) for _ in range(VANTAGE_POINTS)]
    fp = F.col("fp")
    keys = [
        F.xxhash64(
            F.lit(tree), *(F.bit_count(fp.bitwiseXOR(F.lit(_signed(v))).bitwiseAND(F.lit(_signed(mask)))) for v in vantage)
        )
        for tree, mask in enumerate(_masks(_blocks(rows, max_bits), max_bits))
    ]
    return distinct.select(F.explode(F.array(*keys)).alias("shard"), "fp")


def _tiles(shards: DataFrame) -> DataFrame:
    """(shard, tile, fp): shards of up to SHARD_ROWS are one tile, larger ones a tile for each pair of chunks."""
    sizes = shards.groupBy("shard").count().where(F.col("count") > 1)
    n = F.ceil(F.col("count") / SHARD_ROWS).cast("int")
    chunk = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    other = F.sequence(F.lit(0), F.col("n") - 1)
    tile = F.transform(other, lambda k: F.least(k, F.col("chunk")) * F.col("n") + F.greatest(k, F.col("chunk")))
    joined = shards.join(sizes, "shard").select("shard", "fp", n.alias("n"))
    return joined.withColumn("chunk", chunk).select("shard", F.explode(tile).alias("tile"), "fp")


class _Forest:
    """Union-find over fingerprints."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (parent := up.setdefault(x, x)) != x:
            up[x] = up[parent]
            x = up[x]
        return x

    def link(self, a: list[int], b: list[int]) -> None:
        for x, y in zip(a, b):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)


def link_shard(fps: np.ndarray, max_bits: int, forest: _Forest) -> None:
    """Adds every link among ``fps`` (unsigned) to ``forest``, descending a vantage-point tree."""
    stack = [fps]
    while stack:
        part = stack.pop()
        if len(part) > LEAF_ROWS:
            away = np.bitwise_count(part ^ part[len(part) // 2]).astype(np.int16)
            middle = int(np.median(away))
            inner = part[away <= middle + max_bits]
            if len(inner) <= 0.75 * len(part):
                stack += [inner, part[away > middle]]
                continue
        for at in range(0, len(part), LEAF_ROWS):
            near = np.bitwise_count(part[at : at + LEAF_ROWS, None] ^ part[None, at:]) <= max_bits
            i, j = np.nonzero(np.triu(near, 1))
            forest.link(part[at + i].tolist(), part[at + j].tolist())


def _link(max_bits: int):
    def run(keys: np.ndarray, fps: np.ndarray, forest: _Forest) -> None:
        """Tiles lie one after another; small ones are compared together, one shift at a time."""
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        for a, n in zip(starts[sizes > LEAF_ROWS].tolist(), sizes[sizes > LEAF_ROWS].tolist()):
            link_shard(fps[a : a + n], max_bits, forest)
        small = np.repeat(sizes <= LEAF_ROWS, sizes)
        k, f = keys[small], fps[small]
        for shift in range(1, int(sizes[sizes <= LEAF_ROWS].max(initial=1))):
            hit = np.flatnonzero((k[shift:] == k[:-shift]) & (np.bitwise_count(f[shift:] ^ f[:-shift]) <= max_bits))
            forest.link(f[hit].tolist(), f[hit + shift].tolist())

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            forest = _Forest()
            run(keys, fps, forest)
            a = [x for x in forest.up if forest.root(x) != x]
            b = [forest.root(x) for x in a]
            arrays = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
            return pa.RecordBatch.from_arrays(arrays, names=["a", "b"])

        for batch in batches:
            shard = batch.column(0).to_numpy(zero_copy_only=False)
            tile = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = shard * np.int64(1_000_003) + tile
            held.append((keys, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)))
            keys, fps = (np.concatenate(x) for x in zip(*held))
            cut = int(np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[-1]) if len(keys) else 0
            if cut:
                yield done(keys[:cut], fps[:cut])
            held = [(keys[cut:], fps[cut:])]
        if held and len(held[0][0]):
            yield done(*held[0])

    return linked


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) fingerprints: links that connect all distinct fingerprints within ``max_bits`` of each other."""
    rows = distinct.count()
    tiles = _tiles(_shards(distinct, max_bits, rows))
    dealt = tiles.repartition("shard", "tile").sortWithinPartitions("shard", "tile")
    return dealt.mapInArrow(_link(max_bits), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_bits: int = MAX_BITS
) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    component_id is the least doc_id reachable over links, a row's own included. Empty texts have
    fingerprint zero and link like any other. Rows with a null id take part in linking; a component
    of such rows alone has a null id. Repeated rows are returned as often as they come. An empty
    table gives an empty one; other columns of ``docs`` are not read.
    """
    fps = checkpointed(fingerprints(docs, id_column, text_column))
    distinct = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")))
    labels = component_labels(fingerprint_links(distinct.select("fp"), max_bits))
    of = distinct.join(labels, distinct["fp"] == labels["vertex"], "left").select(
        "fp", "first_id", F.coalesce("label", "fp").alias("label"), (F.col("label").isNotNull() | (F.col("copies") > 1)).alias("grouped")
    )
    of = of.where("grouped")
    first = of.groupBy("label").agg(F.min("first_id").alias("component_id"))
    groups = of.join(first, "label").select("fp", "component_id")
    return fps.join(groups, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, max_bits: int | None = None, broadcast_rows: int = BROADCAST_IDS) -> DataFrame:
    """``docs`` without the documents whose group has a smaller doc_id.

    Groups are linked by similar sets of five-word shingles (``near_copies``), or by fingerprints within ``max_bits`` where that is given.
    The ids to drop are broadcast while they are at most ``broadcast_rows``, about 40 bytes each in a broadcast relation; beyond, the
    anti-join shuffles. Rows with a null id stay; rows of one id go or stay together; null and empty texts are copies of each other; an empty
    table gives an empty one; all columns are kept.
    """
    found = components(docs, broadcast_rows=broadcast_rows) if max_bits is None else near_duplicates(docs, max_bits=max_bits)
    drop = checkpointed(found.where("component_id <> doc_id").select("doc_id").distinct())
    small = drop.count() <= broadcast_rows
    return docs.join(F.broadcast(drop) if small else drop, "doc_id", "left_anti").select(*docs.columns)

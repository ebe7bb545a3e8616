"""Operator 2 by similarity: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The SimHash fingerprints of the sets are linked through vantage-point shards as in operator 2, and the sets of linked ones are compared exactly. At
a similarity of 0.8 fingerprints of 64 bits are 10 bits apart on average and up to 18, where the triangle bounds of whole fingerprints prune
nothing (README has figures). So for the pairs that are less alike, sets are dealt into shards by min-hashes, too, and the bounds are taken inside the
shards, on exact distances:

1. Each document gives the key of its shingle set, a SimHash and ``BANDS`` min-hash fingerprints, each of ``BAND_ROWS`` min-hashes. Two sets of
   similarity s agree on one of these with probability s ** BAND_ROWS, so a pair at 0.8 shares none with probability 3e-5
   and is found otherwise. Equal sets are one from here on.
2. Sets that share a min-hash fingerprint are a shard. Its vantage point is the set that shares fingerprints most often, which in a group of edited copies is
   the text that they were edited from, or near it. Each set is compared with the best of its vantage points, set by set; a large group of
   copies costs a pair a copy, not the square of the group.
3. In shards that still hold several components, all sets are compared with the vantage point.
4. Where a shard holds several components even so, sets of different components are compared by their differences from the vantage point b: of
   D(x) = x ^ b (symmetric), D(x) ^ D(y) = x ^ y, and x and y are similar if that has at most a ninth of their shingles. So two sets that are not both
   similar to b (these are connected) must share a known number of elements of their differences, and hence one of the rarest few of each. Pairs
   are made by an equi-join on those alone: what a copy's own edits have brought in is shared with nobody, so the members of a large group do not
   meet all others. So every pair of a shard is compared, ruled out by this bound, or connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, text_slices
from .components import component_labels
from .substring_dedup import grams, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 20, 4
BROADCAST_IDS = 1_000_000
#: Slack of bounds that are compared in floating point.
SLACK = 1e-9
#: Two sets are similar if this part of their shingles, at most, isn't shared.
UNSHARED = (1 - SIMILARITY) / (1 + SIMILARITY)
#: Differences of up to so many shingles are compared where they meet; greater ones are fetched again.
CARRIED = 512
#: SimHash fingerprints that differ in so many bits at most are linked.
MAX_BITS = 4

_random = np.random.default_rng(42)
_FLIPS = _random.integers(0, 2**32, BANDS * BAND_ROWS, dtype=np.uint32)
_FACTORS = _random.integers(0, 2**31, BANDS * BAND_ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit hashes of the word shingles of each text, ascending, one text after another, and how many each has. A shorter
    text is one shingle, an empty one has none."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    gram = grams(words, shingle)
    text = np.repeat(np.arange(len(texts)), counts)[: len(gram)]
    inside = np.arange(len(gram)) + shingle <= ends[text]
    found, of = [gram[inside]], [text[inside]]
    for i in np.flatnonzero((counts > 0) & (counts < shingle)):
        found.append(grams(words[ends[i] - counts[i] : ends[i]], int(counts[i])))
        of.append(np.array([i]))
    gram, text = np.concatenate(found), np.concatenate(of)
    order = np.lexsort((gram, text))
    gram, text = gram[order], text[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
    return gram[new], np.bincount(text[new], minlength=len(texts))


def band_keys(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The BANDS fingerprints of each set that isn't empty, a row each."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    if not len(starts):
        return np.zeros((0, BANDS), np.uint64)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    keys = np.empty((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), band, np.uint64)
        for k in range(band * BAND_ROWS, (band + 1) * BAND_ROWS):
            key = (key ^ np.minimum.reduceat((low ^ _FLIPS[k]) * _FACTORS[k], starts)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        keys[:, band] = key
    return keys


def set_fingerprints(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The SimHash of each set: bit i is set if it is set in over half of the shingles. An empty set's is zero."""
    out = np.zeros(len(counts), np.uint64)
    sizes = counts[counts > 0]
    if len(sizes):
        starts = np.cumsum(sizes) - sizes
        ones = np.zeros((len(sizes), 64), np.uint8)
        for byte in range(8):
            bits = np.unpackbits((shingles >> np.uint64(8 * byte)).astype(np.uint8)[:, None], axis=1, bitorder="little")
            ones[:, 8 * byte : 8 * byte + 8] = 2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int64) > sizes[:, None]
        out[counts > 0] = np.packbits(ones, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(flat.view(np.int64)))


def _set_keys(shingles: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.cumsum(counts)
    keys = [xxhash.xxh64_intdigest(shingles[a:b], 42) for a, b in zip((ends - counts).tolist(), ends.tolist())]
    return pa.array(np.array(keys, np.uint64).view(np.int64))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in text_slices(batch.column(1)):
            shingles, counts = shingle_sets(texts)
            bands = _lists(band_keys(shingles, counts).ravel(), np.where(counts > 0, BANDS, 0))
            fps = pa.array(set_fingerprints(shingles, counts).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _set_keys(shingles, counts), fps, bands], names=["doc_id", "set_key", "fp", "bands"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, texts in text_slices(batch.column(1)):
            shingles, counts = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays([_set_keys(shingles, counts), _lists(shingles, counts)], names=["set_key", "shingles"])


def _shingles(wanted: DataFrame, sets: DataFrame, rows: DataFrame, broadcast_rows: int) -> DataFrame:
    """(set_key, shingles) of the wanted set keys. One text of each set is read again."""
    ids = checkpointed(sets.join(wanted, "set_key", "left_semi").select(F.col("first_id").alias("doc_id")).distinct())
    few = ids.count() <= broadcast_rows
    texts = rows.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("doc_id", "text")
    return texts.mapInArrow(_shingle_rows, "set_key bigint, shingles array<bigint>").dropDuplicates(["set_key"])


def _compared(pairs: DataFrame, sets: DataFrame, rows: DataFrame, broadcast_rows: int) -> DataFrame:
    """(a, b, similarity) of pairs (a, b) of set keys."""
    found = _shingles(pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct(), sets, rows, broadcast_rows)
    side = lambda key, name: found.select(F.col("set_key").alias(key), F.col("shingles").alias(name))
    both = pairs.join(side("a", "of_a"), "a").join(side("b", "of_b"), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return checkpointed(both.select("a", "b", (shared / (F.size("of_a") + F.size("of_b") - shared)).alias("similarity")))


def _differences(pairs: DataFrame, sets: DataFrame, rows: DataFrame, broadcast_rows: int) -> DataFrame:
    """(set_key, label, leader, size, diff, far, spare) of pairs (set_key, label, leader).

    diff: the shingles that only one of the two has; far: they aren't similar; spare: half of what diff has beyond a ninth of the set. x and y with
    one leader are similar if their diffs share spare(x) + spare(y) elements.
    """
    found = _shingles(pairs.select(F.explode(F.array("set_key", "leader")).alias("set_key")).distinct(), sets, rows, broadcast_rows)
    both = pairs.join(found, "set_key").join(found.toDF("leader", "of_leader"), "leader")
    diff = F.array_union(F.array_except("shingles", "of_leader"), F.array_except("of_leader", "shingles"))
    out = both.select("set_key", "label", "leader", F.size("shingles").alias("size"), F.size("of_leader").alias("leader_size"), diff.alias("diff"))
    far = F.size("diff") > (F.col("size") + F.col("leader_size")) * UNSHARED
    return checkpointed(out.withColumn("far", far).withColumn("spare", (F.size("diff") - F.col("size") * UNSHARED) / 2).drop("leader_size"))


def _linked_rest(pairs: DataFrame, links: DataFrame, labels: DataFrame, sets: DataFrame, rows: DataFrame, broadcast_rows: int) -> DataFrame:
    """Labels after the sets of one leader in ``pairs`` (set_key, label, leader) that have different labels are compared, too."""
    of = _differences(pairs, sets, rows, broadcast_rows)
    elements = of.select("leader", "set_key", F.explode("diff").alias("element"))
    counts = elements.groupBy("leader", "element").agg(F.count(F.lit(1)).alias("n"))
    ordered = elements.join(counts, ["leader", "element"]).groupBy("leader", "set_key").agg(F.array_sort(F.collect_list(F.struct("n", "element"))).alias("ordered"))
    # A partner of a far set is any set, one of another set is a far one. So many elements are shared at least:
    bounds = of.groupBy("leader").agg(F.min("spare").alias("any"), F.min(F.when(F.col("far"), F.col("spare"))).alias("any_far"))
    shared = F.greatest(F.lit(1.0), F.ceil(F.col("spare") + F.when(F.col("far"), F.col("any")).otherwise(F.col("any_far")) - SLACK))
    keys = of.join(ordered, ["leader", "set_key"]).join(bounds, "leader").withColumn("n_rare", (F.size("diff") - shared + 1).cast("int")).where("n_rare > 0")
    rare = F.filter(F.slice("ordered", F.lit(1), F.col("n_rare")), lambda x: x["n"] > 1)["element"]
    small = F.when(F.size("diff") <= CARRIED, F.col("diff"))
    names = ("set_key", "label", "far", "spare", "n_diff", "diff")
    mine = keys.select("leader", F.explode(rare).alias("element"), "set_key", "label", "far", "spare", F.size("diff").alias("n_diff"), small.alias("diff"))
    mine = mine.repartition("leader", "element")  # one exchange for both sides
    other = mine.select("leader", "element", *[F.col(c).alias(f"other_{c}") for c in names])
    least = F.col("spare") + F.col("other_spare") - SLACK
    may = (mine["leader"] == other["leader"]) & (mine["element"] == other["element"])
    may &= (F.col("set_key") < F.col("other_set_key")) & (F.col("label") != F.col("other_label")) & (F.col("far") | F.col("other_far"))
    may &= F.least("n_diff", "other_n_diff") >= least
    may &= F.coalesce(F.size(F.array_intersect("diff", "other_diff")) >= least, F.lit(True))
    met = mine.join(other, may).select(F.col("set_key").alias("a"), F.col("other_set_key").alias("b"), (F.col("diff").isNotNull() & F.col("other_diff").isNotNull()).alias("sure"))
    met = checkpointed(met.distinct())
    more = met.where("sure").select("a", "b")
    if not (rest := checkpointed(met.where("not sure").select("a", "b").distinct())).isEmpty():
        more = more.union(_compared(rest, sets, rows, broadcast_rows).where(F.col("similarity") >= SIMILARITY).select("a", "b"))
    return labels if more.isEmpty() else component_labels(links.union(more))


def _simhash_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): the sets of one fingerprint with the first of them, and the first ones of linked fingerprints."""
    from .simhash import fingerprint_links  # that module has this one's components

    firsts = checkpointed(sets.groupBy("fp").agg(F.min("set_key").alias("first")))
    same = sets.join(firsts, "fp").where("set_key <> first").select(F.col("set_key").alias("a"), F.col("first").alias("b"))
    side = lambda fp, name: firsts.select(F.col("fp").alias(fp), F.col("first").alias(name))
    links = fingerprint_links(firsts.select("fp"), MAX_BITS).distinct().toDF("fp_a", "fp_b")
    return same.union(links.join(side("fp_a", "a"), "fp_a").join(side("fp_b", "b"), "fp_b").select("a", "b"))


def components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", broadcast_rows: int = BROADCAST_IDS) -> DataFrame:
    """(doc_id, component_id) of every row with an id.

    component_id is the least doc_id reachable over pairs of similarity SIMILARITY or more. Empty texts are copies of each
    other; very long ones are compared whole; repeated rows are returned as often as they come; rows with a null id are left out; an
    empty table gives an empty one; other columns are not read.
    """
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).where("doc_id is not null")
    signed = checkpointed(rows.mapInArrow(_signatures, "doc_id bigint, set_key bigint, fp bigint, bands array<bigint>"))
    sets = checkpointed(signed.groupBy("set_key").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    entries = sets.select(F.explode("bands").alias("band"), "set_key")
    entries = checkpointed(entries.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("band"))).where("n > 1"))
    central = entries.groupBy("set_key").agg(F.sum("n").alias("central"))
    entries = entries.join(central, "set_key").select("band", "set_key", F.struct("central", "set_key").alias("rank"))
    vantage = entries.groupBy("band").agg(F.max("rank").alias("leader_rank"))
    entries = checkpointed(entries.join(vantage, "band").select("band", "set_key", F.col("leader_rank.set_key").alias("leader"), "leader_rank"))

    def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """``rows`` of those shards that hold several components, with the label of each set."""
        known = rows.join(labels, F.col("set_key") == F.col("vertex"), "left").withColumn("label", F.coalesce("label", "set_key")).drop("vertex")
        mixed = known.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band")
        return checkpointed(known.join(mixed, "band", "left_semi"))

    near = F.col("similarity") >= SIMILARITY
    first = entries.where("set_key <> leader").groupBy(F.col("set_key").alias("a")).agg(F.max("leader_rank").alias("best")).select("a", F.col("best.set_key").alias("b"))
    scored = _compared(checkpointed(_simhash_pairs(sets).union(first).distinct()), sets, rows, broadcast_rows)
    links = scored.where(near).select("a", "b")
    labels = checkpointed(component_labels(links))
    open_ = labelled(entries, labels)
    stars = checkpointed(open_.where("set_key <> leader").select(F.col("set_key").alias("a"), F.col("leader").alias("b")).distinct().join(scored, ["a", "b"], "left_anti"))
    if not stars.isEmpty():
        scored = scored.union(_compared(stars, sets, rows, broadcast_rows))
        links = scored.where(near).select("a", "b")
        labels = checkpointed(component_labels(links))
        open_ = labelled(open_.drop("label"), labels)
    open_ = open_.where("set_key <> leader").select("set_key", "label", "leader").distinct()
    mixed = open_.groupBy("leader").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("leader")
    open_ = checkpointed(open_.join(mixed, "leader", "left_semi"))
    if not open_.isEmpty():
        labels = _linked_rest(open_, links, labels, sets, rows, broadcast_rows)
    grouped = sets.join(labels, sets["set_key"] == labels["vertex"], "left").select("set_key", "first_id", F.coalesce("label", "set_key").alias("label"))
    least = grouped.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return signed.select("doc_id", "set_key").join(grouped.join(least, "label").select("set_key", "component_id"), "set_key").select("doc_id", "component_id")

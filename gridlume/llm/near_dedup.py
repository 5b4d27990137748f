"""Operator 3, MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find.

Words are runs of other than ASCII white space, A-Z lower-cased; a document's set is its distinct five-word
shingles (64-bit hashes), or its whole word sequence if it is shorter. SuperMinHash draws one slot of the
signature for each element and round from a seeded permutation; rounds go on only while a slot is empty, so
long documents need one or two.

Documents with equal sets form a class and are represented by its smallest doc_id. Representatives that share
a band of ROWS slots are candidates. First each bucket's members meet its first one; after grouping, the pairs
of a bucket that still lie in different groups follow, so each candidate pair is either tested or already in one
group. In a bucket of more than CROWD members (texts with a passage in common and no links) those pairs must also share
one of their rarest elements, which loses none that meets the threshold (rare_buckets). Before sets are fetched a pair must pass an exact bound from the sets' bitmaps. A pair of exactly the
threshold shares no band with probability (1 - 0.85^5)^26 = 2.4e-7.

Nothing hot is compared in one task: a large bucket's rows are dealt to tasks in parts, a document with many pairs sends its
set once for each PART of them, and classes with many copies get their roots by broadcast. A bucket's rows do meet where its
number is joined to them; these are ids and keys, which Spark's skew join deals out.

Null or empty text: empty set, linked with nothing. Null doc_id: kept as a row of its own, never linked.
Repeated rows have equal sets, and so one class. A doc_id with several texts is one node: it is linked with all that any
of its texts is linked with. Very long texts are read whole, one at a time. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlume.llm.common import small_batches, stage
from gridlume.operators.graph import components

SHINGLE, ROWS, BANDS = 5, 5, 26
SLOTS = ROWS * BANDS
#: Bits of a set's bitmap.
BITS = 1024
#: A link: 100 * shared >= PERCENT * union.
PERCENT = 85
#: Pairs of one document, and rows of one bucket, that are dealt to one task; most documents with more pairs, and most classes with many copies, that are broadcast.
PART, MEMBERS, MOST_HUBS, MOST_HOT = 500, 1000, 100_000, 1000
#: Most words of 64 bits of the filter of wanted ids that is broadcast; ids for each word up to there.
MOST_WORDS, IDS = 1 << 19, 4
#: Members of a bucket with several groups up to which all of them are compared; beyond, they must share a rare element. Cells of its counts.
CROWD, COUNTS = 64, 1 << 18
_odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's set."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    k = min(n, SHINGLE)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = mixed(h + w[i : n - k + 1 + i] * _odd[i])
    return np.unique(h)


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of all sets at once, round by round: (sets, slots); an empty set's slots stay at the largest number.

    In round j an element's value is j plus a fraction (24 bits) and its slot the j-th of its own permutation.
    A set leaves when no slot is empty: later rounds' values are larger than any it has.
    """
    empty = np.uint32(0xFFFFFFFF)
    out = np.full(len(sets) * slots, empty, np.uint32)
    sizes = np.array([len(s) for s in sets])
    element = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order: np.ndarray | None = None
    for j in range(slots):
        if not len(element):
            break
        r = mixed(element + np.uint64((j + 1) * int(_odd[0]) % 2**64))
        at = j + ((r >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        value = (np.uint64(j << 24) | (r & np.uint64(0xFFFFFF))).astype(np.uint32)
        if order is None:
            slot = at
        else:
            each = np.arange(len(element))
            slot = order[each, at].astype(np.int64)
            order[each, at] = order[:, j]
            order[:, j] = slot
        np.minimum.at(out, owner * slots + slot, value)
        open_sets = (out.reshape(-1, slots) == empty).any(axis=1)
        left = open_sets[owner]
        if order is None:
            # Only sets that go on need their elements' permutations, with the first draw's swap.
            at, element, owner = at[left], element[left], owner[left]
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(element), 1))
            order[np.arange(len(element)), at] = 0
            order[:, 0] = at
        elif not left.all():
            element, owner, order = element[left], owner[left], order[left]
    return out.reshape(-1, slots)


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, its number included."""
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _odd[1], (len(signature), 1))
    for i in range(ROWS):
        key = mixed(key + signature[:, i::ROWS].astype(np.uint64) * _odd[i])
    return key.view(np.int64)


def bitmap(s: np.ndarray) -> np.ndarray:
    """A bit for each element, in 64-bit words."""
    on = np.zeros(BITS, np.uint8)
    on[((s >> np.uint64(20)) % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(on).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two 64-bit sums that identify the set, its band keys and its bitmap."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(1)]
            keys = bands(signatures(sets))
            sums = np.array([(mixed(s).sum(dtype=np.uint64), mixed(s ^ _odd[2]).sum(dtype=np.uint64)) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            bits = np.concatenate([bitmap(s) for s in sets]) if sets else np.zeros(0, np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * n, pa.int32()), pa.array(x.ravel())) for x, n in ((keys, BANDS), (bits, BITS // 64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), *lists], ["doc_id", "n_shingles", "sum_a", "sum_b", "bands", "bits"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n_shingles long, sum_a long, sum_b long, bands array<long>, bits array<long>")


def sifted(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents whose id is in wanted (doc_id), and some others: texts are not shuffled to find them.

    Each wanted id sets one of 64 bits of a word; the words are broadcast, MOST_WORDS at most, and beyond that more others pass.
    """
    words = max(1, min(MOST_WORDS, wanted.count() // IDS))
    word = F.pmod(F.xxhash64("doc_id"), F.lit(words)).alias("_word")
    bit = F.expr("shiftleft(1L, CAST(pmod(xxhash64(doc_id, 1), 64) AS INT))")
    bits = wanted.where("doc_id is not null").groupBy(word).agg(F.bit_or(bit).alias("_bits"))
    return docs.withColumn("_word", word).join(F.broadcast(bits), "_word").where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and the sorted shingle hashes of the documents in wanted, and of some others (see sifted)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()).view(np.int64) for t in batch.column(1)]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))], ["doc_id", "shingles"])

    texts = sifted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted)
    return texts.mapInArrow(rows, "doc_id long, shingles array<long>")


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The candidate pairs that are links, by the full sets of the documents they name."""
    pairs = stage(pairs, "candidates")
    if pairs.isEmpty():
        return pairs
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = full_sets(docs, wanted).withColumn("_set", F.xxhash64("shingles")).dropDuplicates(["doc_id", "_set"]).drop("_set")
    return stage(verified(pairs, stage(sets, "full-sets")), "confirmed")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold. Both tables are read more than once.

    Each a's set goes ahead of its pairs, which bring the sets of their b, and is held while they pass.
    """
    most = max(PART, pairs.count() // MOST_HUBS)
    hubs = F.broadcast(pairs.groupBy("a").count().where(F.col("count") > most).select("a", F.ceil(F.col("count") / most).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    ahead = sets.withColumnRenamed("doc_id", "a").join(pairs.select("a"), "a", "left_semi").join(hubs, "a", "left")
    ahead = ahead.select("a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "shingles")
    after = pairs.select("a", "b").join(sets.withColumnRenamed("doc_id", "b"), "b").join(hubs, "a", "left")
    after = after.select("a", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"), "b", "shingles")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, held = None, []
        for batch in batches:
            ends = batch.column(3).offsets.to_numpy() - batch.column(3).offsets[0].as_py()
            values, found = batch.column(3).flatten().to_numpy().view(np.uint64), []
            for a, part, b, i, j in zip(*(batch.column(k).to_pylist() for k in range(3)), ends, ends[1:], strict=False):
                if (a, part) != owner:
                    owner, held = (a, part), []
                if b is None:
                    held.append(values[i:j].copy())
                elif any(alike(x, values[i:j]) for x in held):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    small_batches(pairs.sparkSession)
    ordered = ahead.union(after).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return ordered.mapInArrow(rows, "a long, b long").distinct()


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets meet the threshold."""
    if not len(x) or not len(y):
        return False
    shared = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * shared >= PERCENT * (len(x) + len(y) - shared)


def bounded(pairs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The pairs (a, b) that can still meet the threshold by their sets' bitmaps. bitmaps: doc, n, bits."""
    for side in "ab":
        pairs = pairs.join(bitmaps.select(F.col("doc").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)
    return pairs.where(possible()).select("a", "b")


def possible():
    """An exact bound: an element whose bit the other set lacks isn't shared."""

    def only(one: str, other: str):
        return F.aggregate(F.zip_with(f"bits_{one}", f"bits_{other}", lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda n, k: n + k)

    shared = F.least(F.col("n_a") - only("a", "b"), F.col("n_b") - only("b", "a"))
    return 100 * shared >= PERCENT * (F.col("n_a") + F.col("n_b") - shared)


def open_buckets(rows: DataFrame) -> DataFrame:
    """key, members, largest (group) of the buckets that hold several groups. rows: key, doc, root; counted before a key's rows meet."""
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    return sizes.groupBy("key").agg(F.count("*").alias("groups"), F.sum("n").alias("members"), F.max_by("root", F.struct("n", "root")).alias("largest")).where("groups > 1").drop("groups")


def other_groups(rows: DataFrame) -> DataFrame:
    """Pairs (a < b) of different groups of a bucket that can still meet the threshold. rows: key, doc, root, largest, parts, n, bits.

    Of such a pair one lies outside the bucket's largest group: those are dealt to parts of their bucket, and each part meets
    the whole bucket.
    """
    part = {"a": F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"), "b": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))}
    a, b = (rows.select("key", part[s].alias("part"), *(F.col(c).alias(f"{c}_{s}") for c in ("doc", "root", "n", "bits", "largest"))) for s in "ab")
    met = a.where("root_a <> largest_a").join(b, (a["key"] == b["key"]) & (a["part"] == b["part"]) & (F.col("root_a") != F.col("root_b")) & possible())
    return met.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")).distinct()


def rare_buckets(docs: DataFrame, crowd: DataFrame) -> DataFrame:
    """Buckets of the documents in crowd (doc, root) by their rarest elements: key, doc, root, largest, parts.

    Two sets that meet the threshold share at least PERCENT of the larger one, so under one order of all elements they share
    one of the first n - ceil(PERCENT n / 100) + 1 of each. The order is by how many elements of the crowd fall on the
    element's count cell (COUNTS cells, which are sent to all tasks), rare first, then by the element: any order is exact,
    this one leaves out what the crowd has in common.
    """
    sets = stage(full_sets(docs, crowd.select(F.col("doc").alias("doc_id"))), "crowd-sets")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTS, np.int64)
        for batch in batches:
            total += np.bincount(cell_of(batch.column(0).flatten().to_numpy()), minlength=COUNTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["cell", "n"])

    counted = sets.select("shingles").mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(COUNTS, np.int64)
    for batch in counted.toArrow().to_batches():  # at most COUNTS rows
        counts[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(1).offsets.to_numpy()
            values, found = batch.column(1).values.to_numpy(), []
            for i, j in zip(ends, ends[1:], strict=False):
                own = values[i:j]
                n = len(own)
                order = np.lexsort((own, sent.value[cell_of(own)]))
                found.append(own[order[: n + (-PERCENT * n) // 100 + 1]])
            lengths = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))], ["doc_id", "rare"])

    small_batches(docs.sparkSession)
    elements = sets.mapInArrow(rare, "doc_id long, rare array<long>").select(F.col("doc_id").alias("doc"), F.explode("rare").alias("element")).distinct()
    rows = stage(elements.join(crowd, "doc").select(F.col("element").alias("key"), "doc", "root"), "rare-elements")
    shared = stage(open_buckets(rows), "rare-buckets")
    return rows.join(shared, "key").select("key", "doc", "root", "largest", F.ceil(F.col("members") / MEMBERS).cast("int").alias("parts"))


def cell_of(elements: np.ndarray) -> np.ndarray:
    return (elements.view(np.uint64) % np.uint64(COUNTS)).astype(np.int64)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each document."""
    sketch = stage(sketches(docs), "sketches")
    same = ["n_shingles", "sum_a", "sum_b"]
    classes = stage(sketch.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.min("bands").alias("bands"), F.min("bits").alias("bits")), "set-classes")
    bitmaps = classes.select("doc", F.col("n_shingles").alias("n"), "bits")
    keyed = classes.select(F.explode("bands").alias("key"), "doc")
    firsts = keyed.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first <> last").select("key", "first")
    buckets = stage(keyed.join(firsts, "key"), "buckets")

    first = stage(buckets.where("doc <> first").select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct(), "first-pairs")
    groups = components(confirmed(docs, bounded(first, bitmaps).distinct()))

    # Pairs of different groups that still share a bucket; in a crowded one they must share a rare element as well.
    root = F.coalesce("root", "doc").alias("root")
    grouped = stage(buckets.join(groups, F.col("doc") == F.col("node"), "left").select("key", "doc", root), "grouped-buckets")
    open_ = stage(open_buckets(grouped), "open-buckets")
    small = grouped.join(open_.where(F.col("members") <= CROWD), "key").select("key", "doc", "root", "largest", F.lit(1).alias("parts"))
    crowd = grouped.join(open_.where(F.col("members") > CROWD).select("key"), "key", "left_semi").select("doc", "root").distinct()
    crowd = stage(crowd, "crowd")
    rows = small if crowd.isEmpty() else small.union(rare_buckets(docs, crowd))
    rows = stage(rows.join(bitmaps, "doc"), "open-members")
    rest = other_groups(rows).join(first, ["a", "b"], "left_anti")
    # A group's members with its root stand for the links found so far.
    links = groups.select(F.col("node").alias("a"), F.col("root").alias("b")).union(confirmed(docs, rest))
    groups = components(links)

    roots = stage(classes.join(groups, F.col("doc") == F.col("node"), "left").select(*same, "copies", root), "class-roots")
    # At most MOST_HOT classes have so many copies; empty sets have no root.
    hot = F.broadcast(roots.where(F.col("copies") > sketch.count() / MOST_HOT).select(*same, F.col("root").alias("hot_root")))
    rows = sketch.select("doc_id", *same)
    full = rows.where("n_shingles > 0").join(hot, same, "left")
    few = full.where("hot_root is null").join(roots.select(*same, "root"), same, "left")
    out = few.select("doc_id", "n_shingles", "root").union(full.where("hot_root is not null").select("doc_id", "n_shingles", "hot_root"))
    out = out.union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

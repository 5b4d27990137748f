"""Operator 12, vector code compression: product codes whose codebooks are fitted by dual-tree Lloyd rounds.

Components become integers, floor(1024 x); a vector is cut in 4 equal parts, each with a codebook of its own. Vectors are
gathered, in the task that reads them, to blocks of BLOCK; a block has for each part a balanced tree over its parts (split at
the median of the widest component) with each node's bounds and cached sums, written once. A round sends the codebooks
(PARTS x ENTRIES entries: bounded) to the tasks, builds a tree over each, and walks both trees together: a pair of nodes goes
when even its least distance is above the greatest distance to another pair of the same parts' node. A node left with one
entry is assigned whole by its cached sum; leaves with several compare integers. Only sums and counts by part and entry are
shuffled. All is exact: pruning asks for a strictly greater bound, so ties reach the leaves and go to the lower index.

Rows with a null or empty vector, or with a null or non-finite component, are dropped. Other vectors must have one length,
a multiple of 4, and components below 65,536 in size (int64 is then exact); else the job fails and says so. Ties among
vec_ids (repeated rows, null ids last) are ordered by vector: each row counts and is coded. With fewer than 256 rows
the codebooks are shorter. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlume.llm.common import small_batches, stage

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors in a block and parts in a tree's leaf.
BLOCK, LEAF = 2048, 32
#: Integers below it are exact in all sums of squares, up to 1024 components a part.
LARGEST = 1 << 26
#: Labels whose sums are broadcast at most (16 bytes each and the label); beyond, rows meet them by a salted join.
MOST_LABELS, SALTS = 1 << 16, 64


def integers(vectors: np.ndarray) -> np.ndarray:
    out = np.floor(vectors.astype(np.float64) * SCALE)
    if out.size and np.abs(out).max() >= LARGEST:
        raise ValueError(f"components of {LARGEST // SCALE} or more aren't supported")
    return out.astype(np.int64)


def cuts(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin and end among n rows in the tree's order."""
    return (np.arange((1 << level) + 1) * n) >> level


def depth(n: int, leaf: int) -> int:
    return max(0, math.ceil(math.log2(n / leaf))) if leaf > 1 else int(math.log2(n))


def tree_order(x: np.ndarray, levels: int) -> np.ndarray:
    """A permutation of the rows under which each node's rows are neighbours: nodes are split in the middle of their widest component."""
    order = np.arange(len(x))
    for level in range(levels):
        at, below = cuts(len(x), level), cuts(len(x), level + 1)
        for j in range(1 << level):
            part = order[at[j] : at[j + 1]]
            rows = x[part]
            widest = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
            order[at[j] : at[j + 1]] = part[np.argpartition(rows[:, widest], below[2 * j + 1] - at[j])]
    return order


def node_bounds(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum.reduceat(x, at[:-1]), np.maximum.reduceat(x, at[:-1])


def node_table(x: np.ndarray, levels: int) -> np.ndarray:
    """Least, greatest and summed components of all nodes, level by level."""
    out = []
    for level in range(levels + 1):
        at = cuts(len(x), level)
        out.append(np.stack([*node_bounds(x, at), np.add.reduceat(x, at[:-1])], axis=1))
    return np.concatenate(out)


class EntryTree:
    """A codebook's tree: bounds of each level's nodes, the last level being the entries themselves."""

    def __init__(self, entries: np.ndarray):
        levels = depth(len(entries), 1)
        self.entries, self.order = entries, tree_order(entries, levels)
        x = entries[self.order]
        self.cuts = [cuts(len(x), level) for level in range(levels + 1)]
        self.bounds = [*(node_bounds(x, at) for at in self.cuts), (x, x)]
        self.last = levels + 1

    def children(self, pairs: tuple[np.ndarray, np.ndarray], level: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the same parts' nodes with the children of the entries' nodes, which are of this level."""
        p, e = pairs
        first, after = (2 * e, 2 * e + 2) if level + 1 < self.last else (self.cuts[level][e], self.cuts[level][e + 1])
        many = after - first
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(p, many), np.repeat(first, many) + within


def pruned(p: np.ndarray, e: np.ndarray, part_bounds: tuple, entry_bounds: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (sorted by p) that may hold a nearest entry: least distance not above p's least greatest distance."""
    (low, high), (entry_low, entry_high) = part_bounds, entry_bounds
    a, b, c, d = low[p], high[p], entry_low[e], entry_high[e]
    near = (np.maximum(0, np.maximum(c - b, a - d)) ** 2).sum(axis=1)
    far = (np.maximum(d - a, b - c) ** 2).sum(axis=1)
    starts = np.flatnonzero(np.diff(p, prepend=-1))
    least = np.minimum.reduceat(far, starts)
    keep = near <= np.repeat(least, np.diff(starts, append=len(p)))
    return p[keep], e[keep]


class PartTree:
    """One part of a block's vectors in the tree's order, with its nodes' bounds and sums."""

    def __init__(self, x: np.ndarray, nodes: np.ndarray):
        self.x, self.levels = x, depth(len(x), LEAF)
        self.low, self.high, self.sums = (nodes[:, i] for i in range(3))

    def assign(self, tree: EntryTree) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
        """Nearest entry of each row; the rows' sums and counts by entry; how many rows went by whole nodes and by comparison."""
        n, width = self.x.shape
        best, sums, counts = np.zeros(n, np.int64), np.zeros((len(tree.entries), width), np.int64), np.zeros(len(tree.entries), np.int64)
        went = {"whole": 0, "compared": 0, "distances": 0}
        p = e = np.zeros(1, np.int64)
        entry_level = 0
        for level in range(self.levels + 1):
            at, base = cuts(n, level), (1 << level) - 1
            mine = (self.low[base : 2 * base + 1], self.high[base : 2 * base + 1])
            p, e = pruned(p, e, mine, tree.bounds[entry_level])
            for _ in range(2):
                if entry_level < tree.last:
                    p, e = tree.children((p, e), entry_level)
                    entry_level += 1
                    p, e = pruned(p, e, mine, tree.bounds[entry_level])
            if level == self.levels:
                while entry_level < tree.last:
                    p, e = tree.children((p, e), entry_level)
                    entry_level += 1
                    p, e = pruned(p, e, mine, tree.bounds[entry_level])
            if entry_level == tree.last:
                starts = np.flatnonzero(np.diff(p, prepend=-1))
                many = np.diff(starts, append=len(p))
                for i in starts[many == 1]:
                    node, entry = int(p[i]), int(tree.order[e[i]])
                    best[at[node] : at[node + 1]] = entry
                    sums[entry] += self.sums[base + node]
                    counts[entry] += at[node + 1] - at[node]
                    went["whole"] += int(at[node + 1] - at[node])
                open_ = np.repeat(many > 1, many)
                p, e = p[open_], e[open_]
            if not len(p):
                break
            if level < self.levels:
                order = np.argsort(np.concatenate([2 * p, 2 * p + 1]), kind="stable")
                p, e = np.concatenate([2 * p, 2 * p + 1])[order], np.concatenate([e, e])[order]
        else:
            starts = [*np.flatnonzero(np.diff(p, prepend=-1)), len(p)]
            for i, j in zip(starts, starts[1:]):
                rows = slice(at[p[i]], at[p[i] + 1])
                some = np.sort(tree.order[e[i:j]])
                x, c = self.x[rows], tree.entries[some]
                # Squared distances but for each row's own square, in integers.
                own = some[np.argmin((c * c).sum(axis=1) - 2 * (x @ c.T), axis=1)]
                best[rows] = own
                went["compared"] += len(x)
                went["distances"] += len(x) * len(c)
                np.add.at(sums, own, x)
                counts += np.bincount(own, minlength=len(counts))
        return best, sums, counts, went


def blocks_of(vectors: DataFrame) -> DataFrame:
    """Blocks of vectors with their trees: ids and labels, and for each part the order, the components in it, and the nodes."""
    label = vectors.schema["label"].dataType
    schema = f"vec_ids array<long>, labels array<{label.simpleString()}>, orders array<binary>, parts array<binary>, nodes array<binary>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                yield block(held)
                held = []
        if sum(b.num_rows for b in held):
            yield block(held)

    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        n = table.num_rows
        lists = table.column("vector").combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        lengths = np.diff(lists.offsets.to_numpy())
        if len(set(lengths.tolist())) > 1 or lengths[0] % PARTS:
            raise ValueError(f"vectors must have one length, a multiple of {PARTS}: {sorted(set(lengths.tolist()))[:5]}")
        x = integers(flat.reshape(n, -1)).reshape(n, PARTS, -1)
        levels = depth(n, LEAF)
        orders, parts, nodes = [], [], []
        for i in range(PARTS):
            order = tree_order(x[:, i], levels)
            mine = x[order, i]
            orders.append(order.astype("<i4").tobytes())
            parts.append(mine.astype("<i4").tobytes())
            nodes.append(node_table(mine, levels).astype("<i8").tobytes())
        whole = pa.array([0, n], pa.int32())
        columns = [pa.ListArray.from_arrays(whole, table.column(c).combine_chunks()) for c in ("vec_id", "label")]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array([c], pa.list_(pa.binary())) for c in (orders, parts, nodes))], ["vec_ids", "labels", "orders", "parts", "nodes"])

    small_batches(vectors.sparkSession, BLOCK)
    return vectors.mapInArrow(rows, schema)


def trees_of(row: dict, width: int) -> list[PartTree]:
    out = []
    for part, nodes in zip(row["parts"], row["nodes"], strict=True):
        out.append(PartTree(np.frombuffer(part, "<i4").reshape(-1, width).astype(np.int64), np.frombuffer(nodes, "<i8").reshape(-1, 3, width)))
    return out


def lloyd_round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, component) after one more assignment and mean."""
    parts, entries, width = books.shape
    names = ["part", "entry", "n", *(f"s{i}" for i in range(width))]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [EntryTree(b) for b in books]
        total, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                for i, mine in enumerate(trees_of(row, width)):
                    _, s, c, _ = mine.assign(trees[i])
                    total[i] += s
                    counts[i] += c
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (part, entry, counts[part, entry], *total[part, entry].T)], names)

    small_batches(blocks.sparkSession, 8)
    made = blocks.select("parts", "nodes").mapInArrow(sums, ", ".join(f"{n} long" for n in names)).groupBy("part", "entry").agg(*(F.sum(n).alias(n) for n in names[2:]))
    out = books.copy()
    for row in made.collect():
        out[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return out


def codes_of(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of every vector."""
    label = blocks.schema["labels"].dataType.elementType.simpleString()
    width = books.shape[2]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [EntryTree(b) for b in books]
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = one.select(["orders", "parts", "nodes"]).to_pylist()[0]
                errors, codes = 0, []
                for k, mine in enumerate(trees_of(row, width)):
                    best = mine.assign(trees[k])[0]
                    off = ((mine.x - books[k][best]) ** 2).sum(axis=1)
                    place = np.argsort(np.frombuffer(row["orders"][k], "<i4"))
                    codes.append(best[place])
                    errors = errors + off[place]
                code = [f"{a:02x}{b:02x}{c:02x}{d:02x}" for a, b, c, d in zip(*(c.tolist() for c in codes), strict=True)]
                yield pa.RecordBatch.from_arrays([one.column("vec_ids").flatten(), one.column("labels").flatten(), pa.array(code), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    small_batches(blocks.sparkSession, 8)
    return blocks.mapInArrow(rows, f"vec_id long, label {label}, code string, error long")


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector (doubles) of the rows that are kept."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where((F.size("embedding") > 0) & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))


def first_books(rows: DataFrame, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the vectors with the smallest ids: part, entry, component. At most ENTRIES vectors come to the driver."""
    some = rows.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    if not some:
        return np.zeros((PARTS, 0, 0), np.int64)
    lengths = {len(r["vector"]) for r in some}
    if len(lengths) > 1 or min(lengths) % PARTS:
        raise ValueError(f"vectors must have one length, a multiple of {PARTS}: {sorted(lengths)[:5]}")
    return integers(np.array([r["vector"] for r in some])).reshape(len(some), PARTS, -1).swapaxes(0, 1)


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the errors summed over equal labels; nulls are one label."""
    sums = stage(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    if sums.count() <= MOST_LABELS:
        sums = F.broadcast(sums.withColumnRenamed("label", "_label"))
        return coded.join(sums, coded["label"].eqNullSafe(sums["_label"]), "left").drop("_label")
    salted = sums.withColumnRenamed("label", "_label").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, rows["label"].eqNullSafe(salted["_label"]) & (rows["salt"] == salted["_salt"]), "left").drop("salt", "_label", "_salt")


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every kept row of vectors (vec_id, embedding, label)."""
    rows = usable(vectors)
    books = first_books(rows)
    if not books.size:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    blocks = stage(blocks_of(rows), "vector-blocks")
    books = reduce(lambda now, _: lloyd_round(blocks, now), range(rounds), books)
    coded = stage(codes_of(blocks, books), "vector-codes")
    return with_label_errors(coded).withColumn("codebooks_sha256", F.lit(books_sha256(books)))

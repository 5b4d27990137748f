"""Operator 1, packing: cutting-stock column generation.

Piece lengths are rounded up to WIDTH tokens, so the histogram has capacity / WIDTH
classes at any corpus size. A linear program over packing patterns is solved by
column generation on that histogram (knapsack dynamic programming prices columns);
the rounded patterns are handed to the pieces by their rank in their class.

Null text counts as empty (one piece with the end id alone). Repeated rows are packed
each by itself. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlume.llm.common import small_batches, stage
from gridlume.llm.token_counts import byte_alphabet

#: Tokens in a length class, words that a worker remembers, and their longest.
WIDTH, REMEMBERED, LONGEST = 16, 500_000, 64
#: Characters of the texts that are told apart together; a longer text is by itself.
TOGETHER = 1 << 20
#: Pivots after which a search that no longer gains is ended.
STALL = 400
#: Stands between words that are encoded together.
MARK = "|"
#: Lower-case Latin letters, which no normalisation changes, and a run of ASCII marks after them: two pre-tokens of the vocabulary's pattern.
SIMPLE = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)").fullmatch
#: Pieces for which one more bucket is taken, and the most: each class is ranked in that many.
PER_SALT, MOST_SALTS = 500_000, 4096


class Encoder:
    """Token ids of texts.

    The tokenizer drops white space and never joins words across it. So a batch's words are told apart by Arrow, each
    distinct one is looked up once, those not met before are encoded (plain ones by the model itself, the others in one text), and the texts' ids are gathered from
    one array of all known words' ids. Words of more than LONGEST letters aren't remembered, and when REMEMBERED others
    are, all are forgotten: that bounds a worker's memory.
    """

    def __init__(self, path: str, keep: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        (self.mark,) = self.raw([MARK])[0]
        self.model, self.letters = self.tokenizer.model, [letter for letter, _ in sorted(byte_alphabet().items(), key=lambda x: x[1])]
        self.forget()

    def forget(self) -> None:
        """No known words: their places in starts and sizes, and the ids that those two speak of."""
        self.place: dict[str, int] = {}
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def separate(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids one after another, and each word's size. SIMPLE words go to the model by their one or two pre-tokens."""
        found: list[list[int] | None] = []
        for w in words:
            parts = SIMPLE(w)
            found.append(self.merged(parts[1]) + (self.merged(parts[2]) if parts[2] else []) if parts else None)
        rest = [i for i, ids in enumerate(found) if ids is None]
        ids, sizes = self.together([words[i] for i in rest]) if rest else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        for i, part in zip(rest, np.split(ids, np.cumsum(sizes)[:-1])) if rest else []:
            found[i] = part.tolist()
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), "<u4", int(sizes.sum())), sizes

    def merged(self, part: str) -> list[int]:
        """Ids of a pre-token, which the model gets as letters that stand for its bytes."""
        return [t.id for t in self.model.tokenize(part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode())))]

    def together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words' ids and sizes from one text in which a mark that no word has stands between them."""
        odd = [i for i, w in enumerate(words) if MARK in w or any(s in w for s in self.special)]
        alone = dict(zip(odd, self.raw([words[i] for i in odd]), strict=True)) if odd else {}
        joined = f" {MARK} ".join("" if i in alone else w for i, w in enumerate(words)) if odd else f" {MARK} ".join(words)
        ids = self.raw([joined])[0]
        marks = np.flatnonzero(ids == self.mark)
        sizes = np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
        ids = np.delete(ids, marks)
        if odd:
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i, found in alone.items():
                parts[i], sizes[i] = found, len(found)
            ids = np.concatenate(parts)
        return ids, sizes

    def plain(self, text: str) -> str:
        """text lower-cased where that gives the same ids: it is composed both before and after."""
        if "Σ" not in text:
            low = text.lower()
            if text.isascii() or unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low):
                text = low
        return text.replace("\n", " ")

    def known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's start and size in the array of ids, which is the third."""
        if len(self.place) > self.keep:
            self.forget()
        get = self.place.get
        at = np.array([get(w, -1) for w in words], np.int64)
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return self.starts[at], self.sizes[at], self.ids
        # Words to be remembered come first, so the others' ids can be cut off after this batch.
        new = sorted((words[i] for i in missing), key=lambda w: len(w) > LONGEST)
        found, sizes = self.separate(new)
        ids, n = np.concatenate([self.ids, found]), sum(len(w) <= LONGEST for w in new)
        base, starts = len(self.starts), len(self.ids) + np.cumsum(sizes) - sizes
        all_starts, all_sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        here = dict(zip(new, range(base, base + len(new)), strict=True))
        at[missing] = [here[words[i]] for i in missing]
        self.place.update(zip(new[:n], range(base, base + n), strict=True))
        self.starts, self.sizes, self.ids = all_starts[: base + n], all_sizes[: base + n], ids[: len(self.ids) + int(sizes[:n].sum())]
        return all_starts[at], all_sizes[at], ids

    def all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Each text's ids, TOGETHER characters of texts at a time."""
        some, size = [], 0
        for text in texts:
            if some and size + len(text) > TOGETHER:
                yield from self.texts(some)
                some, size = [], 0
            some.append(text)
            size += len(text)
        yield from self.texts(some)

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids, as little-endian 32-bit numbers."""
        whole = [any(s in t for s in self.special) for t in texts]
        split = pc.split_pattern(pa.array(["" if w else self.plain(t) for t, w in zip(texts, whole, strict=True)], pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        starts, sizes, ids = self.known(words.dictionary.to_pylist())
        code = words.indices.to_numpy(zero_copy_only=False)
        size = sizes[code]
        ends = np.cumsum(size)
        flat = ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[code] - (ends - size), size)]
        cuts = np.append(0, ends)[split.offsets.to_numpy()]
        return [self.raw([t])[0] if w else flat[i:j] for t, w, i, j in zip(texts, whole, cuts, cuts[1:], strict=False)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder in each Python worker, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of at most capacity ids: doc_id, start, length, ids_crc32, doc_tokens."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path), np.array([end_id], "<u4")
        for batch in batches:
            keys, starts, lengths, crcs, totals = [], [], [], [], []
            for key, ids in zip(batch.column(0).to_pylist(), encode.all([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = np.append(ids, end)
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity]
                    keys.append(key)
                    starts.append(at)
                    lengths.append(len(part))
                    crcs.append(zlib.crc32(part.tobytes()))
                    totals.append(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, starts, lengths, crcs, totals)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    small_batches(docs.sparkSession, 512)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the pattern of greatest value within capacity."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = np.searchsorted(sizes, room, "right")
        best[room], choice[room] = best[room - 1], -1
        if fits:
            worth = best[room - sizes[:fits]] + values[:fits]
            if worth[k := int(worth.argmax())] > best[room] + 1e-12:
                best[room], choice[room] = worth[k], k
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(best[capacity]), pattern


def inverted(square: np.ndarray) -> np.ndarray:
    """The inverse, by elimination with row exchanges."""
    n = len(square)
    both = np.hstack([square, np.eye(n)])
    for k in range(n):
        top = k + int(np.abs(both[k:, k]).argmax())
        if top != k:
            both[[k, top]] = both[[top, k]]
        both[k] /= both[k, k]
        rows = np.flatnonzero(both[:, k])
        rows = rows[rows != k]
        both[rows] -= both[rows, k][:, None] * both[k]
    return both[:, n:]


def cutting_stock(demand: dict[int, int], capacity: int, gap: float = 5e-4) -> list[tuple[dict[int, int], int]]:
    """Patterns (pieces by size, how often) that cover demand exactly.

    Revised simplex on the columns priced so far; it ends when the dual bound is within gap, or when STALL
    pivots lower the number of sequences by less than a fiftieth of gap: the patterns then still cover all pieces,
    but may lie above the gap. What rounding down leaves is at most one pattern for each size, and is packed
    largest first. No product or inverse here runs in the linear algebra library: after the
    driver's JVM has started, its inverse of 128 rows never returned (most likely its threads are lost in that fork).
    """
    sizes = np.array(sorted(k for k, n in demand.items() if n), int)
    if not len(sizes):
        return []
    need = np.array([demand[k] for k in sizes], float)
    basis = np.diag((capacity // sizes).astype(float))
    inverse, amounts = np.diag(1 / np.diag(basis)), need / np.diag(basis)
    held = np.inf
    for turn in itertools.count():
        if turn % 64 == 63:
            inverse = inverted(basis)
            amounts = np.maximum((inverse * need).sum(axis=1), 0)
        prices = inverse.sum(axis=0)
        worth, pattern = best_pattern(np.maximum(prices, 0), sizes, capacity)
        if worth <= 1 + gap:
            break
        used = np.flatnonzero(pattern)
        step = (inverse[:, used] * pattern[used]).sum(axis=1)
        rows = np.flatnonzero(step > 1e-9)
        # Degenerate pivots bring nothing, and could go round: a long run of them ends the search.
        if turn % STALL == STALL - 1:
            if amounts.sum() > held * (1 - gap / 50):
                break
            held = amounts.sum()
        if not len(rows):
            break
        out = rows[np.argmin(amounts[rows] / step[rows])]
        move = amounts[out] / step[out]
        amounts = np.maximum(amounts - move * step, 0)
        amounts[out] = move
        basis[:, out] = pattern
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
    left, found = need.astype(np.int64), []
    for column, amount in sorted(zip(basis.T.astype(np.int64), amounts, strict=True), key=lambda x: -x[1]):
        used = column > 0
        times = min(int(amount + 1e-6), int((left[used] // column[used]).min()))
        if times > 0:
            found.append((dict(zip(sizes[used].tolist(), column[used].tolist(), strict=True)), times))
            left = left - times * column
    while left.any():
        pattern, room = np.zeros(len(sizes), np.int64), capacity
        for k in range(len(sizes) - 1, -1, -1):
            pattern[k] = min(left[k], room // sizes[k])
            room -= pattern[k] * sizes[k]
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        found.append((dict(zip(sizes[used].tolist(), pattern[used].tolist(), strict=True)), times))
        left = left - times * pattern
    return found


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces with sequence_id and offset. pieces must be stored (see stage): it is read three times.

    Only the histogram (capacity / WIDTH rows) reaches the driver; the pattern table and the rank offsets that
    are broadcast have at most (capacity / WIDTH) * capacity / WIDTH and (capacity / WIDTH) * MOST_SALTS rows. The
    number of buckets follows the number of pieces, so that a class, however large, is ranked in tasks of like size.
    """
    spark = pieces.sparkSession
    salts = max(64, min(MOST_SALTS, pieces.count() // PER_SALT))
    ranked = pieces.withColumns({"_class": F.ceil(F.col("length") / WIDTH).cast("int"), "_salt": F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int")})
    counts = stage(ranked.groupBy("_class", "_salt").agg(F.count("*").alias("_n")), "packing-counts")
    patterns = cutting_stock({r[0]: r[1] for r in counts.groupBy("_class").agg(F.sum("_n")).collect()}, capacity // WIDTH)
    rows, first, given = [], 0, dict.fromkeys(range(capacity // WIDTH + 1), 0)
    for pattern, times in patterns:
        slot = 0
        for size, each in sorted(pattern.items(), reverse=True):
            rows.append((size, given[size], given[size] + times * each, first, each, slot))
            given[size] += times * each
            slot += each
        first += times
    plan = spark.createDataFrame(rows, "_class int, _from long, _to long, _first long, _each long, _slot long")
    before = counts.select("_class", "_salt", (F.sum("_n").over(Window.partitionBy("_class").orderBy("_salt")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_class", "_salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    placed = (
        ranked.withColumn("_rank", rank)
        .join(F.broadcast(before), ["_class", "_salt"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .join(F.broadcast(plan), ["_class"])
        .where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
        .withColumns({"sequence_id": (F.col("_first") + F.expr("(_rank - _from) div _each")), "_at": F.col("_slot") + (F.col("_rank") - F.col("_from")) % F.col("_each")})
    )
    offset = F.coalesce(F.sum("length").over(Window.partitionBy("sequence_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("offset", offset.cast("long")).drop("_class", "_salt", "_rank", "_before", "_from", "_to", "_first", "_each", "_slot", "_at")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """Every document's ids in sequences of at most capacity: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(stage(token_pieces(docs, tokenizer_path, capacity, end_id), "packing-pieces"), capacity)

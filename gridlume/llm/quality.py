"""Operator 10, quality classifier: nearest-neighbour voting on latent-semantic vectors.

A text's terms are taken over the whole text and hashed: its words and their first four letters, sequences of three
shapes (runs of letters of one case, single digits, marks, spaces and line ends), and how often a word is repeated at
once up to REPEATS times. Log counts, weighted by rarity, words and shapes alike in length, are projected on
the sample's first DIMENSIONS right singular vectors. The labelled sample's vectors (at most MOST_LABELLED
by DIMENSIONS, 1 MB) are broadcast; every document's exact cosines with all of them are computed in blocks, and
its NEIGHBOURS nearest, with all that tie with the last of them, vote with their similarity as weight.

Labels come from the training folds alone. Null or empty text has the zero vector: its score is the sample's mean
label. Very long texts are read whole, one at a time. Repeated rows are each scored; in the sample a doc_id counts once,
by its first text in order, and of several labels the lowest holds. An empty table gives no rows; without labels every
score is 1, so that nothing is rejected. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlume.llm.common import fold_of, small_batches, stage

#: Bounds of the sample, and those that vote.
MOST_LABELLED, DIMENSIONS, NEIGHBOURS = 4096, 64, 15
FOLDS, HELD_OUT = 3, 1
SHAPES, WORDS, REPEATS, BLOCK = 4096, 4096, 8, 256
#: Texts that are scored together.
VOTING = 64
TERMS = SHAPES + WORDS


def shape_codes() -> np.ndarray:
    """A code for each byte: letters by case (bytes of longer characters count as lower-case letters), digits, and each mark by itself."""
    code = np.arange(256, dtype=np.int64) + 8
    code[[*range(97, 123), *range(128, 256)]] = 1
    code[65:91] = 2
    code[48:58] = 3
    code[[9, 11, 12, 13, 32]] = 4
    code[10] = 5
    return code


_codes = shape_codes()
#: For a byte (A-Z as a-z) at each of 32 places in a word a random number: a word's hash is their sum.
_places = np.random.default_rng(10).integers(0, 2**63, (32, 256), np.int64).astype(np.uint64)
_places[:, 65:91] = _places[:, 97:123]
#: Letters of a word that also count by themselves.
START = 4


def word_terms(b: np.ndarray) -> np.ndarray:
    """The hashed numbers of a text's words (runs of letters and digits, by its bytes) and of their first letters."""
    at = np.flatnonzero((_codes[b] <= 3))
    if not len(at):
        return at
    first = np.append(True, at[1:] != at[:-1] + 1)
    starts = np.flatnonzero(first)
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    value = _places[place & 31, b[at]] * (2 * (place >> 5).astype(np.uint64) + np.uint64(1))
    words = np.add.reduceat(value, starts)
    begun = np.add.reduceat(np.where(place < START, value, np.uint64(0)), starts)[np.diff(np.append(starts, len(at))) > START] + np.uint64(1)
    return ((np.concatenate([words, begun]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)


def terms(text: str | None) -> np.ndarray:
    """Counts of the text's hashed terms: shapes, then words."""
    out = np.zeros(TERMS, np.float32)
    b = np.frombuffer((text or "").encode(), np.uint8)
    if not len(b):
        return out
    out[SHAPES:] = np.bincount(word_terms(b), minlength=WORDS)
    c = _codes[b]
    # A run of letters is one shape.
    c = c[np.append(True, (c[1:] != c[:-1]) | (c[1:] > 2))]
    if len(c) < 3:
        c = np.append(c, np.zeros(3, np.int64))
    h = (c[:-2] * 1_000_003 + c[1:-1] * 10_007 + c[2:] * 101) * 0x9E3779B1 & 0xFFFFFFFF
    out[:SHAPES] = np.bincount(h >> 20, minlength=SHAPES)
    words, run = text.split(), 0
    for x, y in zip(words, words[1:], strict=False):
        if x == y:
            run = min(run + 1, REPEATS)
            out[SHAPES - run] += 1
        elif run:
            run = 0
    return out


class Model:
    """rarity: weight of each term; basis: terms by DIMENSIONS; vectors, labels: the sample.

    The sample's counts are kept by their non-zero places and made dense BLOCK texts at a time.
    """

    def __init__(self, counts: list[np.ndarray], labels: np.ndarray):
        """counts: for each text an array of two rows, places and counts."""
        present = np.bincount(np.concatenate([c[0] for c in counts]), minlength=TERMS)
        self.rarity = np.log((1 + len(counts)) / (1 + present)).astype(np.float32) + 1
        rng = np.random.default_rng(10)
        k = min(DIMENSIONS, len(counts))
        # Randomised singular vectors, three power rounds.
        y = rng.standard_normal((TERMS, min(k + 16, len(counts))), np.float32)
        for turn in range(4):
            q = np.linalg.qr(y)[0] if turn else y
            y = sum(x.T @ (x @ q) for x in self.blocks(counts))
        q = np.linalg.qr(y)[0]
        z = np.concatenate([x @ q for x in self.blocks(counts)])
        self.basis = (q @ np.linalg.svd(z, full_matrices=False)[2].T[:, :k]).astype(np.float32)
        self.vectors = np.concatenate([self.unit(x @ self.basis) for x in self.blocks(counts)])
        self.labels, self.mean = labels.astype(np.float32), float(labels.mean())

    def blocks(self, counts: list[np.ndarray]) -> Iterator[np.ndarray]:
        for at in range(0, len(counts), BLOCK):
            some = counts[at : at + BLOCK]
            dense = np.zeros((len(some), TERMS), np.float32)
            for row, c in zip(dense, some, strict=True):
                row[c[0]] = c[1]
            yield self.weighted(dense)

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        weighted = np.log1p(counts) * self.rarity
        return np.hstack([self.unit(weighted[:, :SHAPES]), self.unit(weighted[:, SHAPES:])])

    @staticmethod
    def unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def vote(self, texts: list[str | None]) -> np.ndarray:
        """Scores of a block of texts."""
        v = self.unit(self.weighted(np.stack([terms(t) for t in texts])) @ self.basis)
        near = v @ self.vectors.T
        k = near.shape[1] - min(NEIGHBOURS, near.shape[1])
        last = np.partition(near, k, axis=1)[:, k : k + 1]
        weight = np.square(np.square(np.where(near >= last, np.maximum(near, 0), np.float32(0))))
        total = weight.sum(axis=1)
        return np.where(total > 1e-9, weight @ self.labels / np.maximum(total, 1e-9), self.mean).astype(float).clip(0, 1)


def fitted(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model from a bounded sample of the training folds' labelled rows, chosen by hash."""
    label = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_quality")).where((fold_of("_id", FOLDS) != HELD_OUT) & F.col("_quality").isNotNull())
    label = stage(label.groupBy("_id").agg(F.min("_quality").alias("_quality")), "quality-labels")
    place = F.pmod(F.xxhash64(F.col("_id"), F.lit(10)), F.lit(1 << 30)) / float(1 << 30)
    # A little under the bound; the limit, in the same order, makes it sure.
    chosen = label.where(place < 0.95 * MOST_LABELLED / max(label.count(), 1)).orderBy(place, "_id").limit(MOST_LABELLED)
    sample = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(chosen), "_id").groupBy("_id", "_quality").agg(F.min("text").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.stack([np.flatnonzero(c), c[c > 0]]).astype("<u4").tobytes() for c in (terms(t.as_py()) for t in batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.binary()), batch.column(1)], ["counts", "label"])

    small_batches(docs.sparkSession)
    found = sample.select("text", F.col("_quality").cast("double")).mapInArrow(rows, "counts binary, label double").collect()
    if not found:
        return None
    found.sort(key=lambda r: bytes(r[0]))  # the model doesn't depend on the order of arrival
    return Model([np.frombuffer(r[0], "<u4").reshape(2, -1) for r in found], np.array([r[1] for r in found]))


def scored(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """docs with the score in a column of that name, which is replaced."""
    kept = docs.drop(name)
    if model is None:
        return kept.withColumn(name, F.lit(1.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            blocks = [sent.value.vote([t.as_py() for t in texts[i : i + VOTING]]) for i in range(0, len(texts), VOTING)]
            score = np.concatenate([np.zeros(0), *blocks])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, name])

    small_batches(docs.sparkSession)
    return kept.mapInArrow(rows, T.StructType([*kept.schema, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each document."""
    out = scored(docs.select("doc_id", "text"), fitted(docs, labels)).select("doc_id", "score")
    return out.select("doc_id", (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

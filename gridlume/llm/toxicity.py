"""Operator 4, toxicity: non-negative positive-unlabelled learning with a class prior.

Training sees confirmed toxic documents and unlabelled text, never confirmed clean ones. The risk is
prior * loss(positive, 1) + max(0, loss(unlabelled, 0) - prior * loss(positive, 0)); where the second term
turns negative its gradient is reversed. The prior is the toxic share of the labelled training rows among the
documents. The score is 0.5 where the same risk, with misses and false alarms counted instead of the loss, is least.

Features are the presence of words and of word beginnings in the whole text, screened on the sample: each says that a
text is toxic, so no weight is below zero. The sample (at most MOST_POSITIVE and MOST_UNLABELLED documents, chosen by
hash) is counted in Spark tasks; only its screened features' numbers reach the driver. The model is at most
MOST_FEATURES strings. Labels come from training folds alone, and unlabelled text too.

Null or empty text gets the score of a text without features. Very long texts are read whole, one at a time. Repeated
rows are each scored, and count once in the sample: of several texts of a doc_id the first in order, as do near copies
(same longest words). Of several labels of a doc_id the toxic one holds. Features that tie in the screening go by name.
An empty table gives no rows; without confirmed toxic rows every score is the prior (0 without labels). Other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlume.llm.common import fold_of, small_batches, stage

MOST_POSITIVE, MOST_UNLABELLED, MOST_FEATURES = 3000, 6000, 3000
FOLDS, HELD_OUT = 5, 0
#: Lengths of the word beginnings that count as features, and what is cut off a word's ends.
BEGINNINGS, MARKS = (4, 5, 6), ".,;:!?\"'()[]{}|*%$#&<>-_/\\"
#: Confirmed documents that must have a feature, and by how many standard errors its share must exceed the unlabelled one.
LEAST, ERRORS = 4, 4.0


def words_of(text: str | None) -> set[str]:
    return {w.strip(MARKS) for w in set((text or "").lower().split())}


def features_of(words: set[str]) -> set[str]:
    """Words, and beginnings of longer words with a mark."""
    found = set(words)
    for n in BEGINNINGS:
        found.update("^" + w[:n] for w in words if len(w) > n)
    return found


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.words = {f for f in weights if f[:1] != "^"}
        self.starts = {n: {f[1:] for f in weights if f[:1] == "^" and len(f) == n + 1} for n in BEGINNINGS}

    def score(self, text: str | None) -> float:
        words = words_of(text)
        hits = words & self.words
        for n, starts in self.starts.items():
            if starts:
                hits.update({"^" + s for s in {w[:n] for w in words if len(w) > n} & starts})
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, self.bias + sum(self.weights[f] for f in sorted(hits)))))))


class Sample:
    """Documents as lists of feature numbers; the last number, the bias, is in every one."""

    def __init__(self, documents: list[np.ndarray], features: int):
        self.n, self.width = len(documents), features + 1
        each = [np.append(d, features) for d in documents]
        self.feature = np.concatenate(each).astype(np.int64) if each else np.zeros(0, np.int64)
        self.sizes = np.array([len(d) for d in each], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def margins(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.feature], self.starts) if self.n else np.zeros(0)

    def mean(self, v: np.ndarray) -> np.ndarray:
        """Mean over the documents of v times their features."""
        return np.bincount(self.feature, np.repeat(v, self.sizes), self.width) / max(1, self.n)


def risk(w: np.ndarray, positive: Sample, unlabelled: Sample, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The positive part of the risk, the negative part before it is held at zero, and the gradients of both."""
    fp, fu = positive.margins(w), unlabelled.margins(w)
    sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
    gain = prior * np.logaddexp(0, -fp).mean()
    against = (np.logaddexp(0, fu).mean() if unlabelled.n else 0.0) - prior * np.logaddexp(0, fp).mean()
    return gain, against, prior * positive.mean(sp - 1), unlabelled.mean(su) - prior * positive.mean(sp)


def least_risk_cut(fp: np.ndarray, fu: np.ndarray, prior: float) -> float:
    """The margin at which the share of misses times the prior, and the false alarms left after the prior's correction, are least: the middle of all such."""
    cuts = np.unique(np.concatenate([fp, fu]))
    miss = np.searchsorted(np.sort(fp), cuts) / len(fp)
    alarm = 1 - np.searchsorted(np.sort(fu), cuts) / max(1, len(fu)) if len(fu) else 1 - miss
    total = prior * miss + np.maximum(0, alarm - prior * (1 - miss))
    best = np.flatnonzero(total <= total.min() + 1e-12)
    # A cut may lie anywhere above the margin before the first best one, and up to the last of the run.
    run = best[: 1 + int(np.argmax(np.append(np.diff(best) > 1, True)))]
    low, high = cuts[max(run[0] - 1, 0)], cuts[run[-1]]
    return float((low + high) / 2)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], names: list[str], prior: float, steps: int = 800, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """Full-batch Adam on the non-negative risk with the logistic loss. Documents as the places of their features in names."""
    if not positive or not 0 < prior < 1:
        return Model({}, float(np.log(prior / (1 - prior))) if 0 < prior < 1 else -30.0)
    p, u = Sample(positive, len(names)), Sample(unlabelled, len(names))
    w = np.zeros(len(names) + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, steps + 1):
        _, against, up, down = risk(w, p, u, prior)
        g = (up + down if against >= 0 else -down) + decay * np.append(w[:-1], 0)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)
    w[-1] -= least_risk_cut(p.margins(w), u.margins(w), prior)
    return Model({f: float(v) for f, v in zip(names, w[:-1], strict=True) if v > 1e-3}, float(w[-1]))


def place(seed: int):
    """A number from 0 to 1 by the hash of the document's id: the order in which documents are taken for a sample."""
    return F.pmod(F.xxhash64(F.col("_id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def bounded(docs: DataFrame, toxic: DataFrame, n_toxic: int) -> DataFrame:
    """The sample: positive, _id, text, key (of near copies). toxic: the confirmed ids, once each."""
    texts = docs.select(F.col("doc_id").alias("_id"), "text").where((fold_of("_id", FOLDS) != HELD_OUT) & F.col("text").isNotNull())
    share = lambda n, most: 0.95 * most / max(n, 1)  # noqa: E731  a little under the bound; the cuts below make it sure
    positives = toxic.where(place(4) < share(n_toxic, MOST_POSITIVE)).orderBy(place(4), "_id").limit(MOST_POSITIVE).withColumn("_positive", F.lit(True))
    both = texts.join(F.broadcast(positives), "_id", "left")
    open_share = share(texts.count(), MOST_UNLABELLED)
    kinds = F.array_compact(F.array(F.col("_positive"), F.when(place(5) < open_share, False)))
    picked = both.select("_id", "text", F.explode(kinds).alias("positive")).groupBy("positive", "_id").agg(F.min("text").alias("text"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longest = (" ".join(sorted(sorted(words_of(t.as_py())), key=len)[-20:]) for t in batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([xxhash.xxh64_intdigest(x) >> 1 for x in longest], pa.int64())], [*batch.schema.names, "key"])

    small_batches(docs.sparkSession)
    sample = stage(picked.mapInArrow(keyed, T.StructType([*picked.schema, T.StructField("key", T.LongType())])), "toxicity-sample")
    order = [r[0] for r in sample.where("not positive").select(place(5)).orderBy(place(5)).limit(MOST_UNLABELLED + 1).collect()]
    if len(order) > MOST_UNLABELLED:
        sample = sample.where(F.col("positive") | (place(5) < order[-1]))
    # Copies and near copies count once: else all the words of a much-copied toxic document look toxic.
    firsts = sample.groupBy("positive", "key").agg(F.min("_id").alias("_id"))
    return stage(sample.join(F.broadcast(firsts), ["positive", "key", "_id"], "left_semi"), "toxicity-firsts")


def screened(sample: DataFrame) -> list[str]:
    """Features whose share among the positive exceeds the unlabelled share by more than ERRORS standard errors."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {True: Counter(), False: Counter()}
        for batch in batches:
            for positive, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen[positive].update(features_of(words_of(text.as_py())))
        names = sorted(seen[True] | seen[False])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[k][f] for f in names], pa.int64()) for k in (True, False))], ["feature", "p", "u"])

    n, m = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    counts = sample.select("positive", "text").mapInArrow(counted, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") >= LEAST)
    n, m = max(1, n), max(1, m)
    pooled = (F.col("p") + F.col("u") + 1) / float(n + m + 2)
    z = (F.col("p") / float(n) - F.col("u") / float(m)) / F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    best = counts.where(pooled < 1).select("feature", z.alias("z")).where(F.col("z") > ERRORS).orderBy(F.col("z").desc(), "feature").limit(MOST_FEATURES)
    return [r[0] for r in best.collect()]


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from the training folds' toxic rows and unlabelled text, both bounded."""
    label = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic")).where((fold_of("_id", FOLDS) != HELD_OUT) & F.col("_toxic").isNotNull())
    there = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("_id"))
    known = stage(label.groupBy("_id").agg(F.max("_toxic").alias("_toxic")).join(there, "_id", "left_semi"), "toxicity-labels")
    toxic, n = known.agg(F.count_if(F.col("_toxic") == 1), F.count("*")).first()
    if not toxic:
        return train([], [], [], 0.0)
    sample = bounded(docs, known.where("_toxic = 1").select("_id"), toxic)
    names = screened(sample)
    at = {f: i for i, f in enumerate(names)}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(sorted(at[f] for f in features_of(words_of(t.as_py())) & at.keys()), "<u2").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["positive", "features"])

    found = sorted((r[0], bytes(r[1])) for r in sample.select("positive", "text").mapInArrow(numbered, "positive boolean, features binary").collect())
    sides = [[np.frombuffer(x, "<u2") for kind, x in found if kind is side] for side in (True, False)]
    return train(*sides, names, min(0.9, toxic / n))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with the score in a column of that name, which is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array([sent.value.score(t.as_py()) for t in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, name])

    small_batches(docs.sparkSession)
    kept = docs.drop(name)
    return kept.mapInArrow(rows, T.StructType([*kept.schema, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each document."""
    out = scored(docs.select("doc_id", "text"), fitted(docs, labels)).select("doc_id", "score")
    return out.select("doc_id", (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

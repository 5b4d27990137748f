"""Operator 6, document fingerprints: homomorphic multiset hash.

A paragraph (line) is hashed to a wide vector: IDENTITY lanes of 64 uniform bits, and CONTENT lanes of 32 bits
in which each of its words, with the two before it, adds or subtracts one at a hashed place. A text's
fingerprint is the lane-wise sum over its paragraphs modulo 2^64 and 2^32: it doesn't depend on their order,
and a paragraph is inserted or deleted by adding or subtracting its vector. The difference of two fingerprints
is the vector of what the texts don't share, so the content lanes' squared length estimates how much that is:
likeness is 1 - |a - b|^2 / (|a|^2 + |b|^2), at least 0.

Null text counts as empty: no paragraph, the zero vector. The order is descending doc_id, null last, then text;
repeated rows follow each other. Very long texts are read whole, one at a time, with the next one's first third. The
order is cut in ranges of like size by the ids' quantiles; rows of one doc_id, and those without one, are in one range.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlume.llm.common import small_batches

IDENTITY, CONTENT = 8, 128
#: Documents in a range of ids that is sorted together, and most ranges: their first ids are broadcast.
RANGE, MOST_RANGES = 1024, 4096
_odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_START = xxhash.xxh64_intdigest(b"\n")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The summed lanes of a text's paragraphs."""
    lines = text.encode().split(b"\n") if text else []
    identity = np.zeros(IDENTITY, np.uint64)
    if lines:
        digests = b"".join([hashlib.blake2b(x, digest_size=8 * IDENTITY).digest() for x in lines])
        identity = np.frombuffer(digests, "<u8").reshape(-1, IDENTITY).sum(axis=0, dtype=np.uint64)
    words = []
    for x in lines:
        words += (_START, _START)
        words += map(xxhash.xxh64_intdigest, x.split())
    content = np.zeros(CONTENT, np.int32)
    if len(words) > 2:
        w = np.array(words, np.uint64)
        h = mixed(w[2:] * _odd[0] + w[1:-1] * _odd[1] + w[:-2] * _odd[2])[w[2:] != np.uint64(_START)]
        sign = 1 - 2 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
        content = np.bincount((h % np.uint64(CONTENT)).astype(np.int64), weights=sign, minlength=CONTENT).astype(np.int64).astype(np.int32)
    return identity, content


def shown(v: tuple[np.ndarray, np.ndarray]) -> str:
    return base64.b64encode(v[0].astype("<u8").tobytes() + v[1].astype("<i4").tobytes()).decode()


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """The lanes of a shown fingerprint."""
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw, "<u8", IDENTITY), np.frombuffer(raw, "<i4", CONTENT, 8 * IDENTITY)


def insert(fingerprint: str, paragraph: str) -> str:
    """The fingerprint of the text with one more paragraph (line), wherever it stands; the others aren't read."""
    (a, x), (b, y) = read(fingerprint), paragraph_vector(paragraph)
    return shown((a + b, x + y))


def delete(fingerprint: str, paragraph: str) -> str:
    """The fingerprint of the text without one of its paragraphs."""
    (a, x), (b, y) = read(fingerprint), paragraph_vector(paragraph)
    return shown((a - b, x - y))


def paragraph_vector(line: str) -> tuple[np.ndarray, np.ndarray]:
    """A paragraph's lanes; it is a line, and an empty one is a paragraph too."""
    if "\n" in line:
        raise ValueError("a paragraph is one line")
    return vector(line) if line else (np.frombuffer(hashlib.blake2b(b"", digest_size=8 * IDENTITY).digest(), "<u8"), np.zeros(CONTENT, np.int32))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if (a[0] == b[0]).all() and (a[1] == b[1]).all():
        return 1.0
    x, y = a[1].astype(float), b[1].astype(float)
    both = float(x @ x + y @ y)
    return max(0.0, 1 - float((x - y) @ (x - y)) / both) if both else 0.0


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def in_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, text, range, borrowed: ranges of descending ids, each followed by a borrowed copy of the next one's first row.

    Only the ids' quantiles and each range's first id (MOST_RANGES rows at most) are gathered; texts are moved once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE))
    shares = [k / ranges for k in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), 20 * ranges)).first()[0] if shares else None
    # A range's number falls with the id; equal ids have equal numbers. Null ids come last.
    splits = [float("-inf"), *sorted(set(map(float, cuts or []))), float("inf")]
    number = F.lit(0)
    if len(splits) > 2:
        rows = Bucketizer(splits=splits, inputCol="_id", outputCol="_bucket", handleInvalid="keep").transform(rows.withColumn("_id", F.col("doc_id").cast("double")))
        number = len(splits) - F.col("_bucket")
    number = F.when(F.col("doc_id").isNull(), len(splits) + 1).otherwise(number).cast("int")
    rows = rows.select("doc_id", "text", number.alias("range"))
    firsts = sorted(rows.groupBy("range").agg(F.max("doc_id")).collect())
    before = [(key, firsts[i - 1][0], at) for i, (at, key) in enumerate(firsts)]
    heads = docs.sparkSession.createDataFrame(before, "head_id long, before int, range int")
    with_heads = rows.join(F.broadcast(heads), rows["doc_id"].eqNullSafe(heads["head_id"]) & (rows["range"] == heads["range"]), "left").drop(heads["range"])
    places = F.when(F.col("before").isNull(), F.array(F.struct("range", F.lit(0).alias("borrowed")))).otherwise(F.array(F.struct("range", F.lit(0).alias("borrowed")), F.struct(F.col("before").alias("range"), F.lit(1).alias("borrowed"))))
    return with_heads.select("doc_id", "text", F.inline(places))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row for each document: its fingerprint, its edited text's, and their likeness."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []
        for batch in batches:
            for key, text, number, borrowed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = vector(text)
                if held is not None and held[2] == number:
                    out.append(edited(held, text, own))
                held = None if borrowed else (key, text, number, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _types, strict=True)], NAMES)
                out = []

    def edited(row: tuple, after: str, next_vector: tuple) -> tuple:
        key, text, _, own = row
        n = len(text) // 3
        changed = text[: len(text) - n] + after[:n]
        new = vector(changed)
        return key, len(text), hashlib.sha256(changed.encode()).hexdigest(), shown(own), shown(new), likeness(own, new), likeness(own, next_vector)

    small_batches(docs.sparkSession)
    ordered = in_ranges(docs).repartition("range").sortWithinPartitions("range", "borrowed", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.mapInArrow(rows, SCHEMA)

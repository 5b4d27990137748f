"""Operator 11, fill-in-middle transformation: cuts at token boundaries, found in a Roaring-style boundary set.

The code-point offsets at which a text's tokens end are kept by their upper 16 bits in containers: a sorted array, a bitmap
with counts before each word, or runs with counts before each, whichever is smallest, and the counts before each container.
The offset after k tokens is the set's k-th member: the container is searched in the counts, the member selected inside it.

Null text counts as empty, and a null doc_id as the empty text where it is hashed. An empty text is plain. Very long texts
are read whole, in pieces of 65,536 code points, one text at a time. Repeated rows are each transformed, alike. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlume.llm.common import small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPAN = 1 << 16


class Members:
    """An array container: the members themselves."""

    def __init__(self, present: np.ndarray):
        self.values = np.flatnonzero(present).astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.values[k])


class Bitmap:
    """A bit for each place, and the number of members before each word of 64."""

    def __init__(self, present: np.ndarray):
        self.bits = np.zeros(SPAN // 8, np.uint8)
        packed = np.packbits(present, bitorder="little")
        self.bits[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits.view("<u8")), dtype=np.int64)])

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right")) - 1
        set_bits = np.flatnonzero(np.unpackbits(self.bits[8 * word : 8 * word + 8], bitorder="little"))
        return 64 * word + int(set_bits[k - self.before[word]])


class Runs:
    """First members of runs of neighbours, and the number of members before each run."""

    def __init__(self, present: np.ndarray):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], present.view(np.int8), [0]])))
        self.first = edges[::2]
        self.before = np.concatenate([[0], np.cumsum(edges[1::2] - self.first)])

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.first[run] + k - self.before[run])


def container(present: np.ndarray, members: int) -> Members | Bitmap | Runs:
    """The smallest of the three: 2 bytes a member, 8 KB, or 4 bytes a run."""
    runs = int(np.count_nonzero(present[1:] & ~present[:-1])) + int(present[0])
    return min(((4 * runs, 0, Runs), (2 * members, 1, Members), (SPAN // 8, 2, Bitmap)))[2](present)


class BoundarySet:
    """The offsets at which the tokens [A-Za-z]+|[^A-Za-z] of a text end."""

    def __init__(self, text: str):
        self.keys, self.containers, self.before = [], [], [0]
        for low in range(0, len(text) + 1, SPAN):
            high = min(low + SPAN, len(text) + 1)
            at = max(0, low - 1)
            points = np.frombuffer(text[at:high].encode("utf-32-le"), "<u4") | 32
            letter = np.zeros(high - low + 1, bool)  # from the code point before low to the one at high - 1, or the text's end
            letter[at - low + 1 : at - low + 1 + len(points)] = (points >= ord("a")) & (points <= ord("z"))
            ends = ~(letter[:-1] & letter[1:])
            if low == 0:
                ends[0] = False
            members = int(np.count_nonzero(ends))
            if members:
                self.keys.append(low)
                self.containers.append(container(ends, members))
                self.before.append(self.before[-1] + members)

    def __len__(self) -> int:
        return self.before[-1]

    def offset(self, tokens: int) -> int:
        """Code points in the first so many tokens."""
        if tokens == 0:
            return 0
        i = bisect_right(self.before, tokens - 1) - 1
        return self.keys[i] + self.containers[i].select(tokens - 1 - self.before[i])


def transformed(key: int | None, text: str, seed: int, fim_percent: int, spm_percent: int) -> tuple:
    """n, form, prefix_chars, middle_chars, output."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    ends = BoundarySet(text)
    n = len(ends)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= fim_percent:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends.offset(first), ends.offset(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())


def fill_in_middle(docs: DataFrame, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """One row for each document: its number of tokens, the form, the lengths of prefix and middle (null if plain), the output."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(key.as_py(), *transformed(key.as_py(), text.as_py(), seed, fim_percent, spm_percent)) for key, text in zip(*batch.columns, strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _types, strict=True)], NAMES)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(rows, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text, from its output and form alone. A mark's first occurrence after the one before it is that mark: parts hold none."""

    def parts(second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(4), F.length(output))
        one = F.substring_index(rest, second, 1)
        rest = F.substring(rest, F.length(one) + 4, F.length(output))
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substring(rest, F.length(two) + 4, F.length(output))

    prefix, suffix, middle = parts(SUFFIX)
    s_suffix, s_prefix, s_middle = parts(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(s_prefix, s_middle, s_suffix)).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """made with digests of the output and of the text rebuilt from it, in place of the output."""
    text = restored(F.col("output"), F.col("form"))
    return made.select(*(n for n in NAMES if n != "output"), F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))

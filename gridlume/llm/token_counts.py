"""Operator 5, token counts: byte-pair encoding compiled to a deterministic counting transducer.

A state of the transducer holds, for every suffix of the bytes read that can still grow into a token, that
suffix's place in the vocabulary's trie, the last token of the encoding before it and that encoding's token
count less the current one. A byte's transition is annotated with the tokens it adds to the count (none or
fewer where tokens merge), so the annotations of a path add up to the token count. States and transitions are
made when first met and kept.

Texts are cut in chunks. A place where a non-space meets a space ends every piece, so there the state is the start
state. A chunk's map takes the state in which it is entered, whatever it is, through its head (the bytes up to its first
such place) to the start state, from there to a count, and to the state in which it is left, which its tail (the bytes
since its last such place) fixes; a chunk without such a place is all head. Maps compose associatively and without
reading a chunk again: only where a tail meets a head are those bytes run, once. All of a text's maps are composed in
pairs, level by level, inside the one task that holds the text; other texts are spread over tasks.

Null text counts as empty: 0 tokens. Very long texts are counted whole, in memory that STATES, REMEMBERED and LONGEST bound.
Repeated rows are each counted. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlume.llm.common import small_batches

#: Characters in a chunk; pieces whose path is remembered in each of two generations, and their longest; most states kept.
CHUNK, REMEMBERED, LONGEST, STATES = 16_384, 300_000, 64, 250_000
#: The pattern that cuts a text in pieces before merging, as the vocabulary's library has it.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
FIRST_CUT, LAST_CUT = regex.compile(r"(?<=\S)(?=\s)"), regex.compile(r"(?r)(?<=\S)(?=\s)")


def byte_alphabet() -> dict[str, int]:
    """The byte that each letter of the vocabulary's strings stands for: printable ones for themselves, the others in order from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.bytes_of = {i: as_bytes(s) for s, i in spec["model"]["vocab"].items() if all(c in letters for c in s)}
        ids = {b: i for i, b in self.bytes_of.items()}
        self.single = [ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = map(as_bytes, pair if isinstance(pair, list) else pair.split(" "))
            self.merges.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
        # The trie: child[node << 8 | byte], and the token that ends at a node.
        self.child: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        nodes = 1
        for i, b in self.bytes_of.items():
            node = 0
            for x in b:
                below = self.child.get(node << 8 | x)
                if below is None:
                    self.child[node << 8 | x] = below = nodes
                    nodes += 1
                node = below
            self.token_at[node] = i
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def reset(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.next: list[dict[int, tuple[int, int]]] = [{}]
        self.fits.clear()

    def begin_anew(self, state: int) -> int:
        """Forget all states but this one, and give its new number."""
        here = self.states[state]
        self.reset()
        if here not in self.number:
            self.number[here] = len(self.states)
            self.states.append(here)
            self.next.append({})
        return self.number[here]

    def merged(self, ids: list[int]) -> list[int]:
        """Plain byte-pair merging, lowest rank first; only used on the bytes of two tokens."""
        while len(ids) > 1:
            best = min(((self.merges[p][0], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges), default=None)
            if best is None:
                break
            k = best[1]
            ids = [*ids[:k], self.merges[ids[k], ids[k + 1]][1], *ids[k + 2 :]]
        return ids

    def follows(self, left: int, right: int) -> bool:
        """Whether the two tokens stand side by side in an encoding; left -1: right stands alone."""
        known = self.fits.get((left, right))
        if known is None:
            want = [right] if left < 0 else [left, right]
            known = self.fits[left, right] = self.merged([self.single[b] for t in want for b in self.bytes_of[t]]) == want
        return known

    def transition(self, state: int, byte: int) -> tuple[int, int]:
        grown, token, added = [], None, 0
        for node, last, less in self.states[state]:
            below = self.child.get(node << 8 | byte)
            if below is None:
                continue
            grown.append((below, last, less))
            at = self.token_at.get(below)
            if at is not None and token is None and self.follows(last, at):
                token, added = at, less + 1
        key = (*((node, last, less - added) for node, last, less in grown), (0, token, 0))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
        self.next[state][byte] = to, added
        return to, added

    def piece(self, text: str) -> int:
        """The sum of the annotations along a piece's path from the start state."""
        count = self.old.get(text)
        if count is None:
            count, state, table = 0, 0, self.next
            for byte in text.encode():
                step = table[state].get(byte)
                if step is None:
                    if len(self.states) > STATES:
                        state, table = self.begin_anew(state), self.next
                    step = self.transition(state, byte)
                state, added = step
                count += added
        if len(text) > LONGEST:
            return count
        if len(self.new) >= REMEMBERED:
            self.old, self.new = self.new, {}
        self.new[text] = count
        return count

    def count(self, text: str) -> int:
        known, total = self.new.get, 0
        for p in PIECES.findall(text):
            n = known(p)
            if n is None:
                n = self.piece(p)
                known = self.new.get
            total += n
        return total

    def chunk_map(self, text: str) -> tuple[str, int | None, str]:
        """(head, tokens after it, tail); without a cut all is head."""
        first = FIRST_CUT.search(text)
        if first is None:
            return text, None, ""
        last = LAST_CUT.search(text).start()
        return text[: first.start()], self.count(text[first.start() : last]), text[last:]

    def compose(self, a: tuple, b: tuple) -> tuple[str, int | None, str]:
        """The map of a and then b."""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.count(a[2] + b[0]) + b[1], b[2]

    def document(self, text: str) -> int:
        for s in self.special:
            if s in text:
                parts = text.split(s)
                return len(parts) - 1 + sum(map(self.document, parts))
        if len(text) <= CHUNK:
            return self.count(text)
        maps = [self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, middle, tail = maps[0]
        return self.count(head) + (middle or 0) + self.count(tail)


_transducers: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One transducer in each Python worker, kept from task to task."""
    if path not in _transducers:
        _transducers[path] = Transducer(path)
    return _transducers[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer_path)
        for batch in batches:
            tokens = np.fromiter((machine.document(t.as_py() or "") for t in batch.column(2)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(counts, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

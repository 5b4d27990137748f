"""Operator 9, chat formatting: incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Prefixes of a conversation are
rendered one turn longer each time; what an output adds to the one before is that turn's span, and a template
whose output doesn't begin with the output before rewrites history (reported, its spans are then those of the
last common prefix). The loss mask is the union of the assistant turns' text spans. Each is found by rendering once
more with that turn's text replaced by a mark that the output hasn't: where the mark stands the text begins, and what
follows the mark follows the text. If the template rewrites history, this is done on the whole conversation, so that
the mask is of the last output; a turn that the template drops has no span.

A conversation is one training example and so one row: its turns, in order of (turn, role, text), meet in one
task. Null text counts as empty, null role as the role "". Repeated turns stay. Null conv_id is a conversation
of its own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlume.llm.common import small_batches

Turns = list[tuple[str, str]]
#: The template's control strings. Every one starts with a bracket of which escape() leaves none bare.
ROLE, SAYS, END = "[ROLE]", "[/ROLE]", "</s>"
_bare, _escaped = re.compile(r"[\\\[<]"), re.compile(r"([\\\[<])\\")


def escape(text: str) -> str:
    """A backslash after every bracket or backslash: no control string is left, and unescape() gives the text back."""
    return _bare.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def template(turns: Turns) -> str:
    return "".join(f"{ROLE}{escape(role)}{SAYS}{escape(text)}{END}" for role, text in turns)


def spans(render: Callable[[Turns], str], turns: Turns) -> tuple[str, list[tuple[int, int]], bool]:
    """The last output, each turn's span in it, and whether the template rewrites history."""
    out, found, rewrites = render([]), [], False
    for n in range(1, len(turns) + 1):
        longer = render(turns[:n])
        start = len(out)
        if not longer.startswith(out):
            rewrites, start = True, next((i for i, (a, b) in enumerate(zip(out, longer, strict=False)) if a != b), min(len(out), len(longer)))
        found.append((start, len(longer)))
        out = longer
    return out, found, rewrites


def text_span(render: Callable[[Turns], str], turns: Turns, at: int, output: str) -> tuple[int, int] | None:
    """Where the text of turn number at stands in the output of turns; None if the template drops it."""
    mark = "\ue000"
    while mark in output:
        mark += "\ue001"
    marked = render([*turns[:at], (turns[at][0], mark), *turns[at + 1 :]])
    start = marked.find(mark)
    return None if start < 0 else (start, len(output) - (len(marked) - start - len(mark)))


def loss_spans(render: Callable[[Turns], str], turns: Turns, output: str, found: list[tuple[int, int]], rewrites: bool, role: str = "assistant") -> list[tuple[int, int]]:
    """The spans of the role's texts in the last output."""
    spans = []
    for i, (who, _) in enumerate(turns):
        if who == role:
            spans.append(text_span(render, turns, i, output) if rewrites else text_span(render, turns[: i + 1], i, output[: found[i][1]]))
    return [s for s in spans if s is not None]


_turn = re.compile(re.escape(ROLE) + r"(.*?)" + re.escape(SAYS) + r"(.*)" + re.escape(END), re.S)


def read_back(output: str, found: list[tuple[int, int]]) -> Turns:
    """The turns, from an output of template() and its spans alone."""
    turns = []
    for start, end in found:
        if (m := _turn.fullmatch(output, start, end)) is None:
            raise ValueError(f"no turn of this template stands at {start} to {end}")
        turns.append((unescape(m[1]), unescape(m[2])))
    return turns


def format_conversations(conversations: DataFrame, render: Callable[[Turns], str] = template) -> DataFrame:
    """conv_id, formatted, turn_spans, loss_spans (start, end in code points), rewrites_history. render: the chat template."""
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(said)).alias("turns"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, turns in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                turns = [(t["role"], t["text"]) for t in turns.as_py()]
                output, found, rewrites = spans(render, turns)
                mask = loss_spans(render, turns, output, found, rewrites)
                out.append((key, output, *([{"start": a, "end": b} for a, b in x] for x in (found, mask)), rewrites))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(TYPES)], NAMES)

    small_batches(conversations.sparkSession)
    return grouped.mapInArrow(rows, "conv_id long, formatted string, turn_spans array<struct<start: long, end: long>>, loss_spans array<struct<start: long, end: long>>, rewrites_history boolean")


_spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
TYPES, NAMES = (pa.int64(), pa.string(), _spans, _spans, pa.bool_()), ["conv_id", "formatted", "turn_spans", "loss_spans", "rewrites_history"]


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from format_conversations: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites_history."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, output, found, masked, rewrites in zip(*(c for c in batch.columns), strict=True):
                output, found, masked = output.as_py(), found.as_py(), masked.as_py()
                turns = read_back(output, [(x["start"], x["end"]) for x in found])
                loss = "".join(unescape(output[x["start"] : x["end"]]) for x in masked)
                told = "".join(f"{role}\n{text}\n" for role, text in turns)
                out.append((key.as_py(), len(turns), sha256(told), len(loss), sha256(loss), len(output), rewrites.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]
    return formatted.mapInArrow(rows, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()

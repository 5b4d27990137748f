"""Operator 13, quality rules: a short-circuit cascade, native DataFrame operations only.

A rule rejects a text by a test of features. On a sample each feature's cost is measured (seconds for a text, beyond those of
the features it needs) and the texts that each set of rules rejects are counted; rules are then ordered greedily by the share
of the texts left that they reject, by the cost of the features they still need. The cascade computes a feature only where no
earlier rule has rejected the text, and names the first rule that rejects it. The order changes what is computed and
rejected_by, never which texts are kept: a text is kept when no rule rejects it.

Null text counts as empty; an empty text has no words and is rejected. Very long texts are read whole, one row at a time.
Repeated rows are each judged, null ids are carried. An empty table gives no rows. Other columns, whatever their names, are
carried by kept_documents and ignored by judge.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlume.llm.common import WORD, stage

#: What separates words.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of the sample from which costs and selectivities are estimated; it bears on the order alone.
SAMPLE_ROWS = 512
#: Seconds for a sample below which costs can't be told apart.
LEAST_COST = 1e-3


class Feature(NamedTuple):
    """needs: the features that `of` reads; "text" is there from the start."""

    needs: tuple[str, ...]
    of: Callable[[Callable[[str], Column]], Column]


class Rule(NamedTuple):
    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Callable[[str], Column]], Column]


def long(column: Column) -> Column:
    return column.cast("long")


def left_over(text: Column, removed: str) -> Column:
    """Number of code points of text outside the runs that match removed."""
    return long(F.length(F.regexp_replace(text, removed, "")))


def words_of(text: Column) -> Column:
    """The words of text: what SPACE separates."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def window_hashes(words: Column) -> Column:
    """A hash for each 3-word window."""
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    return F.when(F.size(words) >= 3, F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))


def repeated_windows(hashes: Column) -> Column:
    """Hashes and places of the windows, sorted, where a hash occurs twice; else null: no window does."""
    placed = F.arrays_zip(hashes, F.sequence(F.lit(0), F.size(hashes) - 1)).cast("array<struct<h:bigint,at:int>>")
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(placed))


def words_within(spans: Column, words: Column) -> Column:
    """Number of words inside windows that stand twice or more; windows with one hash are compared by their words."""

    def same(a: Column, b: Column) -> Column:
        return F.coalesce((a["h"] == b["h"]) & (F.slice(words, a["at"] + 1, F.lit(3)) == F.slice(words, b["at"] + 1, F.lit(3))), F.lit(False))

    twice = F.filter(spans, lambda w, i: same(w, F.get(spans, i - 1)) | same(w, F.get(spans, i + 1)))
    return F.coalesce(long(F.size(F.array_distinct(F.flatten(F.transform(twice, lambda w: F.array(w["at"], w["at"] + 1, w["at"] + 2)))))), F.lit(0).cast("long"))


FEATURES: dict[str, Feature] = {
    "words": Feature(("text",), lambda f: words_of(f("text"))),
    "n_words": Feature(("words",), lambda f: long(F.size(f("words")))),
    "word_chars": Feature(("words",), lambda f: long(F.length(F.array_join(f("words"), "")))),
    "n_symbols": Feature(("text",), lambda f: left_over(f("text"), r"[^#*$%&|<>]+")),
    "lines": Feature(("text",), lambda f: F.filter(F.split(f("text"), "\n", -1), lambda x: x.rlike(WORD))),
    "n_lines": Feature(("lines",), lambda f: long(F.size(f("lines")))),
    "n_dup_lines": Feature(("lines",), lambda f: long(F.size(f("lines")) - F.size(F.array_distinct(f("lines"))))),
    "window_hashes": Feature(("words",), lambda f: window_hashes(f("words"))),
    "repeated_windows": Feature(("window_hashes",), lambda f: repeated_windows(f("window_hashes"))),
    "n_repeat_words": Feature(("repeated_windows", "words"), lambda f: words_within(f("repeated_windows"), f("words"))),
    "n_letters": Feature(("text",), lambda f: left_over(f("text"), r"[^\p{L}]+")),
    "n_capitals": Feature(("text",), lambda f: left_over(f("text"), r"[^\p{Lu}]+")),
    "n_bare_words": Feature(("words",), lambda f: long(F.size(F.filter(f("words"), lambda x: ~x.rlike(r"\p{L}"))))),
    "n_cut_lines": Feature(("lines",), lambda f: long(F.size(F.filter(f("lines"), lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))))),
    "n_list_lines": Feature(("lines",), lambda f: long(F.size(F.filter(f("lines"), lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))))),
}

#: What is reported of every text.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BASE = (
    Rule("few words", ("n_words",), lambda f: f("n_words") < 50),
    Rule("repeated words", ("n_words", "n_repeat_words"), lambda f: 100 * f("n_repeat_words") > 50 * f("n_words")),
)
RULES = (
    *BASE,
    Rule("word length", ("n_words", "word_chars"), lambda f: (f("word_chars") < 2 * f("n_words")) | (f("word_chars") > 25 * f("n_words"))),
    Rule("symbols", ("n_words", "n_symbols"), lambda f: 10 * f("n_symbols") > f("n_words")),
    Rule("repeated lines", ("n_lines", "n_dup_lines"), lambda f: 100 * f("n_dup_lines") > 30 * f("n_lines")),
    Rule("words without letters", ("n_words", "n_bare_words"), lambda f: 100 * f("n_bare_words") > 20 * f("n_words")),
    Rule("capitals", ("n_letters", "n_capitals"), lambda f: 100 * f("n_capitals") > 60 * f("n_letters")),
    Rule("cut lines", ("n_lines", "n_cut_lines"), lambda f: 100 * f("n_cut_lines") > 30 * f("n_lines")),
    Rule("list lines", ("n_lines", "n_list_lines"), lambda f: 100 * f("n_list_lines") > 90 * f("n_lines")),
)


def closure(names: tuple[str, ...]) -> list[str]:
    """These features and all they need, each after what it needs; without the text."""
    out: list[str] = []
    for n in names:
        out += [x for x in (*closure(FEATURES[n].needs), n) if x not in out] if n != "text" else []
    return out


class Names:
    """The columns of features among the table's own: under a prefix that no column of the table has."""

    def __init__(self, taken: list[str]):
        self.prefix = "_rule_"
        while any(c.lower().startswith(self.prefix) for c in taken):
            self.prefix = f"_{self.prefix}"

    def __call__(self, feature: str) -> str:
        return self.prefix + feature.replace(" ", "_")

    def column(self, feature: str) -> Column:
        return F.col(self(feature))


def with_features(rows: DataFrame, names: Names, features: list[str], only_where: Column | None = None) -> DataFrame:
    for n in features:
        value = FEATURES[n].of(names.column)
        rows = rows.withColumn(names(n), value if only_where is None else F.when(only_where, value))
    return rows


class Estimate(NamedTuple):
    """costs: seconds of each feature beyond what it needs; rejected: for each set of rules the sampled texts that just these reject; order: of the rules."""

    costs: dict[str, float]
    rejected: dict[frozenset[str], int]
    order: tuple[str, ...]


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, computed: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS, seed: int = 13) -> Estimate:
    """Costs, selectivities and the order that follows. computed: features that are made of every text anyway, and so are free."""
    names, n = Names([]), docs.count()
    text = docs.select(F.coalesce("text", F.lit("")).alias(names("text")))
    sample = stage(text.sample(min(1.0, sample_rows / n), seed) if n else text, "rules-sample")

    def seconds(features: list[str]) -> float:
        began = time.perf_counter()
        made = with_features(sample, names, features)
        made.agg(*(F.bit_xor(F.xxhash64(c)) for c in made.columns)).collect()
        return time.perf_counter() - began

    seconds([])
    needed = closure(tuple(x for r in rules for x in r.needs))
    alone = seconds([])
    whole = {f: max(0.0, seconds(closure((f,))) - alone) for f in needed}
    costs = {f: max(0.0, whole[f] - sum(whole[x] for x in FEATURES[f].needs if x != "text")) for f in needed}
    made = with_features(sample, names, needed)
    verdicts = made.select(F.array(*(F.coalesce(r.rejects(names.column), F.lit(False)) for r in rules)).alias("by"))
    rejected = {frozenset(r.name for r, yes in zip(rules, row["by"], strict=True) if yes): row["count"] for row in verdicts.groupBy("by").count().collect()}
    return Estimate(costs, rejected, ordered(rules, costs, rejected, computed))


def ordered(rules: tuple[Rule, ...], costs: dict[str, float], rejected: dict[frozenset[str], int], computed: tuple[str, ...] = ()) -> tuple[str, ...]:
    """Greedy: next comes the rule that rejects most of the texts left, for the cost of what it still needs; ties as the rules are listed."""
    have, left, out = set(closure(computed)), dict(rejected), []
    rest = list(rules)
    while rest:

        def gain(r: Rule) -> float:
            return sum(k for by, k in left.items() if r.name in by) / (LEAST_COST + sum(costs[f] for f in closure(r.needs) if f not in have))

        best = max(rest, key=gain)
        rest.remove(best)
        out.append(best.name)
        have |= set(closure(best.needs))
        left = {by: k for by, k in left.items() if best.name not in by}
    return tuple(out)


def cascade(docs: DataFrame, names: Names, order: tuple[str, ...], rules: tuple[Rule, ...], computed: tuple[str, ...] = ()) -> DataFrame:
    """docs with the computed features, and the name of the first rule that rejects the text as the feature "rejected by"."""
    by_name = {r.name: r for r in rules}
    have = closure(computed)
    out = with_features(docs.withColumn(names("text"), F.coalesce("text", F.lit(""))), names, have).withColumn(names("rejected by"), F.lit(None).cast("string"))
    for rule in (by_name[n] for n in order):
        standing = names.column("rejected by").isNull()
        missing = [f for f in closure(rule.needs) if f not in have]
        out = with_features(out, names, missing, standing)
        have += missing
        out = out.withColumn(names("rejected by"), F.when(standing, F.when(rule.rejects(names.column), F.lit(rule.name))).otherwise(names.column("rejected by")))
    # A filter on the verdict must stay above: pushed down it would repeat the features of every step. It stays above what isn't deterministic.
    return out.withColumn(names("rejected by"), F.when(F.spark_partition_id() >= 0, names.column("rejected by")))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, order: tuple[str, ...] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, MEASURES, base_failed, kept, rejected_by of every text. order: of the rules, else estimated on a sample."""
    rows, names = docs.select("doc_id", "text"), Names(["doc_id", "text"])
    order = order or estimate(rows, rules, MEASURES, sample_rows).order
    judged = cascade(rows, names, order, rules, MEASURES)
    failed = F.coalesce(BASE[0].rejects(names.column), F.lit(False)) | F.coalesce(BASE[1].rejects(names.column), F.lit(False))
    rejected = names.column("rejected by")
    return judged.select("doc_id", *(names.column(m).alias(m) for m in MEASURES), failed.alias("base_failed"), (rejected.isNull() & ~failed).alias("kept"), rejected.alias("rejected_by"))


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, order: tuple[str, ...] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, with their own columns, that no rule rejects; features are made only where they are needed."""
    names = Names(docs.columns)
    order = order or estimate(docs, rules, (), sample_rows).order
    return cascade(docs, names, order, rules).where(names.column("rejected by").isNull()).select(*docs.columns)

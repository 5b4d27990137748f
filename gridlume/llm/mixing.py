"""Operator 2, mixing sources to target weights: capped water-filling, native DataFrame operations only.

A source's target is its weight's share of the total, at most max_epochs times its size; the excess goes to
the others by weight until none is above. A target is met by whole repetitions of all its documents and a
fractional one: documents in seeded order until the rest of the target is reached. The order's cumulative sum
is taken over BUCKETS ranges of the seeded hash first, then inside the one range where the target ends, so no
source, however large, is sorted in one task.

Null text has size 0; a null source is a source of its own, last in order; a source without words has target 0.
Rows that repeat a doc_id share the cut in proportion to their sizes. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlume.llm.common import WORD, stage

BUCKETS = 4096


def seeded(seed: int):
    """A 32-bit number from the seed and doc_id: the order in which documents are taken."""
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source as two never-null columns, size in words, seeded 32-bit order."""
    return docs.select(
        "doc_id",
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("src"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        seeded(seed).alias("ord"),
    )


def water_fill(sources: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """sources (no_source, src, source_size) with target.

    In order of max_epochs * size / weight the clamped sources are a prefix. With each that is clamped the level
    (total - clamped sizes) / (weights left) rises, with any further one it would fall: the level is the greatest.
    One row a source: the two orderings run over sources, not documents.
    """
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy("no_source", "src")) - 1) % len(weights) + 1)
    fill = Window.orderBy("ratio", "no_source", "src")
    everything, before = Window.partitionBy(), fill.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sources.withColumn("weight", cycle.cast("double"))
        .withColumn("ratio", max_epochs * F.col("source_size") / F.col("weight"))
        .withColumns(
            {
                "total": F.sum("source_size").over(everything),
                "clamped": F.coalesce(F.sum(max_epochs * F.col("source_size")).over(before), F.lit(0)),
                "open_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            }
        )
        .withColumn("level", (F.col("total") - F.col("clamped")) / F.col("open_weight"))
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.round(F.least(max_epochs * F.col("source_size").cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")), 6))
        .select("no_source", "src", "source_size", "target")
    )


def plan(words: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row a source: target, whole repetitions, and where in the seeded order the fractional one ends."""
    source, bucket = ["no_source", "src"], F.shiftright("ord", 20)
    buckets = stage(words.groupBy(*source, bucket.alias("bucket")).agg(F.sum("size").alias("words")), "mixing-buckets")
    targets = water_fill(buckets.groupBy(*source).agg(F.sum("words").alias("source_size")), weights, max_epochs)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = stage(targets.withColumn("budget", F.round("target").cast("long") - F.col("whole") * F.col("source_size")), "mixing-targets")
    ends = (
        buckets.withColumn("upto", F.sum("words").over(Window.partitionBy(*source).orderBy("bucket")))
        .join(targets.select(*source, "budget"), source)
        .where((F.col("budget") > 0) & (F.col("upto") >= F.col("budget")) & (F.col("upto") - F.col("words") < F.col("budget")))
        .select(*source, "bucket", (F.col("budget") - (F.col("upto") - F.col("words"))).alias("rest"))
    )
    last = (
        words.withColumn("bucket", bucket)
        .join(ends, [*source, "bucket"])
        .groupBy(*source, "rest", "ord", "doc_id")
        .agg(F.sum("size").alias("words"))
        .withColumn("upto", F.sum("words").over(Window.partitionBy(*source).orderBy("ord", F.col("doc_id").asc_nulls_first())))
        .where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
        .select(*source, F.col("ord").alias("end_ord"), F.col("doc_id").alias("end_id"), F.col("words").alias("end_words"), (F.col("rest") - (F.col("upto") - F.col("words"))).alias("end_rest"))
    )
    return stage(targets.join(last, source, "left"), "mixing-plan")


def taken(whole_documents: bool = False):
    """Words taken from a row of sized() joined to plan(). whole_documents: the last document is taken or left as a whole, whichever is nearer."""
    lowest = F.lit(-(2**63))
    here, end = F.coalesce("doc_id", lowest), F.coalesce("end_id", lowest)
    before = (F.col("ord") < F.col("end_ord")) | ((F.col("ord") == F.col("end_ord")) & (here < end))
    at = (F.col("ord") == F.col("end_ord")) & (here == end)
    cut = F.when(2 * F.col("end_rest") >= F.col("end_words"), F.col("size")).otherwise(F.lit(0)) if whole_documents else F.expr("size * end_rest div end_words")
    return F.col("whole") * F.col("size") + F.when(before, F.col("size")).when(at, cut).otherwise(0)


def mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each input row."""
    words = stage(sized(docs, seed), "mixing-words")
    joined = words.join(plan(words, weights, max_epochs), ["no_source", "src"])
    return joined.select("doc_id", "size", F.col("source_size").cast("long"), "target", taken().cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """The mix itself: each document as often as it is taken, whole, with its own columns."""
    sources = plan(stage(sized(docs, seed), "mixing-words"), weights, max_epochs)
    # A size of one word makes taken() the number of repetitions.
    keyed = docs.select(F.struct(*docs.columns).alias("_mix_row"), "doc_id", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("src"), seeded(seed).alias("ord"), F.lit(1).cast("long").alias("size"))
    copies = F.explode(F.array_repeat("_mix_row", taken(whole_documents=True).cast("int")))
    return keyed.join(sources, ["no_source", "src"]).select(copies.alias("_mix_row")).select("_mix_row.*")

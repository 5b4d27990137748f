"""A training corpus from the documents table, by five operators of the llm subpackage, one after another.

Each stage gets what its predecessor kept (null texts, empty tables and repeated rows included, as its operator's
module defines) and returns the same columns, but for the last, which returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlume.llm import mixing, near_dedup, packing, quality, toxicity
from gridlume.llm.common import stage, table
from gridlume.llm.queries import tokenizer


def free_name(docs: DataFrame, name: str) -> str:
    """name, or that with underscores before it: a column that docs hasn't."""
    while name.lower() in map(str.lower, docs.columns):
        name = f"_{name}"
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, score = quality.fitted(docs, table(spark, sf_dir, "labels")), free_name(docs, "_quality_score")
    return quality.scored(docs, model, score).where(F.col(score) >= 0.5).select(*docs.columns)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, score = toxicity.fitted(docs, table(spark, sf_dir, "labels")), free_name(docs, "_toxic_score")
    return toxicity.scored(docs, model, score).where(F.col(score) < 0.5).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays; of rows with one doc_id the one with the least text, null last."""
    kept = near_dedup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    known = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    row, order = F.struct(*docs.columns), F.struct(F.col("text").isNull(), "text", *(c for c in docs.columns if c != "text"))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.min_by(row, order).alias("_row")).select("_row.*")
    return known.union(docs.where("doc_id is null")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", keep_civil),
    ("near-dedup", keep_one_of_each),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models and tokenizers decide; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

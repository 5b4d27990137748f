"""Shared helpers: reading tables, bounded Arrow batches, folds of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlume.operators.lineage import stage  # noqa: F401  the operators of this subpackage take it from here

#: Bytes that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 256, mb: int = 8) -> None:
    """Rows and size of an Arrow batch: long texts then keep a Python worker's memory bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")


def fold_of(key: str, folds: int):
    """crc32 of the key written as text, modulo folds; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds

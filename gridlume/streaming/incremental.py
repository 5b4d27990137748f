"""Resumable and incremental work."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridlume.operators.lineage import exists, shared_dir

c = F.col


def pending(work: DataFrame, completed: DataFrame, keys: list[str]) -> DataFrame:
    """Work that isn't completed under the same fingerprint and version; state of another fingerprint doesn't count."""
    return work.join(completed.select(*keys, "fingerprint", "version"), [*keys, "fingerprint", "version"], "left_anti")


def append_once(spark: SparkSession, source: str, schema: StructType, key: str, order: str, sink: str, checkpoint: str) -> None:
    """ST-02: every file of the source once, every key once, to a Parquet sink; later calls take up where the last one ended.

    However late a row comes, it is appended if its key isn't in the sink; of a batch's rows with one key the least by order
    stays. A batch has its own folder, which a repeated run of it overwrites, so a failure between write and commit adds
    nothing twice. A null key is a key.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy(key).agg(F.min_by(F.struct(*batch.columns), order).alias("_row")).select("_row.*")
        if exists(spark, sink):
            known = spark.read.schema(StructType([*schema, StructField("batch", LongType())])).parquet(sink).where(c("batch") != number)
            first = first.join(known.select(c(key).alias("_known")), c(key).eqNullSafe(c("_known")), "left_anti")
        first.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def appended(df: DataFrame, key: str, order: str) -> DataFrame:
    """df through append_once twice: the second run adds nothing."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/append-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/source")
    for _ in range(2):
        append_once(spark, f"{root}/source", df.schema, key, order, f"{root}/sink", f"{root}/state")
    return spark.read.schema(df.schema).parquet(f"{root}/sink")


def isolated(spark: SparkSession, sources: list[str], job: Callable[[str], int]) -> DataFrame:
    """ST-03: each source's job by itself; an error is recorded and the others go on."""
    rows = []
    for source in sources:
        try:
            rows.append((source, "complete", job(source), ""))
        except Exception as error:  # recorded, not hidden
            rows.append((source, "error", None, type(error).__name__))
    return spark.createDataFrame(rows, "source string, status string, rows long, error string")

"""Cutting lineage between the rounds of an iterative operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: How many times smaller than in memory tables of pixels, labels and points are in Parquet files (they are mostly small or repeated numbers).
FACTOR, SMALLER = "spark.sql.sources.fileCompressionFactor", 32.0
#: For each application its folder of staged tables.
_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that the cluster names in spark.checkpoint.dir.

    Where none is named, the context's checkpoint folder is taken, and in local mode, where driver and executors are one
    process, a temporary one; on a cluster without a shared folder this raises. The folder goes when the application ends.
    """
    context = spark.sparkContext
    key = context.applicationId
    if key not in _roots:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if named is None and context.getCheckpointDir() is not None:
            named = os.path.dirname(context.getCheckpointDir().rstrip("/"))
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir isn't set: it must name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        root = f"{named.rstrip('/')}/staged-{key}-{uuid.uuid4().hex[:8]}"
        system, path = file_system(spark, root)
        system.mkdirs(path)
        system.deleteOnExit(path)
        _roots[key] = root
    return _roots[key]


def file_system(spark: SparkSession, place: str):
    """The Hadoop file system that holds place, and place as its path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, place: str) -> bool:
    system, path = file_system(spark, place)
    return system.exists(path)


def honest_sizes(spark: SparkSession) -> None:
    """Spark takes a table in memory to be as large as its files, so it broadcasts, through the driver, well-compressed tables of millions
    of rows. Unless the session says otherwise a file counts SMALLER times; smaller tables are still broadcast, by their size in a shuffle.
    """
    if float(spark.conf.get(FACTOR)) == 1.0:
        spark.conf.set(FACTOR, str(SMALLER))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: it is computed once and survives lost executors."""
    spark = df.sparkSession
    honest_sizes(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(staged: DataFrame) -> None:
    """Delete a table written by stage() that nothing will read again."""
    system, path = file_system(staged.sparkSession, staged._staged_at)
    system.delete(path, True)

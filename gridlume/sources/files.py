"""SRC-13: the files of a written package, with size and SHA-256, hashed in tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlume.operators.lineage import file_system

c = F.col
#: Bytes up to which a file's content becomes one cell; larger ones are read in chunks.
WHOLE, CHUNK = 32 << 20, 8 << 20


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes, modified of all files under root but hidden ones; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", c("length").alias("bytes"), c("modificationTime").alias("modified"))


def asset_type(path: Column) -> Column:
    """What a file is, by its suffix."""
    kinds = {"table": ("parquet", "csv"), "settings": ("json",), "image": ("png", "tif", "tiff"), "text": ("txt",), "archive": ("zip",)}
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("other")
    for kind, suffixes in kinds.items():
        out = F.when(suffix.isin(*suffixes), kind).otherwise(out)
    return out


def hashed_in_chunks(paths: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """path, sha256 of each file, read chunk by chunk in the task that has its row; a task never holds more than one chunk."""

    def digest(path: str) -> str:
        from pyarrow import fs

        local = path.startswith("file:")
        system, place = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(quote(path, safe=":/@"))
        got = hashlib.sha256()
        with system.open_input_stream(place) as stream:
            while part := stream.read(chunk):
                got.update(part)
        return got.hexdigest()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([digest(p) for p in names], pa.string())], ["path", "sha256"])

    return paths.select("path").mapInArrow(rows, "path string, sha256 string")


def empty_files(spark: SparkSession, root: str) -> list[tuple[str, int, str]]:
    """Files without content, which Spark's scans leave out, as the manifest has them; of the others nothing is kept."""
    system, path = file_system(spark, root)
    found, rows = system.listFiles(path, True), []
    while found.hasNext():
        file = found.next()
        name = file.getPath().toString()
        if file.getLen() == 0 and not any(part.startswith(("_", ".")) for part in name.removeprefix(path.toString()).split("/")):
            rows.append((name, 0, hashlib.sha256(b"").hexdigest()))
    return rows


def manifest(spark: SparkSession, root: str, whole: int = WHOLE, chunk: int = CHUNK) -> DataFrame:
    """One row a file under root: path below root, asset_type, bytes, sha256 of its content.

    Files of up to whole bytes are hashed by Spark as they are scanned (larger ones are left out of that scan by its pushed
    filter); larger ones are dealt to tasks by path and hashed in chunks. No file passes through the driver.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    small = files.where(c("length") <= whole).select("path", c("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = listed(spark, root).where(c("bytes") > whole)
    # As many partitions as files, within reason: a large file is a task.
    tasks = max(1, min(10_000, large.count()))
    slow = large.join(hashed_in_chunks(large.repartition(tasks, "path"), chunk), "path").select("path", "bytes", "sha256")
    nothing = spark.createDataFrame(empty_files(spark, root), "path string, bytes long, sha256 string")
    below = F.substring_index(c("path"), root.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    return small.union(slow).union(nothing).select(below.alias("path"), asset_type(c("path")).alias("asset_type"), "bytes", "sha256")

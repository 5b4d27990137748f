"""ST-01: keyed work that resumes. Each batch of keys is computed, written and committed; a later run does what is left.

Under root there is a folder for each signature (fingerprint of the source, version of the method, whatever the caller names):
work done under another signature doesn't count, and goes when a run under a new one begins. In a folder `data/<batch>/rows` holds
the results of a batch, `data/<batch>/keys` its keys (a key may have no rows), and `commits/<batch>` names what is committed: it is
written under another name and renamed, so it is there in whole or not at all. Rows without a commit, left by a run that was
stopped, are never read. One run at a time writes under a root.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlume.operators.lineage import file_system

Compute = Callable[[DataFrame], DataFrame]


def signature_of(signature: dict) -> str:
    """SHA-256 of the signature as compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(signature, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


class WorkState:
    """What is committed under root for one signature."""

    def __init__(self, spark: SparkSession, root: str, signature: dict):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = f"{self.root}/{signature_of(signature)}"

    def commits(self) -> list[str]:
        """Names of the committed batches."""
        system, path = file_system(self.spark, f"{self.folder}/commits")
        if not system.exists(path):
            return []
        return sorted(s.getPath().getName() for s in system.listStatus(path) if not s.getPath().getName().startswith(("_", ".")))

    def read(self, kind: str, schema) -> DataFrame:
        """Committed rows or keys; none yet: an empty table of this schema."""
        paths = [f"{self.folder}/data/{name}/{kind}" for name in self.commits()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, keys: DataFrame, rows: DataFrame) -> None:
        """Write a batch, then its commit."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/data/{name}/rows")
        keys.write.parquet(f"{self.folder}/data/{name}/keys")
        system, commits = file_system(self.spark, f"{self.folder}/commits")
        system.mkdirs(commits)
        _, hidden = file_system(self.spark, f"{self.folder}/commits/.{name}")
        system.create(hidden, True).close()
        if not system.rename(hidden, file_system(self.spark, f"{self.folder}/commits/{name}")[1]):
            raise RuntimeError(f"the commit of {name} could not be renamed")

    def clear(self) -> None:
        """Delete the state of other signatures, and what a stopped run left uncommitted under this one."""
        system, root = file_system(self.spark, self.root)
        if not system.exists(root):
            return
        for other in system.listStatus(root):
            if other.getPath().getName() != self.folder.rsplit("/", 1)[1]:
                system.delete(other.getPath(), True)
        known = set(self.commits())
        _, data = file_system(self.spark, f"{self.folder}/data")
        for batch in system.listStatus(data) if system.exists(data) else []:
            if batch.getPath().getName() not in known:
                system.delete(batch.getPath(), True)


def resume(spark: SparkSession, root: str, work: DataFrame, keys: list[str], signature: dict, compute: Compute, batches: int = 8, bucket: Column | None = None) -> DataFrame:
    """The results of all of work under this signature: what is committed is read, the rest is computed batch by batch.

    work has one row or more a key; compute gives rows for the work it gets, and its schema doesn't depend on them. bucket (0 to
    batches - 1, by default from the keys' hash) deals keys to batches: a run that is stopped loses at most one batch. Null
    keys are keys. Results of keys that are no longer in work are kept in the state, and left out here.
    """
    state = WorkState(spark, root, signature)
    state.clear()
    bucket = F.pmod(F.xxhash64(*keys), F.lit(batches)) if bucket is None else bucket
    key = F.struct(*keys)
    done = state.read("keys", work.select(*keys).schema).select(key.alias("_done")).distinct()
    left = work.withColumn("_key", key).join(done, F.col("_key") == F.col("_done"), "left_anti").drop("_key")
    for number in range(batches) if not left.isEmpty() else []:
        batch = left.where(bucket == number)
        mine = batch.select(*keys).distinct()
        if not mine.isEmpty():
            state.commit(mine, compute(batch))
    rows = state.read("rows", compute(work.limit(0)).schema)
    wanted = work.select(key.alias("_wanted")).distinct()
    return rows.withColumn("_key", key).join(wanted, F.col("_key") == F.col("_wanted"), "left_semi").drop("_key")

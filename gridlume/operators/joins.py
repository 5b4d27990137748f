"""Equi joins with a contract: uniqueness, defaults, flags, design grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """SO-03: the first row of each key in a stated order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def lookup(left: DataFrame, right: DataFrame, keys: list[str], order: list) -> DataFrame:
    """JN-01: left join to the first right row of each key."""
    return left.join(first_by(right, keys, order), keys, "left")


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """JN-03: left join; a key that repeats on the right is an error."""
    n = F.count("*").over(Window.partitionBy(*keys))
    checked = right.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit("keys are not unique on the right"))).otherwise(F.lit(True))).drop("_n")
    return left.join(checked, keys, "left")


def dimension_defaults(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN-22: first known dose of each condition; first known time of each time point, else time point - min."""

    def first_known(value: str, key: str, order: list[str]) -> DataFrame:
        known = F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
        return df.groupBy(key).agg(known.alias(value))

    dose = first_known("concentration", "condition_index", ["timepoint_index", "trajectory_id"])
    time = first_known("elapsed_time", "timepoint_index", ["condition_index", "trajectory_id"])
    low = F.min("timepoint_index").over(Window.partitionBy())
    return dose, time.withColumn("elapsed_time", F.coalesce("elapsed_time", F.col("timepoint_index") - low))


def attach_metadata(df: DataFrame, conditions: DataFrame, times: DataFrame) -> DataFrame:
    """JN-04: old metadata columns go, those of the condition and time dimensions come in."""
    old = [c for c in (*conditions.columns, *times.columns) if c not in ("condition_index", "timepoint_index")]
    return df.drop(*old).join(conditions, "condition_index", "left").join(times, "timepoint_index", "left")


def flagged_parts(df: DataFrame, kept: Column) -> tuple[DataFrame, DataFrame]:
    """TK-04: rows with their membership flag, as kept and excluded tables."""
    flagged = df.withColumn("kept", F.coalesce(kept, F.lit(False)))
    return flagged.where("kept"), flagged.where("NOT kept")


def design_grid(conditions: DataFrame, times: DataFrame, fields: int) -> DataFrame:
    """JN-19: conditions by time points by fields; dimensions, not data, are multiplied."""
    return conditions.crossJoin(times).withColumn("field", F.explode(F.sequence(F.lit(1), F.lit(fields))))


def matched_values(pairs: DataFrame, values: DataFrame, key: str, value: str, sides: dict[str, str]) -> DataFrame:
    """JN-16: for each side (output column: id column) the value by id, 0 where there is none."""
    for out, column in sides.items():
        side = values.select(F.col(key).alias(column), F.col(value).alias(out))
        pairs = pairs.join(side, column, "left").withColumn(out, F.coalesce(out, F.lit(0.0)))
    return pairs


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """JN-15: every key of either side with its status."""
    left, right = a.select(key).distinct().withColumn("_a", F.lit(True)), b.select(key).distinct().withColumn("_b", F.lit(True))
    status = F.when(F.col("_a").isNull(), "no_baseline").when(F.col("_b").isNull(), "no_followup").otherwise("both")
    return left.join(right, key, "full").select(key, status.alias("status"))

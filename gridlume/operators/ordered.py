"""Ordered operators: numbering, running-mean clusters, array indices, growth of matched pairs, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlume.functions.scalar import padded
from gridlume.sources.tables import ranked, running

c = F.col


def numbered(df: DataFrame, keys: list[str], order: list, name: str, count: str | None = None) -> DataFrame:
    """WN-04, WN-13, WN-15: 1-based place in a group, and the group's size."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return out if count is None else out.withColumn(count, F.count("*").over(Window.partitionBy(*keys)))


def clusters(df: DataFrame, key: str, value: str, tolerance: float, support: int = 1) -> DataFrame:
    """WN-05: sorted values join the last group while at most tolerance from its running mean, else open a new one.

    A value farther than tolerance from the one before always opens a group, so the scan is a fold over each stretch of
    distinct values between such gaps, with their counts: no key's values meet in one array unless they lie that close.
    It gives each group's number from 1, mean and support.
    """
    from gridlume.operators.lineage import stage

    counted = stage(ranked(df.groupBy(key, c(value).alias("v")).agg(F.count("*").alias("n")), ["v"], "_i", [key]), "cluster-values")
    before = counted.select(key, (c("_i") + 1).alias("_i"), c("v").alias("_p"))
    gap = F.when(c("_p").isNull() | (c("v") - c("_p") > tolerance), 1).otherwise(0)
    opened = counted.join(before, [key, "_i"], "left").withColumn("_open", gap).drop("_p", "_i")
    cut = running(opened, [key], ["v"], c("_open"), "_piece").withColumn("_piece", c("_piece") + c("_open"))
    values = cut.groupBy(key, "_piece").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("vs"))
    empty = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"))
    start = F.struct(F.array().cast("array<struct<s:double,n:bigint>>").alias("done"), empty.alias("now"))

    def one(acc, v):
        # One more of the value v: equal values can fall in different groups only before the first of them moves the mean.
        inside = (acc["now"]["n"] == 0) | (F.abs(v - acc["now"]["s"] / F.nullif(acc["now"]["n"], F.lit(0))) <= tolerance)
        joined = F.struct((acc["now"]["s"] + v).alias("s"), (acc["now"]["n"] + 1).alias("n"))
        opened = F.struct(v.alias("s"), F.lit(1).cast("long").alias("n"))
        return F.struct(F.when(inside, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))).alias("done"), F.when(inside, joined).otherwise(opened).alias("now"))

    def step(acc, e):
        first = one(acc, e["v"])
        # Further copies of one value always join: they lie no farther from the mean than the first did.
        more = F.struct((first["now"]["s"] + e["v"] * (e["n"] - 1)).alias("s"), (first["now"]["n"] + e["n"] - 1).alias("n"))
        return F.struct(first["done"].alias("done"), more.alias("now"))

    folded = F.aggregate("vs", start, step, lambda a: F.concat(a["done"], F.array(a["now"])))
    groups = values.select(key, "_piece", F.posexplode(folded).alias("_i", "g")).select(key, "_piece", "_i", (c("g.s") / c("g.n")).alias("centre"), c("g.n").alias("support"))
    out = ranked(groups, ["_piece", "_i"], "cluster", [key]).select(key, "cluster", "centre", "support")
    return out.where(c("support") >= support)


def nearest_centre(df: DataFrame, centres: DataFrame, key: str, value: str) -> DataFrame:
    """WN-06: each row's nearest cluster; ties go to the lowest; a row without a value has none.

    Half-way places between neighbouring centres and the rows' distinct values are put in one order by ranges; how many
    such places lie before a value tells its centre. Neither rows and centres nor a key's centres meet in one task.
    """
    from gridlume.operators.lineage import stage

    kept = stage(ranked(centres.select(key, "cluster", "centre"), ["centre", "cluster"], "_k", [key]), "centres")
    before = kept.select(key, (c("_k") + 1).alias("_k"), c("centre").alias("_p"))
    starts = kept.join(before, [key, "_k"], "left").select(key, F.coalesce((c("centre") + c("_p")) / 2, F.lit(float("-inf"))).alias("_at"), F.lit(1).alias("_start"))
    values = df.where(c(value).isNotNull()).select(key, c(value).cast("double").alias("_at"), F.lit(0).alias("_start")).distinct()
    found = running(values.union(starts), [key], ["_at", "_start"], c("_start"), "_k").where("_start = 0").join(kept, [key, "_k"]).select(key, "_at", "cluster", "centre")
    keyed = df.join(kept.select(key).distinct(), key, "left_semi").withColumn("_at", c(value).cast("double"))
    return keyed.join(found, [key, "_at"], "left").select(*df.columns, "cluster", "centre")


def array_indices(points: DataFrame, tolerance: float) -> DataFrame:
    """WN-07: row by clusters of y, column by place of x in the row. points (id, x, y)."""
    rows = points.withColumn("_all", F.lit(1))
    near = nearest_centre(rows, clusters(rows, "_all", "y", tolerance), "_all", "y")
    out = numbered(near, ["cluster"], ["x", "id"], "col_index").withColumnRenamed("cluster", "row_index")
    return out.select("id", "row_index", "col_index", F.concat(F.lit("R"), padded(c("row_index"), 4), F.lit("_C"), padded(c("col_index"), 3)).alias("array_key"))


def pair_growth(pairs: DataFrame, days: float) -> DataFrame:
    """WN-12: fold, percent and daily log rate from base to follow, and what they rest on."""
    b, f = c("base"), c("follow")
    fold = F.when(b > 0, f / b)
    status = F.when(~(b > 0), "undefined_no_baseline_PDO").when(~(f > 0), "followup_zero_or_lost").otherwise("quantified")
    return pairs.withColumns({"fold": fold, "percent_change": 100.0 * (fold - 1), "log_rate": F.when((b > 0) & (f > 0), F.ln(f / b) / days), "growth_status": status})


def tracking_rows(pairs: DataFrame) -> DataFrame:
    """WN-14: a baseline and a follow-up row for each matched pair."""
    base = F.struct(F.lit(1).alias("timepoint_index"), c("base").alias("area"), F.when(c("base") > 0, 1.0).alias("relative"))
    follow = F.struct(F.lit(2).alias("timepoint_index"), c("follow").alias("area"), c("fold").alias("relative"))
    return pairs.select("*", F.inline(F.array(base, follow)))


def spread_sample(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """TK-01: n rows spread evenly over an order (rounded half to even), or all if there are no more."""
    placed = ranked(df, order, "place").withColumn("place", c("place") - 1)
    total = df.count()
    if total <= n:
        return placed
    spots = df.sparkSession.range(n).select(F.bround(c("id") * float(total - 1) / float(n - 1)).cast("long").alias("place")).distinct()
    return placed.join(F.broadcast(spots), "place", "left_semi")


def borderline(df: DataFrame, value: str, cut: float, n: int, ties: list[str]) -> DataFrame:
    """TK-02: the n rows nearest to the cut on either side: two ordered limits, so no side is sorted in one task."""
    out = None
    for above in (False, True):
        side = df.where(c(value) >= cut) if above else df.where(c(value) < cut)
        part = side.withColumn("above", F.lit(above)).orderBy(F.abs(c(value) - cut), *ties).limit(n)
        out = part if out is None else out.union(part)
    return out

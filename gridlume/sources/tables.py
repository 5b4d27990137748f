"""Sources and sinks: keys, names, metadata, regions of pixel tables, dataset packages, manifests."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlume.functions.scalar import padded, slugify
from gridlume.operators.lineage import shared_dir

c = F.col
#: Suffixes of images that are read (fixed values).
SUFFIXES = (".png", ".jpg", ".jpeg", ".tif", ".tiff")
#: Mask types and their definitions (fixed values).
MASKS = (("well", "disc of the detected radius"), ("object", "segmented foreground"), ("focus", "disc of radius 2"))


def list_files(spark, path: str) -> DataFrame:
    """SRC-01 on a folder: path, length and time of its images, without their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return image_keys(files, "path")


def image_keys(df: DataFrame, key: str = "key") -> DataFrame:
    """SRC-01"""
    return df.where(F.lower(F.regexp_extract(key, r"\.[^./]*$", 0)).isin(*SUFFIXES))


def dataset_roots(df: DataFrame, key: str = "key") -> DataFrame:
    """SRC-02"""
    root = F.regexp_extract(key, r"^(.+?\.ome\.zarr)", 1)
    return df.select(root.alias("root")).where("root <> ''").distinct().select(F.concat("root", F.lit("/")).alias("root"))


def read_measurements(spark, paths: list[str], schema: T.StructType) -> DataFrame:
    """SRC-03: the union of measurement tables; columns that a file lacks are null."""
    out = None
    for path in paths:
        raw = spark.read.option("header", True).csv(path)
        part = raw.select(*[(c(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])
        out = part if out is None else out.union(part)
    return out


def csv_round_trip(tables: list[DataFrame], schema: T.StructType) -> DataFrame:
    """Tables written as CSV with a header in the shared folder, and read again as one."""
    spark, paths = tables[0].sparkSession, []
    for df in tables:
        paths.append(f"{shared_dir(spark)}/measurements-{uuid.uuid4().hex}")
        df.write.option("header", True).csv(paths[-1])
    return read_measurements(spark, paths, schema)


def running(df: DataFrame, keys: list[str], order: list, amount: Column, name: str) -> DataFrame:
    """df with the sum of amount over the rows before, by keys (nulls are a key) and in order.

    Neither the table nor a key, however large, is put in one partition: rows are dealt by ranges of keys and order, sums are
    taken inside a range and added to those of the ranges before. order must tell rows apart, or ties are in any order.
    """
    n = max(1, df.sparkSession.sparkContext.defaultParallelism)
    from gridlume.operators.lineage import stage

    held = stage(df.withColumn("_amount", amount).repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    by = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    key = F.struct(F.lit(0).alias("_0"), *keys).alias("_key")
    # One row for each range and each key that it holds: as many as ranges and keys together.
    before = held.groupBy("_part", key).agg(F.sum("_amount").alias("_sum")).withColumn("_earlier", F.coalesce(F.sum("_sum").over(by), F.lit(0))).drop("_sum")
    inside = F.coalesce(F.sum("_amount").over(Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.withColumns({"_key": key, "_inside": inside}).join(before, ["_part", "_key"]).withColumn(name, (c("_inside") + c("_earlier")).cast("long")).drop("_part", "_key", "_inside", "_earlier", "_amount")


def ranked(df: DataFrame, order: list, name: str, keys: list[str] | None = None) -> DataFrame:
    """A 1-based place by keys and in order, without putting the table or a key in one partition."""
    return running(df, keys or [], order, F.lit(1), name).withColumn(name, c(name) + 1)


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, n and for each share its exact quantile (between two places in proportion); null values don't count.

    Values are counted first, then found by their place: no group's values meet in one buffer.
    """
    counted = running(df.where(c(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n")), keys, [value], c("_n"), "_before")
    key = F.struct(F.lit(0).alias("_0"), *keys).alias("_key")
    totals = counted.groupBy(key).agg(F.sum("_n").alias("n"))
    placed = counted.withColumn("_key", key).join(totals, "_key")
    holds = lambda place: F.max(F.when((c("_before") <= place) & (place < c("_before") + c("_n")), c(value).cast("double")))
    at = {k: q * (c("n") - 1) for k, q in shares.items()}
    ends = [holds(f(at[k])).alias(f"_{k}_{i}") for k in shares for i, f in enumerate((F.floor, F.ceil))]
    out = placed.groupBy("_key", "n").agg(*ends)
    return out.select(*(c(f"_key.{k}").alias(k) for k in keys), "n", *((c(f"_{k}_0") + (at[k] - F.floor(at[k])) * (c(f"_{k}_1") - c(f"_{k}_0"))).alias(k) for k in shares))


def distinct_names(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """SRC-06: later files of one base name get their number in front."""
    base = F.regexp_extract(key, r"[^/]*$", 0)
    numbered = ranked(df.withColumn("_base", base), order, "_i", ["_base"])
    return numbered.withColumn("name", F.when(c("_i") == 1, c("_base")).otherwise(F.concat(padded(c("_i"), 3), F.lit("_"), c("_base")))).drop("_base", "_i")


def long_channels(pixels: DataFrame) -> DataFrame:
    """Two channels in long form, the second derived from the first."""
    each = F.array(F.struct(F.lit(0).alias("channel"), c("v").alias("v")), F.struct(F.lit(1).alias("channel"), ((c("v") * 3 + c("x")) % 256).alias("v")))
    return pixels.select("image_id", "x", "y", F.inline(each))


def compose_rgb(pixels: DataFrame, channels: tuple[int, int, int]) -> DataFrame:
    """SRC-08: red, green and blue from chosen channels; a channel that isn't there is 0."""
    plane = lambda k: F.coalesce(F.max(F.when(c("channel") == k, c("v"))), F.lit(0).cast("long"))
    return pixels.groupBy("image_id", "x", "y").agg(*[plane(k).alias(n) for k, n in zip(channels, "rgb", strict=True)])


def channel_plan(df: DataFrame) -> DataFrame:
    """SRC-09: which channel serves objects and wells in a mode; -1 or another mode: the RGB image."""
    known = lambda k: F.when(c(k) >= 0, c(k))
    return df.select(*[x for x in df.columns if x not in ("gfp", "dic")], F.when(c("mode") == "gfp", known("gfp")).when(c("mode") == "brightfield", known("dic")).alias("object_channel"), F.when(c("mode") != "rgb", known("dic")).alias("well_channel"), (c("mode") == "rgb").alias("rgb"))


def suggest_channel(df: DataFrame, keys: list[str], terms: list[str]) -> DataFrame:
    """SRC-10: the first channel whose name has one of the terms."""
    hit = F.exists(F.array(*map(F.lit, terms)), lambda term: F.contains(F.lower("name"), term))
    return df.groupBy(*keys).agg(F.min(F.when(hit, c("i"))).alias("channel"))


def position_records(df: DataFrame, keys: list[str]) -> DataFrame:
    """SRC-11: one row for each stage position of nested metadata."""
    parsed = F.from_json("metadata", "positions array<struct<x: double>>")
    return df.select(*keys, F.posexplode(parsed["positions"]).alias("position", "p")).select(*keys, c("position").cast("long").alias("position"), c("p.x").alias("x"))


def fingerprint(*columns: str) -> Column:
    """SRC-12: SHA-256 of compact JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def manifest_rows(df: DataFrame, etags: list[str]) -> DataFrame:
    """SRC-14"""
    out = df.withColumn("_etag", F.coalesce(*etags)).drop(*etags).withColumnRenamed("_etag", "etag")
    return out.withColumns({"shape": F.to_json("shape"), "status": F.when(c("error").isNull(), "complete").otherwise("error"), "error": F.coalesce("error", F.lit(""))})


def axis_names(names: Column, dims: Column) -> Column:
    """SRC-16: upper-case names; where their count isn't the number of dimensions, YX, CYX or D0.. before YX."""
    letters = lambda *x: F.array(*map(F.lit, x))
    numbered = F.concat(F.transform(F.sequence(F.lit(0), dims - 3), lambda i: F.concat(F.lit("D"), i.cast("string"))), letters("Y", "X"))
    default = F.when(dims == 2, letters("Y", "X")).when(dims == 3, letters("C", "Y", "X")).otherwise(numbered)
    chosen = F.when(F.coalesce(F.size(names), F.lit(-1)) == dims, F.transform(names, F.upper)).otherwise(default)
    return F.when(F.array_contains(chosen, "X") & F.array_contains(chosen, "Y"), chosen).otherwise(F.raise_error(F.lit("X and Y axes are needed")).cast("array<string>"))


def channel_labels(df: DataFrame, count: int) -> DataFrame:
    """SRC-18: labels padded to count, and the scale of nested metadata or 1."""
    i = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    rows = df.withColumn("channel", i)
    label = F.coalesce(F.get("labels", c("channel")), F.concat(F.lit("Channel "), c("channel").cast("string")))
    return rows.withColumns({"label": label, "scale": F.coalesce(F.get_json_object("meta", "$.scale").cast("double"), F.lit(1.0))}).drop("labels", "meta")


def keep_columns(df: DataFrame, wanted: list[str], prefix: str) -> DataFrame:
    """FN-23: wanted columns that are there, and all with the prefix."""
    return df.select(*[x for x in df.columns if x in wanted or x.startswith(prefix)])


def local_stretch(pixels: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """FN-11: each image stretched between two percentiles, or its extremes if they are equal; flat images are 0."""
    s = pixels.groupBy("image_id").agg(F.percentile("v", F.array(F.lit(low), F.lit(high))).alias("q"), F.min("v").alias("a"), F.max("v").alias("b"))
    s = s.select("image_id", *[F.when(c("q")[1] > c("q")[0], c("q")[i]).otherwise(c(e)).alias(n) for i, e, n in ((0, "a", "lo"), (1, "b", "hi"))])
    level = F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (c("v") - c("lo")) * 255.0 / F.nullif(c("hi") - c("lo"), F.lit(0.0)))))
    return pixels.join(s, "image_id").select("image_id", "x", "y", F.when(c("hi") > c("lo"), level.cast("int")).otherwise(0).alias("level"))


def export_package(tracking: DataFrame) -> dict[str, DataFrame]:
    """SNK-01: a table each of the experiment, the dimensions, the map, the measurements, the foci and the flags."""
    d = lambda *x: tracking.select(*x).distinct()
    flags = F.filter(F.array(F.when(c("total_area_um2") == 0, "no_area"), F.when(~c("foci_analysed"), "foci_not_analysed"), F.when(c("object_count") > 3, "many_objects")), lambda f: f.isNotNull())
    return {
        "experiment": tracking.agg(F.count_distinct("condition").alias("conditions"), F.count_distinct("timepoint").alias("timepoints")).select(F.lit("Experiment_001").alias("name"), "conditions", "timepoints"),
        "condition": d("condition"),
        "timepoint": d("timepoint"),
        "map": d("condition", "timepoint"),
        "trajectory": d("trajectory_id"),
        "wells": tracking,
        "objects": tracking.where("object_count > 0").select("trajectory_id", "timepoint", F.explode(F.sequence(F.lit(1).cast("long"), c("object_count"))).alias("object_number")),
        "foci": tracking.where("foci_analysed").select("trajectory_id", "timepoint", "focus_count"),
        "qc_flags": tracking.select("trajectory_id", "timepoint", F.explode(flags).alias("flag")),
    }


def write_package(package: dict[str, DataFrame], root: str) -> dict[str, DataFrame]:
    """Each table in its folder under root, the wells in folders of condition and time (SNK-04); gives the written tables."""
    for name, df in package.items():
        if name == "wells":
            folder = F.split(output_folder(), "/")
            df.withColumns({"condition_folder": folder[0], "time_folder": folder[1]}).write.mode("overwrite").partitionBy("condition_folder", "time_folder").parquet(f"{root}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{root}/{name}")
    spark = next(iter(package.values())).sparkSession
    return {name: spark.read.parquet(f"{root}/{name}") for name in package}


def row_counts(package: dict[str, DataFrame]) -> DataFrame:
    """SNK-02"""
    out = None
    for name, df in package.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.union(n)
    return out


def manifest_prefix(path: Column, root: str) -> Column:
    """The folder of a manifest under the root."""
    return F.regexp_replace(F.regexp_extract(path, re.escape(root.rsplit(":", 1)[-1].lstrip("/")) + r"/(.*)$", 1), r"/[^/]*$", "")


def read_manifests(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """SNK-03: all manifests under root in one table, each row with its manifest's folder."""
    found = spark.read.option("header", True).option("recursiveFileLookup", True).schema(schema).csv(root)
    return found.select("*", manifest_prefix(c("_metadata.file_path"), root).alias("prefix"))


def output_folder() -> Column:
    """SNK-04: the folder of a condition and a time."""
    return F.concat(F.lit("condition_"), padded(c("condition_index"), 2), F.lit("_"), slugify(c("condition")), F.lit("/time_"), padded(c("timepoint_index"), 2), F.lit("_"), slugify(c("timepoint")))


def run_id(stamp: Column, label: Column) -> Column:
    """SNK-05: UTC stamp and at most 80 letters of the label."""
    return F.concat(F.date_format(stamp, "yyyyMMdd'T'HHmmss'Z'"), F.lit("_"), F.substring(slugify(label), 1, 80))


def settings_snapshot(rows: DataFrame, *settings: dict) -> DataFrame:
    """SNK-06: the settings in force, later ones merged in, beside the results."""
    merged = {k: v for s in settings for k, v in s.items()}
    return rows.withColumns({k: F.lit(v) for k, v in sorted(merged.items())})


def mask_manifest(images: DataFrame) -> DataFrame:
    """SNK-07: a row for each image and mask type."""
    kinds = F.inline(F.array(*[F.struct(F.lit(a).alias("mask_type"), F.lit(b).alias("definition")) for a, b in MASKS]))
    return images.select("image_id", kinds)

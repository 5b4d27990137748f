"""Aggregations of wells, objects, foci and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlume.sources.tables import quantiles

c = F.col


def total(condition: Column | str) -> Column:
    return F.count_if(c(condition) if isinstance(condition, str) else condition)


def image_summary(wells: DataFrame, keys: list[str]) -> DataFrame:
    """AG-01: wells, wells with objects, objects, foci (null where none was analysed), calibration."""
    return wells.groupBy(*keys).agg(
        F.count("*").alias("wells"), total(c("object_count") > 0).alias("object_wells"), F.sum("object_count").alias("objects"), F.sum("focus_count").alias("foci"), F.avg("um_per_pixel").alias("um_per_pixel")
    )


def spread(value: str, single_sd: float | None = 0.0) -> list[Column]:
    """AG-02: count, mean, median, sample SD (of one value: single_sd), extremes."""
    sd = F.when(F.count(value) == 1, F.lit(single_sd).cast("double")).otherwise(F.stddev_samp(value))
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), sd.alias("sd"), F.min(value).alias("low"), F.max(value).alias("high")]


def foci_totals(wells: DataFrame) -> DataFrame:
    """AG-03"""
    return wells.agg(F.sum("focus_count").alias("all_wells"), F.sum(F.when(c("object_count") > 0, c("focus_count"))).alias("object_wells"))


def frequencies(df: DataFrame, value: str) -> DataFrame:
    """AG-04: rows by value and their percent."""
    n = df.groupBy(value).agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100.0 * c("n") / F.sum("n").over(Window.partitionBy()))


def roll_up(wells: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """AG-05: mean and largest diameter and total area of each well's objects; only the area of an empty well is 0."""
    per = objects.groupBy(key).agg(F.avg("diameter_um").alias("mean_diameter_um"), F.max("diameter_um").alias("max_diameter_um"), F.sum("area_um2").alias("total_area_um2"))
    return wells.join(per, key, "left").withColumn("total_area_um2", F.coalesce("total_area_um2", F.lit(0.0)))


def condition_summary(wells: DataFrame, keys: list[str]) -> DataFrame:
    """AG-06: occupancy in percent, mean foci in wells with objects."""
    filled = c("object_count") > 0
    return wells.groupBy(*keys).agg(
        F.count("*").alias("wells"), F.when(F.count("*") > 0, 100.0 * total(filled) / F.count("*")).alias("occupancy_percent"), F.avg(F.when(filled, c("focus_count"))).alias("mean_foci")
    )


def status_counts(df: DataFrame) -> DataFrame:
    """AG-07: objects by status for the run, each image and each well in one pass."""
    grouped = df.groupingSets([[], ["image_id"], ["image_id", "well_id"]], "image_id", "well_id")
    status = lambda s: total(c("membership_status") == s).alias(s)
    return grouped.agg(F.grouping_id().alias("level"), status("accepted"), status("ambiguous"), status("outside_well"), F.count_distinct(F.when(c("false_well"), c("well_id"))).alias("false_wells"))


def metric_summary(df: DataFrame, label: str, metrics: list[str]) -> DataFrame:
    """AG-14: least, median and greatest value of each metric by label."""
    long = df.select(label, *[c(m).cast("double").alias(m) for m in metrics]).unpivot([label], metrics, "metric", "value")
    ends = long.groupBy(F.struct(label, "metric").alias("_key")).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    middle = quantiles(long, [label, "metric"], "value", {"median": 0.5}).select(F.struct(label, "metric").alias("_key"), "median")
    return ends.join(middle, "_key", "left").select("_key.*", "low", "median", "high")


def quantile_row(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: n and the quantiles of all values; without any, 0 and nulls."""
    return df.agg(F.count(value).alias("n")).join(quantiles(df, [], value, shares).drop("n"), F.lit(True), "left")


def cut_off(df: DataFrame, value: str, truth: str) -> DataFrame:
    """AG-15: midway between the lowest true and the highest false value, whether that separates them, and counts at it."""
    ends = df.agg(F.min(F.when(c(truth), c(value))).alias("true_low"), F.max(F.when(~c(truth), c(value))).alias("false_high"))
    ends = ends.withColumns({"cut": (c("true_low") + c("false_high")) / 2, "separable": c("true_low") > c("false_high")})
    at = c(value) >= c("cut")
    # one row of thresholds
    return df.crossJoin(F.broadcast(ends)).groupBy("true_low", "false_high", "cut", "separable").agg(total(at & c(truth)).alias("true_pass"), total(~at & c(truth)).alias("true_reject"), total(at & ~c(truth)).alias("false_pass"), total(~at & ~c(truth)).alias("false_reject"))


def pitch(neighbours: DataFrame, diameter: float, points: int) -> DataFrame:
    """AG-16: median over points of the smallest neighbour distance in [1.03, 2.2] diameters; too few samples are an error."""
    near = neighbours.where((c("d") >= 1.03 * diameter) & (c("d") <= 2.2 * diameter)).groupBy("a_id").agg(F.min("d").alias("d"))
    out = quantile_row(near, "d", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).withColumnRenamed("n", "samples")
    checked = F.when(c("samples") < max(20, 0.1 * points), F.raise_error(F.lit("too few neighbours for a pitch")).cast("double")).otherwise(c("p50"))
    return out.select("samples", checked.alias("pitch"), "p10", "p90")


def registration_metrics(matches: DataFrame, base_n: int, follow_n: int, pitch_px: float, least: int = 8, least_share: float = 0.35, good_error: float = 0.2) -> DataFrame:
    """AG-17: matched wells, shares, median error and the status ladder. matches (d, confident)."""
    m = quantile_row(matches.where(c("confident")).select("d"), "d", {"median_error_px": 0.5}).withColumnRenamed("n", "matched")
    m = m.withColumns({"base_share": c("matched") / float(base_n), "follow_share": c("matched") / float(follow_n), "median_error_pitch": c("median_error_px") / pitch_px})
    status = F.when((c("matched") < least) | (c("base_share") < least_share), "rejected_low_overlap_or_match_count").when(c("median_error_pitch").isNull() | (c("median_error_pitch") > good_error), "rejected_high_registration_error").otherwise("accepted")
    return m.withColumn("status", status)


def pca_axes(points: DataFrame) -> DataFrame:
    """AG-19: centre and unit axes of 2-d points; the long axis points to larger y, the short one is (-ly, lx)."""
    s = points.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("vxy"))
    angle = F.atan2(2 * c("vxy"), c("vx") - c("vy")) / 2
    s = s.withColumns({"lx": F.cos(angle), "ly": F.sin(angle)})
    flip = F.when(c("ly") < 0, -1.0).otherwise(1.0)
    s = s.withColumns({"lx": c("lx") * flip, "ly": c("ly") * flip})
    return s.select("cx", "cy", "lx", "ly", (-c("ly")).alias("sx"), c("lx").alias("sy"))


def hex_angle(edges: DataFrame) -> DataFrame:
    """AG-20: orientation of annulus edges modulo 60 degrees, in radians."""
    t = F.atan2(c("by") - c("ay"), c("bx") - c("ax"))
    return edges.agg(F.count("*").alias("edges"), (F.atan2(F.avg(F.sin(6 * t)), F.avg(F.cos(6 * t))) / 6).alias("angle"))


def final_summary(wells: DataFrame) -> DataFrame:
    """AG-23"""
    n = F.count("*")
    positive, multi = total(c("object_count") > 0), total(c("object_count") > 1)
    return wells.agg(n.alias("wells"), positive.alias("positive"), (n - positive).alias("negative"), multi.alias("multiple"), (positive / n).alias("positive_share"), F.avg("object_count").alias("mean_objects"), F.percentile("object_count", 0.5).alias("median_objects"))


def run_status(sources: DataFrame) -> DataFrame:
    """AG-26"""
    n = lambda s: total(c("status") == s).alias(s)
    return sources.agg(n("complete"), n("partial"), n("error"), F.bool_and(c("status") == "complete").alias("all_complete"))


def calibration_audit(fields: DataFrame) -> DataFrame:
    """AG-29: mean calibration of each time point, accepted fields, matched wells."""
    return fields.groupBy("timepoint_index").agg(F.avg("um_per_pixel").alias("um_per_pixel"), total("accepted").alias("accepted_fields"), F.sum("matched").alias("matched_wells"))


def collected(objects: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """AG-30: a well's objects in order, for display."""
    return objects.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("objects"))


def membership(f: Column, i: Column, w: Column) -> Column:
    """QC-01: from centroid, inside and wall fraction; a null fraction makes each comparison false."""
    outside = ((f > 1.05) & (i < 0.50)) | ((f > 0.60) & (i < 0.75) & (w >= 0.35))
    ambiguous = ((f > 0.65) & (i < 0.88)) | ((f > 0.75) & (w >= 0.25))
    return F.when(outside, "outside_well").when(ambiguous, "ambiguous").otherwise("accepted")


def routed_status(status: Column, distance_share: Column, false_well: Column, route: str) -> Column:
    """QC-02: beyond 1.2 radii is outside. Route "nd2": a false well wins; "zarr": the distance wins."""
    far = distance_share > 1.20
    first, second = ((false_well, "rejected_false_well"), (far, "outside_well"))[:: 1 if route == "nd2" else -1]
    return F.when(first[0], first[1]).when(second[0], second[1]).otherwise(status)


def included(status: Column, exclude_ambiguous: bool) -> Column:
    """QC-03"""
    return (status == "accepted") | ((status == "ambiguous") & F.lit(not exclude_ambiguous))


def false_wells(candidates: DataFrame, scores: DataFrame, threshold: float = 0.337) -> DataFrame:
    """QC-04: a finite score up to the threshold vetoes a well; only wells with candidates are evaluated."""
    asked = scores.join(candidates.select("well_id").distinct(), "well_id", "left_semi")
    bad = (c("wall_score") <= threshold) & ~F.isnan("wall_score")
    return asked.select("well_id", "wall_score", F.when(F.coalesce(bad, F.lit(False)), "rejected_false_well").otherwise("accepted").alias("validity"))


def rebuilt_wells(wells: DataFrame, kept: DataFrame) -> DataFrame:
    """QC-07: counts, formatted sizes and flags of every well, from the kept candidates (well_id, n, diameter)."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "diameter"))), lambda o: F.format_string("%.4f", o["diameter"])), "; ")
    per = kept.groupBy("well_id").agg(F.count("*").alias("objects"), text.alias("sizes"))
    out = wells.join(per, "well_id", "left").withColumns({"objects": F.coalesce("objects", F.lit(0).cast("long")), "sizes": F.coalesce("sizes", F.lit(""))})
    return out.withColumns({"qc_multiple": c("objects") > 1, "qc_none": c("objects") == 0})


def on_axes(points: DataFrame, axes: DataFrame) -> DataFrame:
    """points (id, x, y) with their place along the long and across the short axis. axes has one row."""
    dx, dy = c("x") - c("cx"), c("y") - c("cy")
    return points.crossJoin(F.broadcast(axes)).select("id", "x", "y", (dx * c("lx") + dy * c("ly")).alias("along"), (dx * c("sx") + dy * c("sy")).alias("across"))


def robust_bounds(points: DataFrame, axes: DataFrame, pitch_px: float, bins: int = 44, least: int = 20, share: float = 0.1, margin: float = 0.45) -> DataFrame:
    """AG-22: a straight region around an array: its sides are percentiles of the extremes in bins along the long axis."""
    p = on_axes(points, axes)
    q = quantile_row(p.select("along"), "along", {"_0": 0.005, "_1": 0.01, "_2": 0.99, "_3": 0.995}).select(F.array("_0", "_1", "_2", "_3").alias("q"))
    ranged = p.crossJoin(F.broadcast(q)).where((c("along") >= c("q")[1]) & (c("along") <= c("q")[2]))
    b = F.least(F.lit(bins - 1), F.floor((c("along") - c("q")[1]) / (c("q")[2] - c("q")[1]) * bins))
    per = ranged.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.min("across").alias("lo"), F.max("across").alias("hi")).where(c("n") >= least)
    m = margin * pitch_px
    sides = per.agg((F.percentile("lo", share) - m).alias("left"), (F.percentile("hi", 1 - share) + m).alias("right"))
    return sides.crossJoin(q).select("left", "right", (c("q")[0] - m).alias("start"), (c("q")[3] + m).alias("end"))


def ransac_similarity(pairs: DataFrame, order: Column, hypotheses: int = 64, tolerance: float = 4.0) -> DataFrame:
    """AG-24: scale, rotation and shift of matched points (id, x, y, u, v) by two-point hypotheses.

    The first hypotheses + 1 pairs in order give the hypotheses (neighbours in order), whose inliers are counted over all
    pairs; the one with most (then the first) is fitted again on its inliers by least squares.
    """
    first = pairs.orderBy(order, "id").limit(hypotheses + 1)
    k = Window.orderBy(order, "id")  # hypotheses + 1 rows
    step = first.withColumn("h", F.row_number().over(k)).withColumns({f"{x}2": F.lead(x).over(k) for x in ("x", "y", "u", "v")}).where("x2 IS NOT NULL")
    dx, dy, du, dv = (c(f"{x}2") - c(x) for x in ("x", "y", "u", "v"))
    n = dx * dx + dy * dy
    h = step.where(n > 0).select("h", ((du * dx + dv * dy) / n).alias("a"), ((dv * dx - du * dy) / n).alias("b"), "x", "y", "u", "v")
    h = h.select("h", "a", "b", (c("u") - c("a") * c("x") + c("b") * c("y")).alias("tx"), (c("v") - c("b") * c("x") - c("a") * c("y")).alias("ty"))

    def error() -> Column:
        ex = c("a") * c("x") - c("b") * c("y") + c("tx") - c("u")
        ey = c("b") * c("x") + c("a") * c("y") + c("ty") - c("v")
        return F.sqrt(ex * ex + ey * ey)

    # every pair meets a fixed number of hypotheses
    tried = pairs.crossJoin(F.broadcast(h)).groupBy("h", "a", "b", "tx", "ty").agg(F.count_if(F.round(error(), 6) <= tolerance).alias("inliers"))
    best = tried.agg(F.max_by(F.struct("h", "a", "b", "tx", "ty", "inliers"), F.struct("inliers", -c("h"))).alias("m")).select("m.*")
    own = pairs.crossJoin(F.broadcast(best)).where(F.round(error(), 6) <= tolerance)
    s = own.agg(F.count("*").alias("inliers"), *[F.avg(x).alias(f"m{x}") for x in "xyuv"], (F.covar_pop("x", "u") + F.covar_pop("y", "v")).alias("p"), (F.covar_pop("x", "v") - F.covar_pop("y", "u")).alias("q"), (F.var_pop("x") + F.var_pop("y")).alias("r"))
    s = s.withColumns({"a": c("p") / c("r"), "b": c("q") / c("r")}).crossJoin(pairs.agg(F.count("*").alias("total")))
    return s.select(
        F.sqrt(c("a") * c("a") + c("b") * c("b")).alias("scale"), F.degrees(F.atan2("b", "a")).alias("rotation"), (c("mu") - c("a") * c("mx") + c("b") * c("my")).alias("tx"), (c("mv") - c("b") * c("mx") - c("a") * c("my")).alias("ty"), "inliers", (c("inliers") / c("total")).alias("inlier_share"), (c("inliers") >= 8).alias("usable")
    )

"""Longitudinal response: baselines, growth, dose summaries, classes, association statistics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AREA, RELATIVE, CHANGE = "total_area_um2", "relative_area", "percent_change"
DERIVED = ("baseline_time", "baseline_area", RELATIVE, CHANGE, "log_growth_rate")
#: Terms of the series of Student's t.
MOST_TERMS = 10_000
NOTE_NO_FIT = "At least four distinct concentrations, including at least three >0, are required for a 4PL fit."


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Raise for missing columns, listed in order of name."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError("Missing required longitudinal columns: " + ", ".join(missing))
    return df


def drop_derived(df: DataFrame) -> DataFrame:
    """FN-24: without derived columns, suffixed ones included, so that a second run gives the same."""
    return df.drop(*[c for c in df.columns if any(c == p or c.startswith(p + "_") for p in DERIVED)])


def trajectory_safe(df: DataFrame) -> DataFrame:
    """FN-25: the local well index is kept, the trajectory takes its place; an empty or missing one is an error."""
    bad = F.col("trajectory_id").isNull() | (F.trim("trajectory_id") == "")
    key = F.when(bad, F.raise_error(F.lit("trajectory_id is missing"))).otherwise(F.col("trajectory_id"))
    return df.withColumn("local_well_index", F.col("well_index")).withColumn("well_index", key)


def first_known(column: str, keys: list[str], order: list[str]) -> Column:
    """WN-01: the first non-null value of a group in order, as pandas' first."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.first(column, ignorenulls=True).over(w)


def with_baseline(df: DataFrame) -> DataFrame:
    """WN-01 per trajectory: baseline area and the ratio to it."""
    out = df.withColumn("baseline_area", first_known(AREA, ["trajectory_id"], ["timepoint_index"]))
    return out.withColumn(RELATIVE, F.when(F.col("baseline_area") > 0, F.col(AREA) / F.col("baseline_area")))


def response_metrics(df: DataFrame) -> DataFrame:
    """WN-02: baseline-normalised metrics by (condition_index, well_index)."""
    out = drop_derived(require(df, "condition_index", "well_index", "timepoint_index", AREA))
    if "elapsed_time" not in out.columns:
        out = out.withColumn("elapsed_time", F.col("timepoint_index") - F.lit(1.0))
    out = out.withColumn(AREA, F.coalesce(F.col(AREA), F.lit(0.0)))
    keys, order = ["condition_index", "well_index"], ["timepoint_index"]
    out = out.withColumns({"baseline_time": first_known("elapsed_time", keys, order), "baseline_area": first_known(AREA, keys, order)})
    base, now, dt = F.col("baseline_area"), F.col(AREA), F.col("elapsed_time") - F.col("baseline_time")
    out = out.withColumn(RELATIVE, F.when(base > 0, now / base))
    return out.withColumns({CHANGE: F.when(base > 0, 100.0 * (F.col(RELATIVE) - 1)), "log_growth_rate": F.when((base > 0) & (now > 0) & (dt > 0), F.ln(now / base) / dt)})


def final_rows(df: DataFrame, keys: tuple[str, ...] = ("condition_index", "condition", "well_index")) -> DataFrame:
    """WN-03: each well's last row (not its last known values); rows with a null key go."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("timepoint_index").desc(), "trajectory_id"))
    return df.dropna(subset=list(keys)).withColumn("_last", last).where("_last = 1").drop("_last")


def quartiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AG-08, AG-09: n, median, quartiles and mean by keys, null keys kept; groups without a value go."""
    from gridlume.sources.tables import quantiles

    rows = df.select(*keys, value)
    means = rows.where(F.col(value).isNotNull()).groupBy(F.struct(F.lit(0).alias("_0"), *keys).alias("_key")).agg(F.avg(value).alias("mean"))
    found = quantiles(rows, keys, value, {"median": 0.5, "q25": 0.25, "q75": 0.75})
    return found.withColumn("_key", F.struct(F.lit(0).alias("_0"), *keys)).join(means, "_key").select(*keys, "n", "median", "q25", "q75", "mean")


def responder_class(change: Column, responder_max: float, resistant_min: float) -> Column:
    """QC-08; null for a null change."""
    if responder_max >= resistant_min:
        raise ValueError("Responder threshold must be lower than the resistant threshold.")
    return F.when(change <= responder_max, "Responder").when(change >= resistant_min, "Resistant").when(change.isNotNull(), "Intermediate")


def class_shares(df: DataFrame) -> DataFrame:
    """AG-10: count and percent of each class in its condition, absent classes as 0."""
    classes = ["Responder", "Intermediate", "Resistant"]
    wide = df.groupBy("condition").pivot("response_class", classes).count().na.fill(0)
    total = reduce(Column.__add__, [F.col(c) for c in classes])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("response_class"), F.col(c).alias("n"), (100.0 * F.col(c) / total).alias("percent")) for c in classes])).alias("e")
    return wide.select("condition", each).select("condition", "e.*")


def with_average_rank(df: DataFrame, value: str, keys: list[str], name: str) -> DataFrame:
    """df with the mean of the ranks that ties share, by keys: counted by value, so that no key is ranked in one task."""
    from gridlume.sources.tables import running

    counted = running(df.groupBy(*keys, value).agg(F.count("*").alias("_n")), keys, [value], F.col("_n"), "_before")
    rank = (F.col("_before") + (F.col("_n") + 1) / 2).alias(name)
    key = F.struct(*keys, value).alias("_key")
    return df.withColumn("_key", key).join(counted.select(key, rank), "_key").drop("_key")


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """AG-11: rank correlation by keys; null with under 3 rows or a constant side."""
    from gridlume.operators.lineage import stage

    both = stage(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b), "spearman")
    ranked = with_average_rank(with_average_rank(both, a, keys, "_ra"), b, keys, "_rb")
    out = ranked.groupBy(*keys).agg(F.count("*").alias("n_wells"), (F.covar_pop("_ra", "_rb") / F.nullif(F.stddev_pop("_ra") * F.stddev_pop("_rb"), F.lit(0.0))).alias("_rho"), F.count_distinct(a).alias("_da"), F.count_distinct(b).alias("_db"))
    usable = (F.col("n_wells") >= 3) & (F.col("_da") >= 2) & (F.col("_db") >= 2)
    return out.withColumn("spearman_rho", F.when(usable, F.col("_rho"))).drop("_rho", "_da", "_db")


def spearman_p(rho: Column, n: Column) -> Column:
    """AG-12: two-sided p of Student's t with n - 2 degrees of freedom, by the finite series for whole degrees.

    Beyond MOST_TERMS terms the normal law takes over, at the place that an expansion in 1 / v gives (Hill 1970): within 1e-12 of
    the series there.
    """
    v = (n - 2).cast("double")
    t = F.abs(rho) * F.sqrt(v / ((1 + rho) * (1 - rho)))
    angle = F.atan(t / F.sqrt(v))
    c2, even = F.cos(angle) * F.cos(angle), (n % 2) == 0
    # term k from term k - 1: the factor is (2k - 1) / 2k for even degrees, 2k / (2k + 1) for odd ones
    terms = F.when(even, (n - 2) / 2 - 1).otherwise((n - 5) / 2).cast("int")
    factor = lambda k: F.when(even, (2 * k - 1) / (2 * k)).otherwise(2 * k / (2 * k + 1))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * factor(k) * c2
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    series = F.when(terms >= 1, F.aggregate(F.sequence(F.lit(1), F.least(F.lit(MOST_TERMS), F.greatest(terms, F.lit(1)))), start, step)["sum"]).when(terms == 0, F.lit(1.0)).otherwise(0.0)
    inside = F.when(even, F.sin(angle) * series).otherwise(2 / F.pi() * (angle + F.when(n > 3, F.sin(angle) * F.cos(angle) * series).otherwise(0.0)))
    few = F.greatest(F.lit(0.0), 1 - inside)
    a = v - 0.5
    b, y = 48 * a * a, a * F.log1p(t * t / v)
    many = two_sided_normal((((((-0.4 * y - 3.3) * y - 24) * y - 85.5) / (0.8 * y * y + 100 + b) + y + 3) / b + 1) * F.sqrt(y))
    return F.when(F.abs(rho) == 1, 0.0).when(rho.isNotNull() & (n >= 3), F.when(terms > MOST_TERMS, many).otherwise(few))


def two_sided_normal(z: Column) -> Column:
    """P(|Z| > z) for z >= 0: up to 3 by the series of the error function, beyond by its continued fraction, 80 terms of either."""
    terms, x2 = F.sequence(F.lit(1), F.lit(80)), z * z
    start = F.struct(z.alias("term"), z.alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * x2 / (2 * k + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    density = F.exp(-x2 / 2) * math.sqrt(2 / math.pi)
    near = 1 - density * F.aggregate(terms, start, step)["sum"]
    # z + 1 / (z + 2 / (z + 3 / ..)), from the inside out
    far = density / F.aggregate(F.reverse(terms), z, lambda acc, k: z + k / acc)
    return F.when(z <= 3, near).otherwise(far)


def bh_adjusted(df: DataFrame, p: str, ties: list[str]) -> DataFrame:
    """AG-13: false discovery rates of all p of the table as one family; one row a test, so the ordering is small."""
    known = df.where(F.col(p).isNotNull())
    rank = F.row_number().over(Window.orderBy(p, *ties))
    scaled = known.withColumn("_rank", rank).withColumn("_scaled", F.col(p) * F.count("*").over(Window.partitionBy()) / F.col("_rank"))
    down = Window.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    done = scaled.withColumn("p_bh", F.least(F.lit(1.0), F.min("_scaled").over(down))).drop("_rank", "_scaled")
    return done.unionByName(df.where(F.col(p).isNull()), allowMissingColumns=True)


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """AG-25: counts in bins equal widths over the range, the last one closed, with mean and mean -/+ one SD."""
    known = df.where(F.col(value).isNotNull())
    s = known.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    width = F.greatest((F.col("hi") - F.col("lo")) / bins, F.lit(1e-300))
    b = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / width)).cast("int")
    # one row of statistics
    return known.crossJoin(F.broadcast(s)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("lo", "hi", "mean", "sd")])


def dose_grid_fit(doses: DataFrame, midpoints: list[float], hills: list[float]) -> DataFrame:
    """Four-parameter logistic of one group on a given grid, by profile least squares: for each (midpoint, hill) of a grid bottom and top are
    closed-form from sums; the smallest squared error wins, then the smaller midpoint and hill.

    doses (dose, response) has one row a concentration. Without four doses, three of them positive, or without a range
    of responses the row has the note instead.
    """
    spark = doses.sparkSession
    grid = spark.createDataFrame([(float(m), float(h)) for m in midpoints for h in hills], "midpoint double, hill double")
    f = F.when(F.col("dose") <= 0, 1.0).otherwise(1 / (1 + F.pow(F.col("dose") / F.col("midpoint"), F.col("hill"))))
    # dose medians times a grid of fixed size: a bounded product
    each = doses.crossJoin(F.broadcast(grid)).withColumn("f", f)
    fit = each.groupBy("midpoint", "hill").agg(
        F.count("*").alias("n"), F.sum("f").alias("sf"), F.sum("response").alias("sy"), F.sum(F.col("f") * F.col("f")).alias("sff"), F.sum(F.col("f") * F.col("response")).alias("sfy"), F.sum(F.col("response") * F.col("response")).alias("syy")
    )
    det = F.col("n") * F.col("sff") - F.col("sf") * F.col("sf")
    slope = F.when(F.abs(det) > 1e-12, (F.col("n") * F.col("sfy") - F.col("sf") * F.col("sy")) / det).otherwise(0.0)
    fit = fit.withColumn("slope", slope).withColumn("bottom", (F.col("sy") - F.col("slope") * F.col("sf")) / F.col("n"))
    fit = fit.withColumn("sse", F.round(F.col("syy") - F.col("bottom") * F.col("sy") - F.col("slope") * F.col("sfy"), 9)).withColumn("top", F.col("bottom") + F.col("slope"))
    best = fit.agg(F.min_by(F.struct("midpoint", "hill", "bottom", "top", "sse"), F.struct("sse", "midpoint", "hill")).alias("b"))
    gate = doses.agg((F.count_distinct("dose") >= 4).alias("a"), (F.count_distinct(F.when(F.col("dose") > 0, F.col("dose"))) >= 3).alias("b3"), (F.max("response") > F.min("response")).alias("c"))
    ok = F.col("a") & F.col("b3") & F.col("c")
    return gate.crossJoin(best).select(*[F.when(ok, F.col(f"b.{c}")).alias(c) for c in ("midpoint", "hill", "bottom", "top", "sse")], F.when(~F.coalesce(ok, F.lit(False)), F.lit(NOTE_NO_FIT)).alias("fit_error"))


#: Points of the starting grid on each axis, bounds of the hill, and decades beyond the doses within which midpoints are sought.
GRID, HILL, DECADES = 33, (0.05, 10.0), 3


#: Doses of a group that are one array.
BLOCK = 1024
#: Variances and covariances of a curve f, its derivatives a by midpoint and b by hill, and the responses r.
MOMENTS = ("ff", "rr", "fr", "aa", "ab", "bb", "af", "bf", "ar", "br")


def dose_blocks(known: DataFrame, sizes: DataFrame) -> DataFrame:
    """known (_key, dose, response) as arrays in order of dose, a row an array; a group of more than BLOCK doses (n in sizes) is dealt by their hashes."""
    dealt = known.join(sizes, "_key").withColumn("block", F.pmod(F.xxhash64("dose", "response"), F.ceil(F.col("n") / BLOCK)))
    return dealt.groupBy("_key", "block").agg(F.array_sort(F.collect_list(F.struct("dose", "response"))).alias("doses"))


def dose_moments() -> tuple[Column, Column]:
    """Count, means and MOMENTS of a point (m, h) over the doses of its block, and over its blocks' _part.

    Where f is nearly 1 at all doses they are of the size of rounding errors, so sums go by order of dose, then of block: the same
    on any partitions.
    """
    c = F.col
    hill, rest = F.exp("h"), ("f", "a", "b", "r")
    at = F.transform("doses", lambda d: F.struct((d["dose"] <= 0).alias("none"), (hill * (F.ln(d["dose"]) - c("m"))).alias("u"), d["response"].alias("r")))
    at = F.transform(at, lambda d: F.struct(d["none"], d["u"], d["r"], F.when(d["none"], 1.0).otherwise(1 / (1 + F.exp(d["u"]))).alias("f")))
    bend = lambda d, by: F.when(d["none"], 0.0).otherwise(d["f"] * (1 - d["f"]) * by)
    at = F.transform(at, lambda d: F.struct(d["f"], bend(d, hill).alias("a"), bend(d, -d["u"]).alias("b"), d["r"]))
    zero = F.struct(*(F.lit(0.0).alias(k) for k in ("n", *rest, *MOMENTS)))

    def add(s: Column, d: Column) -> Column:
        n = s["n"] + 1
        mean = {k: s[k] + (d[k] - s[k]) / n for k in rest}
        return F.struct(n.alias("n"), *(mean[k].alias(k) for k in rest), *((s[p + q] + (d[q] - s[q]) * (d[p] - mean[p])).alias(p + q) for p, q in MOMENTS))

    def both(s: Column, t: Column) -> Column:
        n = s["n"] + t["n"]
        share = t["n"] / n
        return F.struct(n.alias("n"), *((s[k] + (t[k] - s[k]) * share).alias(k) for k in rest), *((s[p + q] + t[p + q] + (t[p] - s[p]) * (t[q] - s[q]) * s["n"] * share).alias(p + q) for p, q in MOMENTS))

    return F.aggregate(at, zero, add), F.aggregate(F.array_sort(F.collect_list("_part")), zero, lambda s, t: both(s, t["s"]))


def best_places(grid: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of grid (_key, .., m, h) that may have their group's least squared error, those within the rounding errors of sums in any order."""
    c = F.col
    f = F.when(c("dose") <= 0, 1.0).otherwise(1 / (1 + F.exp(F.exp("h") * (F.ln("dose") - c("m")))))
    each = grid.join(known, "_key").withColumn("f", f)
    sums = each.groupBy(*grid.columns).agg(F.count("*").alias("n"), F.var_pop("f").alias("ff"), F.var_pop("response").alias("rr"), F.covar_pop("f", "response").alias("fr"))
    sse = c("n") * (c("rr") - F.when(c("ff") > 1e-15, c("fr") * c("fr") / c("ff")).otherwise(0.0))
    least = F.min("sse").over(Window.partitionBy("_key"))
    return sums.withColumn("sse", sse).withColumn("least", least).where(c("sse") <= c("least") + 1e-6 * c("n") * c("rr") + 2e-9).select(*grid.columns)


def dose_sums(points: DataFrame, blocks: DataFrame, moments: tuple[Column, Column]) -> DataFrame:
    """For each row of points (_key, m, h, ..: logarithms of midpoint and hill) the best bottom, slope and squared error, and the
    normal equations of a Gauss-Newton step, all from sums over the group's doses.

    bottom and slope are linear, so the derivatives by m and h are taken less what 1 and f explain of them.
    """
    c, (of_block, of_all) = F.col, moments
    parts = points.join(blocks, "_key").select(*points.columns, F.struct("block", of_block.alias("s")).alias("_part"))
    sums = parts.groupBy(*points.columns).agg(of_all.alias("s"))
    sums = sums.select(*points.columns, c("s.n").alias("n"), c("s.f").alias("mf"), c("s.r").alias("mr"), *((c(f"s.{k}") / c("s.n")).alias(k) for k in MOMENTS))
    slope = F.when(c("ff") > 1e-15, c("fr") / c("ff")).otherwise(0.0)
    less = lambda p, q: F.when(c("ff") > 1e-15, c(p + q) - c(p + "f") * c(q + "f") / c("ff")).otherwise(0.0)
    return sums.select(
        *points.columns, slope.alias("slope"), (c("mr") - slope * c("mf")).alias("bottom"), F.greatest(F.lit(0.0), c("n") * (c("rr") - slope * c("fr"))).alias("sse"),
        (slope * slope * less("a", "a")).alias("paa"), (slope * slope * less("a", "b")).alias("pab"), (slope * slope * less("b", "b")).alias("pbb"), (slope * (c("ar") - slope * c("af"))).alias("par"), (slope * (c("br") - slope * c("bf"))).alias("pbr"),
    )


def dose_fit(doses: DataFrame, keys: list[str], rounds: int = 16) -> DataFrame:
    """AG-27: four-parameter logistic of every group at once: bottom + (top - bottom) / (1 + (dose / midpoint) ** hill).

    Bottom and top are closed-form, so the squared error is a function of midpoint and hill. It starts from the best point of
    a grid of their logarithms (equal errors to nine digits: the lower place) and goes on by damped Gauss-Newton rounds, each
    one aggregation for all groups: a step that lowers the error is taken and the damping falls, else it rises. hill stays in
    HILL, the midpoint within DECADES of the doses. Where only the highest dose stands out, every midpoint well beyond it fits
    as well, and rounding errors decide the rounds: only the order of the sums makes the result the same in every run. doses
    (keys.., dose, response) has one row a concentration; null doses and responses don't count. A group without four doses,
    three of them positive, or without a range of responses has the note instead.
    """
    from gridlume.operators.lineage import stage

    c = F.col
    known = stage(doses.where("dose IS NOT NULL AND response IS NOT NULL").select(F.struct(F.lit(0).alias("_0"), *keys).alias("_key"), c("dose").cast("double").alias("dose"), c("response").cast("double").alias("response")), "doses")
    positive = F.when(c("dose") > 0, c("dose"))
    ends = ((F.count_distinct("dose") >= 4) & (F.count_distinct(positive) >= 3) & (F.max("response") > F.min("response"))).alias("usable")
    groups = stage(known.groupBy("_key").agg(F.count("*").alias("n"), ends, (F.ln(F.min(positive)) - math.log(10) * DECADES).alias("lo"), (F.ln(F.max(positive)) + math.log(10) * DECADES).alias("hi")), "dose-groups")
    blocks = stage(dose_blocks(known, groups.select("_key", "n")), "dose-blocks")
    low, high = map(math.log, HILL)
    grid = groups.where("usable").select("_key", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(GRID * GRID - 1))).alias("i"))
    along = lambda k, a, b: a + (b - a) * F.expr(k) / (GRID - 1)
    grid = grid.withColumns({"m": along(f"i div {GRID}", c("lo"), c("hi")), "h": along(f"i % {GRID}", F.lit(low), F.lit(high))})
    parts = ("m", "h", "slope", "bottom", "sse", "paa", "pab", "pbb", "par", "pbr")
    moments = dose_moments()
    best = dose_sums(best_places(grid, known), blocks, moments).groupBy("_key", "lo", "hi").agg(F.min_by(F.struct(*parts), F.struct(F.round("sse", 9), "i")).alias("t"))
    at = stage(best.select("_key", "lo", "hi", "t.*", F.lit(0.01).alias("lam")), "dose-fit")
    for _ in range(rounds):
        paa, pbb = c("paa") * (1 + c("lam")), c("pbb") * (1 + c("lam"))
        det = paa * pbb - c("pab") * c("pab")
        dm, dh = (c("par") * pbb - c("pbr") * c("pab")) / det, (c("pbr") * paa - c("par") * c("pab")) / det
        step = lambda k, d, a, b: F.when(det > 1e-300, F.least(b, F.greatest(a, c(k) + d))).otherwise(c(k)).alias(k)
        tried = dose_sums(at.select("_key", step("m", dm, c("lo"), c("hi")), step("h", dh, F.lit(low), F.lit(high))), blocks, moments)
        both = at.join(tried.select("_key", F.struct(*parts).alias("t")), "_key")
        better = c("t.sse") < c("sse")
        # Each round is written: sixteen rounds in one plan would be planned anew in every one.
        at = stage(both.select("_key", "lo", "hi", *(F.when(better, c(f"t.{k}")).otherwise(c(k)).alias(k) for k in parts), F.when(better, c("lam") / 10).otherwise(c("lam") * 10).alias("lam")), "dose-fit")
    out = groups.select("_key", "usable").join(at, "_key", "left")
    found = lambda e, name: F.when(c("usable"), e).alias(name)
    note = F.when(~c("usable"), F.lit(NOTE_NO_FIT)).alias("fit_error")
    return out.select(*(c(f"_key.{k}").alias(k) for k in keys), found(F.exp("m"), "midpoint"), found(F.exp("h"), "hill"), found(c("bottom"), "bottom"), found(c("bottom") + c("slope"), "top"), found(c("sse"), "sse"), note)

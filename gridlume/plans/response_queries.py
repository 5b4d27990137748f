"""Queries of the response operators on the tracking view."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlume.operators import response as R
from gridlume.plans.registry import query
from gridlume.plans.views import Tables
from gridlume.sources import tables as IO

KEYS = ["condition", "timepoint_index"]


def r6(c, name: str | None = None):
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column, 6).alias(name or c)


def metrics(t: Tables) -> DataFrame:
    return R.response_metrics(R.trajectory_safe(t.tracking))


#: The same metrics for the oracle, as CTEs that the queries' SQL goes on from.
METRICS = """
WITH safe AS (SELECT *, well_index AS local_well_index, trajectory_id AS key FROM v_tracking),
based AS (
  SELECT *, first_value(elapsed_time IGNORE NULLS) OVER w AS baseline_time, first_value(coalesce(total_area_um2, 0)) OVER w AS baseline_area
  FROM safe WINDOW w AS (PARTITION BY condition_index, key ORDER BY timepoint_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
rel AS (SELECT *, CASE WHEN baseline_area > 0 THEN total_area_um2 / baseline_area END AS relative_area FROM based),
m AS (
  SELECT *, CASE WHEN baseline_area > 0 THEN 100 * (relative_area - 1) END AS percent_change,
         CASE WHEN baseline_area > 0 AND total_area_um2 > 0 AND elapsed_time - baseline_time > 0
              THEN ln(total_area_um2 / baseline_area) / (elapsed_time - baseline_time) END AS log_growth_rate
  FROM rel),
final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY condition_index, condition, key ORDER BY timepoint_index DESC) AS last FROM m) WHERE last = 1)
"""
CLASS = "CASE WHEN percent_change <= -10 THEN 'Responder' WHEN percent_change >= 10 THEN 'Resistant' WHEN percent_change IS NOT NULL THEN 'Intermediate' END"


@query("fn_25", METRICS + "SELECT key AS well_index, local_well_index, condition_index, timepoint_index FROM m", "v_tracking")
def fn_25(t: Tables) -> DataFrame:
    return R.trajectory_safe(t.tracking).select("well_index", "local_well_index", "condition_index", "timepoint_index")


@query("fn_24", METRICS + "SELECT key AS well_index, timepoint_index, round(relative_area, 6) AS relative_area FROM m", "v_tracking")
def fn_24(t: Tables) -> DataFrame:
    again = R.response_metrics(metrics(t).withColumn("relative_area_x", F.lit(0)))
    return again.select("well_index", "timepoint_index", r6("relative_area"))


@query("wn_01", METRICS + "SELECT trajectory_id, timepoint_index, round(baseline_area, 6) AS baseline_area, round(relative_area, 6) AS relative_area FROM m", "v_tracking")
def wn_01(t: Tables) -> DataFrame:
    return R.with_baseline(t.tracking).select("trajectory_id", "timepoint_index", r6("baseline_area"), r6("relative_area"))


@query("wn_02", METRICS + "SELECT key AS well_index, condition_index, timepoint_index, baseline_time, round(baseline_area, 6) AS baseline_area, round(relative_area, 6) AS relative_area, round(percent_change, 6) AS percent_change, round(log_growth_rate, 6) AS log_growth_rate FROM m", "v_tracking")
def wn_02(t: Tables) -> DataFrame:
    return metrics(t).select("well_index", "condition_index", "timepoint_index", "baseline_time", *map(r6, ("baseline_area", "relative_area", "percent_change", "log_growth_rate")))


@query("wn_03", METRICS + "SELECT key AS well_index, condition_index, condition, timepoint_index, round(relative_area, 6) AS relative_area FROM final", "v_tracking")
def wn_03(t: Tables) -> DataFrame:
    return R.final_rows(metrics(t)).select("well_index", "condition_index", "condition", "timepoint_index", r6("relative_area"))


def classified(t: Tables) -> DataFrame:
    return R.final_rows(metrics(t)).withColumn("response_class", R.responder_class(F.col("percent_change"), -10, 10)).where("response_class IS NOT NULL")


@query("qc_08", METRICS + f"SELECT key AS well_index, condition, {CLASS} AS response_class, -10 AS responder_max, 10 AS resistant_min FROM final WHERE percent_change IS NOT NULL", "v_tracking")
def qc_08(t: Tables) -> DataFrame:
    return classified(t).select("well_index", "condition", "response_class", F.lit(-10).alias("responder_max"), F.lit(10).alias("resistant_min"))


@query(
    "ag_10",
    METRICS + f""", c AS (SELECT condition, {CLASS} AS response_class FROM final WHERE percent_change IS NOT NULL),
k AS (SELECT * FROM (SELECT DISTINCT condition FROM c) CROSS JOIN (VALUES ('Responder'), ('Intermediate'), ('Resistant')) AS v(response_class))
SELECT condition, response_class, n, round(100 * n / CAST(sum(n) OVER (PARTITION BY condition) AS DOUBLE), 6) AS percent
FROM (SELECT k.condition, k.response_class, count(c.condition) AS n FROM k LEFT JOIN c ON k.condition = c.condition AND k.response_class = c.response_class GROUP BY ALL)""",
    "v_tracking",
)
def ag_10(t: Tables) -> DataFrame:
    return R.class_shares(classified(t)).withColumn("percent", F.round("percent", 6))


QUART = "count(*) AS n, round(quantile_cont({0}, 0.5), 6) AS median, round(quantile_cont({0}, 0.25), 6) AS q25, round(quantile_cont({0}, 0.75), 6) AS q75, round(avg({0}), 6) AS mean"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("ag_08", METRICS + f"SELECT condition_index, condition, timepoint_index, timepoint, elapsed_time, {QUART.format('relative_area')} FROM m WHERE baseline_area > 0 AND relative_area IS NOT NULL GROUP BY ALL", "v_tracking")
def ag_08(t: Tables) -> DataFrame:
    keys = ["condition_index", "condition", "timepoint_index", "timepoint", "elapsed_time"]
    return rounded(R.quartiles(metrics(t).where("baseline_area > 0"), keys, "relative_area"), "median", "q25", "q75", "mean")


@query("ag_09", METRICS + f"SELECT concentration, {QUART.format('relative_area')} FROM final WHERE relative_area IS NOT NULL AND concentration IS NOT NULL GROUP BY ALL", "v_tracking")
def ag_09(t: Tables) -> DataFrame:
    return rounded(R.quartiles(R.final_rows(metrics(t)).where("concentration IS NOT NULL"), ["concentration"], "relative_area"), "median", "q25", "q75", "mean")


SPEAR = METRICS + """, pairs AS (SELECT condition, timepoint_index, focus_count AS a, percent_change AS b FROM m WHERE focus_count IS NOT NULL AND percent_change IS NOT NULL),
ranks AS (SELECT condition, timepoint_index, a, b,
  rank() OVER (PARTITION BY condition, timepoint_index ORDER BY a) + (count(*) OVER (PARTITION BY condition, timepoint_index, a) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY condition, timepoint_index ORDER BY b) + (count(*) OVER (PARTITION BY condition, timepoint_index, b) - 1) / 2.0 AS rb FROM pairs),
rho AS (SELECT condition, timepoint_index, count(*) AS n_wells,
  CASE WHEN count(*) >= 3 AND count(DISTINCT a) >= 2 AND count(DISTINCT b) >= 2 THEN corr(ra::DOUBLE, rb::DOUBLE) END AS r FROM ranks GROUP BY ALL),
ang AS (SELECT *, atan(abs(r) / sqrt((1 + r) * (1 - r))) AS g FROM rho),
terms AS (SELECT condition, timepoint_index, unnest(generate_series(0, greatest(n_wells // 2 - 1, 0))) AS k FROM ang),
series AS (SELECT a.condition, a.timepoint_index, sum(CASE
    WHEN n_wells % 2 = 0 AND k <= (n_wells - 2) / 2 - 1 THEN exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * cos(g) ** (2 * k)
    WHEN n_wells % 2 = 1 AND k <= (n_wells - 5) / 2 THEN sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * cos(g) ** (2 * k + 1) ELSE 0 END) AS s
  FROM ang a JOIN terms t ON a.condition = t.condition AND a.timepoint_index = t.timepoint_index GROUP BY ALL),
p AS (SELECT a.condition, a.timepoint_index, n_wells, r, CASE WHEN abs(r) = 1 THEN 0 WHEN r IS NULL THEN NULL
    WHEN n_wells % 2 = 0 THEN greatest(0, 1 - sin(g) * s) ELSE greatest(0, 1 - 2 / pi() * (g + sin(g) * s)) END AS p
  FROM ang a JOIN series x ON a.condition = x.condition AND a.timepoint_index = x.timepoint_index)
"""


def spearman(t: Tables) -> DataFrame:
    rho = R.spearman(metrics(t), KEYS, "focus_count", "percent_change")
    return rho.withColumn("p_value", R.spearman_p(F.col("spearman_rho"), F.col("n_wells")))


@query("ag_11", SPEAR + "SELECT condition, timepoint_index, n_wells, round(r, 6) AS spearman_rho FROM p", "v_tracking")
def ag_11(t: Tables) -> DataFrame:
    return rounded(spearman(t).drop("p_value"), "spearman_rho")


@query("ag_12", SPEAR + "SELECT condition, timepoint_index, round(p, 6) AS p_value FROM p", "v_tracking")
def ag_12(t: Tables) -> DataFrame:
    return spearman(t).select(*KEYS, r6("p_value"))


@query("ag_13", SPEAR + """, o AS (SELECT *, row_number() OVER (ORDER BY round(p, 9), condition, timepoint_index) AS k, count(*) OVER () AS n FROM p WHERE p IS NOT NULL)
SELECT condition, timepoint_index, round(least(1, min(round(p, 9) * n / k) OVER (ORDER BY k DESC)), 6) AS p_bh FROM o
UNION ALL SELECT condition, timepoint_index, NULL FROM p WHERE p IS NULL""", "v_tracking")
def ag_13(t: Tables) -> DataFrame:
    return R.bh_adjusted(spearman(t).withColumn("p_value", F.round("p_value", 9)), "p_value", KEYS).select(*KEYS, r6("p_bh"))


@query("ag_25", METRICS + """, s AS (SELECT min(percent_change) AS lo, max(percent_change) AS hi, avg(percent_change) AS mean, stddev_samp(percent_change) AS sd FROM m)
SELECT CAST(least(19, floor((percent_change - lo) / ((hi - lo) / 20))) AS INT) AS bin, count(*) AS n, round(lo, 6) AS lo, round(hi, 6) AS hi, round(mean, 6) AS mean, round(sd, 6) AS sd
FROM m, s WHERE percent_change IS NOT NULL GROUP BY ALL""", "v_tracking")
def ag_25(t: Tables) -> DataFrame:
    return rounded(R.histogram(metrics(t), "percent_change", 20), "lo", "hi", "mean", "sd")


LINES = ["total_area_um2", "relative_area", "focus_count", "object_count"]


@query("ag_28", METRICS + "SELECT condition, timepoint_index, metric, count(value) AS n, round(avg(value), 6) AS mean FROM (" + " UNION ALL ".join(f"SELECT condition, timepoint_index, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM m" for c in LINES) + ") WHERE value IS NOT NULL GROUP BY ALL", "v_tracking")
def ag_28(t: Tables) -> DataFrame:
    wide = metrics(t).select(*KEYS, *[F.col(c).cast("double") for c in LINES])
    long = wide.unpivot(KEYS, LINES, "metric", "value").where("value IS NOT NULL")
    return long.groupBy(*KEYS, "metric").agg(F.count("value").alias("n"), r6(F.avg("value"), "mean"))


def dose_fit_sql(rounds: int = 16) -> str:
    """The same rounds: a grid over the logarithms of midpoint and hill, then damped Gauss-Newton steps."""
    low, high, ten = (f"CAST({math.log(x)!r} AS DOUBLE)" for x in (*R.HILL, 10))
    n, parts = R.GRID, ("m", "h", "slope", "bottom", "sse", "paa", "pab", "pbb", "par", "pbr")

    def sums(points: str, keys: str) -> str:
        f = f"SELECT p.*, y AS r, dose > 0 AS pos, exp(h) AS hill, CASE WHEN dose > 0 THEN exp(h) * (ln(dose) - m) ELSE 0 END AS u FROM {points} p JOIN d ON d.condition_index = p.condition_index"
        g = f"SELECT *, CASE WHEN pos THEN 1 / (1 + exp(u)) ELSE CAST(1 AS DOUBLE) END AS f FROM ({f})"
        e = f"SELECT *, CASE WHEN pos THEN f * (1 - f) * hill ELSE 0 END AS a, CASE WHEN pos THEN -f * (1 - f) * u ELSE 0 END AS b FROM ({g})"
        cov = ", ".join(f"covar_pop({p[0]}, {p[1]}) AS {p}" for p in ("fr", "aa", "ab", "bb", "af", "bf", "ar", "br"))
        s = f"SELECT {keys}, count(*) AS n, avg(f) AS mf, avg(r) AS mr, var_pop(f) AS ff, var_pop(r) AS rr, {cov} FROM ({e}) GROUP BY {keys}"
        w = f"SELECT *, CASE WHEN ff > 1e-15 THEN fr / ff ELSE 0 END AS slope FROM ({s})"
        less = lambda p, q: f"slope * slope * CASE WHEN ff > 1e-15 THEN {p}{q} - {p}f * {q}f / ff ELSE 0 END AS p{p}{q}"
        return f"SELECT {keys}, slope, mr - slope * mf AS bottom, greatest(0, n * (rr - slope * fr)) AS sse, {less('a', 'a')}, {less('a', 'b')}, {less('b', 'b')}, slope * (ar - slope * af) AS par, slope * (br - slope * bf) AS pbr FROM ({w})"

    out = [
        "d AS MATERIALIZED (SELECT condition_index, concentration AS dose, round(quantile_cont(relative_area, 0.5), 9) AS y FROM dosed WHERE relative_area IS NOT NULL AND concentration IS NOT NULL GROUP BY ALL)",
        f"g AS (SELECT condition_index, count(DISTINCT dose) >= 4 AND count(DISTINCT dose) FILTER (dose > 0) >= 3 AND max(y) > min(y) AS usable, ln(min(dose) FILTER (dose > 0)) - {ten} * {R.DECADES} AS lo, ln(max(dose) FILTER (dose > 0)) + {ten} * {R.DECADES} AS hi FROM d GROUP BY 1)",
        f"grid AS (SELECT condition_index, lo, hi, i, lo + (hi - lo) * (i // {n}) / {n - 1} AS m, {low} + ({high} - {low}) * (i % {n}) / {n - 1} AS h FROM g, range({n * n}) AS r(i) WHERE usable)",
        f"at0 AS MATERIALIZED (SELECT condition_index, lo, hi, {', '.join(parts)}, CAST(0.01 AS DOUBLE) AS lam FROM (SELECT *, row_number() OVER (PARTITION BY condition_index ORDER BY round(sse, 9), i) AS k FROM ({sums('grid', 'condition_index, lo, hi, i, m, h')})) WHERE k = 1)",
    ]
    for k in range(rounds):
        det = "(paa * (1 + lam) * (pbb * (1 + lam)) - pab * pab)"
        dm, dh = f"(par * (pbb * (1 + lam)) - pbr * pab) / {det}", f"(pbr * (paa * (1 + lam)) - par * pab) / {det}"
        out.append(f"try{k} AS (SELECT condition_index, CASE WHEN {det} > 1e-300 THEN least(hi, greatest(lo, m + {dm})) ELSE m END AS m, CASE WHEN {det} > 1e-300 THEN least({high}, greatest({low}, h + {dh})) ELSE h END AS h FROM at{k})")
        taken = ", ".join(f"CASE WHEN t.sse < o.sse THEN t.{x} ELSE o.{x} END AS {x}" for x in parts)
        out.append(f"at{k + 1} AS MATERIALIZED (SELECT o.condition_index, lo, hi, {taken}, CASE WHEN t.sse < o.sse THEN lam / 10 ELSE lam * 10 END AS lam FROM at{k} o JOIN ({sums(f'try{k}', 'condition_index, m, h')}) t ON t.condition_index = o.condition_index)")
    return ", ".join(out)


#: Doses that follow each well: its condition's wells in six steps, the first without any.
DOSES = "CASE WHEN well % 6 = 0 THEN 0 ELSE pow(3, well % 6) END"
_dosed = f"dosed AS (SELECT condition_index, CAST({DOSES.replace('well', 'CAST(substr(key, 2) AS BIGINT)')} AS DOUBLE) AS concentration, relative_area FROM final)"


@query("ag_27", METRICS + f""", {_dosed}, {dose_fit_sql()} SELECT g.condition_index, round(exp(m), 3) AS midpoint, round(exp(h), 3) AS hill, round(bottom, 4) AS bottom, round(bottom + slope, 4) AS top, round(sse, 6) AS sse,
CASE WHEN NOT usable THEN '{R.NOTE_NO_FIT}' END AS fit_error FROM g LEFT JOIN at16 ON at16.condition_index = g.condition_index""", "v_tracking")
def ag_27(t: Tables) -> DataFrame:
    well = F.substring("well_index", F.lit(2), F.lit(20)).cast("long") % 6
    final = R.final_rows(metrics(t)).withColumn("concentration", F.when(well == 0, 0.0).otherwise(F.pow(F.lit(3.0), well)))
    doses = R.quartiles(final, ["condition_index", "concentration"], "relative_area")
    fit = R.dose_fit(doses.select("condition_index", F.col("concentration").alias("dose"), F.round("median", 9).alias("response")), ["condition_index"])
    digits = {"midpoint": 3, "hill": 3, "bottom": 4, "top": 4, "sse": 6}
    return fit.withColumns({k: F.round(k, n) for k, n in digits.items()})


@query("wn_08", METRICS + "SELECT condition, key AS well_index, round(percent_change, 6) AS percent_change, row_number() OVER (PARTITION BY condition ORDER BY percent_change, key) AS waterfall_rank FROM final WHERE percent_change IS NOT NULL", "v_tracking")
def wn_08(t: Tables) -> DataFrame:
    known = R.final_rows(metrics(t)).where("percent_change IS NOT NULL").select("condition", "well_index", "percent_change")
    return IO.ranked(known, ["percent_change", "well_index"], "waterfall_rank", ["condition"]).withColumn("percent_change", r6("percent_change"))


@query("wn_09", METRICS + """SELECT timepoint_index, condition, key AS well_index, round(percent_change, 6) AS percent_change,
round(row_number() OVER (PARTITION BY timepoint_index, condition ORDER BY percent_change, key) / CAST(count(*) OVER (PARTITION BY timepoint_index, condition) AS DOUBLE), 6) AS ecdf FROM m WHERE percent_change IS NOT NULL""", "v_tracking")
def wn_09(t: Tables) -> DataFrame:
    known = metrics(t).where("percent_change IS NOT NULL").select("timepoint_index", "condition", "well_index", "percent_change")
    sizes = known.groupBy("timepoint_index", "condition").agg(F.count("*").alias("n"))
    placed = IO.ranked(known, ["percent_change", "well_index"], "k", ["timepoint_index", "condition"]).join(sizes, ["timepoint_index", "condition"])
    return placed.select("timepoint_index", "condition", "well_index", r6("percent_change"), r6(F.col("k") / F.col("n"), "ecdf"))


@query("wn_10", METRICS + f"SELECT condition, {QUART.format('percent_change')}, round(min(percent_change), 6) AS low, round(max(percent_change), 6) AS high FROM final WHERE percent_change IS NOT NULL GROUP BY ALL", "v_tracking")
def wn_10(t: Tables) -> DataFrame:
    known = R.final_rows(metrics(t)).where("percent_change IS NOT NULL")
    ends = known.groupBy("condition").agg(r6(F.min("percent_change"), "low"), r6(F.max("percent_change"), "high"))
    return rounded(R.quartiles(known, ["condition"], "percent_change"), "median", "q25", "q75", "mean").join(ends, "condition")


@query("wn_11", METRICS + """, cells AS (SELECT condition, key, timepoint_index, first(relative_area) AS v FROM m WHERE relative_area IS NOT NULL GROUP BY ALL),
wide AS (SELECT condition, key AS well_index, """ + ", ".join(f"round(max(CASE WHEN timepoint_index = {k} THEN v END), 6) AS t{k}" for k in range(1, 7)) + """ FROM cells GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY condition ORDER BY CASE (SELECT max(timepoint_index) FROM cells c WHERE c.condition = wide.condition) WHEN 6 THEN t6 WHEN 5 THEN t5 WHEN 4 THEN t4 WHEN 3 THEN t3 WHEN 2 THEN t2 ELSE t1 END ASC NULLS LAST, well_index) AS sort_rank FROM wide""", "v_tracking")
def wn_11(t: Tables) -> DataFrame:
    known = metrics(t).where("relative_area IS NOT NULL")
    wide = known.groupBy("condition", "well_index").pivot("timepoint_index", list(range(1, 7))).agg(F.round(F.first("relative_area", ignorenulls=True), 6))
    wide = wide.withColumnsRenamed({str(k): f"t{k}" for k in range(1, 7)})
    # A condition's rows are in order of its last column, those without a value there last.
    last = known.groupBy("condition").agg(F.max("timepoint_index").alias("_last"))
    value = reduce(lambda out, k: F.when(F.col("_last") == k, F.col(f"t{k}")).otherwise(out), range(1, 7), F.lit(None).cast("double"))
    rows = wide.join(last, "condition").withColumn("_v", value).withColumn("_none", F.col("_v").isNull()).drop("_last")
    return IO.ranked(rows, ["_none", "_v", "well_index"], "sort_rank", ["condition"]).drop("_v", "_none")


@query("jn_03", METRICS + ", f AS (SELECT DISTINCT condition_index, key, baseline_area FROM m) SELECT m.key AS well_index, m.timepoint_index, round(f.baseline_area, 6) AS baseline_area FROM m LEFT JOIN f ON m.condition_index = f.condition_index AND m.key = f.key", "v_tracking")
def jn_03(t: Tables) -> DataFrame:
    from gridlume.operators.joins import many_to_one

    rows = R.trajectory_safe(t.tracking)
    first = metrics(t).select("condition_index", "well_index", "baseline_area").distinct()
    return many_to_one(rows, first, ["condition_index", "well_index"]).select("well_index", "timepoint_index", r6("baseline_area"))


DIMS = """, dose AS (SELECT condition_index, first(concentration ORDER BY timepoint_index, trajectory_id) FILTER (concentration IS NOT NULL) AS concentration FROM v_tracking GROUP BY 1),
tp AS (SELECT timepoint_index, coalesce(first(elapsed_time ORDER BY condition_index, trajectory_id) FILTER (elapsed_time IS NOT NULL), timepoint_index - (SELECT min(timepoint_index) FROM v_tracking)) AS elapsed_time FROM v_tracking GROUP BY 1)
"""


@query("jn_22", METRICS + DIMS + "SELECT * FROM (SELECT 'condition' AS dim, condition_index AS idx, concentration AS value FROM dose UNION ALL SELECT 'timepoint', timepoint_index, elapsed_time FROM tp)", "v_tracking")
def jn_22(t: Tables) -> DataFrame:
    from gridlume.operators.joins import dimension_defaults

    dose, time = dimension_defaults(t.tracking)
    return dose.select(F.lit("condition").alias("dim"), F.col("condition_index").alias("idx"), F.col("concentration").alias("value")).union(time.select(F.lit("timepoint"), "timepoint_index", "elapsed_time"))


@query("jn_04", METRICS + DIMS + "SELECT t.trajectory_id, t.timepoint_index, dose.concentration, tp.elapsed_time FROM v_tracking t LEFT JOIN dose USING (condition_index) LEFT JOIN tp ON t.timepoint_index = tp.timepoint_index", "v_tracking")
def jn_04(t: Tables) -> DataFrame:
    from gridlume.operators.joins import attach_metadata, dimension_defaults

    return attach_metadata(t.tracking, *dimension_defaults(t.tracking)).select("trajectory_id", "timepoint_index", "concentration", "elapsed_time")

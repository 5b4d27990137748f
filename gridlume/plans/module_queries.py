"""Queries of incremental work and of the module registry."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlume.operators import response as R
from gridlume.operators.lineage import shared_dir, stage
from gridlume.plans.registry import query
from gridlume.plans.response_queries import METRICS, metrics
from gridlume.plans.views import Tables
from gridlume.streaming import incremental, resumable

c = F.col


_areas = "SELECT well_id, {n} AS attempt, round(pi() * radius_px * radius_px, 6) AS area FROM v_points"


@query("st_01", f"SELECT 'resumed' AS state, * FROM ({_areas.format(n='CASE WHEN well_id % 4 < 2 THEN 1 ELSE 2 END')}) UNION ALL SELECT 'changed', * FROM ({_areas.format(n='3')})", "v_points")
def st_01(t: Tables) -> DataFrame:
    """A job over all wells that stops after two of four batches and is run again; then the source's fingerprint changes."""
    root = f"{shared_dir(t.spark)}/resumed-{uuid.uuid4().hex}"

    def run(attempt: int, fingerprint: str, stop_after: int = 4) -> DataFrame:
        begun = []

        def areas(wells: DataFrame) -> DataFrame:
            begun.append(wells)
            if len(begun) > stop_after:
                raise InterruptedError
            return wells.select("well_id", F.lit(attempt).alias("attempt"), F.round(F.pi() * c("radius_px") * c("radius_px"), 6).alias("area"))

        return resumable.resume(t.spark, root, t.points, ["well_id"], {"fingerprint": fingerprint, "version": 2}, areas, 4, F.pmod("well_id", F.lit(4)))

    try:
        run(1, "f1", stop_after=2)
    except InterruptedError:
        pass
    resumed = stage(run(2, "f1", stop_after=9).select(F.lit("resumed").alias("state"), "*"), "resumed")
    changed = run(3, "f2", stop_after=9).select(F.lit("changed").alias("state"), "*")
    return resumed.union(changed)


@query("st_02", "SELECT event_id, user_id FROM events")
def st_02(t: Tables) -> DataFrame:
    e = t.table("events").select("event_id", "user_id", c("ts").cast("timestamp").alias("ts"))
    return incremental.appended(e.union(e.where("event_id % 4 = 0")), "event_id", "ts").select("event_id", "user_id")


@query("st_03", "SELECT 'events' AS source, 'complete' AS status, count(*) AS rows, '' AS error FROM events UNION ALL SELECT 'orders', 'complete', count(*), '' FROM orders UNION ALL SELECT 'not_there', 'error', NULL, 'AnalysisException'")
def st_03(t: Tables) -> DataFrame:
    return incremental.isolated(t.spark, ["events", "orders", "not_there"], lambda name: t.table(name).count())


NO_BASELINE, NO_CHANGE = "No wells had a positive baseline area.", "No wells had a known change."


def rows_or_skip(df: DataFrame, reason: str) -> tuple[str, int, str]:
    n = df.count()
    return ("complete", n, "") if n else ("skipped", n, reason)


def growth(m: DataFrame, settings: dict) -> tuple[str, int, str]:
    """Quartiles over time; without usable doses only partial."""
    status, n, reason = rows_or_skip(R.quartiles(m.where("baseline_area > 0"), ["condition", "timepoint_index"], "relative_area"), NO_BASELINE)
    if n and R.final_rows(m).where("concentration IS NOT NULL AND relative_area IS NOT NULL").isEmpty():
        return "partial", n, "No usable concentrations were supplied."
    return status, n, reason


def classification(m: DataFrame, settings: dict) -> tuple[str, int, str]:
    if not {"responder_max", "resistant_min"} <= settings.keys():
        return "skipped", 0, "Responder and resistant thresholds were not supplied."
    classed = R.final_rows(m).withColumn("response_class", R.responder_class(c("percent_change"), settings["responder_max"], settings["resistant_min"]))
    return rows_or_skip(R.class_shares(classed.where("response_class IS NOT NULL")), NO_CHANGE)


#: Each module gives its status, its rows and a reason.
MODULES: dict[str, Callable[[DataFrame, dict], tuple[str, int, str]]] = {
    "growth": growth,
    "waterfall": lambda m, s: rows_or_skip(R.final_rows(m).where("percent_change IS NOT NULL"), NO_CHANGE),
    "heatmap": lambda m, s: rows_or_skip(m.where("relative_area IS NOT NULL").select("condition", "well_index").distinct(), NO_BASELINE),
    "distributions": lambda m, s: rows_or_skip(m.where("percent_change IS NOT NULL"), NO_CHANGE),
    "classification": classification,
    "foci": lambda m, s: rows_or_skip(R.spearman(m, ["condition", "timepoint_index"], "focus_count", "percent_change"), "No wells had foci and a change."),
}


def run_modules(tracking: DataFrame, names: list[str], settings: dict | None = None, modules: dict[str, Callable] = MODULES) -> DataFrame:
    """UX-01, QC-09: the chosen modules on one enriched table, with what became of each: complete, partial, skipped or error.

    A module that fails is recorded with its error's text, and the others go on; one that isn't known is skipped.
    """
    rows = []
    for name in names:
        try:
            rows.append((name, *(modules[name](tracking, settings or {}) if name in modules else ("skipped", 0, "Unknown analysis module."))))
        except Exception as error:  # recorded, not hidden
            rows.append((name, "error", None, str(error)))
    return tracking.sparkSession.createDataFrame(rows, "module string, status string, rows long, reason string")


def absent(m: DataFrame, settings: dict) -> tuple[str, int, str]:
    return rows_or_skip(R.require(m, "absent"), NO_CHANGE)


_growth = "SELECT 'growth' AS module, 'complete' AS status, count(*) AS rows, '' AS reason FROM (SELECT DISTINCT condition, timepoint_index FROM m WHERE baseline_area > 0 AND relative_area IS NOT NULL)"
_waterfall = "SELECT 'waterfall', 'complete', count(*), '' FROM final WHERE percent_change IS NOT NULL"


@query("qc_09", METRICS + f"""{_growth} UNION ALL {_waterfall} UNION ALL SELECT 'nothing', 'skipped', 0, 'Unknown analysis module.'
UNION ALL SELECT 'classification', 'skipped', 0, 'Responder and resistant thresholds were not supplied.' UNION ALL SELECT 'broken', 'error', NULL, 'Missing required longitudinal columns: absent'
UNION ALL SELECT 'undosed', 'partial', count(*), 'No usable concentrations were supplied.' FROM (SELECT DISTINCT condition, timepoint_index FROM m WHERE baseline_area > 0 AND relative_area IS NOT NULL)""", "v_tracking")
def qc_09(t: Tables) -> DataFrame:
    undosed = lambda m, s: growth(m.withColumn("concentration", F.lit(None).cast("double")), s)
    return run_modules(stage(metrics(t), "metrics"), ["growth", "broken", "waterfall", "nothing", "classification", "undosed"], modules=MODULES | {"broken": absent, "undosed": undosed})


@query("ux_01", METRICS + f"""{_growth} UNION ALL {_waterfall}
UNION ALL SELECT 'heatmap', 'complete', count(*), '' FROM (SELECT DISTINCT condition, key FROM m WHERE relative_area IS NOT NULL)
UNION ALL SELECT 'distributions', 'complete', count(*), '' FROM m WHERE percent_change IS NOT NULL
UNION ALL SELECT 'classification', 'complete', 3 * count(DISTINCT condition), '' FROM final WHERE percent_change IS NOT NULL
UNION ALL SELECT 'foci', 'complete', count(*), '' FROM (SELECT DISTINCT condition, timepoint_index FROM m WHERE focus_count IS NOT NULL AND percent_change IS NOT NULL)""", "v_tracking")
def ux_01(t: Tables) -> DataFrame:
    return run_modules(stage(metrics(t), "metrics"), list(MODULES), {"responder_max": -30.0, "resistant_min": 20.0})

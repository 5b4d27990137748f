"""Queries of joins, aggregations, ordered operators, samples, set operations and QC."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlume.operators import joins as J
from gridlume.operators import spatial as G
from gridlume.operators import summaries as A
from gridlume.operators.lineage import stage
from gridlume.operators.ordered import borderline, clusters, nearest_centre, numbered, spread_sample
from gridlume.plans.registry import query
from gridlume.plans.views import Tables
from gridlume.sources.tables import ranked

c = F.col
P = F.lit


def r6(column, name: str):
    return F.round(column, 6).alias(name)


def pts(df: DataFrame) -> DataFrame:
    return df.select(c("well_id").alias("id"), c("x_px").cast("double").alias("x"), c("y_px").cast("double").alias("y"))


# ---- joins


@query("jn_01", """WITH l AS (SELECT * FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1)
SELECT e.event_id, l.event_type AS first_type, round(l.value, 6) AS first_value FROM events e LEFT JOIN l ON e.user_id = l.user_id""")
def jn_01(t: Tables) -> DataFrame:
    e = t.table("events")
    right = e.select("user_id", "ts", c("event_id").alias("_e"), c("event_type").alias("first_type"), c("value").alias("first_value"))
    return J.lookup(e.select("event_id", "user_id"), right, ["user_id"], ["ts", "_e"]).select("event_id", "first_type", r6("first_value", "first_value"))


@query("jn_02", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def jn_02(t: Tables) -> DataFrame:
    return t.table("orders").join(t.table("customer"), c("o_custkey") == c("c_custkey"), "left").select("o_orderkey", "c_name")


@query("jn_05", "SELECT object_id FROM v_object_points WHERE object_id % 1500 IN (SELECT well_id FROM v_points)", "v_object_points", "v_points")
def jn_05(t: Tables) -> DataFrame:
    return t.object_points.withColumn("well_id", c("object_id") % 1500).join(t.points, "well_id", "left_semi").select("object_id")


@query("jn_06", "SELECT object_id FROM v_object_points WHERE object_id % 1500 NOT IN (SELECT well_id FROM v_points)", "v_object_points", "v_points")
def jn_06(t: Tables) -> DataFrame:
    return t.object_points.withColumn("well_id", c("object_id") % 1500).join(t.points, "well_id", "left_anti").select("object_id")


@query("jn_07", "SELECT object_id, well_id, round(sqrt((o.x_px - w.x_px) * (o.x_px - w.x_px) + (o.y_px - w.y_px) * (o.y_px - w.y_px)), 6) AS d FROM v_object_points o JOIN v_points_raw w ON (o.x_px - w.x_px) * (o.x_px - w.x_px) + (o.y_px - w.y_px) * (o.y_px - w.y_px) <= pow(w.radius_px * CAST(0.86 AS DOUBLE), 2)", "v_object_points", "v_points_raw")
def jn_07(t: Tables) -> DataFrame:
    return G.circle_join(t.object_points, t.points_raw).select("object_id", "well_id", r6(F.sqrt("d2"), "d"))


NEAR = "(SELECT o.object_id, w.well_id, sqrt(CAST((o.x_px - w.x_px) * (o.x_px - w.x_px) + (o.y_px - w.y_px) * (o.y_px - w.y_px) AS DOUBLE)) AS d, w.radius_px FROM v_object_points o, v_points w WHERE abs(o.x_px - w.x_px) <= 2000 AND o.object_id % 5 = 0)"


@query("jn_08", f"SELECT object_id, CASE WHEN d <= CAST(1.2 AS DOUBLE) * radius_px THEN well_id END AS well_id, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY d, well_id) AS k FROM {NEAR.replace(' AND o.object_id % 5 = 0', '')}) WHERE k = 1", "v_object_points", "v_points")
def jn_08(t: Tables) -> DataFrame:
    o = t.object_points.select(c("object_id"), c("x_px"), c("y_px"))
    near = G.nearest(o, pts(t.points), 1, 64.0)
    wells = t.points.select(c("well_id").alias("b_id"), "radius_px")
    return near.join(wells, "b_id").select(c("a_id").alias("object_id"), F.when(c("d") <= 1.2 * c("radius_px"), c("b_id")).alias("well_id"), r6("d", "d"))


DIST = "sqrt(CAST((a.x_px - b.x_px) * (a.x_px - b.x_px) + (a.y_px - b.y_px) * (a.y_px - b.y_px) AS DOUBLE))"


@query("jn_09", f"SELECT a_id, b_id, round(d, 6) AS d, CAST(k AS INT) AS rank FROM (SELECT a.well_id AS a_id, b.well_id AS b_id, {DIST} AS d, row_number() OVER (PARTITION BY a.well_id ORDER BY {DIST}, b.well_id) AS k FROM v_points a, v_points b WHERE a.well_id <> b.well_id) WHERE k <= 12", "v_points")
def jn_09(t: Tables) -> DataFrame:
    return G.nearest(pts(t.points), pts(t.points), 12, 128.0, same=True).select("a_id", "b_id", r6("d", "d"), "rank")


EDGES = f"edges AS (SELECT a.well_id AS a_id, b.well_id AS b_id, a.x_px AS ax, a.y_px AS ay, b.x_px AS bx, b.y_px AS b_y, {DIST} AS d FROM v_points a JOIN v_points b ON a.well_id < b.well_id AND {DIST} BETWEEN CAST(0.78 AS DOUBLE) * 60 AND CAST(1.22 AS DOUBLE) * 60)"


@query("jn_10", f"WITH {EDGES} SELECT a_id, b_id, round(d, 6) AS d FROM edges", "v_points")
def jn_10(t: Tables) -> DataFrame:
    return G.annulus_edges(pts(t.points), 60.0).select("a_id", "b_id", r6("d", "d"))


#: The affine of the second time point (fixed values of the view).
MATRIX = (1.079342, -0.037691, 42.0, 0.037691, 1.079342, 18.0)
MOVED = "moved AS (SELECT well_id, CAST(1.079342 AS DOUBLE) * x_px - CAST(0.037691 AS DOUBLE) * y_px + 42 AS x, CAST(0.037691 AS DOUBLE) * x_px + CAST(1.079342 AS DOUBLE) * y_px + 18 AS y FROM v_points)"
MATCH = MOVED + """, pairs AS (SELECT m.well_id AS a_id, f.well_id AS b_id, round(sqrt((m.x - f.x_px) * (m.x - f.x_px) + (m.y - f.y_px) * (m.y - f.y_px)), 9) AS d FROM moved m, v_points_t2 f),
there AS (SELECT a_id, b_id, d FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY d, b_id) AS k FROM pairs) WHERE k = 1),
back AS (SELECT a_id AS back, b_id FROM (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY d, a_id) AS k FROM pairs) WHERE k = 1),
mm AS (SELECT a_id, t.b_id, d, back = a_id AS mutual FROM there t JOIN back USING (b_id))"""


def matches(t: Tables) -> DataFrame:
    x, y = G.affine(c("x_px"), c("y_px"), MATRIX)
    base = t.points.select("well_id", x.alias("x"), y.alias("y"))
    return G.mutual_nearest(base, t.points_t2.select("well_id", "x_px", "y_px"))


@query("jn_11", f"WITH {MATCH} SELECT a_id, b_id, round(d, 6) AS d, mutual, mutual AND d <= CAST(0.35 AS DOUBLE) * 60 AS confident FROM mm", "v_points", "v_points_t2")
def jn_11(t: Tables) -> DataFrame:
    return matches(t).select("a_id", "b_id", r6("d", "d"), "mutual", (c("mutual") & (c("d") <= 0.35 * 60)).alias("confident"))


@query("jn_12", f"WITH {MATCH} SELECT a_id, b_id, round(d * CAST(0.65 AS DOUBLE), 6) AS error_um FROM mm WHERE mutual", "v_points", "v_points_t2")
def jn_12(t: Tables) -> DataFrame:
    return matches(t).where("mutual").orderBy("d", "a_id").select("a_id", "b_id", r6(c("d") * 0.65, "error_um"))


@query("jn_14", """WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT q.vec_id AS left_id, e.vec_id AS right_id, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: CAST(z[1] - z[2] AS DOUBLE) * CAST(z[1] - z[2] AS DOUBLE))), 9) AS d2 FROM q, embeddings e WHERE e.vec_id <> q.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY d2, right_id) AS k FROM d)
SELECT a.left_id, a.right_id, round(sqrt(a.d2), 5) AS d, sqrt(a.d2) < CAST(0.75 AS DOUBLE) * sqrt(b.d2) AS accepted FROM k a JOIN k b ON a.left_id = b.left_id AND a.k = 1 AND b.k = 2""")
def jn_14(t: Tables) -> DataFrame:
    e = t.table("embeddings").select("vec_id", "embedding")
    two = G.blocked_two_nearest(e.where("vec_id % 20 = 0"), e, same=True)
    best = two.groupBy("left_id").agg(F.min_by("right_id", "rank").alias("right_id"), F.min_by("d", "rank").alias("d"), F.max_by("d", "rank").alias("next"), F.count("*").alias("n")).where("n = 2")
    return best.select("left_id", "right_id", F.round("d", 5).alias("d"), (c("d") < 0.75 * c("next")).alias("accepted"))


@query("jn_15", "WITH a AS (SELECT DISTINCT image_series AS k FROM v_tracking WHERE timepoint_index = 1 AND image_series <> 3), b AS (SELECT DISTINCT image_series AS k FROM v_tracking WHERE timepoint_index = 2 AND image_series <> 5) SELECT coalesce(a.k, b.k) AS image_series, CASE WHEN a.k IS NULL THEN 'no_baseline' WHEN b.k IS NULL THEN 'no_followup' ELSE 'both' END AS status FROM a FULL JOIN b ON a.k = b.k", "v_tracking")
def jn_15(t: Tables) -> DataFrame:
    x = t.tracking
    return J.shared_keys(x.where("timepoint_index = 1 AND image_series <> 3"), x.where("timepoint_index = 2 AND image_series <> 5"), "image_series")


@query("jn_16", f"WITH {MATCH} SELECT a_id, b_id, coalesce(p.o_totalprice, 0)::DOUBLE AS base_area, coalesce(q.o_totalprice, 0)::DOUBLE AS follow_area FROM mm LEFT JOIN orders p ON p.o_orderkey = a_id LEFT JOIN orders q ON q.o_orderkey = b_id - 500000 WHERE mutual", "v_points", "v_points_t2")
def jn_16(t: Tables) -> DataFrame:
    areas = t.object_points.select(c("object_id").alias("id"), "area_px2")
    pairs = matches(t).where("mutual").select("a_id", "b_id", (c("b_id") - 500000).alias("f_id"))
    return J.matched_values(pairs, areas, "id", "area_px2", {"base_area": "a_id", "follow_area": "f_id"}).select("a_id", "b_id", "base_area", "follow_area")


@query("jn_17", "WITH s AS (SELECT s_suppkey, s_nationkey, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier), n AS (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) AS k, count(*) OVER () AS m FROM nation WHERE n_nationkey % 2 = 0) SELECT s.s_suppkey, coalesce(a.n_nationkey, b.n_nationkey) AS field FROM s LEFT JOIN n a ON a.n_nationkey = s.s_nationkey LEFT JOIN n b ON b.k = least(s.k, b.m)")
def jn_17(t: Tables) -> DataFrame:
    s = ranked(t.table("supplier").select("s_suppkey", "s_nationkey"), ["s_suppkey"], "k")
    n = t.table("nation").where("n_nationkey % 2 = 0").select("n_nationkey")
    own = Window.orderBy("n_nationkey")  # a dimension of fixed size
    by_place = n.select(F.row_number().over(own).cast("long").alias("k"), c("n_nationkey").alias("by_place"))
    most = n.count()
    return s.withColumn("k", F.least("k", P(most))).join(n.withColumn("s_nationkey", c("n_nationkey")), "s_nationkey", "left").join(by_place, "k", "left").select("s_suppkey", F.coalesce("n_nationkey", "by_place").alias("field"))


@query("jn_18", "SELECT w.well_id, w.n, round(s.score, 6) AS score FROM (SELECT well_id, count(*) AS n FROM v_candidates GROUP BY 1) w JOIN (SELECT well_id, min(wall_score) AS score FROM v_candidates GROUP BY 1) s USING (well_id) WHERE s.score <= CAST(0.337 AS DOUBLE)", "v_candidates")
def jn_18(t: Tables) -> DataFrame:
    n = t.candidates.groupBy("well_id").agg(F.count("*").alias("n"))
    score = t.candidates.groupBy("well_id").agg(F.min("wall_score").alias("score"))
    return n.join(score, "well_id").where(c("score") <= 0.337).select("well_id", "n", r6("score", "score"))


@query("jn_19", "SELECT condition, timepoint, CAST(f AS INT) AS field FROM (SELECT DISTINCT condition FROM v_tracking), (SELECT DISTINCT timepoint FROM v_tracking), range(1, 4) AS r(f)", "v_tracking")
def jn_19(t: Tables) -> DataFrame:
    d = lambda k: t.tracking.select(k).distinct()
    return J.design_grid(d("condition"), d("timepoint"), 3)


@query("jn_20", "SELECT e.event_id, t.timepoint, t.condition FROM (SELECT event_id, user_id, CAST(floor((day(ts) - 1) / 6) + 1 AS INT) AS k FROM events) e JOIN v_tracking t ON t.trajectory_id = 'T' || e.user_id::VARCHAR AND t.timepoint_index = e.k", "v_tracking")
def jn_20(t: Tables) -> DataFrame:
    rows = t.table("events").select("event_id", F.concat(P("T"), c("user_id").cast("string")).alias("trajectory_id"), (F.floor((F.dayofmonth("ts") - 1) / 6) + 1).cast("int").alias("timepoint_index"))
    attributes = t.tracking.select("trajectory_id", "timepoint_index", "timepoint", "condition")
    return rows.join(attributes, ["trajectory_id", "timepoint_index"]).select("event_id", "timepoint", "condition")


@query("jn_21", "SELECT o.object_id, o.object_id % 1500 AS well_id, w.radius_px, CASE WHEN w.well_id IS NULL THEN '' ELSE 'crops/well_' || w.well_id::VARCHAR || '.png' END AS crop FROM v_object_points o LEFT JOIN v_points w ON w.well_id = o.object_id % 1500", "v_object_points", "v_points")
def jn_21(t: Tables) -> DataFrame:
    wells = t.points.select("well_id", "radius_px", F.concat(P("crops/well_"), c("well_id").cast("string"), P(".png")).alias("crop"))
    return t.object_points.select("object_id", (c("object_id") % 1500).alias("well_id")).join(wells, "well_id", "left").select("object_id", "well_id", "radius_px", F.coalesce("crop", P("")).alias("crop"))


# ---- aggregations


@query("ag_01", "SELECT image_series, timepoint_index, count(*) AS wells, count(*) FILTER (WHERE object_count > 0) AS object_wells, CAST(sum(object_count) AS BIGINT) AS objects, CAST(sum(focus_count) AS BIGINT) AS foci, 0.65::DOUBLE AS um_per_pixel FROM v_tracking GROUP BY ALL", "v_tracking")
def ag_01(t: Tables) -> DataFrame:
    return A.image_summary(t.tracking.withColumn("um_per_pixel", P(0.65)), ["image_series", "timepoint_index"]).withColumn("um_per_pixel", F.round("um_per_pixel", 6))


DIAM = "2 * sqrt(area_px2 / pi()) * CAST(0.65 AS DOUBLE)"
SPREAD = "count(v) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(CASE WHEN count(v) = 1 THEN 0 ELSE stddev_samp(v) END, 6) AS sd, round(min(v), 6) AS low, round(max(v), 6) AS high"


@query("ag_02", f"SELECT well_observation_id, {SPREAD} FROM (SELECT well_observation_id, {DIAM} AS v FROM v_objects) GROUP BY 1", "v_objects")
def ag_02(t: Tables) -> DataFrame:
    from gridlume.functions.scalar import equivalent_diameter

    d = t.objects.withColumn("v", equivalent_diameter(c("area_px2"), P(0.65)))
    out = d.groupBy("well_observation_id").agg(*A.spread("v"))
    return out.withColumns({k: F.round(k, 6) for k in ("mean", "median", "sd", "low", "high")})


@query("ag_03", "SELECT CAST(sum(focus_count) AS BIGINT) AS all_wells, CAST(sum(focus_count) FILTER (object_count > 3) AS BIGINT) AS object_wells FROM (SELECT focus_count, object_count FROM v_tracking)", "v_tracking")
def ag_03(t: Tables) -> DataFrame:
    return A.foci_totals(t.tracking.withColumn("object_count", c("object_count") - 3))


@query("ag_04", "SELECT objects, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM (SELECT well_observation_id, count(*) AS objects FROM v_objects GROUP BY 1) GROUP BY 1", "v_objects")
def ag_04(t: Tables) -> DataFrame:
    per = t.objects.groupBy("well_observation_id").agg(F.count("*").alias("objects"))
    return A.frequencies(per, "objects").withColumn("percent", F.round("percent", 6))


@query("ag_05", f"SELECT o_orderkey AS well_id, round(avg({DIAM}), 6) AS mean_diameter_um, round(max({DIAM}), 6) AS max_diameter_um, round(coalesce(sum(area_px2 * 0.4225::DOUBLE), 0), 6) AS total_area_um2 FROM orders LEFT JOIN v_objects ON well_observation_id = o_orderkey AND area_px2 > 40000 GROUP BY 1", "v_objects")
def ag_05(t: Tables) -> DataFrame:
    from gridlume.functions.scalar import equivalent_diameter

    objects = t.objects.where("area_px2 > 40000").select(c("well_observation_id").alias("well_id"), equivalent_diameter(c("area_px2"), P(0.65)).alias("diameter_um"), (c("area_px2") * 0.4225).alias("area_um2"))
    wells = t.table("orders").select(c("o_orderkey").alias("well_id"))
    return A.roll_up(wells, objects, "well_id").select("well_id", r6("mean_diameter_um", "mean_diameter_um"), r6("max_diameter_um", "max_diameter_um"), r6("total_area_um2", "total_area_um2"))


@query("ag_06", "SELECT condition, timepoint, count(*) AS wells, round(100.0::DOUBLE * count(*) FILTER (WHERE object_count > 2) / count(*), 6) AS occupancy_percent, round(avg(focus_count) FILTER (object_count > 2), 6) AS mean_foci FROM v_tracking GROUP BY ALL", "v_tracking")
def ag_06(t: Tables) -> DataFrame:
    out = A.condition_summary(t.tracking.withColumn("object_count", c("object_count") - 2), ["condition", "timepoint"])
    return out.withColumns({k: F.round(k, 6) for k in ("occupancy_percent", "mean_foci")})


STATUS = """CASE WHEN (centroid_fraction > CAST(1.05 AS DOUBLE) AND inside_fraction < CAST(0.50 AS DOUBLE)) OR (centroid_fraction > CAST(0.60 AS DOUBLE) AND inside_fraction < CAST(0.75 AS DOUBLE) AND wall_fraction >= CAST(0.35 AS DOUBLE)) THEN 'outside_well'
WHEN (centroid_fraction > CAST(0.65 AS DOUBLE) AND inside_fraction < CAST(0.88 AS DOUBLE)) OR (centroid_fraction > CAST(0.75 AS DOUBLE) AND wall_fraction >= CAST(0.25 AS DOUBLE)) THEN 'ambiguous' ELSE 'accepted' END"""


def assessed(t: Tables) -> DataFrame:
    return t.candidates.withColumn("membership_status", A.membership(c("centroid_fraction"), c("inside_fraction"), c("wall_fraction")))


@query("ag_07", f"""WITH s AS (SELECT well_id % 10 AS image_id, well_id, {STATUS} AS st, wall_score <= CAST(0.337 AS DOUBLE) AS bad FROM v_candidates)
SELECT image_id, well_id, CAST(CASE WHEN image_id IS NULL THEN 3 WHEN well_id IS NULL THEN 1 ELSE 0 END AS BIGINT) AS level, count(*) FILTER (WHERE st = 'accepted') AS accepted, count(*) FILTER (WHERE st = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE st = 'outside_well') AS outside_well, count(DISTINCT CASE WHEN bad THEN well_id END) AS false_wells
FROM s GROUP BY GROUPING SETS ((), (image_id), (image_id, well_id))""".replace("count(DISTINCT CASE WHEN bad THEN well_id END)", "count(DISTINCT CASE WHEN bad THEN wid END)").replace("well_id, CASE", "well_id, well_id AS wid, CASE", 1), "v_candidates")
def ag_07(t: Tables) -> DataFrame:
    rows = assessed(t).withColumns({"image_id": c("well_id") % 10, "false_well": c("wall_score") <= 0.337, "wid": c("well_id")})
    return A.status_counts(rows)


@query("ag_14", "SELECT p_brand, metric, round(min(v), 6) AS low, round(quantile_cont(v, 0.5), 6) AS median, round(max(v), 6) AS high FROM (SELECT p_brand, 'p_size' AS metric, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_brand, 'p_retailprice', p_retailprice::DOUBLE FROM part) GROUP BY ALL")
def ag_14(t: Tables) -> DataFrame:
    out = A.metric_summary(t.table("part"), "p_brand", ["p_size", "p_retailprice"])
    return out.withColumns({k: F.round(k, 6) for k in ("low", "median", "high")})


@query("ag_15", """WITH s AS (SELECT wall_score AS v, wall_fraction >= CAST(0.2 AS DOUBLE) AS truth FROM v_candidates), e AS (SELECT min(v) FILTER (truth) AS true_low, max(v) FILTER (NOT truth) AS false_high FROM s)
SELECT true_low, false_high, round((true_low + false_high) / 2, 6) AS cut, true_low > false_high AS separable, count(*) FILTER (WHERE v >= (true_low + false_high) / 2 AND truth) AS true_pass, count(*) FILTER (WHERE v < (true_low + false_high) / 2 AND truth) AS true_reject,
count(*) FILTER (WHERE v >= (true_low + false_high) / 2 AND NOT truth) AS false_pass, count(*) FILTER (WHERE v < (true_low + false_high) / 2 AND NOT truth) AS false_reject FROM s, e GROUP BY true_low, false_high""", "v_candidates")
def ag_15(t: Tables) -> DataFrame:
    return A.cut_off(t.candidates.select("wall_score", (c("wall_fraction") >= 0.2).alias("truth")), "wall_score", "truth").withColumn("cut", F.round("cut", 6))


@query("ag_16", f"WITH n AS (SELECT a.well_id AS a_id, min({DIST}) AS d FROM v_points a JOIN v_points b ON a.well_id <> b.well_id AND {DIST} BETWEEN CAST(1.03 AS DOUBLE) * 50 AND CAST(2.2 AS DOUBLE) * 50 GROUP BY 1) SELECT count(*) AS samples, round(quantile_cont(d, 0.5), 6) AS pitch, round(quantile_cont(d, 0.1), 6) AS p10, round(quantile_cont(d, 0.9), 6) AS p90 FROM n", "v_points")
def ag_16(t: Tables) -> DataFrame:
    p = pts(t.points)
    near = G.pairs_within(p, p, 110.0, c("a_id") != c("b_id"))
    return A.pitch(near, 50.0, p.count()).withColumns({k: F.round(k, 6) for k in ("pitch", "p10", "p90")})


@query("ag_17", f"""WITH {MATCH}, z AS (SELECT count(*) FILTER (mutual AND d <= 21) AS matched, quantile_cont(d, 0.5) FILTER (mutual AND d <= 21) AS e, (SELECT count(*) FROM v_points) AS nb, (SELECT count(*) FROM v_points_t2) AS nf FROM mm)
SELECT matched, round(e, 6) AS median_error_px, round(matched / nb::DOUBLE, 6) AS base_share, round(matched / nf::DOUBLE, 6) AS follow_share, round(e / 60, 6) AS median_error_pitch,
CASE WHEN matched < 8 OR matched / nb::DOUBLE < CAST(0.35 AS DOUBLE) THEN 'rejected_low_overlap_or_match_count' WHEN e IS NULL OR e / 60 > CAST(0.2 AS DOUBLE) THEN 'rejected_high_registration_error' ELSE 'accepted' END AS status FROM z""", "v_points", "v_points_t2")
def ag_17(t: Tables) -> DataFrame:
    m = matches(t).select("d", (c("mutual") & (c("d") <= 21)).alias("confident"))
    out = A.registration_metrics(m, t.points.count(), t.points_t2.count(), 60.0)
    return out.withColumns({k: F.round(k, 6) for k in ("median_error_px", "base_share", "follow_share", "median_error_pitch")})


PCA = """WITH s AS (SELECT avg(x_px) AS cx, avg(y_px) AS cy, var_samp(x_px) AS vx, var_samp(y_px) AS vy, covar_samp(x_px, y_px) AS vxy FROM v_points), a AS (SELECT *, atan2(2 * vxy, vx - vy) / 2 AS g FROM s),
axes AS (SELECT cx, cy, cos(g) * CASE WHEN sin(g) < 0 THEN -1 ELSE 1 END AS lx, sin(g) * CASE WHEN sin(g) < 0 THEN -1 ELSE 1 END AS ly FROM a)"""


@query("ag_19", PCA + " SELECT round(cx, 6) AS cx, round(cy, 6) AS cy, round(lx, 6) AS lx, round(ly, 6) AS ly, round(-ly, 6) AS sx, round(lx, 6) AS sy FROM axes", "v_points")
def ag_19(t: Tables) -> DataFrame:
    return A.pca_axes(pts(t.points)).select(*[r6(k, k) for k in ("cx", "cy", "lx", "ly", "sx", "sy")])


@query("ag_20", f"WITH {EDGES} SELECT count(*) AS edges, round(atan2(avg(sin(6 * atan2(b_y - ay, bx - ax))), avg(cos(6 * atan2(b_y - ay, bx - ax)))) / 6, 6) AS angle FROM edges", "v_points")
def ag_20(t: Tables) -> DataFrame:
    return A.hex_angle(G.annulus_edges(pts(t.points), 60.0)).withColumn("angle", F.round("angle", 6))


@query("ag_23", "WITH w AS (SELECT well_id, count(o.object_id) AS n FROM v_points LEFT JOIN v_object_points o ON o.object_id % 3000 = well_id GROUP BY 1) SELECT count(*) AS wells, count(*) FILTER (WHERE n > 0) AS positive, count(*) FILTER (WHERE n = 0) AS negative, count(*) FILTER (WHERE n > 1) AS multiple, round(count(*) FILTER (WHERE n > 0) / count(*)::DOUBLE, 6) AS positive_share, round(avg(n), 6) AS mean_objects, quantile_cont(n, 0.5)::DOUBLE AS median_objects FROM w", "v_points", "v_object_points")
def ag_23(t: Tables) -> DataFrame:
    o = t.object_points.select((c("object_id") % 3000).alias("well_id"), "object_id")
    wells = t.points.join(o, "well_id", "left").groupBy("well_id").agg(F.count("object_id").alias("object_count"))
    return A.final_summary(wells).withColumns({k: F.round(k, 6) for k in ("positive_share", "mean_objects")})


@query("ag_26", "WITH s AS (SELECT CASE page_id % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'partial' ELSE 'complete' END AS status FROM pages) SELECT count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE status = 'partial') AS partial, count(*) FILTER (WHERE status = 'error') AS error, bool_and(status = 'complete') AS all_complete FROM s")
def ag_26(t: Tables) -> DataFrame:
    k = c("page_id") % 7
    return A.run_status(t.table("pages").select(F.when(k == 0, "error").when(k == 1, "partial").otherwise("complete").alias("status")))


@query("ag_29", "SELECT timepoint_index, round(avg(0.5::DOUBLE + image_series / 100.0::DOUBLE), 6) AS um_per_pixel, count(*) FILTER (WHERE object_count > 3) AS accepted_fields, CAST(sum(object_count) AS BIGINT) AS matched_wells FROM v_tracking GROUP BY 1", "v_tracking")
def ag_29(t: Tables) -> DataFrame:
    f = t.tracking.select("timepoint_index", (0.5 + c("image_series") / 100.0).alias("um_per_pixel"), (c("object_count") > 3).alias("accepted"), c("object_count").alias("matched"))
    return A.calibration_audit(f).withColumn("um_per_pixel", F.round("um_per_pixel", 6))


@query("ag_30", "SELECT well_observation_id, string_agg(printf('%d/%d', CAST(centroid_x_px AS INT), l_partkey), ';' ORDER BY centroid_x_px, l_partkey, l_suppkey) AS shown FROM v_objects GROUP BY 1", "v_objects")
def ag_30(t: Tables) -> DataFrame:
    got = A.collected(t.objects, "well_observation_id", ["centroid_x_px", "l_partkey", "l_suppkey"])
    return got.select("well_observation_id", F.array_join(F.transform("objects", lambda o: F.format_string("%d/%d", o["centroid_x_px"].cast("int"), o["l_partkey"])), ";").alias("shown"))


# ---- ordered

NUMBER = "ORDER BY centroid_x_px, centroid_y_px, l_linenumber, l_partkey, l_suppkey, area_px2"
ORDER = ["centroid_x_px", "centroid_y_px", "l_linenumber", "l_partkey", "l_suppkey", "area_px2"]


@query("wn_04", f"SELECT well_observation_id, area_px2, row_number() OVER (PARTITION BY well_observation_id {NUMBER}) AS object_number, count(*) OVER (PARTITION BY well_observation_id) AS object_count FROM v_objects", "v_objects")
def wn_04(t: Tables) -> DataFrame:
    return numbered(t.objects, ["well_observation_id"], ORDER, "object_number", "object_count").select("well_observation_id", "area_px2", "object_number", "object_count")


FOLD = """WITH RECURSIVE v AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY x) AS i FROM (SELECT {key} AS g, CAST({value} AS DOUBLE) AS x FROM v_points)),
f AS (SELECT g, i, x, CAST(1 AS BIGINT) AS k, x AS s, 1 AS n FROM v WHERE i = 1
UNION ALL SELECT v.g, v.i, v.x, CASE WHEN abs(v.x - s / n) <= {tol} THEN k ELSE k + 1 END, CASE WHEN abs(v.x - s / n) <= {tol} THEN s + v.x ELSE v.x END, CASE WHEN abs(v.x - s / n) <= {tol} THEN n + 1 ELSE 1 END FROM f JOIN v ON v.g = f.g AND v.i = f.i + 1),
cl AS (SELECT g, k, avg(x) AS centre, count(*) AS support FROM f GROUP BY ALL)"""


def folded(key: str, value: str, tol: float) -> str:
    return FOLD.replace("WITH RECURSIVE", "WITH", 1).format(key=key, value=value, tol=f"CAST({tol} AS DOUBLE)")


@query("wn_05", folded("well_id % 4", "y_px", 12) + " SELECT g AS image_id, k AS cluster, round(centre, 6) AS centre, support FROM cl", "v_points", recursive=True)
def wn_05(t: Tables) -> DataFrame:
    out = clusters(t.points.select((c("well_id") % 4).alias("image_id"), c("y_px").cast("double").alias("v")), "image_id", "v", 12.0)
    return out.withColumn("centre", F.round("centre", 6))


@query("wn_06", folded("well_id % 4", "y_px", 12) + ", n AS (SELECT well_id, k, row_number() OVER (PARTITION BY well_id ORDER BY abs(y_px - centre), k) AS o FROM v_points p JOIN cl ON cl.g = p.well_id % 4) SELECT well_id, k AS grid_row FROM n WHERE o = 1", "v_points", recursive=True)
def wn_06(t: Tables) -> DataFrame:
    p = t.points.select("well_id", (c("well_id") % 4).alias("image_id"), c("y_px").cast("double").alias("v"))
    return nearest_centre(p, clusters(p, "image_id", "v", 12.0), "image_id", "v").select("well_id", c("cluster").alias("grid_row"))


@query("wn_07", folded("1", "y_px", 20) + ", n AS (SELECT well_id, x_px, k, row_number() OVER (PARTITION BY well_id ORDER BY abs(y_px - centre), k) AS o FROM v_points, cl), r AS (SELECT well_id, k AS row_index, row_number() OVER (PARTITION BY k ORDER BY x_px, well_id) AS col_index FROM n WHERE o = 1) SELECT well_id, row_index, col_index, 'R' || lpad(row_index::VARCHAR, 4, '0') || '_C' || lpad(col_index::VARCHAR, 3, '0') AS array_key FROM r", "v_points", recursive=True)
def wn_07(t: Tables) -> DataFrame:
    from gridlume.operators.ordered import array_indices

    return array_indices(pts(t.points), 20.0).withColumnRenamed("id", "well_id")


GROWTH = f"""{MATCH}, g AS (SELECT a_id, b_id, d, CASE WHEN a_id % 9 = 0 THEN 0 ELSE (a_id % 50 + 10)::DOUBLE END AS base, CASE WHEN a_id % 7 = 0 THEN 0 ELSE (b_id % 70 + 10)::DOUBLE END AS follow FROM mm WHERE mutual AND d <= 21),
w AS (SELECT *, CASE WHEN base > 0 THEN follow / base END AS fold, CASE WHEN base <= 0 THEN 'undefined_no_baseline_PDO' WHEN follow <= 0 THEN 'followup_zero_or_lost' ELSE 'quantified' END AS growth_status, CASE WHEN base > 0 AND follow > 0 THEN ln(follow / base) / 3 END AS log_rate FROM g)"""


def growth(t: Tables) -> DataFrame:
    from gridlume.operators.ordered import pair_growth

    k = c("a_id")
    pairs = matches(t).where("mutual AND d <= 21").withColumns({"base": F.when(k % 9 == 0, 0.0).otherwise((k % 50 + 10).cast("double")), "follow": F.when(k % 7 == 0, 0.0).otherwise((c("b_id") % 70 + 10).cast("double"))})
    return pair_growth(pairs, 3.0)


@query("wn_12", f"WITH {GROWTH} SELECT a_id, round(fold, 6) AS fold, round(100 * (fold - 1), 6) AS percent_change, round(log_rate, 6) AS log_rate, growth_status FROM w", "v_points", "v_points_t2")
def wn_12(t: Tables) -> DataFrame:
    return growth(t).select("a_id", *[r6(k, k) for k in ("fold", "percent_change", "log_rate")], "growth_status")


@query("wn_13", f"WITH {GROWTH} SELECT a_id, 'F' || lpad((a_id % 4 + 1)::VARCHAR, 2, '0') || '__PHYSWELL' || lpad(row_number() OVER (PARTITION BY a_id % 4 ORDER BY a_id)::VARCHAR, 4, '0') AS physical_id FROM w", "v_points", "v_points_t2")
def wn_13(t: Tables) -> DataFrame:
    from gridlume.functions.scalar import padded

    rows = ranked(growth(t).withColumn("field", c("a_id") % 4 + 1), ["a_id"], "n", ["field"])
    return rows.select("a_id", F.concat(P("F"), padded(c("field"), 2), P("__PHYSWELL"), padded(c("n"), 4)).alias("physical_id"))


@query("wn_14", f"WITH {GROWTH} SELECT a_id, 1 AS timepoint_index, base AS area, CASE WHEN base > 0 THEN 1.0::DOUBLE END AS relative FROM w UNION ALL SELECT a_id, 2, follow, round(fold, 6) FROM w", "v_points", "v_points_t2")
def wn_14(t: Tables) -> DataFrame:
    from gridlume.operators.ordered import tracking_rows

    return tracking_rows(growth(t)).select("a_id", "timepoint_index", "area", r6("relative", "relative"))


@query("wn_15", "SELECT well_id, l_partkey, l_suppkey, candidate_number, row_number() OVER (PARTITION BY well_id ORDER BY candidate_number, l_partkey, l_suppkey) AS n, dense_rank() OVER (PARTITION BY well_id ORDER BY candidate_number) AS parent_component_id FROM v_candidates", "v_candidates")
def wn_15(t: Tables) -> DataFrame:
    rows = numbered(t.candidates, ["well_id"], ["candidate_number", "l_partkey", "l_suppkey"], "n")
    parent = F.dense_rank().over(Window.partitionBy("well_id").orderBy("candidate_number")).cast("long")
    return rows.select("well_id", "l_partkey", "l_suppkey", "candidate_number", "n", parent.alias("parent_component_id"))


@query("wn_16", f"WITH {MATCH}, k AS (SELECT least(20, greatest(3, CAST(1.5 AS DOUBLE) * quantile_cont(d, 0.5))) AS cut FROM mm WHERE mutual) SELECT a_id, round(cut, 6) AS cut, d <= cut AS confident FROM mm, k WHERE mutual", "v_points", "v_points_t2")
def wn_16(t: Tables) -> DataFrame:
    m = stage(matches(t).where("mutual").select("a_id", "d"), "mutual")
    cut = A.quantile_row(m, "d", {"m": 0.5}).select(F.least(P(20.0), F.greatest(P(3.0), 1.5 * c("m"))).alias("cut"))
    # one row
    return m.crossJoin(F.broadcast(cut)).select("a_id", r6("cut", "cut"), (c("d") <= c("cut")).alias("confident"))


# ---- samples and sets


@query("tk_01", "WITH o AS (SELECT well_id, row_number() OVER (ORDER BY y_px, x_px, well_id) - 1 AS i, count(*) OVER () AS n FROM v_points) SELECT well_id, i AS place FROM o WHERE n <= 40 OR i IN (SELECT CAST(round_even(k * (n - 1) / 39.0::DOUBLE, 0) AS BIGINT) FROM range(0, 40) AS r(k))", "v_points")
def tk_01(t: Tables) -> DataFrame:
    return spread_sample(t.points.select("well_id", "x_px", "y_px"), ["y_px", "x_px", "well_id"], 40).select("well_id", "place")


@query("tk_02", "WITH s AS (SELECT well_id, candidate_number, l_partkey, l_suppkey, wall_score, wall_score >= CAST(0.337 AS DOUBLE) AS above FROM v_candidates) SELECT well_id, candidate_number, wall_score, above FROM (SELECT *, row_number() OVER (PARTITION BY above ORDER BY abs(wall_score - CAST(0.337 AS DOUBLE)), well_id, candidate_number, l_partkey, l_suppkey) AS k FROM s) WHERE k <= 6", "v_candidates")
def tk_02(t: Tables) -> DataFrame:
    return borderline(t.candidates, "wall_score", 0.337, 6, ["well_id", "candidate_number", "l_partkey", "l_suppkey"]).select("well_id", "candidate_number", "wall_score", "above")


@query("tk_03", "SELECT well_observation_id, count(*) AS n FROM v_objects GROUP BY 1 ORDER BY n DESC, well_observation_id LIMIT 20", "v_objects")
def tk_03(t: Tables) -> DataFrame:
    return t.objects.groupBy("well_observation_id").agg(F.count("*").alias("n")).orderBy(c("n").desc(), "well_observation_id").limit(20)


@query("tk_04", "SELECT well_id, radius_px >= 25 AS kept FROM v_points", "v_points")
def tk_04(t: Tables) -> DataFrame:
    kept, excluded = J.flagged_parts(t.points, c("radius_px") >= 25)
    return kept.union(excluded).select("well_id", "kept")


@query("so_01", "SELECT p_partkey AS id, p_size AS size, NULL AS name FROM part UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier")
def so_01(t: Tables) -> DataFrame:
    a = t.table("part").select(c("p_partkey").alias("id"), c("p_size").alias("size"))
    b = t.table("supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


@query("so_02", "SELECT DISTINCT condition_index, condition, concentration FROM v_tracking", "v_tracking")
def so_02(t: Tables) -> DataFrame:
    return t.tracking.select("condition_index", "condition", "concentration").distinct().orderBy("condition_index")


@query("so_03", "SELECT well_observation_id, area_px2 FROM (SELECT *, row_number() OVER (PARTITION BY well_observation_id ORDER BY l_linenumber, l_partkey, l_suppkey, area_px2) AS k FROM v_objects) WHERE k = 1", "v_objects")
def so_03(t: Tables) -> DataFrame:
    return J.first_by(t.objects, ["well_observation_id"], ["l_linenumber", "l_partkey", "l_suppkey", "area_px2"]).select("well_observation_id", "area_px2")


@query("so_04", "SELECT well_id, 'both' AS part FROM (SELECT well_id FROM v_points INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT well_id, 'only_wells' FROM (SELECT well_id FROM v_points EXCEPT SELECT o_custkey FROM orders)", "v_points")
def so_04(t: Tables) -> DataFrame:
    wells, reviewed = t.points.select("well_id"), t.table("orders").select("o_custkey")
    return wells.intersect(reviewed).withColumn("part", P("both")).union(wells.exceptAll(wells.intersect(reviewed)).distinct().withColumn("part", P("only_wells")))


# ---- QC

CAND = f"WITH s AS (SELECT *, {STATUS} AS st, wall_score <= CAST(0.337 AS DOUBLE) AS bad FROM v_candidates)"
CID = "well_id, candidate_number, l_partkey, l_suppkey"
CIDS = CID.split(", ")


@query("qc_01", CAND + f" SELECT {CID}, st AS status FROM s", "v_candidates")
def qc_01(t: Tables) -> DataFrame:
    return assessed(t).select(*CIDS, c("membership_status").alias("status"))


@query("qc_02", CAND + f" SELECT {CID}, CASE WHEN bad THEN 'rejected_false_well' WHEN centroid_fraction > CAST(1.2 AS DOUBLE) THEN 'outside_well' ELSE st END AS nd2, CASE WHEN centroid_fraction > CAST(1.2 AS DOUBLE) THEN 'outside_well' WHEN bad THEN 'rejected_false_well' ELSE st END AS zarr FROM s", "v_candidates")
def qc_02(t: Tables) -> DataFrame:
    bad = c("wall_score") <= 0.337
    return assessed(t).select(*CIDS, *[A.routed_status(c("membership_status"), c("centroid_fraction"), bad, r).alias(r) for r in ("nd2", "zarr")])


@query("qc_03", CAND + f" SELECT {CID}, st IN ('accepted', 'ambiguous') AS lenient, st = 'accepted' AS strict FROM s", "v_candidates")
def qc_03(t: Tables) -> DataFrame:
    s = c("membership_status")
    return assessed(t).select(*CIDS, A.included(s, False).alias("lenient"), A.included(s, True).alias("strict"))


WELLSCORE = "ws AS (SELECT well_id, min(wall_score) AS score FROM v_candidates GROUP BY 1), ask AS (SELECT DISTINCT well_id FROM v_candidates WHERE candidate_number >= 3)"


def well_scores(t: Tables) -> DataFrame:
    return t.candidates.groupBy("well_id").agg(F.min("wall_score").alias("wall_score"))


@query("qc_04", f"WITH {WELLSCORE} SELECT well_id, score AS wall_score, CASE WHEN score <= CAST(0.337 AS DOUBLE) THEN 'rejected_false_well' ELSE 'accepted' END AS validity FROM ws WHERE well_id IN (SELECT well_id FROM ask)", "v_candidates")
def qc_04(t: Tables) -> DataFrame:
    return A.false_wells(t.candidates.where("candidate_number >= 3"), well_scores(t))


@query("qc_05", f"WITH {WELLSCORE} SELECT o_orderkey AS well_id, CASE WHEN a.well_id IS NULL THEN NULL WHEN score <= CAST(0.337 AS DOUBLE) THEN 'rejected_false_well' ELSE 'accepted' END AS validity FROM orders LEFT JOIN ask a ON a.well_id = o_orderkey LEFT JOIN ws ON ws.well_id = o_orderkey", "v_candidates")
def qc_05(t: Tables) -> DataFrame:
    per_row = t.candidates.select("well_id").join(A.false_wells(t.candidates.where("candidate_number >= 3"), well_scores(t)), "well_id")
    return J.lookup(t.table("orders").select(c("o_orderkey").alias("well_id")), per_row, ["well_id"], ["validity"]).select("well_id", "validity")


@query("qc_06", f"SELECT {CID} FROM v_candidates WHERE wall_score >= CAST(0.3 AS DOUBLE)", "v_candidates")
def qc_06(t: Tables) -> DataFrame:
    return t.candidates.where((c("wall_score") >= 0.3) & ~F.isnan("wall_score")).select(*CIDS)


@query("qc_07", CAND + f""", k AS (SELECT well_id, row_number() OVER (PARTITION BY well_id ORDER BY centroid_fraction, candidate_number, l_partkey, l_suppkey) AS n, centroid_fraction * 40 AS diameter FROM s WHERE NOT bad AND centroid_fraction <= CAST(1.2 AS DOUBLE) AND st <> 'outside_well'),
p AS (SELECT well_id, count(*) AS objects, string_agg(format('{{:.4f}}', diameter), '; ' ORDER BY n, diameter) AS sizes FROM k GROUP BY 1)
SELECT o_orderkey AS well_id, coalesce(objects, 0) AS objects, coalesce(sizes, '') AS sizes, coalesce(objects, 0) > 1 AS qc_multiple, coalesce(objects, 0) = 0 AS qc_none FROM orders LEFT JOIN p ON p.well_id = o_orderkey""", "v_candidates")
def qc_07(t: Tables) -> DataFrame:
    status = A.routed_status(c("membership_status"), c("centroid_fraction"), c("wall_score") <= 0.337, "nd2")
    kept = assessed(t).withColumn("status", status).where(A.included(c("status"), False))
    rows = numbered(kept, ["well_id"], ["centroid_fraction", "candidate_number", "l_partkey", "l_suppkey"], "n").withColumn("diameter", c("centroid_fraction") * 40)
    return A.rebuilt_wells(t.table("orders").select(c("o_orderkey").alias("well_id")), rows)

"""Queries of scalar functions, sources and sinks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlume.functions import scalar as S
from gridlume.operators.lineage import shared_dir, stage
from gridlume.plans.registry import query
from gridlume.plans.views import Tables
from gridlume.sources import files, stacks
from gridlume.sources import tables as IO

UM = 0.65
c = F.col


def r6(column, name: str):
    return F.round(column, 6).alias(name)


SLUG = "coalesce(nullif(trim(regexp_replace(trim({0}), '[^A-Za-z0-9._-]+', '_', 'g'), '_'), ''), 'unnamed')"
WELL_UM = "CAST(0.65 AS DOUBLE)"


@query("fn_01", f"SELECT page_id, {SLUG.format('url')} AS slug FROM pages")
def fn_01(t: Tables) -> DataFrame:
    return t.table("pages").select("page_id", S.slugify(c("url")).alias("slug"))


@query("fn_02", f"SELECT doc_id, CASE WHEN s = 'unnamed' THEN 'unknown' ELSE s END AS token FROM (SELECT doc_id, {SLUG.format('lang')} AS s FROM documents)")
def fn_02(t: Tables) -> DataFrame:
    return t.table("documents").select("doc_id", S.stable_token(c("lang")).alias("token"))


@query(
    "fn_03",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY condition_index, timepoint_index ORDER BY trajectory_id) AS n FROM v_tracking),
i AS (SELECT *, 'Experiment_001__Array_001__L' || lpad(condition_index::VARCHAR, 2, '0') || '__F' || lpad(image_series::VARCHAR, 2, '0') || '__W' || split_part(well_index, ',', 1) || '_' || split_part(well_index, ',', 2) AS traj FROM o)
SELECT trajectory_id, timepoint_index, traj AS array_id, traj || '__T' || lpad(timepoint_index::VARCHAR, 2, '0') AS observation_id,
traj || '__T' || lpad(timepoint_index::VARCHAR, 2, '0') || '__PDO' || (CASE WHEN n < 100 THEN lpad(n::VARCHAR, 2, '0') ELSE n::VARCHAR END) AS object_id,
traj || '__T' || lpad(timepoint_index::VARCHAR, 2, '0') || '__PSCFOCUS' || (CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END) AS focus_id FROM i""",
    "v_tracking",
)
def fn_03(t: Tables) -> DataFrame:
    at = F.split("well_index", ",")
    rows = IO.ranked(t.tracking, ["trajectory_id"], "n", ["condition_index", "timepoint_index"])
    ids = rows.withColumns({"array_id": S.trajectory_id(F.lit("Experiment_001"), F.lit("Array_001"), c("condition_index"), c("image_series"), at[0], at[1])})
    ids = ids.withColumn("observation_id", S.observation_id(c("array_id"), c("timepoint_index")))
    return ids.select("trajectory_id", "timepoint_index", "array_id", "observation_id", S.object_id(c("observation_id"), c("n")).alias("object_id"), S.focus_id(c("observation_id"), c("n")).alias("focus_id"))


@query("fn_04", f"SELECT object_id, round(2 * sqrt(area_px2 / pi()) * {WELL_UM}, 6) AS diameter_um FROM v_object_points", "v_object_points")
def fn_04(t: Tables) -> DataFrame:
    return t.object_points.select("object_id", r6(S.equivalent_diameter(c("area_px2"), F.lit(UM)), "diameter_um"))


@query("fn_05", f"SELECT object_id, round(area_px2 * {WELL_UM} * {WELL_UM}, 6) AS area_um2 FROM v_object_points", "v_object_points")
def fn_05(t: Tables) -> DataFrame:
    return t.object_points.select("object_id", r6(S.area_um2(c("area_px2"), F.lit(UM)), "area_um2"))


@query("fn_06", "SELECT well_id % 8 AS image_id, round(100.0::DOUBLE / (2 * quantile_cont(radius_px, 0.5)), 6) AS um_per_pixel FROM v_points GROUP BY 1", "v_points")
def fn_06(t: Tables) -> DataFrame:
    return t.points.groupBy((c("well_id") % 8).alias("image_id")).agg(r6(100.0 / (2 * F.percentile("radius_px", 0.5)), "um_per_pixel"))


@query("fn_07", "SELECT p_partkey, round((p_size / 10.0::DOUBLE + p_size / 10.0::DOUBLE + 0.1::DOUBLE) / 2, 6) AS um_per_pixel FROM part WHERE p_size > 0")
def fn_07(t: Tables) -> DataFrame:
    x = c("p_size") / F.lit(10.0)
    return t.table("part").where("p_size > 0").select("p_partkey", r6(S.voxel_scale(x, x + 0.1), "um_per_pixel"))


@query("fn_08", """SELECT p_partkey, greatest(2, CAST(round_even(0.8::DOUBLE * r, 0) AS BIGINT)) AS rmin, greatest(greatest(2, CAST(round_even(0.8::DOUBLE * r, 0) AS BIGINT)) + 2, CAST(round_even(1.2::DOUBLE * r, 0) AS BIGINT)) AS rmax,
greatest(2, CAST(round_even(1.5::DOUBLE * r, 0) AS BIGINT)) AS spacing FROM (SELECT p_partkey, p_size / 2.0::DOUBLE AS r FROM part)""")
def fn_08(t: Tables) -> DataFrame:
    return t.table("part").select("p_partkey", *[v.cast("long").alias(k) for k, v in S.scan_settings(c("p_size") / F.lit(2.0)).items()])


SCALE = "CASE timepoint_index WHEN 1 THEN 0.5 WHEN 2 THEN 0.4 WHEN 3 THEN 0.8 WHEN 4 THEN 0.0 END"


@query("fn_09", f"""WITH s AS (SELECT *, CAST({SCALE} AS DOUBLE) AS new FROM v_tracking)
SELECT trajectory_id, timepoint_index, round(CASE WHEN new > 0 THEN total_area_um2 * ((new / 0.5) * (new / 0.5)) ELSE total_area_um2 END, 6) AS area, round(CASE WHEN new > 0 THEN object_count * (new / 0.5) ELSE object_count END, 6) AS length FROM s""", "v_tracking")
def fn_09(t: Tables) -> DataFrame:
    scales = t.spark.createDataFrame([(1, 0.5), (2, 0.4), (3, 0.8), (4, 0.0)], "timepoint_index int, new double")
    rows = t.tracking.join(F.broadcast(scales), "timepoint_index", "left")
    return rows.select("trajectory_id", "timepoint_index", r6(S.rescaled(c("total_area_um2"), F.lit(0.5), c("new"), 2), "area"), r6(S.rescaled(c("object_count").cast("double"), F.lit(0.5), c("new"), 1), "length"))


@query("fn_10", "SELECT image_id, x, y, CAST(floor(least(255.0, greatest(0.0, v * 255.0::DOUBLE / 200))) AS INT) AS level FROM v_pixels", "v_pixels")
def fn_10(t: Tables) -> DataFrame:
    return t.pixels.select("image_id", "x", "y", S.to_uint8(c("v").cast("double"), F.lit(200)).alias("level"))


@query("fn_11", """WITH s AS (SELECT image_id, quantile_cont(v, 0.005) AS p, quantile_cont(v, 0.995) AS q, min(v) AS a, max(v) AS b FROM v_pixels GROUP BY 1),
l AS (SELECT image_id, CASE WHEN q > p THEN p ELSE a END AS lo, CASE WHEN q > p THEN q ELSE b END AS hi FROM s)
SELECT image_id, x, y, CASE WHEN hi > lo THEN CAST(floor(least(255, greatest(0, (v - lo) * 255.0::DOUBLE / (hi - lo)))) AS INT) ELSE 0 END AS level FROM v_pixels JOIN l USING (image_id)""", "v_pixels")
def fn_11(t: Tables) -> DataFrame:
    return IO.local_stretch(t.pixels)


@query("fn_12", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size ELSE 65535 END::DOUBLE AS window_end FROM part")
def fn_12(t: Tables) -> DataFrame:
    return t.table("part").select("p_partkey", S.window_end(F.when(c("p_size") > 25, c("p_size").cast("double")).otherwise(0.0), 65535.0).alias("window_end"))


PLANES = "WITH p AS (SELECT image_id, x, y, v AS r, (v * 3 + x) % 256 AS g, (v * 5 + y) % 256 AS b FROM v_pixels)"


def planes(t: Tables) -> DataFrame:
    return t.pixels.select("image_id", "x", "y", c("v").alias("r"), ((c("v") * 3 + c("x")) % 256).alias("g"), ((c("v") * 5 + c("y")) % 256).alias("b"))


@query("fn_13", PLANES + " SELECT image_id, x, y, greatest(r, g) AS composite, least(255, r + g) AS added FROM p", "v_pixels")
def fn_13(t: Tables) -> DataFrame:
    return planes(t).select("image_id", "x", "y", F.greatest("r", "g").alias("composite"), F.least(F.lit(255).cast("long"), c("r") + c("g")).alias("added"))


@query("fn_14", PLANES + """, e AS (SELECT *, greatest(0, g - 0.5::DOUBLE * (r + b)) AS soft FROM p), q AS (SELECT image_id, quantile_cont(soft, 0.995) FILTER (soft > 0) AS top FROM e GROUP BY 1)
SELECT image_id, x, y, g - greatest(r, b) AS excess, round(least(1, soft / top), 6) AS soft_excess FROM e JOIN q USING (image_id)""", "v_pixels")
def fn_14(t: Tables) -> DataFrame:
    soft = F.greatest(F.lit(0.0), c("g") - 0.5 * (c("r") + c("b")))
    e = planes(t).withColumn("soft", soft)
    top = e.where("soft > 0").groupBy("image_id").agg(F.percentile("soft", 0.995).alias("top"))
    return e.join(top, "image_id").select("image_id", "x", "y", (c("g") - F.greatest("r", "b")).alias("excess"), r6(F.least(F.lit(1.0), c("soft") / c("top")), "soft_excess"))


@query("fn_15", "SELECT well_id FROM v_points CROSS JOIN (SELECT max(x_px) + 1 AS w, max(y_px) + 1 AS h FROM v_points) WHERE x_px - radius_px >= 2 AND y_px - radius_px >= 2 AND x_px + radius_px < w - 2 AND y_px + radius_px < h - 2", "v_points")
def fn_15(t: Tables) -> DataFrame:
    return t.points.where(S.fully_visible(c("x_px"), c("y_px"), c("radius_px"), *map(F.lit, t.extent))).select("well_id")


@query("fn_16", "SELECT well_id FROM v_points WHERE x_px >= 512 AND x_px < 1024 AND y_px >= 512 AND y_px < 1024", "v_points")
def fn_16(t: Tables) -> DataFrame:
    return t.points.where(S.in_core(c("x_px"), c("y_px"), *map(F.lit, (512, 512, 1024, 1024)))).select("well_id")


@query("fn_17", "SELECT well_id, x_px % 512 + (x_px // 512) * 512 AS x_px, y_px % 512 + (y_px // 512) * 512 AS y_px FROM v_points WHERE x_px >= 0 AND y_px >= 0", "v_points")
def fn_17(t: Tables) -> DataFrame:
    local = t.points.where("x_px >= 0 AND y_px >= 0").select("well_id", (c("x_px") % 512).alias("lx"), (c("y_px") % 512).alias("ly"), F.expr("x_px div 512 * 512").alias("x0"), F.expr("y_px div 512 * 512").alias("y0"))
    return local.select("well_id", (c("lx") + c("x0")).alias("x_px"), (c("ly") + c("y0")).alias("y_px"))


@query("fn_18", "SELECT p_partkey, TRY_CAST(CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_size::VARCHAR END AS DOUBLE) AS number FROM part")
def fn_18(t: Tables) -> DataFrame:
    text = F.when(c("p_size") % 3 == 0, c("p_name")).otherwise(c("p_size").cast("string"))
    return t.table("part").select("p_partkey", text.try_cast("double").alias("number"))


@query("fn_19", "SELECT well_observation_id, count(*) > 1 AS qc_multiple, sum(CASE WHEN area_px2 > 50000 THEN 1 ELSE 0 END) = 0 AS qc_no_large FROM v_objects GROUP BY 1", "v_objects")
def fn_19(t: Tables) -> DataFrame:
    return t.objects.groupBy("well_observation_id").agg((F.count("*") > 1).alias("qc_multiple"), (F.count_if(c("area_px2") > 50000) == 0).alias("qc_no_large"))


@query("fn_20", "SELECT well_observation_id, string_agg(format('{:.4f}', area_px2), '; ' ORDER BY centroid_x_px, centroid_y_px, l_linenumber, l_partkey, l_suppkey, area_px2) AS areas FROM v_objects GROUP BY 1", "v_objects")
def fn_20(t: Tables) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("centroid_x_px", "centroid_y_px", "l_linenumber", "l_partkey", "l_suppkey", "area_px2")))
    return t.objects.groupBy("well_observation_id").agg(F.array_join(F.transform(rows, lambda o: F.format_string("%.4f", o["area_px2"])), "; ").alias("areas"))


@query("fn_21", """SELECT well_id, x_px - 128 AS pad_x0, greatest(0, least(x_px - 128, 1800 - 256)) AS slide_x0,
CAST(least(ceil(1.2::DOUBLE * radius_px), ceil(greatest(28.0::DOUBLE, 1.9::DOUBLE * sqrt(radius_px), 0.42::DOUBLE * radius_px))) AS BIGINT) AS half FROM v_points""", "v_points")
def fn_21(t: Tables) -> DataFrame:
    half = S.adaptive_half(c("radius_px").cast("double"), F.sqrt(c("radius_px").cast("double")))
    return t.points.select("well_id", (c("x_px") - 128).alias("pad_x0"), S.crop_inside(c("x_px"), 256, F.lit(1800)).cast("long").alias("slide_x0"), half.cast("long").alias("half"))


@query("fn_22", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sqrt(pow(l_quantity - 25, 2) + pow(l_discount * 100 - 5, 2)), 6) AS distance FROM lineitem")
def fn_22(t: Tables) -> DataFrame:
    dx, dy = c("l_quantity").cast("double") - 25, c("l_discount").cast("double") * 100 - 5
    return t.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(F.sqrt(dx * dx + dy * dy), "distance"))


@query("fn_23", "SELECT well_observation_id, count(*) > 1 AS qc_multiple, max(area_px2) > 90000 AS qc_large FROM v_objects GROUP BY 1", "v_objects")
def fn_23(t: Tables) -> DataFrame:
    wells = t.objects.groupBy("well_observation_id").agg((F.count("*") > 1).alias("qc_multiple"), (F.max("area_px2") > 90000).alias("qc_large"), F.sum("area_px2").alias("area"))
    return IO.keep_columns(wells, ["well_observation_id", "not_there"], prefix="qc_")


@query("fn_26", "SELECT p_partkey, CAST(p_size AS BIGINT) * 1000 * (p_size * 500) * 3 * 2 AS bytes, round(CAST(p_size AS BIGINT) * 1000 * (p_size * 500) * 3 * 2 / 1048576.0::DOUBLE, 6) AS mib, CAST(p_size AS BIGINT) * 1000 * (p_size * 500) * 3 * 2 > 1073741824 AS large FROM part")
def fn_26(t: Tables) -> DataFrame:
    b = S.frame_bytes(c("p_size") * 1000, c("p_size") * 500, F.lit(3), F.lit(2))
    return t.table("part").select("p_partkey", b.alias("bytes"), r6(b / 1048576.0, "mib"), (b > 1 << 30).alias("large"))


GUARDED = """SELECT p_partkey, p_size % 4 AS object_channel, p_partkey % 5 AS focus_channel, p_size % 6 AS channels, p_size - 30 AS responder_max, p_partkey % 30 - 15 AS resistant_min, n FROM part LEFT JOIN (SELECT ps, count(*) AS n FROM (SELECT l_partkey AS ps, l_discount FROM lineitem) WHERE l_discount > 0.09 GROUP BY ps) ON ps = p_partkey"""


@query("fn_27", f"""SELECT p_partkey, CASE WHEN object_channel >= channels OR focus_channel >= channels THEN 'Selected channel does not exist.' WHEN object_channel = focus_channel THEN 'One channel cannot carry both signals.'
WHEN coalesce(n, 0) = 0 THEN 'No wells were detected.' WHEN responder_max >= resistant_min THEN 'Responder threshold must be lower than the resistant threshold.' END AS problem FROM ({GUARDED})""")
def fn_27(t: Tables) -> DataFrame:
    wells = t.table("lineitem").where("l_discount > 0.09").groupBy(c("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    settings = t.table("part").select("p_partkey", (c("p_size") % 4).alias("object_channel"), (c("p_partkey") % 5).alias("focus_channel"), (c("p_size") % 6).alias("channels"), (c("p_size") - 30).alias("responder_max"), (c("p_partkey") % 30 - 15).alias("resistant_min")).join(wells, "p_partkey", "left")
    return settings.select("p_partkey", S.settings_problem(c("object_channel"), c("focus_channel"), c("channels"), c("n"), c("responder_max"), c("resistant_min")).alias("problem"))


@query("fn_28", "SELECT doc_id, coalesce(lower(trim(CASE doc_id % 4 WHEN 0 THEN 'True ' WHEN 1 THEN '1' WHEN 2 THEN lang END)) IN ('true', '1'), false) AS flag FROM documents")
def fn_28(t: Tables) -> DataFrame:
    k = c("doc_id") % 4
    return t.table("documents").select("doc_id", S.truthy(F.when(k == 0, "True ").when(k == 1, "1").when(k == 2, c("lang"))).alias("flag"))


@query("fn_29", "SELECT count(*) AS cells, count(*) FILTER (WHERE trim(uri) <> '') AS filled FROM (SELECT CASE WHEN page_id % 3 = 0 THEN '  ' ELSE url END AS uri FROM pages)")
def fn_29(t: Tables) -> DataFrame:
    uri = F.when(c("page_id") % 3 == 0, F.lit("  ")).otherwise(c("url"))
    return t.table("pages").agg(F.count("*").alias("cells"), F.count_if(F.trim(uri) != "").alias("filled"))


# ---- sources

OBJECT_KEYS = "SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) || (CASE page_id % 4 WHEN 0 THEN '/a.ome.zarr/0/c.PNG' WHEN 1 THEN '/Series 00' || (page_id % 7)::VARCHAR || '.tif' WHEN 2 THEN '/x.nd2' ELSE '/notes.txt' END) AS key FROM pages"


def object_keys(t: Tables) -> DataFrame:
    k = c("page_id") % 4
    tail = F.when(k == 0, "/a.ome.zarr/0/c.PNG").when(k == 1, F.concat(F.lit("/Series 00"), (c("page_id") % 7).cast("string"), F.lit(".tif"))).when(k == 2, "/x.nd2").otherwise("/notes.txt")
    return t.table("pages").select("page_id", F.concat(F.regexp_extract("url", "://([^?#]*)", 1), tail).alias("key"))


KEYS = f"WITH k AS ({OBJECT_KEYS}) "


@query("src_01", KEYS + "SELECT key FROM k WHERE lower(regexp_extract(key, '\\.[^./]*$')) IN ('.png', '.jpg', '.jpeg', '.tif', '.tiff')")
def src_01(t: Tables) -> DataFrame:
    return IO.image_keys(object_keys(t).select("key")).orderBy("key")


@query("src_02", KEYS + "SELECT DISTINCT regexp_extract(key, '^(.+?\\.ome\\.zarr)', 1) || '/' AS root FROM k WHERE contains(key, '.ome.zarr')")
def src_02(t: Tables) -> DataFrame:
    return IO.dataset_roots(object_keys(t)).orderBy("root")


@query("src_03", "SELECT user_id, round(total, 6) AS total, n FROM (SELECT user_id, sum(value) AS total, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY 1 UNION ALL SELECT user_id, sum(value), NULL FROM events WHERE user_id % 2 = 1 GROUP BY 1)")
def src_03(t: Tables) -> DataFrame:
    e = t.table("events")
    even = e.where("user_id % 2 = 0").groupBy("user_id").agg(r6(F.sum("value"), "total"), F.count("*").alias("n"))
    odd = e.where("user_id % 2 = 1").groupBy("user_id").agg(r6(F.sum("value"), "total"))
    return IO.csv_round_trip([even, odd], T.StructType([T.StructField("user_id", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())]))


@query("src_04", "SELECT p_partkey, row_number() OVER (ORDER BY lower(trim(p_name)), p_size, p_partkey) AS place FROM part")
def src_04(t: Tables) -> DataFrame:
    name = F.concat(F.trim("p_name"), F.lit(" "), c("p_size").cast("string"))
    ordered = t.table("part").select("p_partkey", S.natural_key(name).alias("k"))
    return IO.ranked(ordered, ["k", "p_partkey"], "place").select("p_partkey", "place")


@query("src_05", KEYS + "SELECT page_id, key, coalesce(CAST(nullif(regexp_extract(key, '(?i)series\\s*0*(\\d+)', 1), '') AS BIGINT), row_number() OVER (ORDER BY page_id)) AS series FROM k")
def src_05(t: Tables) -> DataFrame:
    numbered = IO.ranked(object_keys(t), ["page_id"], "n")
    return numbered.select("page_id", "key", S.series_number(c("key"), c("n")).alias("series"))


@query("src_06", KEYS + """, b AS (SELECT page_id, regexp_extract(key, '[^/]*$') AS base FROM k), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY page_id) AS i FROM b)
SELECT page_id, CASE WHEN i = 1 THEN base ELSE (CASE WHEN i < 1000 THEN lpad(i::VARCHAR, 3, '0') ELSE i::VARCHAR END) || '_' || base END AS name FROM n""")
def src_06(t: Tables) -> DataFrame:
    return IO.distinct_names(object_keys(t), "key", ["page_id"]).select("page_id", "name")


#: Regions (x0, y0, width, height), channel, z, t: over the right edge and above the top with z and t past their ends; inside; a channel that isn't there; beside the image.
REGIONS = (((20, -5, 90, 17), 1, 99, -4), ((3, 30, 20, 9), 0, 0, 0), ((40, 40, 5, 5), 7, 0, 0), ((200, 0, 5, 5), 0, 0, 0))
_stack = "st AS (SELECT image_id % 2 AS channel, (image_id // 2) % 2 AS z, image_id // 4 AS t, x, y, v FROM v_pixels), size AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h, max(z) AS mz, max(t) AS mt FROM st)"


def region_sql(number: int) -> str:
    (x0, y0, w, h), channel, z, t = REGIONS[number]
    return (
        f"SELECT {number} AS region, gx.x AS x, gy.y AS y, coalesce(v, 0) AS v FROM (SELECT CAST(unnest(range({x0}, {x0 + w})) AS BIGINT) AS x) gx CROSS JOIN (SELECT CAST(unnest(range({y0}, {y0 + h})) AS BIGINT) AS y) gy CROSS JOIN size"
        f" LEFT JOIN st ON st.x = gx.x AND st.y = gy.y AND channel = {channel} AND z = greatest(0, least(mz, {z})) AND t = greatest(0, least(mt, {t})) WHERE gx.x BETWEEN 0 AND w - 1 AND gy.y BETWEEN 0 AND h - 1"
    )


@query("src_07", f"WITH {_stack} " + " UNION ALL ".join(region_sql(k) for k in range(len(REGIONS))), "v_pixels")
def src_07(t: Tables) -> DataFrame:
    root = f"{shared_dir(t.spark)}/stack-{uuid.uuid4().hex}"
    image = c("image_id")
    stacks.write_stack(t.pixels.select((image % 2).alias("channel"), (F.floor(image / 2) % 2).alias("z"), F.floor(image / 4).alias("t"), "x", "y", "v"), root, 16)
    read = [stacks.read_region(t.spark, root, box, channel, z, at).withColumn("region", F.lit(k)) for k, (box, channel, z, at) in enumerate(REGIONS)]
    return reduce(DataFrame.union, read).select("region", "x", "y", "v")


LONG = "WITH p AS (SELECT image_id, x, y, v AS c0, (v * 3 + x) % 256 AS c1 FROM v_pixels) "


@query("src_08", LONG + "SELECT image_id, x, y, c0 AS r, c1 AS g, CAST(0 AS BIGINT) AS b FROM p", "v_pixels")
def src_08(t: Tables) -> DataFrame:
    return IO.compose_rgb(IO.long_channels(t.pixels), (0, 1, -1))


@query("src_09", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 1 WHEN page_id % 3 = 1 THEN 0 END AS object_channel, CASE WHEN page_id % 3 = 2 THEN NULL ELSE 0 END AS well_channel, page_id % 3 = 2 AS rgb FROM pages")
def src_09(t: Tables) -> DataFrame:
    mode = F.element_at(F.array(F.lit("gfp"), F.lit("brightfield"), F.lit("rgb")), (c("page_id") % 3 + 1).cast("int"))
    return IO.channel_plan(t.table("pages").select("page_id", mode.alias("mode"), F.lit(1).alias("gfp"), F.lit(0).alias("dic"))).drop("mode")


@query("src_10", "WITH n AS (SELECT p_brand, p_partkey AS i, lower(p_name) AS name FROM part) SELECT p_brand, min(i) FILTER (name LIKE '%green%' OR name LIKE '%gfp%' OR name LIKE '%1%') AS channel FROM n GROUP BY 1")
def src_10(t: Tables) -> DataFrame:
    return IO.suggest_channel(t.table("part").select("p_brand", c("p_partkey").alias("i"), c("p_name").alias("name")), ["p_brand"], ["green", "gfp", "1"])


@query("src_11", "SELECT user_id, CAST(ord AS BIGINT) AS position, round(CAST(x AS DOUBLE), 6) AS x FROM (SELECT user_id, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS ord FROM (SELECT user_id, list(round(value, 6) ORDER BY round(value, 6)) AS xs FROM events GROUP BY 1))")
def src_11(t: Tables) -> DataFrame:
    nested = t.table("events").groupBy("user_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.round("value", 6))), lambda v: F.struct(v.alias("x"))).alias("positions"))).alias("metadata"))
    return IO.position_records(nested, ["user_id"]).withColumn("x", F.round("x", 6))


@query("src_12", "SELECT page_id, sha256('{\"page_id\":' || page_id::VARCHAR || ',\"url\":\"' || url || '\"}') AS fingerprint FROM pages")
def src_12(t: Tables) -> DataFrame:
    return t.table("pages").select("page_id", IO.fingerprint("url", "page_id").alias("fingerprint"))


_lines = "SELECT c_nationkey, string_agg(CAST(c_custkey AS VARCHAR) || ',' || c_name || chr(10), '' ORDER BY c_custkey) AS content FROM customer GROUP BY 1"


@query("src_13", f"SELECT 'nation=' || c_nationkey AS path, 'text' AS asset_type, CAST(strlen(content) AS BIGINT) AS bytes, sha256(content) AS sha256 FROM ({_lines})")
def src_13(t: Tables) -> DataFrame:
    """Lists of customers, a text file a nation, written and scanned; files over 16 KB are hashed in chunks of 4 KB."""
    root = f"{shared_dir(t.spark)}/package-{uuid.uuid4().hex}"
    lines = t.table("customer").select(c("c_nationkey").alias("nation"), "c_custkey", F.concat(c("c_custkey").cast("string"), F.lit(","), "c_name").alias("line"))
    lines.repartition("nation").sortWithinPartitions("nation", "c_custkey").drop("c_custkey").write.partitionBy("nation").text(root)
    found = files.manifest(t.spark, root, 16 << 10, 4 << 10)
    return found.withColumn("path", F.substring_index("path", "/", 1))


@query("src_14", "SELECT page_id, coalesce(CASE WHEN page_id % 2 = 0 THEN md5(url) END, 'etag-' || page_id::VARCHAR) AS etag, '[' || (page_id % 9)::VARCHAR || ',512]' AS shape, CASE WHEN page_id % 5 = 0 THEN 'error' ELSE 'complete' END AS status, CASE WHEN page_id % 5 = 0 THEN 'unreadable' ELSE '' END AS error FROM pages")
def src_14(t: Tables) -> DataFrame:
    k = c("page_id")
    rows = t.table("pages").select("page_id", F.when(k % 2 == 0, F.md5("url")).alias("etag"), F.concat(F.lit("etag-"), k.cast("string")).alias("ETag2"), F.array(k % 9, F.lit(512).cast("long")).alias("shape"), F.when(k % 5 == 0, "unreadable").alias("error"))
    return IO.manifest_rows(rows, ["etag", "ETag2"]).select("page_id", "etag", "shape", "status", "error")


@query("src_15", "SELECT a.p_partkey AS a, b.p_partkey AS b, least(a.p_size, b.p_size) AS shared_fields, a.p_size = b.p_size AS same_size, a.p_brand = b.p_brand AS same_brand FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def src_15(t: Tables) -> DataFrame:
    a = t.table("part").select(c("p_partkey").alias("a"), c("p_size").alias("sa"), c("p_brand").alias("ba"))
    b = t.table("part").select(c("p_partkey").alias("b"), (c("p_partkey") - 1).alias("a"), c("p_size").alias("sb"), c("p_brand").alias("bb"))
    return a.join(b, "a").select("a", "b", F.least("sa", "sb").alias("shared_fields"), (c("sa") == c("sb")).alias("same_size"), (c("ba") == c("bb")).alias("same_brand"))


@query("src_16", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'CYX' WHEN 1 THEN 'YX' ELSE 'D0D1YX' END AS axes FROM pages")
def src_16(t: Tables) -> DataFrame:
    k = c("page_id") % 3
    names = F.when(k == 0, F.array(F.lit("c"), F.lit("y"), F.lit("x"))).when(k == 1, F.array(F.lit("t")))
    dims = F.when(k == 0, 3).when(k == 1, 2).otherwise(4)
    return t.table("pages").select("page_id", F.array_join(IO.axis_names(names, dims), "").alias("axes"))


@query("src_17", KEYS + "SELECT page_id, CASE WHEN lower(split_part(key, '?', 1)) LIKE '%.nd2' THEN 'nd2' WHEN contains(lower(split_part(key, '?', 1)), '.zarr') THEN 'zarr' WHEN lower(split_part(key, '?', 1)) LIKE '%.tif' OR lower(split_part(key, '?', 1)) LIKE '%.tiff' THEN 'tiff' ELSE 'unknown' END AS source_type FROM k")
def src_17(t: Tables) -> DataFrame:
    return object_keys(t).select("page_id", S.source_type(c("key")).alias("source_type"))


@query("src_18", "WITH k AS (SELECT p_partkey, CAST(unnest(range(0, 3)) AS INT) AS i, p_size FROM part) SELECT p_partkey, i AS channel, CASE WHEN i < p_size % 3 THEN 'L' || i::VARCHAR ELSE 'Channel ' || i::VARCHAR END AS label, CASE WHEN p_size % 2 = 0 THEN p_size / 10.0::DOUBLE ELSE 1.0::DOUBLE END AS scale FROM k")
def src_18(t: Tables) -> DataFrame:
    k = c("p_size")
    labels = F.when(k % 3 == 1, F.array(F.lit("L0"))).when(k % 3 == 2, F.array(F.lit("L0"), F.lit("L1")))
    meta = F.when(k % 2 == 0, F.to_json(F.struct((k / F.lit(10.0)).alias("scale"))))
    return IO.channel_labels(t.table("part").select("p_partkey", labels.alias("labels"), meta.alias("meta")), 3)


# ---- sinks


PACKAGE = """'condition' AS name, condition AS a, CAST(NULL AS VARCHAR) AS b FROM (SELECT DISTINCT condition FROM v_tracking) UNION ALL SELECT 'timepoint', timepoint, NULL FROM (SELECT DISTINCT timepoint FROM v_tracking)
UNION ALL SELECT 'map', condition, timepoint FROM (SELECT DISTINCT condition, timepoint FROM v_tracking) UNION ALL SELECT 'trajectory', trajectory_id, NULL FROM (SELECT DISTINCT trajectory_id FROM v_tracking)
UNION ALL SELECT 'experiment', 'Experiment_001', count(DISTINCT condition)::VARCHAR FROM v_tracking UNION ALL SELECT 'wells', trajectory_id, timepoint FROM v_tracking
UNION ALL SELECT 'objects', trajectory_id, k::VARCHAR FROM (SELECT trajectory_id, unnest(range(1, object_count + 1)) AS k FROM v_tracking) UNION ALL SELECT 'foci', trajectory_id, focus_count::VARCHAR FROM v_tracking WHERE foci_analysed
UNION ALL SELECT 'qc_flags', trajectory_id, 'no_area' FROM v_tracking WHERE total_area_um2 = 0 UNION ALL SELECT 'qc_flags', trajectory_id, 'foci_not_analysed' FROM v_tracking WHERE NOT foci_analysed
UNION ALL SELECT 'qc_flags', trajectory_id, 'many_objects' FROM v_tracking WHERE object_count > 3"""


def written_package(t: Tables) -> dict[str, DataFrame]:
    return IO.write_package(IO.export_package(stage(t.tracking, "tracking")), f"{shared_dir(t.spark)}/package-{uuid.uuid4().hex}")


@query("snk_01", f"SELECT {PACKAGE}", "v_tracking")
def snk_01(t: Tables) -> DataFrame:
    shown = {"experiment": ("name", "conditions"), "condition": ("condition", None), "timepoint": ("timepoint", None), "map": ("condition", "timepoint"), "trajectory": ("trajectory_id", None), "wells": ("trajectory_id", "timepoint"), "objects": ("trajectory_id", "object_number"), "foci": ("trajectory_id", "focus_count"), "qc_flags": ("trajectory_id", "flag")}
    package = written_package(t)
    return reduce(DataFrame.union, [package[k].select(F.lit(k).alias("name"), c(a).alias("a"), (F.lit(None) if b is None else c(b)).cast("string").alias("b")) for k, (a, b) in shown.items()])


@query("snk_02", f"SELECT name, count(*) AS n FROM (SELECT {PACKAGE}) GROUP BY name", "v_tracking")
def snk_02(t: Tables) -> DataFrame:
    return IO.row_counts(IO.export_package(stage(t.tracking, "tracking")))


@query("snk_03", "SELECT page_id, 'masks/series=T' || lpad((page_id % 5)::VARCHAR, 2, '0') AS prefix FROM pages")
def snk_03(t: Tables) -> DataFrame:
    root = f"{shared_dir(t.spark)}/manifests-{uuid.uuid4().hex}"
    t.table("pages").select("page_id", F.concat(F.lit("T"), S.padded(c("page_id") % 5, 2)).alias("series")).write.option("header", True).partitionBy("series").csv(f"{root}/masks")
    return IO.read_manifests(t.spark, root, "page_id long").select("page_id", "prefix")


@query("snk_04", f"SELECT 'condition_' || lpad(condition_index::VARCHAR, 2, '0') || '_' || condition || '/time_' || lpad(timepoint_index::VARCHAR, 2, '0') || '_' || {SLUG.format('timepoint')} AS folder, count(*) AS wells FROM v_tracking GROUP BY 1", "v_tracking")
def snk_04(t: Tables) -> DataFrame:
    return written_package(t)["wells"].groupBy(F.concat_ws("/", "condition_folder", "time_folder").alias("folder")).agg(F.count("*").alias("wells"))


@query("snk_05", "SELECT page_id, '20260102T030405Z_' || substr(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '_'), 1, 80) AS run_id FROM pages")
def snk_05(t: Tables) -> DataFrame:
    return t.table("pages").select("page_id", IO.run_id(F.to_timestamp(F.lit("2026-01-02 03:04:05")), c("url")).alias("run_id"))


@query("snk_06", "SELECT condition, count(*) AS rows, min(concentration) AS dose, 1.05::DOUBLE AS centroid_outside, true AS foci, 20.0::DOUBLE AS well_rmin FROM v_tracking GROUP BY condition", "v_tracking")
def snk_06(t: Tables) -> DataFrame:
    n = t.tracking.groupBy("condition").agg(F.count("*").alias("rows"), F.min("concentration").alias("dose"))
    return IO.settings_snapshot(n, {"well_rmin": 24.0, "foci": True}, {"centroid_outside": 1.05, "well_rmin": 20.0})


@query("snk_07", "SELECT image_id, m.mask_type, m.definition FROM (SELECT DISTINCT image_id FROM v_pixels) CROSS JOIN (VALUES ('well', 'disc of the detected radius'), ('object', 'segmented foreground'), ('focus', 'disc of radius 2')) AS m(mask_type, definition)", "v_pixels")
def snk_07(t: Tables) -> DataFrame:
    return IO.mask_manifest(t.pixels.select("image_id").distinct())

"""Worked examples and properties of single operators."""

import math
from datetime import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlume.functions import scalar as S
from gridlume.operators import graph, joins, lineage, ordered, raster, response, spatial, summaries, tiles
from gridlume.sources import tables
from gridlume.streaming import incremental


def one(df):
    return df.first()


def test_running_mean_clusters(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (10, 11, 69, 70, 130)], "k int, v double")
    assert [r.centre for r in ordered.clusters(df, "k", "v", 3.0).orderBy("cluster").collect()] == [10.5, 69.5, 130.0]


def test_clusters_of_repeated_values_are_the_plain_scan(spark):
    values = [1.0, 1.0, 5.0, 5.0, 5.0, 9.0, 20.0, 20.0, 33.0]
    groups = [[values[0]]]
    for v in values[1:]:
        if abs(v - sum(groups[-1]) / len(groups[-1])) <= 5:
            groups[-1].append(v)
        else:
            groups.append([v])
    df = spark.createDataFrame([(1, v) for v in values], "k int, v double")
    got = ordered.clusters(df, "k", "v", 5.0).orderBy("cluster").collect()
    assert [(round(r.centre, 9), r.support) for r in got] == [(round(sum(g) / len(g), 9), len(g)) for g in groups]


def test_greedy_dedupe_is_the_scan(spark):
    points = [(i, float(i * 37 % 101), float(i * 53 % 97)) for i in range(80)]
    kept = []
    for i, x, y in sorted(points, key=lambda p: (p[2], p[1], p[0])):
        if all(math.hypot(x - a, y - b) > 12 for _, a, b in kept):
            kept.append((i, x, y))
    got = graph.greedy_dedupe(spark.createDataFrame(points, "id long, x double, y double"), 12.0)
    assert {r.id for r in got.collect()} == {k[0] for k in kept}


def test_components_label_is_least_id(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 9), (9, 8), (20, 3), (5, 5)], "a long, b long")
    assert {(r.node, r.root) for r in graph.components(links).collect()} == {(2, 1), (3, 1), (20, 1), (8, 7), (9, 7)}


def test_components_of_a_long_path(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {r.root for r in graph.components(links).collect()} == {0}


def test_nearest_widens_until_found(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    b = spark.createDataFrame([(7, 900.0, 0.0), (8, 0.0, 950.0)], "id long, x double, y double")
    assert tuple(one(spatial.nearest(a, b, 1, 10.0)))[:2] == (1, 7)


def test_manual_affine_example():
    m = spatial.manual_affine(1.0, 0.0, 10, -5, (100, 100), (200, 200))
    assert (m[0] * 50 + m[1] * 50 + m[2], m[3] * 50 + m[4] * 50 + m[5]) == (110, 95)
    m = spatial.manual_affine(0.5, 0.0, 0, 0, (100, 100), (200, 200))
    assert (m[0] * 70 + m[1] * 50 + m[2], m[3] * 70 + m[4] * 50 + m[5]) == (110, 100)


def test_known_similarity_is_recovered(spark):
    a, b = 1.08 * math.cos(math.radians(2)), 1.08 * math.sin(math.radians(2))
    rows = [(i, float(x), float(y), a * x - b * y + 42, b * x + a * y + 18) for i, (x, y) in enumerate((30 * u + 15 * (v % 2), 26 * v) for u in range(8) for v in range(7))]
    rows += [(100 + i, 10.0 * i, 5.0, 900.0 - 70 * i, 3.0 * i * i) for i in range(6)]
    r = one(summaries.ransac_similarity(spark.createDataFrame(rows, "id long, x double, y double, u double, v double"), F.col("id"), 40))
    assert (round(r.scale, 6), round(r.rotation, 6), round(r.tx, 4), round(r.ty, 4), r.inliers) == (1.08, 2.0, 42.0, 18.0, 56)


def test_recalibration_example(spark):
    df = spark.createDataFrame([(4.0, 0.5, 0.4), (4.0, 0.5, 0.8)], "area double, old double, new double")
    got = [r[0] for r in df.select(S.rescaled(F.col("area") * 6.25, F.col("old"), F.col("new"), 2)).collect()]
    assert [round(v, 9) for v in got] == [16.0, 64.0]


def test_spearman_p_values(spark):
    # rho with n; two-sided p from tables of t: n=3 gives 1 degree of freedom
    df = spark.createDataFrame([(0.5, 3), (1.0, 6), (0.632, 10), (0.0, 11)], "r double, n long")
    got = [r[0] for r in df.select(response.spearman_p(F.col("r"), F.col("n"))).collect()]
    assert abs(got[0] - 2 / 3) < 1e-9 and got[1] == 0.0 and abs(got[2] - 0.05) < 5e-4 and abs(got[3] - 1) < 1e-9


def test_bh_is_monotone_and_bounded(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate((0.01, 0.04, 0.03, 0.5, None))], "i int, p double")
    got = {r.i: r.p_bh for r in response.bh_adjusted(df, "p", ["i"]).collect()}
    assert got[4] is None and [round(got[i], 6) for i in (0, 2, 1, 3)] == [0.04, 0.053333, 0.053333, 0.5]


def test_first_known_and_last_row_differ(spark):
    df = spark.createDataFrame([("a", 1, 1, "w", None, 1.0), ("a", 1, 2, "w", 4.0, 2.0), ("a", 1, 3, "w", None, 3.0)], "condition string, condition_index int, timepoint_index int, well_index string, total_area_um2 double, elapsed_time double")
    df = df.withColumn("trajectory_id", F.col("well_index"))
    assert {r.baseline_area for r in response.with_baseline(df).collect()} == {4.0}
    assert one(response.final_rows(df)).total_area_um2 is None


def test_metrics_are_idempotent(spark):
    df = spark.createDataFrame([(1, "w", t, float(a), float(t)) for t, a in ((1, 10), (2, 20), (3, 0))], "condition_index int, well_index string, timepoint_index int, total_area_um2 double, elapsed_time double")
    once = response.response_metrics(df)
    assert sorted(map(str, response.response_metrics(once).collect())) == sorted(map(str, once.collect()))
    with pytest.raises(ValueError, match="well_index"):
        response.response_metrics(df.drop("well_index"))


def test_thresholds_in_order():
    with pytest.raises(ValueError):
        response.responder_class(F.lit(1.0), 10, 10)


def test_missing_trajectory_is_an_error(spark):
    df = spark.createDataFrame([("1,1", " ")], "well_index string, trajectory_id string")
    with pytest.raises(Exception, match="trajectory_id"):
        response.trajectory_safe(df).collect()


def test_repeated_key_is_an_error(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="not unique"):
        joins.many_to_one(left, right, ["k"]).collect()


def test_null_fraction_makes_comparisons_false(spark):
    df = spark.createDataFrame([(1.2, None, 0.1), (1.2, 0.4, 0.0), (0.7, 0.8, 0.0), (0.8, None, 0.3)], "f double, i double, w double")
    assert [r[0] for r in df.select(summaries.membership(F.col("f"), F.col("i"), F.col("w"))).collect()] == ["accepted", "outside_well", "ambiguous", "ambiguous"]


def test_routes_differ_in_precedence(spark):
    df = spark.range(1)
    got = [one(df.select(summaries.routed_status(F.lit("accepted"), F.lit(1.3), F.lit(True), r)))[0] for r in ("nd2", "zarr")]
    assert got == ["rejected_false_well", "outside_well"]


def test_four_parameter_fit_of_a_known_curve(spark):
    doses = [(float(d), 0.2 + 1.8 / (1 + (d / 30) ** 2) if d else 2.0) for d in (0, 3, 10, 30, 100, 300)]
    r = one(response.dose_grid_fit(spark.createDataFrame(doses, "dose double, response double"), [10, 30, 100], [0.5, 1, 2, 4]))
    assert (r.midpoint, r.hill, round(r.bottom, 6), round(r.top, 6), r.fit_error) == (30.0, 2.0, 0.2, 2.0, None)
    assert one(response.dose_grid_fit(spark.createDataFrame(doses[:3], "dose double, response double"), [10], [1])).fit_error == response.NOTE_NO_FIT


def pixels(spark, f, w, h):
    return spark.createDataFrame([(1, x, y, f(x, y)) for x in range(w) for y in range(h)], "image_id long, x long, y long, v long")


def test_smoothing_keeps_a_constant(spark):
    got = raster.smoothed(pixels(spark, lambda x, y: 7, 9, 5), 1.2)
    assert {round(r.v, 9) for r in got.collect()} == {7.0} and got.count() == 45


def test_labels_join_diagonals_and_bends(spark):
    on = {(0, 0), (1, 1), (2, 0), (6, 0), (6, 1), (7, 2), (5, 3), (6, 3), (9, 9)}
    got = raster.labelled(spark.createDataFrame([(1, x, y) for x, y in on], "image_id long, x long, y long"))
    groups = {}
    for r in got.collect():
        groups.setdefault(r.label, set()).add((r.x, r.y))
    assert sorted(map(len, groups.values())) == [1, 3, 5]


def test_distance_counts_only_the_box(spark):
    full = raster.labelled(spark.createDataFrame([(1, x, y) for x in range(3) for y in range(3)], "image_id long, x long, y long"))
    assert {r.d2 for r in raster.background_distance(full).collect()} == {None}


def test_two_discs_split(spark):
    on = [(1, x, y) for x in range(40) for y in range(20) if (x - 10) ** 2 + (y - 9) ** 2 <= 64 or (x - 27) ** 2 + (y - 9) ** 2 <= 64 or (y == 9 and 10 <= x <= 27)]
    labels = raster.labelled(spark.createDataFrame(on, "image_id long, x long, y long"))
    peaks = raster.component_peaks(labels, 5, 3.0)
    r = one(raster.split_test(labels, peaks, 60))
    assert r.peaks >= 2 and r.split


def test_ring_is_a_wall_and_a_line_is_not(spark):
    ring = pixels(spark, lambda x, y: 35 if 63 <= math.hypot(x - 110, y - 110) <= 73 else 170, 220, 220)
    line = pixels(spark, lambda x, y: 35 if 105 <= x <= 115 else 170, 220, 220)
    wells = spark.createDataFrame([(1, 1, 110.0, 110.0, 68.0)], "image_id long, well_id long, wx double, wy double, wr double")
    assert one(raster.wall_evidence(ring, wells)).score > 0.337 >= one(raster.wall_evidence(line, wells)).score


def test_rendered_circle_is_found(spark):
    ring = pixels(spark, lambda x, y: 35 if math.hypot(x - 70, y - 60) <= 30 else 170, 140, 120)
    got = raster.circles(ring, 24, 36, 200.0, 30, 20.0).orderBy(F.col("votes").desc()).first()
    assert abs(got.x - 70) <= 1 and abs(got.y - 60) <= 1 and abs(got.radius - 30) <= 1


def test_tiles_cover_the_array_once(spark):
    t = tiles.tile_grid(spark, 1100, 900, 512, 96).collect()
    assert sum(r.w * r.h for r in t) == 1100 * 900 and len(t) == 6


def test_tables_of_no_rows(spark):
    empty = spark.createDataFrame([], "id long, x double, y double")
    assert graph.greedy_dedupe(empty, 5.0).count() == 0 and spatial.nearest(empty, empty).count() == 0
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_greedy_dedupe_of_a_long_chain(spark):
    points = [(i, 0.0, 10.0 * i) for i in range(30)]
    got = graph.greedy_dedupe(spark.createDataFrame(points, "id long, x double, y double"), 12.0)
    assert {r.id for r in got.collect()} == set(range(0, 30, 2))


def test_labels_of_far_images(spark):
    """Ids of images, rows and columns beyond a million neither overflow nor meet."""
    big = 10**15
    rows = [(big, 5, 1), (big, 6, 1), (big, 6, 2), (big, 1_000_000, 1), (big, 0, 2), (big + 1, 5, 1)]
    got = raster.labelled(spark.createDataFrame(rows, "image_id long, x long, y long")).select("image_id", "x", "y", *(k.alias(n) for k, n in zip(raster.first_pixel(F.col("label")), ("i", "ly", "lx"), strict=True))).collect()
    assert {(r.image_id, r.x, r.y): (r.i, r.ly, r.lx) for r in got} == {
        (big, 5, 1): (big, 1, 5), (big, 6, 1): (big, 1, 5), (big, 6, 2): (big, 1, 5), (big, 1_000_000, 1): (big, 1, 1_000_000), (big, 0, 2): (big, 2, 0), (big + 1, 5, 1): (big + 1, 1, 5),
    }


def test_background_distance_is_the_nearest_other_pixel(spark):
    shape = ["0111110", "1111111", "1110111", "1111111", "0111100"]
    inside = [(x, y) for y, line in enumerate(shape) for x, v in enumerate(line) if v == "1"]
    outside = [(x, y) for y in range(5) for x in range(7) if (x, y) not in inside]
    df = spark.createDataFrame([(7, 1, x, y) for x, y in inside] + [(8, 1, x, 9) for x in range(3)], "label long, image_id long, x long, y long")
    got = {(r.label, r.x, r.y): r.d2 for r in raster.background_distance(df).collect()}
    assert {k[1:]: v for k, v in got.items() if k[0] == 7} == {(x, y): min((x - a) ** 2 + (y - b) ** 2 for a, b in outside) for x, y in inside}
    assert {v for k, v in got.items() if k[0] == 8} == {None}


def test_natural_key_of_long_digit_runs(spark):
    names = ["a2", "a10", "a" + "9" * 25, "a1" + "0" * 25, "a007", "b"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(S.natural_key(F.col("n")), "n").collect()
    assert [r.n for r in rows] == ["a2", "a007", "a10", "a" + "9" * 25, "a1" + "0" * 25, "b"]


def test_ranks_and_quantiles_by_ranges(spark):
    """Against the windows and percentiles of one task, with null keys, ties and a key that holds most rows."""
    rows = [(None if i % 7 == 0 else "a" if i % 3 else "b", float(i * 37 % 50) if i % 11 else None, i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v double, i long")
    place = {(r.i, r.place) for r in tables.ranked(df, ["v", "i"], "place", ["k"]).collect()}
    w = Window.partitionBy("k").orderBy("v", "i")
    assert place == {(r.i, r.n) for r in df.select("i", F.row_number().over(w).alias("n")).collect()}
    got = {r.k: (r.n, r.q1, r.q2) for r in tables.quantiles(df, ["k"], "v", {"q1": 0.1, "q2": 0.5}).collect()}
    want = {r.k: (r.n, r.q[0], r.q[1]) for r in df.where("v is not null").groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", F.array(F.lit(0.1), F.lit(0.5))).alias("q")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert tables.quantiles(df.limit(0), ["k"], "v", {"q": 0.5}).count() == 0


def test_p_of_large_samples_is_the_series_own(spark):
    df = spark.createDataFrame([(r, n) for r in (0.0, 0.004, 0.01, 0.02, -0.03) for n in (19_999, 20_400)], "r double, n long")
    got = df.select("r", "n", response.spearman_p(F.col("r"), F.col("n")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(math.erfc(abs(r.r) * math.sqrt((r.n - 2) / (1 - r.r**2)) / math.sqrt(2)), abs=2e-5)


def test_late_files_are_appended_once(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType()), T.StructField("ts", T.TimestampType())])
    day = lambda m, d: datetime(2026, m, d)
    run = lambda: incremental.append_once(spark, f"{tmp_path}/in", schema, "id", "ts", f"{tmp_path}/out", f"{tmp_path}/state")
    for rows in ([(1, "a", day(6, 1)), (2, "b", day(6, 2))], [(3, "late", day(1, 1)), (1, "again", day(6, 3)), (4, "d", day(6, 3)), (4, "e", day(6, 4))], []):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
        run()
    assert sorted(tuple(r)[:2] for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()) == [(1, "a"), (2, "b"), (3, "late"), (4, "d")]


def test_a_failing_source_leaves_the_others(spark):
    def job(name):
        if name == "bad":
            raise KeyError(name)
        return len(name)

    assert [tuple(r) for r in incremental.isolated(spark, ["one", "bad", "three"], job).collect()] == [("one", "complete", 3, ""), ("bad", "error", None, "KeyError"), ("three", "complete", 5, "")]


class Session:
    """A stand-in for a session on a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda name, default=None: default)

    class sparkContext:
        applicationId, master = "app-test", "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: Session.conf)


def test_staging_on_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.shared_dir(Session)


def test_staged_tables_lie_in_one_folder_and_go(spark):
    root = lineage.shared_dir(spark)
    staged = lineage.stage(spark.range(5), "five")
    assert staged._staged_at.startswith(root) and staged.count() == 5
    lineage.release(staged)
    assert not lineage.exists(spark, staged._staged_at)

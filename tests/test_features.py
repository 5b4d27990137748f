"""Resumable work, tiles, lattices, dose fits, splitting, stacks and files, each against what is known or plain computation."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from gridlume.operators import lattice, raster, response
from gridlume.operators.tiles import owned, tiled
from gridlume.sources import files, stacks
from gridlume.streaming import resumable


def pixels(spark, f, w, h, image=1):
    return spark.createDataFrame([(image, x, y, f(x, y)) for y in range(h) for x in range(w)], "image_id long, x long, y long, v long" if isinstance(f(0, 0), int) else "image_id long, x long, y long, v double")


# Resumable work


def squares(calls, stop_after=99):
    def compute(work):
        calls.append(1)
        if len(calls) > stop_after:
            raise InterruptedError
        return work.where("k IS NULL OR k % 10 <> 9").select("k", (F.col("v") * F.col("v")).alias("square"))

    return compute


def test_a_stopped_job_gives_the_table_of_an_unbroken_one(spark, tmp_path):
    work = spark.createDataFrame([(i, float(i)) for i in range(40)] + [(None, 2.0)], "k long, v double")
    run = lambda place, calls, stop=99, df=work, **signature: resumable.resume(spark, str(tmp_path / place), df, ["k"], {"fingerprint": "a"} | signature, squares(calls, stop), 5)
    whole = sorted(map(tuple, run("whole", []).collect()), key=str)
    assert len(whole) == 37 and (None, 4.0) in whole

    calls = []
    with pytest.raises(InterruptedError):
        run("broken", calls, 2)
    state = resumable.WorkState(spark, str(tmp_path / "broken"), {"fingerprint": "a"})
    assert len(calls) == 3 and len(state.commits()) == 2
    # What a run leaves without a commit isn't read, and goes.
    spark.createDataFrame([(1, 99.0)], "k long, square double").write.parquet(f"{state.folder}/data/left/rows")
    calls = []
    assert sorted(map(tuple, run("broken", calls).collect()), key=str) == whole
    assert len(state.commits()) == 5 and not (tmp_path / "broken" / state.folder.rsplit("/", 1)[1] / "data" / "left").exists()
    # Three batches and the schema's empty call were left to do; then none is.
    assert len(calls) == 4
    calls = []
    assert sorted(map(tuple, run("broken", calls).collect()), key=str) == whole and len(calls) == 1


def test_another_signature_redoes_all_and_new_work_only_itself(spark, tmp_path):
    work = spark.createDataFrame([(i, float(i)) for i in range(20)], "k long, v double")
    run = lambda df, calls, **signature: resumable.resume(spark, str(tmp_path), df, ["k"], signature, squares(calls), 1)
    run(work, [], fingerprint="a", version=1).count()
    more = work.union(spark.createDataFrame([(20, 20.0)], "k long, v double"))
    calls = []
    assert run(more, calls, fingerprint="a", version=1).count() == 19 and len(calls) == 2
    assert resumable.WorkState(spark, str(tmp_path), {"fingerprint": "a", "version": 1}).read("keys", "k long").count() == 21
    calls = []
    assert run(work.limit(5), calls, fingerprint="a", version=2).count() == 5 and len(calls) == 2
    assert resumable.WorkState(spark, str(tmp_path), {"fingerprint": "a", "version": 1}).commits() == []
    assert run(work.limit(0), [], fingerprint="b").count() == 0


# Tiles with halos


def rings(x, y):
    at = [(40, 44, 14), (100, 60, 16), (64, 128, 12), (127, 127, 15), (20, 110, 13), (160, 30, 14)]
    return 40 if any(abs(math.hypot(x - a, y - b) - r) <= 2 for a, b, r in at) else 170 + (x * 7 + y * 3) % 5


def test_circles_are_the_same_whatever_the_tiles(spark):
    image = pixels(spark, rings, 180, 150)
    rows = lambda df: sorted(map(tuple, df.select("image_id", "x", "y", "votes", "radius").collect()))
    whole = rows(raster.circles(image, 10, 18, 200.0, 30, 8.0))
    found = {size: rows(raster.circles_in_tiles(image, size, 10, 18, 200.0, 30, 8.0)) for size in (64, 512)}
    assert found[64] == found[512] == [r for r in whole if 0 <= r[1] < 180 and 0 <= r[2] < 150]
    for a, b in ((40, 44), (100, 60), (64, 128), (127, 127)):
        assert any(abs(x - a) <= 1 and abs(y - b) <= 1 for _, x, y, _, _ in found[64])


def test_each_place_has_one_owner(spark):
    image = pixels(spark, lambda x, y: x + 100 * y, 37, 21)
    back = owned(tiled(image, 16, 5), 16, 5)
    assert sorted(map(tuple, back.select("image_id", "x", "y", "v").collect())) == sorted(map(tuple, image.collect()))
    most = tiled(image, 16, 5).groupBy("image_id").count().agg(F.max("count")).first()[0]
    assert most <= (16 + 2 * 5) ** 2


# Lattices


def turned_lattice(angle, pitch, seed=3, missing=23, noise=2.0):
    pick, points = random.Random(seed), []
    for u in range(-40, 41):
        for v in range(-40, 41):
            x, y = u * pitch * math.cos(angle) + v * pitch * math.cos(angle + math.pi / 3), u * pitch * math.sin(angle) + v * pitch * math.sin(angle + math.pi / 3)
            if abs(x) < 15 * pitch and abs(y) < 20 * pitch:
                points.append((u, v, x + 2000, y + 3000))
    gone = [p for i, p in enumerate(points) if i % missing == 7]
    kept = [p for i, p in enumerate(points) if i % missing != 7]
    rows = [(i, x + pick.uniform(-noise, noise), y + pick.uniform(-noise, noise)) for i, (_, _, x, y) in enumerate(kept)]
    return rows, gone


def test_a_turned_lattice_is_fitted_despite_outliers(spark):
    rows, _ = turned_lattice(0.2, 50.0)
    pick = random.Random(1)
    off = [(10_000 + i, x + pick.choice((-1, 1)) * pick.uniform(17, 22), y + pick.uniform(-22, 22)) for i, x, y in rows[::9]]
    fit = lattice.fit_lattice(spark.createDataFrame(rows + off, "id long, x double, y double"), 50.0, 0.2)
    a, b = complex(fit.basis.ax, fit.basis.ay), complex(fit.basis.bx, fit.basis.by)
    assert abs(a - 50 * complex(math.cos(0.2), math.sin(0.2))) < 0.2
    assert abs(b - 50 * complex(math.cos(0.2 + math.pi / 3), math.sin(0.2 + math.pi / 3))) < 0.2
    placed = fit.placed(spark.createDataFrame(rows + off, "id long, x double, y double"))
    assert placed.where("inlier AND id >= 10000").count() == 0 and placed.where("NOT inlier AND id < 10000").count() == 0
    assert 2 <= fit.rounds <= 5


def test_missing_and_detached_wells_of_a_lattice(spark):
    rows, gone = turned_lattice(0.05, 60.0, noise=0.4)
    # A well on the lattice that no neighbour links to the rest: its neighbours are taken away.
    far = [(99_999, 2000.0, 3000.0 + 60 * math.sqrt(3) * 30)]
    df = spark.createDataFrame(rows + far, "id long, x double, y double")
    found = lattice.reconstruct(df, 44.0)
    status = lattice.site_status(found, lattice.predicted_sites(found), df)
    inner = [(x, y) for _, _, x, y in gone if abs(x - 2000) < 12 * 60 and abs(y - 3000) < 17 * 60]
    missing = [(r.x, r.y) for r in status.where("status = 'missing'").collect()]
    assert inner and all(any(math.hypot(x - a, y - b) < 4 for a, b in missing) for x, y in inner)
    assert status.where("status = 'observed'").count() >= 0.9 * len(rows)
    assert {r.id: r.inside for r in lattice.within_region(df, found).collect()}[99_999] is False


# Dose fits


def test_known_dose_curves_come_back(spark):
    curves = {"a": (0.2, 2.0, 30.0, 2.0), "b": (10.0, 1.0, 7.5, 0.7), "c": (-3.0, 5.0, 400.0, 4.5)}
    doses = [0.0, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0]
    curve = lambda d, bottom, top, mid, hill: bottom + (top - bottom) / (1 + (d / mid) ** hill)
    rows = [(k, d, curve(d, *p)) for k, p in curves.items() for d in doses] + [("few", d, d) for d in doses[:3]] + [("flat", d, 1.0) for d in doses] + [("a", None, 1.0), ("a", 3.0, None)]
    got = {r.k: r for r in response.dose_fit(spark.createDataFrame(rows, "k string, dose double, response double"), ["k"]).collect()}
    for k, p in curves.items():
        assert [got[k].bottom, got[k].top, got[k].midpoint, got[k].hill] == pytest.approx(p, rel=1e-4, abs=1e-4), k
        assert got[k].fit_error is None
    assert got["few"].fit_error == got["flat"].fit_error == response.NOTE_NO_FIT and got["flat"].midpoint is None


def test_hill_stays_in_its_bounds(spark):
    steep = [("s", d, 0.0 if d > 50 else 1.0) for d in (0.0, 1.0, 10.0, 40.0, 60.0, 500.0)]
    r = response.dose_fit(spark.createDataFrame(steep, "k string, dose double, response double"), ["k"]).first()
    assert r.hill <= 10.0 + 1e-9 and r.midpoint == pytest.approx(math.sqrt(40 * 60), rel=0.1)


# Splitting


def blobs(*at):
    return lambda x, y: sum(120 * math.exp(-((x - a) ** 2 + (y - b) ** 2) / (2 * 9.0**2)) for a, b in at)


def objects_of(spark, f):
    image = pixels(spark, f, 120, 120).where("v > 20")
    labels = raster.labelled(image).join(image, raster.PIXEL)
    return raster.split_by_intensity(labels, 20, 55.0, 10).collect()


def test_two_touching_blobs_split_and_one_does_not(spark):
    two = sorted(objects_of(spark, blobs((48, 60), (72, 60))), key=lambda r: r.cx)
    assert len(two) == 2 and abs(two[0].cx - 48) < 4 and abs(two[1].cx - 72) < 4
    (one,) = objects_of(spark, blobs((60, 60)))
    assert one.pieces == 1 and abs(one.cx - 60) < 0.01


def test_flat_discs_split_by_shape(spark):
    """Without intensity peaks, the two deepest places of a dumbbell split it; a bar has none such."""
    discs = lambda x, y: 100.0 if min(math.hypot(x - 40, y - 60), math.hypot(x - 80, y - 60)) <= 17 or 40 < x < 80 and abs(y - 60) < 4 else 0.0
    tilt = lambda x, y: discs(x, y) + (x * 0.001 if discs(x, y) else 0)
    got = sorted(objects_of(spark, tilt), key=lambda r: r.cx)
    assert [r.pieces for r in got] == [2, 2] and abs(got[0].cx - 40) < 3 and abs(got[1].cx - 80) < 3
    bar = objects_of(spark, lambda x, y: 100.0 + x * 0.001 if 20 < x < 100 and abs(y - 60) < 9 else 0.0)
    assert len(bar) == 1


def test_regions_split_in_up_to_four_by_shape(spark):
    centres = [(30, 30), (62, 30), (30, 62), (62, 62)]
    image = pixels(spark, lambda x, y: 1 if any(math.hypot(x - a, y - b) <= 17 for a, b in centres) else 0, 96, 96).where("v = 1")
    labels = raster.labelled(image).join(image, raster.PIXEL)
    got = raster.split_by_shape(labels, 20).collect()
    assert len(got) == 4 and all(any(math.hypot(r.cx - a, r.cy - b) < 3 for a, b in centres) for r in got)
    (alone,) = raster.split_by_shape(labels.where("x < 46 AND y < 46"), 20).collect()
    assert alone.area == labels.where("x < 46 AND y < 46").count()


def test_component_maxima_see_across_gaps(spark):
    """The threshold follows each component's maximum; a greater pixel beyond a gap of the component still counts."""
    rows = [(1, 1, 0, 0, 5.0), (1, 1, 3, 3, 6.0), (2, 1, 50, 0, 1.0), (2, 1, 58, 0, 0.4), (2, 1, 66, 0, 0.6)]
    field = spark.createDataFrame(rows, "label long, image_id long, x long, y long, r double")
    places = lambda d: {(r.label, r.x) for r in raster.component_maxima(field, d, 0.1, 0.5, "r").collect()}
    assert places(3) == {(1, 3), (2, 50), (2, 66)}
    assert places(2) == {(1, 0), (1, 3), (2, 50), (2, 66)}
    assert places(F.when(F.col("label") == 1, 2).otherwise(20)) == {(1, 0), (1, 3), (2, 50)}


@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_row_distances_are_the_least_over_columns(n):
    for seed in range(100):
        pick = random.Random(seed)
        down = [None if pick.random() < 0.3 else pick.randrange(12) for _ in range(n)]
        want = [min(((x - q) ** 2 + g * g for q, g in enumerate(down) if g is not None), default=None) for x in range(n)]
        assert raster.row_distances(down) == want


# Stacks and files


def test_a_plane_is_read_by_its_partition_and_tiles(spark, tmp_path):
    rows = [(ch, z, t, x, y, 1000 * ch + 100 * z + 10 * t + x * y) for ch in range(2) for z in range(3) for t in range(2) for y in range(20) for x in range(30)]
    root = str(tmp_path / "stack")
    stacks.write_stack(spark.createDataFrame(rows, "channel long, z long, t long, x long, y long, v long"), root, 8)
    shape = stacks.shape_of(spark, root)
    assert shape == stacks.Shape(30, 20, 2, 3, 2, 8)
    got = {(r.x, r.y): r.v for r in stacks.read_region(spark, root, (25, -3, 20, 6), 1, 99, -1).collect()}
    assert got == {(x, y): 1200 + x * y for y in range(3) for x in range(25, 30)}
    assert {r.v for r in stacks.read_region(spark, root, (0, 0, 2, 2), 5).collect()} == {0}
    assert stacks.read_region(spark, root, (40, 0, 5, 5), 0).count() == 0
    plan = stacks.tile_rows(spark, root, shape, (0, 0, 8, 8), 1, 2, 0)._jdf.queryExecution().executedPlan().toString()
    partition, pushed = (plan.split(k)[1].split("]")[0] for k in ("PartitionFilters: [", "PushedFilters: ["))
    assert all(k in partition for k in ("channel", "z#", "t#")) and all(k in pushed for k in ("tile_x", "tile_y"))
    assert "1 paths" in plan or "InMemoryFileIndex" in plan


def test_files_are_hashed_whole_and_in_chunks(spark, tmp_path):
    contents = {"a/small.json": b"{}", "b/c/large.parquet": bytes(range(256)) * 400, "empty.txt": b"", "with space.bin": b"x" * 5000}
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    for whole in (1 << 20, 1000):
        got = {r.path: (r.asset_type, r.bytes, r.sha256) for r in files.manifest(spark, str(tmp_path), whole, 777).collect()}
        kinds = {"a/small.json": "settings", "b/c/large.parquet": "table", "empty.txt": "text", "with space.bin": "other"}
        assert got == {n: (kinds[n], len(b), hashlib.sha256(b).hexdigest()) for n, b in contents.items()}


# Large samples


def test_p_of_large_samples_is_the_series(spark):
    """Beyond MOST_TERMS the expansion agrees with the finite series, summed here in whole."""

    def series(rho, n):
        v = n - 2
        angle = math.atan(rho / math.sqrt((1 + rho) * (1 - rho)))
        c2, even = math.cos(angle) ** 2, n % 2 == 0
        term = total = 1.0
        for k in range(1, ((n - 2) // 2 - 1 if even else (n - 5) // 2) + 1):
            term *= ((2 * k - 1) / (2 * k) if even else 2 * k / (2 * k + 1)) * c2
            total += term
        return 1 - (math.sin(angle) * total if even else 2 / math.pi * (angle + math.sin(angle) * math.cos(angle) * total)), v

    cases = [(r, n) for r in (0.0, 0.001, 0.012, 0.03) for n in (20_500, 40_001)]
    got = spark.createDataFrame(cases, "r double, n long").select(response.spearman_p(F.col("r"), F.col("n"))).collect()
    assert [g[0] for g in got] == pytest.approx([series(*x)[0] for x in cases], abs=1e-9)

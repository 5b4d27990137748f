"""Dose fits whose rounds are decided by rounding errors: the same from rows in any order and on any partitions."""

import random

import pytest

from gridlume.operators import response

DOSES = (0.0, 3.0, 9.0, 27.0, 81.0, 243.0)
#: Medians by dose of ag_27 on sf0.1 (a), and on its events 6 (b) and 60 times (c, d) with user ids shifted by 10,000,000: only the
#: highest dose stands out.
FLAT = {
    "a": (1.196266429, 0.986064719, 0.93148016, 0.958124264, 0.933561537, 1.230369515),
    "b": (1.019113684, 1.091918142, 1.007882334, 1.08905224, 1.023690368, 1.091678326),
    "c": (1.006493957, 0.872402891, 1.006141057, 0.872402891, 1.006141057, 0.871551183),
    "d": (0.952702966, 1.027521121, 0.952702966, 1.032474187, 0.939866513, 1.032474187),
}


def fits(spark, rows, files):
    found = response.dose_fit(spark.createDataFrame(rows, "k string, dose double, response double").repartition(files), ["k"]).collect()
    return {r.k: (r.midpoint, r.hill, r.bottom, r.top, r.sse) for r in found}


def test_flat_fits_are_the_same_from_rows_in_any_order(spark):
    rows = [(k, *point) for k, responses in FLAT.items() for point in zip(DOSES, responses, strict=True)]
    want = fits(spark, rows, 1)
    # what the query's SQL, whose sums are in no order either, gives most often on sf0.1
    assert (round(want["a"][0], 3), round(want["a"][2], 4)) == (820.738, 44293.7712)
    for seed, files in enumerate((3, 6)):
        random.Random(seed).shuffle(rows)
        assert fits(spark, rows, files) == want


def test_groups_of_more_than_one_array(spark, monkeypatch):
    some = random.Random(5)
    doses = [0.0] + [2.0**k for k in range(-3, 12)]
    rows = [("a", d, 3 - 2 / (1 + (d / 20) ** 1.7) + some.uniform(-0.1, 0.1)) for d in doses] + [("b", d, some.random()) for d in DOSES]
    whole = fits(spark, rows, 2)
    monkeypatch.setattr(response, "BLOCK", 4)
    dealt = fits(spark, rows, 1)
    assert dealt["a"] == pytest.approx(whole["a"], rel=1e-6) and dealt["b"] == pytest.approx(whole["b"], rel=1e-4)
    some.shuffle(rows)
    assert fits(spark, rows, 5) == dealt

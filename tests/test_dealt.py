"""Points are dealt before they are copied to cells, and the copies are not broadcast."""

from pyspark.sql import functions as F

from gridlume.operators.spatial import pairs_within


def test_copies_in_cells_are_dealt_and_merged(spark):
    p = spark.range(500).select("id", (F.col("id") * 37 % 300).cast("double").alias("x"), (F.col("id") * 91 % 300).cast("double").alias("y")).coalesce(1)
    got = pairs_within(p, p, 20.0)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    # the deal lies below the copies
    assert plan.index("Generate explode") < plan.index("hashpartitioning(a_id")
    a = p.toPandas().to_numpy()
    want = sum(((a[:, 1] - x) ** 2 + (a[:, 2] - y) ** 2 <= 400).sum() for _, x, y in a)
    assert got.count() == want


def test_numbers_of_a_field_are_not_one_window(spark, sf):
    from gridlume.plans import QUERIES

    plan = QUERIES["wn_13"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "windowspecdefinition(_part" in plan and "windowspecdefinition(field" not in plan

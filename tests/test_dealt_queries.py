"""Queries that match points by cells deal the points before copying them to cells: one task that reads a table of small rows doesn't hold all copies."""

import pytest

from gridlume.operators import lineage, spatial
from gridlume.plans import QUERIES, raster_queries, table_queries

NAMES = ["jn_10", "ag_17", "jn_11", "jn_12", "wn_12", "wn_14", "gr_04", "ag_24", "wn_16", "ag_18"]


@pytest.mark.parametrize("name", NAMES)
def test_points_are_dealt_before_they_are_copied(spark, sf, monkeypatch, name):
    planned = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    plans = []

    def seen(df, label):
        plans.append(planned(df))
        return lineage.stage(df, label)

    for module in (spatial, raster_queries, table_queries):
        monkeypatch.setattr(module, "stage", seen)
    plans.append(planned(QUERIES[name](spark, sf)))
    cells = [p for p in plans if "_cx#" in p]
    assert cells
    for plan in cells:
        assert "SortMergeJoin [_cx#" in plan and "BroadcastHashJoin [_cx#" not in plan
        assert plan.rindex("Generate explode") < plan.index("hashpartitioning(a_id#")

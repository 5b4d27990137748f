"""JN-14 by blocks: against all pairs, with copies, other lengths, missing numbers and infinities; and the query's plan."""

import math

import numpy as np

from gridlume.operators import spatial


def plain(rows, ids):
    out = {}
    for i in ids:
        u, found = rows[i], []
        for j, v in rows.items():
            if j == i:
                continue
            pairs = [(np.float32(a), np.float32(b)) for a, b in zip(u or [], v or []) if a is not None and b is not None]
            with np.errstate(all="ignore"):
                d2 = math.fsum(float(a - b) ** 2 for a, b in pairs) if pairs else None
            found.append((math.inf if d2 is None else round(d2, 9), d2 is None, j))
        out[i] = [j for _, _, j in sorted(found)[:2]]
    return out


def test_two_nearest_in_small_blocks_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(spatial, "LEFT", 7)
    monkeypatch.setattr(spatial, "RIGHT", 11)
    some = np.random.default_rng(3)
    rows = {i: [float(x) for x in some.normal(size=8).astype(np.float32)] for i in range(60)}
    rows |= {i: rows[3] for i in range(60, 75)} | {75: None, 76: [], 77: rows[5][:3], 78: [None, *rows[7][1:]], 79: [math.inf, *rows[9][1:]]}
    e = spark.createDataFrame([(i, v) for i, v in rows.items()], "vec_id long, embedding array<float>")
    got = spatial.blocked_two_nearest(e.where("vec_id % 3 = 0"), e, same=True).collect()
    assert {r.left_id for r in got} == {i for i in rows if i % 3 == 0}
    mine = {i: [r.right_id for r in sorted(got, key=lambda r: r["rank"]) if r.left_id == i] for i in rows if i % 3 == 0}
    assert mine == plain(rows, list(mine))


def test_blocks_are_bounded_whatever_the_partitions(spark):
    e = spark.range(100).selectExpr("id", "array(cast(id as float)) AS v")
    plan = spatial.blocked_two_nearest(e.where("id % 20 = 0"), e, same=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan

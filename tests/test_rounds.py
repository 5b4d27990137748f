"""Rounds of components: none for stars, and the same roots for chains, rings and trees."""

import random

from gridlume.operators import graph


def found(spark, links, monkeypatch):
    names, stage = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, name: (names.append(name), stage(df, name))[1])
    out = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    monkeypatch.undo()
    assert len(out) == len({r.node for r in out})
    return {r.node: r.root for r in out}, len(names)


def test_stars_take_no_round(spark, monkeypatch):
    assert found(spark, [(5, 1), (1, 7), (9, 1), (3, 2), (4, 4)], monkeypatch) == ({5: 1, 7: 1, 9: 1, 3: 2}, 1)
    assert found(spark, [], monkeypatch) == ({}, 1)


def test_chains_and_trees_end_without_a_round_that_changes_nothing(spark, monkeypatch):
    assert found(spark, [(1, 2), (2, 3)], monkeypatch) == ({2: 1, 3: 1}, 2)
    some = random.Random(3)
    links = [(i, i + 1) for i in range(100, 140)] + [(300, 339)] + [(i, i + 1) for i in range(300, 339)] + [(i, some.randrange(500, i)) for i in range(501, 560)]
    got, _ = found(spark, links, monkeypatch)
    assert got == {i: 100 for i in range(101, 141)} | {i: 300 for i in range(301, 340)} | {i: 500 for i in range(501, 560)}

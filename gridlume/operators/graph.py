"""Graph operators: components, greedy proximity de-duplication, lattice filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlume.operators.lineage import release, stage
from gridlume.operators.spatial import annulus_edges, pairs_within


def only_stars(edges: DataFrame) -> bool:
    """Whether each larger end u of distinct edges (u > v) has one v, which is no u itself: v is then the smallest of its component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("n")), F.struct(F.col("v").alias("node"), F.lit(0).alias("n")))).alias("e"))
    seen = ends.groupBy("e.node").agg(F.sum("e.n").alias("larger"), F.min("e.n").alias("least"))
    return not seen.agg(F.max((F.col("larger") > 1) | (F.col("larger") > 0) & (F.col("least") == 0))).first()[0]


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """GR-04: node, root (the smallest id reachable) of every linked node, from links (a, b).

    Union-find as alternating large and small stars; each round is written to the shared folder, and the rounds end
    when only stars are left, which may be before the first.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    rounds = 0
    while not only_stars(edges):
        if rounds == most_rounds:
            raise RuntimeError(f"components are not stable after {most_rounds} rounds")
        # Large star: every larger neighbour of u points to u's smallest neighbour or itself.
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours point to the smallest of them.
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        before, edges = edges, stage(small.where("u <> v").distinct(), "links")
        release(before)
        rounds += 1
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def labelled_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """GR-04 with single nodes: node, root, size, degree, in_largest (ties: the lower root)."""
    roots = nodes.toDF("node").join(components(links.select("a", "b")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    largest = sizes.agg(F.max_by("root", F.struct("size", -F.col("root"))).alias("_largest"))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    out = roots.join(sizes, "root").join(degree, "node", "left").crossJoin(F.broadcast(largest))
    return out.select("node", "root", "size", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"), (F.col("root") == F.col("_largest")).alias("in_largest"))


def greedy_dedupe(points: DataFrame, distance: float) -> DataFrame:
    """GR-01: scan in order of (y, x, id) and keep a point if every kept one is farther than distance.

    The same set as the lexicographically first maximal independent set: in each round the points without an earlier
    undecided neighbour are kept and their neighbours go, until all are decided: a chain of points takes as many rounds
    as it has kept points. points (id, x, y); returns the kept ids.
    """
    p = points.toDF("id", "x", "y")
    near = pairs_within(p, p, distance, F.col("a_id") != F.col("b_id"))
    earlier = F.struct(F.col("ay").alias("y"), F.col("ax").alias("x"), F.col("a_id").alias("id")) < F.struct(F.col("by").alias("y"), F.col("bx").alias("x"), F.col("b_id").alias("id"))
    edges = stage(near.where(earlier).select(F.col("a_id").alias("first"), F.col("b_id").alias("then")), "dedupe-edges")
    dropped = []
    while not edges.isEmpty():
        # A node with no earlier undecided neighbour is kept; what follows it is dropped, with its edges.
        kept = edges.select("first").distinct().join(edges.select(F.col("then").alias("first")).distinct(), "first", "left_anti")
        gone = stage(edges.join(kept, "first", "left_semi").select(F.col("then").alias("id")).distinct(), "dedupe-gone")
        dropped.append(gone)
        left = edges.join(kept, "first", "left_anti").join(gone.withColumnRenamed("id", "first"), "first", "left_anti")
        before, edges = edges, stage(left.join(gone.withColumnRenamed("id", "then"), "then", "left_anti").select("first", "then"), "dedupe-edges")
        release(before)
    out = p.select("id")
    return out.join(reduce(DataFrame.union, dropped), "id", "left_anti") if dropped else out


def lattice_degree(points: DataFrame, pitch: float, width: float, height: float) -> DataFrame:
    """GR-03: annulus neighbours, near-edge flag, and keep (two neighbours, or one within 1.3 pitches of an edge)."""
    p = points.toDF("id", "x", "y")
    degree = annulus_edges(p, pitch).select(F.explode(F.array("a_id", "b_id")).alias("id")).groupBy("id").agg(F.count("*").alias("neighbours"))
    m = 1.3 * pitch
    edge = (F.col("x") <= m) | (F.col("y") <= m) | (F.col("x") >= width - m) | (F.col("y") >= height - m)
    out = p.join(degree, "id", "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0).cast("long"))).withColumn("near_edge", edge)
    return out.withColumn("keep", (F.col("neighbours") >= 2) | (F.col("near_edge") & (F.col("neighbours") >= 1)))


def grid_filter(points: DataFrame, radius: float) -> DataFrame:
    """GR-02: points near a line of at least two both in x and in y; an axis without such lines doesn't filter."""
    from gridlume.operators.ordered import clusters, nearest_centre

    out = points.withColumn("_all", F.lit(1))
    for axis in ("x", "y"):
        lines = clusters(points.withColumn("_all", F.lit(1)), "_all", axis, max(6.0, 0.32 * radius), support=2)
        if not lines.isEmpty():
            near = nearest_centre(out, lines, "_all", axis)
            out = near.where(F.abs(F.col(axis) - F.col("centre")) <= max(8.0, 0.38 * radius)).drop("cluster", "centre")
    return out.drop("_all")

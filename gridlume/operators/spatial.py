"""Spatial joins: points meet through grid cells, so every join is an equi-join with a residual distance test."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlume.operators.lineage import stage


def cell(value: Column, size: Column | float) -> Column:
    return F.floor(value / size).cast("long")


def in_cells(df: DataFrame, reach: Column, size: float, x: str = "x_px", y: str = "y_px") -> DataFrame:
    """One row for every cell that the square of half-width reach around the point touches."""
    span = lambda c: F.sequence(cell(F.col(c) - reach, size), cell(F.col(c) + reach, size))
    return df.withColumn("_cx", F.explode(span(x))).withColumn("_cy", F.explode(span(y)))


def own_cell(df: DataFrame, size: float, x: str = "x_px", y: str = "y_px") -> DataFrame:
    return df.withColumns({"_cx": cell(F.col(x), size), "_cy": cell(F.col(y), size)})


def squared_distance(ax: str, ay: str, bx: str, by: str) -> Column:
    dx, dy = F.col(ax) - F.col(bx), F.col(ay) - F.col(by)
    return (dx * dx + dy * dy).cast("double")


def circle_join(points: DataFrame, circles: DataFrame, share: float = 0.86, size: float = 64.0) -> DataFrame:
    """JN-07: every (point, circle) with d^2 <= (share * radius)^2. A point can lie in several circles.

    points (object_id, x_px, y_px), circles (well_id, x_px, y_px, radius_px).
    """
    c = circles.select("well_id", F.col("x_px").alias("wx"), F.col("y_px").alias("wy"), F.col("radius_px").alias("wr"))
    c = in_cells(c, F.col("wr") * share, size, "wx", "wy")
    both = own_cell(points, size).join(c, ["_cx", "_cy"]).withColumn("d2", squared_distance("x_px", "y_px", "wx", "wy"))
    return both.where(F.col("d2") <= F.pow(F.col("wr") * share, F.lit(2.0))).drop("_cx", "_cy")


def pairs_within(a: DataFrame, b: DataFrame, reach: float, extra: Column | None = None) -> DataFrame:
    """(a_id, b_id, d) of all points at most reach apart; both tables (id, x, y).

    Points are dealt before they are copied to cells, as a table of small rows may be one task's; cells of twice the reach take four
    copies of each. Spark's estimate doesn't know of the copies and would broadcast them, so both sides are merged by cell.
    """
    size = 2 * reach
    left = in_cells(a.toDF("a_id", "ax", "ay").repartition("a_id"), F.lit(reach), size, "ax", "ay").hint("merge")
    right = own_cell(b.toDF("b_id", "bx", "by"), size, "bx", "by")
    near = F.sqrt(squared_distance("ax", "ay", "bx", "by"))
    out = left.join(right, ["_cx", "_cy"]).withColumn("d", near).where(F.col("d") <= reach).drop("_cx", "_cy")
    return out if extra is None else out.where(extra)


def nearest(a: DataFrame, b: DataFrame, k: int = 1, reach: float = 64.0, same: bool = False) -> DataFrame:
    """JN-08, JN-09: each a's k nearest b (a_id, b_id, d, rank); equal distances by lower id.

    Points without k neighbours inside reach go on with twice the reach, until all are answered or reach covers
    both tables. same: a row isn't its own neighbour.
    """
    box = lambda df: df.toDF("i", "x", "y").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*"))
    p, q = box(a).first(), box(b).first()
    if not p[4] or not q[4]:
        return pairs_within(a, b, reach).select("a_id", "b_id", "d", F.lit(1).alias("rank")).limit(0)
    across = max(p[1], q[1]) - min(p[0], q[0]) + max(p[3], q[3]) - min(p[2], q[2]) + 1
    todo, done = a.toDF("a_id", "ax", "ay"), []
    by = Window.partitionBy("a_id").orderBy("d", "b_id")
    while True:
        near = pairs_within(todo, b, reach, F.col("a_id") != F.col("b_id") if same else None)
        best = stage(near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("a_id", "b_id", "d", "rank"), "nearest")
        if reach >= across:
            done.append(best)
            break
        full = best.where(F.col("rank") == k).select("a_id")
        done.append(best.join(full, "a_id", "left_semi"))
        todo = stage(todo.join(full, "a_id", "left_anti"), "nearest-todo")
        if todo.isEmpty():
            break
        reach *= 2
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def annulus_edges(points: DataFrame, pitch: float, low: float = 0.78, high: float = 1.22) -> DataFrame:
    """JN-10: pairs a_id < b_id with low * pitch <= d <= high * pitch."""
    return pairs_within(points, points, high * pitch, (F.col("a_id") < F.col("b_id")) & (F.col("d") >= low * pitch))


def mutual_nearest(base: DataFrame, follow: DataFrame, reach: float = 64.0) -> DataFrame:
    """JN-11: every base point's nearest follow-up point, and whether it is the nearest both ways."""
    there = nearest(base, follow, 1, reach).select("a_id", "b_id", "d")
    back = nearest(follow, base, 1, reach).select(F.col("a_id").alias("b_id"), F.col("b_id").alias("_back"))
    return there.join(back, "b_id").select("a_id", "b_id", "d", (F.col("_back") == F.col("a_id")).alias("mutual"))


def affine(x: Column, y: Column, m: tuple[float, ...]) -> tuple[Column, Column]:
    """GR-07: a 2 by 3 matrix (a, b, c, d, e, f) applied to a point."""
    a, b, c, d, e, f = (F.lit(float(v)) for v in m)
    return a * x + b * y + c, d * x + e * y + f


def manual_affine(scale: float, degrees: float, dx: float, dy: float, base: tuple[float, float], follow: tuple[float, float]) -> tuple[float, ...]:
    """GR-07: scaled rotation (counter-clockwise, y down) about the base's centre, which goes to the follow-up's plus a shift."""
    from math import cos, radians, sin

    a, b = scale * cos(radians(degrees)), scale * sin(radians(degrees))
    cx, cy = base[0] / 2, base[1] / 2
    tx, ty = follow[0] / 2 + dx, follow[1] / 2 + dy
    return a, b, tx - a * cx - b * cy, -b, a, ty + b * cx - a * cy


#: Rows of a block of the left and of the right side, and left rows that are compared at once.
LEFT, RIGHT, AT_ONCE = 2048, 8192, 256


def matrix(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of float32, filled up to the longest, and which of their numbers there are."""
    one = lists.combine_chunks()
    sizes = np.asarray(pc.fill_null(pc.list_value_length(one), 0), np.int64)
    values = one.flatten()
    there = np.arange(sizes.max(initial=0))[None] < sizes[:, None]
    out, known = np.zeros(there.shape, np.float32), there.copy()
    out[there] = values.to_numpy(zero_copy_only=False)
    known[there] = np.asarray(values.is_valid())
    return np.where(known, out, np.float32(0)), known


def exact_squares(u: np.ndarray, ku: np.ndarray, v: np.ndarray, kv: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows over the places that both have, to nine digits; nan with none."""
    w = min(u.shape[1], v.shape[1])
    both = ku[:, :w] & kv[:, :w]
    off = np.where(both, u[:, :w] - v[:, :w], np.float32(0)).astype(np.float64)
    if not w:
        return np.full(len(u), np.nan)
    total = np.cumsum(off * off, axis=1)[:, -1]
    return np.where(both.any(1), np.floor(total * 1e9 + 0.5) / 1e9, np.nan)


def two_best(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
    """The two nearest right rows of each left row: products give a bound that is a little too wide, what is within is measured exactly."""
    ids, others = (t.column(0).to_numpy() for t in (left, right))
    (u, ku), (v, kv) = matrix(left.column(1)), matrix(right.column(1))
    width = max(u.shape[1], v.shape[1])
    plain = lambda m, k: (k.all(1) & np.isfinite(m).all(1)) if m.shape[1] == width and width else np.zeros(len(m), bool)
    pu, pv = plain(u, ku), plain(v, kv)
    good, odd = np.flatnonzero(pv), np.flatnonzero(~pv)
    v64 = v[good].astype(np.float64)
    vv = (v64 * v64).sum(1)
    order = np.argsort(others[good], kind="stable")
    found = []
    for at in range(0, len(ids), AT_ONCE):
        rows = np.arange(at, min(at + AT_ONCE, len(ids)))
        near = np.zeros((len(rows), len(others)), bool)
        near[:, odd] = True
        near[~pu[rows]] = True
        some = rows[pu[rows]]
        if len(some) and len(good):
            a = u[some].astype(np.float64)
            uu = (a * a).sum(1)
            d2 = uu[:, None] + vv[None] - 2 * (a @ v64.T)
            if same:
                lo, hi = (np.searchsorted(others[good][order], ids[some], side) for side in ("left", "right"))
                for i in np.flatnonzero(hi > lo):
                    d2[i, order[lo[i] : hi[i]]] = np.inf
            second = np.partition(d2, 1, axis=1)[:, 1] if len(good) > 1 else np.full(len(some), np.inf)
            bound = second * (1 + 1e-6) + 4e-9 + 1e-12 * (uu + vv.max())
            near[np.ix_(some - at, good)] = d2 <= bound[:, None]
        l, r = near.nonzero()
        l = l + at
        if same:
            l, r = l[(apart := ids[l] != others[r])], r[apart]
        for i in range(0, len(l), 1 << 16):
            some = slice(i, i + (1 << 16))
            with np.errstate(all="ignore"):
                d = exact_squares(u[l[some]], ku[l[some]], v[r[some]], kv[r[some]])
            # lexsort puts nan last; two of a slice's rows are enough
            by = np.lexsort((others[r[some]], d, l[some]))
            who = l[some][by]
            keep = np.ones(len(by), bool)
            keep[2:] = who[2:] != who[:-2]
            found.append((ids[who[keep]], others[r[some][by][keep]], d[by][keep]))
    columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [ids[:0], others[:0], np.zeros(0)]
    return pa.table({"left_id": columns[0], "right_id": columns[1], "d2": pa.array(columns[2], mask=np.isnan(columns[2]))})


def blocked_two_nearest(left: DataFrame, right: DataFrame, same: bool = False) -> DataFrame:
    """JN-14: each left vector's two nearest right vectors by exact distance (left_id, right_id, d, rank), equal ones by lower id.

    Every left row meets every right row, in pairs of blocks of about LEFT and RIGHT rows, whatever the tables' size; each keeps its
    two best, and these are put together. The work is the product of the sides. Distances are taken over the numbers that both vectors have, and without any
    they are null and last. same: both are of one table, and a row is not its own neighbour.
    """
    l, r = left.toDF("left_id", "u").where("left_id IS NOT NULL"), right.toDF("right_id", "v").where("right_id IS NOT NULL")
    lefts, rights = max(1, -(-l.count() // LEFT)), max(1, -(-r.count() // RIGHT))
    block = lambda k, n: F.pmod(F.xxhash64(k), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    l = l.withColumn("i", block("left_id", lefts)).withColumn("j", every(rights))
    r = r.withColumn("j", block("right_id", rights)).withColumn("i", every(lefts))
    found = l.groupBy("i", "j").cogroup(r.groupBy("i", "j")).applyInArrow(lambda a, b: two_best(a.select(["left_id", "u"]), b.select(["right_id", "v"]), same), "left_id bigint, right_id bigint, d2 double")
    best = F.row_number().over(Window.partitionBy("left_id").orderBy(F.col("d2").asc_nulls_last(), "right_id"))
    return found.withColumn("rank", best).where("rank <= 2").select("left_id", "right_id", F.sqrt("d2").alias("d"), "rank")

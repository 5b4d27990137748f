"""The hexagonal lattice of an array: a robust fit, the straight region it fills, and its sites with what was found there."""

from __future__ import annotations

from math import cos, pi, sin
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlume.operators import summaries as A
from gridlume.operators.graph import labelled_components
from gridlume.operators.lineage import stage
from gridlume.operators.spatial import annulus_edges, pairs_within

c = F.col
#: Share of the pitch within which a point belongs to its site in the fit, and a well to a predicted site.
INLIER, MATCH = 0.32, 0.34
#: Rows and columns of sites beyond those of the points.
BEYOND = 3


class Basis(NamedTuple):
    """x = ox + u ax + v bx, y = oy + u ay + v by."""

    ox: float
    oy: float
    ax: float
    ay: float
    bx: float
    by: float

    def site(self) -> dict[str, Column]:
        """The nearest (u, v) of x, y: halves go to the even number; nine digits, so that noise doesn't decide."""
        det = self.ax * self.by - self.bx * self.ay
        dx, dy = c("x") - self.ox, c("y") - self.oy
        rint = lambda value: F.bround(F.round(value / det, 9)).cast("long")
        return {"u": rint(dx * self.by - dy * self.bx), "v": rint(dy * self.ax - dx * self.ay)}

    def place(self) -> dict[str, Column]:
        return {"x": self.ox + c("u") * self.ax + c("v") * self.bx, "y": self.oy + c("u") * self.ay + c("v") * self.by}

    def holds(self, u: Column, v: Column, reach: float) -> Column:
        """Whether x, y is within reach of the site (u, v)."""
        ex, ey = c("x") - (self.ox + u * self.ax + v * self.bx), c("y") - (self.oy + u * self.ay + v * self.by)
        return F.round(F.sqrt(ex * ex + ey * ey), 6) <= round(reach, 6)


class LatticeFit(NamedTuple):
    """basis: fitted. sites: the basis by which points were last given their (u, v). kept: None, when all points are inliers, or
    the pair of bases whose sites and places tell them."""

    basis: Basis
    sites: Basis
    kept: tuple[Basis, Basis] | None
    pitch: float
    rounds: int

    def placed(self, points: DataFrame) -> DataFrame:
        """points (id, x, y) with u, v and whether each is an inlier."""
        return points.withColumns({**self.sites.site(), "inlier": inside(self.kept, self.pitch)})


def inside(kept: tuple[Basis, Basis] | None, pitch_px: float) -> Column:
    if kept is None:
        return F.lit(True)
    site = kept[0].site()
    return kept[1].holds(site["u"], site["v"], INLIER * pitch_px)


def fit_lattice(points: DataFrame, pitch_px: float, angle: float, rounds: int = 5) -> LatticeFit:
    """AG-21: from the median point and the pitch at angle, points are given their sites and the inliers fitted by least squares;
    points within INLIER pitches of their site are the next inliers, all of them at first. It ends when the inliers stay the
    same, when fewer than 50 or half of the points are left (the ones before then stay), or after rounds.

    points (id, x, y). Two rows of sums a round reach the driver.
    """
    middle = [A.quantile_row(points, k, {"m": 0.5}).first()["m"] for k in "xy"]
    if None in middle:
        raise ValueError("there are no points to fit a lattice to")
    basis = Basis(*middle, pitch_px * cos(angle), pitch_px * sin(angle), pitch_px * cos(angle + pi / 3), pitch_px * sin(angle + pi / 3))
    kept, n_all = None, points.count()
    for number in range(1, rounds + 1):
        sites = basis
        own = points.withColumns(sites.site()).where(inside(kept, pitch_px))
        mean = [F.avg(k).alias(f"m{k}") for k in "uvxy"]
        s = own.agg(*mean, *(F.covar_pop(i, j).alias(i + j) for i, j in ("uu", "uv", "vv", "ux", "vx", "uy", "vy"))).first()
        d = s["uu"] * s["vv"] - s["uv"] ** 2
        if not d:
            raise ValueError("the points lie on one line of the lattice")
        slope = {k: ((s[f"u{k}"] * s["vv"] - s[f"v{k}"] * s["uv"]) / d, (s[f"v{k}"] * s["uu"] - s[f"u{k}"] * s["uv"]) / d) for k in "xy"}
        origin = [s[f"m{k}"] - slope[k][0] * s["mu"] - slope[k][1] * s["mv"] for k in "xy"]
        basis = Basis(*origin, slope["x"][0], slope["y"][0], slope["x"][1], slope["y"][1])
        now = inside((sites, basis), pitch_px)
        n, changed = points.agg(F.count_if(now), F.count_if(now != inside(kept, pitch_px))).first()
        if not changed or n < max(50, n_all / 2):
            break
        kept = (sites, basis)
    return LatticeFit(basis, sites, kept, pitch_px, number)


class Reconstruction(NamedTuple):
    """fit: of the largest group of neighbours, which seed holds (id, x, y, u, v, inlier). axes, region: one row each."""

    fit: LatticeFit
    seed: DataFrame
    axes: DataFrame
    region: DataFrame


def reconstruct(points: DataFrame, diameter: float) -> Reconstruction:
    """The lattice of an array of circles, from points (id, x, y) alone: pitch, largest component, angle, fit, straight region.

    The pitch of AG-16, a median of smallest distances, is short where points are off their sites; it serves to find the
    neighbours, whose median distance is the pitch of the fit.
    """
    p = stage(points, "lattice-points")
    near = pairs_within(p, p, 2.20 * diameter, c("a_id") != c("b_id"))
    pitch_px = float(A.pitch(near, diameter, p.count()).first()["pitch"])
    edges = stage(annulus_edges(p, pitch_px), "lattice-edges")
    largest = labelled_components(p.select("id"), edges.select(c("a_id").alias("a"), c("b_id").alias("b"))).where("in_largest")
    seed = stage(p.join(largest.select(c("node").alias("id")), "id", "left_semi"), "lattice-seed")
    own = edges.join(seed.select(c("id").alias("a_id")), "a_id", "left_semi")
    angle, pitch_px = A.hex_angle(own).first()["angle"], float(A.quantile_row(own, "d", {"m": 0.5}).first()["m"])
    fit = fit_lattice(seed, pitch_px, float(angle))
    placed = stage(fit.placed(seed), "lattice-placed")
    inliers = placed.where("inlier")
    axes = A.pca_axes(inliers)
    return Reconstruction(fit, placed, axes, A.robust_bounds(inliers, axes, pitch_px))


def within_region(points: DataFrame, found: Reconstruction) -> DataFrame:
    """points (id, x, y) with along, across, and whether they lie in the straight region; without a region none does."""
    region = found.region.toDF("_left", "_right", "_start", "_end")
    rounded = lambda k: F.round(k, 4)
    inside_ = rounded("along").between(rounded("_start"), rounded("_end")) & rounded("across").between(rounded("_left"), rounded("_right"))
    out = A.on_axes(points, found.axes).crossJoin(F.broadcast(region))
    return out.withColumn("inside", F.coalesce(inside_, F.lit(False))).drop("_left", "_right", "_start", "_end")


def predicted_sites(found: Reconstruction) -> DataFrame:
    """GR-05: the lattice's sites (u, v, x, y, along, across) inside the region, as far as BEYOND rows past the seed's.

    Sites are made in tasks from the fit; only the range of (u, v) reaches the driver.
    """
    u0, u1, v0, v1 = found.seed.agg(F.min("u") - BEYOND, F.max("u") + BEYOND, F.min("v") - BEYOND, F.max("v") + BEYOND).first()
    spark, down = found.seed.sparkSession, v1 - v0 + 1
    ids = spark.range((u1 - u0 + 1) * down).select("id", (F.expr(f"id div {down}") + u0).alias("u"), (c("id") % down + v0).alias("v"))
    sites = ids.withColumns(found.fit.basis.place())
    return within_region(sites.select("id", "x", "y"), found).where("inside").join(sites.select("id", "u", "v"), "id").select("u", "v", "x", "y", "along", "across")


def site_status(found: Reconstruction, sites: DataFrame, points: DataFrame) -> DataFrame:
    """JN-13: for each site (u, v, x, y) the nearest point within MATCH pitches, ties to the lower id, and its status: observed when
    it is of the seed, else recovered; missing where there is none. Points farther off aren't looked for."""
    key = F.struct("u", "v").alias("id")
    near = pairs_within(sites.select(key, "x", "y"), points, MATCH * found.fit.pitch)
    best = near.withColumn("d", F.round("d", 6)).groupBy("a_id").agg(F.min(F.struct("d", "b_id")).alias("m")).select(c("a_id.u").alias("u"), c("a_id.v").alias("v"), c("m.b_id").alias("well_id"), c("m.d").alias("d"))
    seed = found.seed.select(c("id").alias("well_id"), F.lit(True).alias("_seed"))
    out = sites.join(best, ["u", "v"], "left").join(seed, "well_id", "left")
    status = F.when(c("well_id").isNull(), "missing").when(c("_seed"), "observed").otherwise("recovered")
    return out.select("u", "v", "x", "y", "well_id", "d", status.alias("status"))

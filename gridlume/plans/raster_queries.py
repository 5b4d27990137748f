"""Queries of the iterative spatial operators and of the raster operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlume.operators import graph, raster as R
from gridlume.operators import lattice as L
from gridlume.operators import spatial as G
from gridlume.operators import summaries as A
from gridlume.operators.lineage import stage
from gridlume.plans.registry import query
from gridlume.plans.table_queries import DIST, EDGES, MATCH, MATRIX, PCA, matches, pts, r6
from gridlume.plans.views import Tables

c = F.col
REACH = "reach AS (SELECT well_id AS node, well_id AS r FROM v_points UNION SELECT reach.node, CASE WHEN e.a_id = reach.r THEN e.b_id ELSE e.a_id END FROM reach JOIN edges e ON e.a_id = reach.r OR e.b_id = reach.r)"
BOTH = "both_ways AS (SELECT a_id AS a, b_id AS b FROM edges UNION ALL SELECT b_id, a_id FROM edges), reach AS (SELECT well_id AS node, well_id AS r FROM v_points UNION SELECT reach.node, e.b FROM reach JOIN both_ways e ON e.a = reach.r), comp AS (SELECT node, min(r) AS root FROM reach GROUP BY 1)"


@query(
    "gr_01",
    """WITH o AS (SELECT well_id, CAST(x_px AS BIGINT) AS x, CAST(y_px AS BIGINT) AS y, row_number() OVER (ORDER BY y_px, x_px, well_id) AS i FROM v_points_raw),
s AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(x BIGINT, y BIGINT, id BIGINT)[]) AS kept
UNION ALL SELECT o.i, CASE WHEN len(list_filter(s.kept, lambda k: (k.x - o.x) * (k.x - o.x) + (k.y - o.y) * (k.y - o.y) <= 400)) = 0 THEN list_append(s.kept, {'x': o.x, 'y': o.y, 'id': o.well_id}) ELSE s.kept END FROM s JOIN o ON o.i = s.i + 1),
done AS (SELECT unnest(kept) AS k FROM s WHERE i = (SELECT max(i) FROM o)) SELECT k.id AS well_id FROM done""",
    "v_points_raw",
    recursive=True,
)
def gr_01(t: Tables) -> DataFrame:
    return graph.greedy_dedupe(pts(t.points_raw), 20.0).select(c("id").alias("well_id"))


def line_fold(name: str, value: str) -> str:
    step = "abs(v.x - s / n) <= 8"
    return f"""v{name} AS (SELECT CAST({value} AS DOUBLE) AS x, row_number() OVER (ORDER BY {value}) AS i FROM v_points),
f{name} AS (SELECT i, x, 1 AS k, x AS s, 1 AS n FROM v{name} WHERE i = 1 UNION ALL SELECT v.i, v.x, CASE WHEN {step} THEN k ELSE k + 1 END, CASE WHEN {step} THEN s + v.x ELSE v.x END, CASE WHEN {step} THEN n + 1 ELSE 1 END FROM f{name} f JOIN v{name} v ON v.i = f.i + 1),
c{name} AS (SELECT k, avg(x) AS centre FROM f{name} GROUP BY 1 HAVING count(*) >= 2)"""


@query("gr_02", f"WITH {line_fold('x', 'x_px')}, {line_fold('y', 'y_px')} SELECT well_id FROM v_points p WHERE (SELECT min(abs(p.x_px - centre)) FROM cx) <= CAST(9.5 AS DOUBLE) AND (SELECT min(abs(p.y_px - centre)) FROM cy) <= CAST(9.5 AS DOUBLE)", "v_points", recursive=True)
def gr_02(t: Tables) -> DataFrame:
    return graph.grid_filter(pts(t.points), 25.0).select(c("id").alias("well_id"))


@query("gr_03", f"""WITH {EDGES}, d AS (SELECT id, count(*) AS n FROM (SELECT a_id AS id FROM edges UNION ALL SELECT b_id FROM edges) GROUP BY 1),
a AS (SELECT well_id, coalesce(n, 0) AS neighbours, x_px <= 78 OR y_px <= 78 OR x_px >= w - 78 OR y_px >= h - 78 AS near_edge FROM v_points CROSS JOIN (SELECT max(x_px) + 1 AS w, max(y_px) + 1 AS h FROM v_points) LEFT JOIN d ON d.id = well_id)
SELECT *, neighbours >= 2 OR (near_edge AND neighbours >= 1) AS keep FROM a""", "v_points")
def gr_03(t: Tables) -> DataFrame:
    return graph.lattice_degree(pts(t.points), 60.0, *t.extent).select(c("id").alias("well_id"), "neighbours", "near_edge", "keep")


def lattice_components(t: Tables) -> DataFrame:
    p = pts(t.points)
    edges = stage(G.annulus_edges(p, 60.0).select(c("a_id").alias("a"), c("b_id").alias("b")), "annulus")
    return graph.labelled_components(p.select("id"), edges)


SIZES = ", sizes AS (SELECT root, count(*) AS size FROM comp GROUP BY 1), deg AS (SELECT a AS node, count(*) AS degree FROM both_ways GROUP BY 1), top AS (SELECT root FROM sizes ORDER BY size DESC, root LIMIT 1)"


@query("gr_04", f"WITH {EDGES}, {BOTH}{SIZES} SELECT comp.node, root, size, coalesce(degree, 0) AS degree, root = (SELECT root FROM top) AS in_largest FROM comp JOIN sizes USING (root) LEFT JOIN deg ON deg.node = comp.node", "v_points", recursive=True)
def gr_04(t: Tables) -> DataFrame:
    return lattice_components(t)


@query("ag_18", f"WITH {EDGES}, {BOTH}{SIZES} SELECT root, size, min(x_px) AS x0, max(x_px) AS x1, min(y_px) AS y0, max(y_px) AS y1, round(size / (SELECT count(*) FROM v_points)::DOUBLE, 6) AS share FROM comp JOIN sizes USING (root) JOIN v_points ON well_id = node GROUP BY root, size ORDER BY size DESC, root LIMIT 20", "v_points", recursive=True)
def ag_18(t: Tables) -> DataFrame:
    p = t.points.select(c("well_id").alias("node"), "x_px", "y_px")
    boxes = lattice_components(t).join(p, "node").groupBy("root").agg(F.count("*").alias("size"), F.min("x_px").alias("x0"), F.max("x_px").alias("x1"), F.min("y_px").alias("y0"), F.max("y_px").alias("y1"))
    total = t.points.agg(F.count("*").alias("_n"))
    return boxes.crossJoin(F.broadcast(total)).withColumn("share", F.round(c("size") / c("_n"), 6)).drop("_n").orderBy(c("size").desc(), "root").limit(20)


def round_sql(k: int) -> str:
    """One round of the robust fit: sites by the basis before, least squares on the inliers, and whether it goes on."""
    o = k - 1
    rint = lambda e: f"CAST(round_even(round(({e}) / (ax * byy - bx * ay), 9), 0) AS BIGINT)"
    taken = ", ".join(f"CASE WHEN o.stop THEN o.{n} ELSE f.{n} END AS {n}" for n in ("ox", "oy", "ax", "ay", "bx", "byy"))
    return f"""uv{k} AS MATERIALIZED (SELECT id, x, y, p.u AS pu, p.v AS pv, keep, {rint("(x - ox) * byy - (y - oy) * bx")} AS u, {rint("(y - oy) * ax - (x - ox) * ay")} AS v FROM pts{o} p, fit{o}),
s{k} AS (SELECT avg(u) AS mu, avg(v) AS mv, avg(x) AS mx, avg(y) AS my, covar_pop(u, u) AS uu, covar_pop(u, v) AS uv, covar_pop(v, v) AS vv, covar_pop(u, x) AS ux, covar_pop(v, x) AS vx, covar_pop(u, y) AS uy, covar_pop(v, y) AS vy FROM uv{k} WHERE keep),
c{k} AS (SELECT *, (ux * vv - vx * uv) / (uu * vv - uv * uv) AS ax, (vx * uu - ux * uv) / (uu * vv - uv * uv) AS bx, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS ay, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS byy FROM s{k}),
f{k} AS (SELECT mx - ax * mu - bx * mv AS ox, my - ay * mu - byy * mv AS oy, ax, ay, bx, byy FROM c{k}),
new{k} AS MATERIALIZED (SELECT w.*, round(sqrt(pow(x - (ox + u * ax + v * bx), 2) + pow(y - (oy + u * ay + v * byy), 2)), 6) <= round(CAST(0.32 AS DOUBLE) * pitch, 6) AS nk FROM uv{k} w, f{k}, pit),
t{k} AS (SELECT count(*) FILTER (nk <> keep) = 0 AS same, count(*) FILTER (nk) < greatest(50, count(*) / 2.0::DOUBLE) AS few FROM new{k}),
fit{k} AS MATERIALIZED (SELECT {taken}, o.stop OR same OR few AS stop FROM fit{o} o, f{k} f, t{k}),
pts{k} AS MATERIALIZED (SELECT id, x, y, CASE WHEN o.stop THEN pu ELSE n.u END AS u, CASE WHEN o.stop THEN pv ELSE n.v END AS v, CASE WHEN o.stop OR same OR few THEN keep ELSE nk END AS keep FROM new{k} n, fit{o} o, t{k})"""


LATTICE = f"""WITH dia AS (SELECT 2 * quantile_cont(radius_px, 0.5) AS dia FROM v_points),
nb AS (SELECT a_id, min(d) AS d FROM (SELECT a.well_id AS a_id, {DIST} AS d FROM v_points a JOIN v_points b ON a.well_id <> b.well_id), dia WHERE d BETWEEN CAST(1.03 AS DOUBLE) * dia AND CAST(2.2 AS DOUBLE) * dia GROUP BY 1),
pit0 AS MATERIALIZED (SELECT quantile_cont(d, 0.5) AS pitch FROM nb),
edges AS MATERIALIZED (SELECT e.* FROM (SELECT a.well_id AS a_id, b.well_id AS b_id, a.x_px AS ax, a.y_px AS ay, b.x_px AS bx, b.y_px AS b_y, {DIST} AS d FROM v_points a JOIN v_points b ON a.well_id < b.well_id) e, pit0 WHERE d BETWEEN CAST(0.78 AS DOUBLE) * pitch AND CAST(1.22 AS DOUBLE) * pitch),
{BOTH}{SIZES}, seed AS MATERIALIZED (SELECT well_id AS id, CAST(x_px AS DOUBLE) AS x, CAST(y_px AS DOUBLE) AS y FROM v_points JOIN comp ON node = well_id WHERE root = (SELECT root FROM top)),
th AS (SELECT atan2(avg(sin(6 * t)), avg(cos(6 * t))) / 6 AS g FROM (SELECT atan2(b_y - ay, bx - ax) AS t FROM edges WHERE a_id IN (SELECT id FROM seed))),
pit AS MATERIALIZED (SELECT quantile_cont(d, 0.5) AS pitch FROM edges WHERE a_id IN (SELECT id FROM seed)),
mid AS (SELECT quantile_cont(x, 0.5) AS ox, quantile_cont(y, 0.5) AS oy FROM seed),
fit0 AS MATERIALIZED (SELECT ox, oy, pitch * cos(g) AS ax, pitch * sin(g) AS ay, pitch * cos(g + pi() / 3) AS bx, pitch * sin(g + pi() / 3) AS byy, false AS stop FROM mid, th, pit),
pts0 AS (SELECT id, x, y, CAST(0 AS BIGINT) AS u, CAST(0 AS BIGINT) AS v, true AS keep FROM seed),
{", ".join(round_sql(k) for k in range(1, 6))}"""
REGION = LATTICE + """, lm AS (SELECT avg(x) AS cx, avg(y) AS cy, atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) / 2 AS g FROM pts5 WHERE keep),
laxes AS (SELECT cx, cy, cos(g) * CASE WHEN sin(g) < 0 THEN -1 ELSE 1 END AS lx, sin(g) * CASE WHEN sin(g) < 0 THEN -1 ELSE 1 END AS ly FROM lm),
lp AS (SELECT (x - cx) * lx + (y - cy) * ly AS al, -(x - cx) * ly + (y - cy) * lx AS ac FROM pts5, laxes WHERE keep),
lq AS (SELECT quantile_cont(al, 0.005) AS a, quantile_cont(al, 0.01) AS b, quantile_cont(al, 0.99) AS c, quantile_cont(al, 0.995) AS d FROM lp),
lbins AS (SELECT least(43, floor((al - b) / (c - b) * 44)) AS bin, min(ac) AS lo, max(ac) AS hi FROM lp, lq WHERE al BETWEEN b AND c GROUP BY 1 HAVING count(*) >= 20),
m AS (SELECT CAST(0.45 AS DOUBLE) * pitch AS m FROM pit), region AS (SELECT quantile_cont(lo, 0.1) - any_value(m) AS l, quantile_cont(hi, 0.9) + any_value(m) AS r, (SELECT a FROM lq) - any_value(m) AS s, (SELECT d FROM lq) + any_value(m) AS e FROM lbins, m),
span AS (SELECT min(u) - 3 AS u0, max(u) + 3 AS u1, min(v) - 3 AS v0, max(v) + 3 AS v1 FROM pts5),
grid AS (SELECT u, v, ox + u * ax + v * bx AS x, oy + u * ay + v * byy AS y FROM (SELECT unnest(generate_series(u0, u1)) AS u FROM span), (SELECT unnest(generate_series(v0, v1)) AS v FROM span), fit5),
placed AS (SELECT u, v, x, y, (x - cx) * lx + (y - cy) * ly AS al, -(x - cx) * ly + (y - cy) * lx AS ac FROM grid, laxes),
sites AS MATERIALIZED (SELECT placed.* FROM placed, region WHERE round(al, 4) BETWEEN round(s, 4) AND round(e, 4) AND round(ac, 4) BETWEEN round(l, 4) AND round(r, 4))"""


def reconstruction(t: Tables) -> L.Reconstruction:
    diameter = 2 * A.quantile_row(t.points.select(c("radius_px").cast("double").alias("r")), "r", {"m": 0.5}).first()["m"]
    return L.reconstruct(pts(t.points), diameter)


@query("ag_21", LATTICE + " SELECT round(ox, 4) AS ox, round(oy, 4) AS oy, round(ax, 5) AS ax, round(ay, 5) AS ay, round(bx, 5) AS bx, round(byy, 5) AS \"by\", (SELECT count(*) FROM pts5 WHERE keep) AS inliers FROM fit5", "v_points", recursive=True)
def ag_21(t: Tables) -> DataFrame:
    found = reconstruction(t)
    digits = {"ox": 4, "oy": 4, "ax": 5, "ay": 5, "bx": 5, "by": 5}
    fit = [F.lit(round(v, digits[k])).alias(k) for k, v in found.fit.basis._asdict().items()]
    return found.seed.agg(F.count_if("inlier").alias("inliers")).select(*fit, "inliers")


@query("gr_05", REGION + ' SELECT u, v, round(x, 3) AS x, round(y, 3) AS y, round(al, 3) AS along, round(ac, 3) AS across FROM sites', "v_points", recursive=True)
def gr_05(t: Tables) -> DataFrame:
    return L.predicted_sites(reconstruction(t)).withColumns({k: F.round(k, 3) for k in ("x", "y", "along", "across")})


@query("jn_13", REGION + """, near AS (SELECT u, v, well_id, round(sqrt((x - x_px) * (x - x_px) + (y - y_px) * (y - y_px)), 6) AS d FROM sites, v_points, pit WHERE sqrt((x - x_px) * (x - x_px) + (y - y_px) * (y - y_px)) <= CAST(0.34 AS DOUBLE) * pitch),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY d, well_id) AS k FROM near) WHERE k = 1)
SELECT sites.u, sites.v, well_id, round(d, 3) AS d, CASE WHEN well_id IS NULL THEN 'missing' WHEN well_id IN (SELECT id FROM seed) THEN 'observed' ELSE 'recovered' END AS status FROM sites LEFT JOIN best ON sites.u = best.u AND sites.v = best.v""", "v_points", recursive=True)
def jn_13(t: Tables) -> DataFrame:
    found = reconstruction(t)
    return L.site_status(found, L.predicted_sites(found), pts(t.points)).select("u", "v", "well_id", F.round("d", 3).alias("d"), "status")


ROI = PCA + """, p AS (SELECT well_id, (x_px - cx) * lx + (y_px - cy) * ly AS al, -(x_px - cx) * ly + (y_px - cy) * lx AS ac FROM v_points, axes),
q AS (SELECT quantile_cont(al, 0.005) AS a, quantile_cont(al, 0.01) AS b, quantile_cont(al, 0.99) AS c, quantile_cont(al, 0.995) AS d FROM p),
bins AS (SELECT least(43, floor((al - b) / (c - b) * 44)) AS bin, min(ac) AS lo, max(ac) AS hi FROM p, q WHERE al BETWEEN b AND c GROUP BY 1 HAVING count(*) >= 20),
roi AS (SELECT quantile_cont(lo, 0.1) - 27 AS l, quantile_cont(hi, 0.9) + 27 AS r, (SELECT a FROM q) - 27 AS s, (SELECT d FROM q) + 27 AS e FROM bins)"""


@query("ag_22", ROI + ' SELECT round(l, 4) AS "left", round(r, 4) AS "right", round(s, 4) AS start, round(e, 4) AS "end" FROM roi', "v_points")
def ag_22(t: Tables) -> DataFrame:
    p = pts(t.points)
    return A.robust_bounds(p, A.pca_axes(p), 60.0).select(*[F.round(k, 4).alias(k) for k in ("left", "right", "start", "end")])


@query("gr_06", REGION + """, st AS (SELECT well_id, CASE WHEN well_id IN (SELECT id FROM seed) THEN 'original' WHEN round((x_px - cx) * lx + (y_px - cy) * ly, 4) BETWEEN round(s, 4) AND round(e, 4) AND round(-(x_px - cx) * ly + (y_px - cy) * lx, 4) BETWEEN round(l, 4) AND round(r, 4) THEN 'recovered' ELSE 'outside' END AS status FROM v_points, laxes, region)
SELECT status, count(DISTINCT st.well_id) AS wells, count(o.object_id) AS objects FROM st LEFT JOIN v_object_points o ON o.object_id % 1500 = st.well_id GROUP BY 1""", "v_points", "v_object_points", recursive=True)
def gr_06(t: Tables) -> DataFrame:
    found = reconstruction(t)
    seed = found.seed.select("id", F.lit(True).alias("_seed"))
    status = F.when(c("_seed"), "original").when(c("inside"), "recovered").otherwise("outside")
    wells = L.within_region(pts(t.points), found).join(seed, "id", "left").select(c("id").alias("well_id"), status.alias("status"))
    objects = t.object_points.select((c("object_id") % 1500).alias("well_id"), "object_id")
    per = wells.join(objects, "well_id", "left").groupBy("status", "well_id").agg(F.count("object_id").alias("n"))
    return per.groupBy("status").agg(F.count("*").alias("wells"), F.sum("n").alias("objects"))


@query("gr_07", "SELECT well_id, round(CAST(1.079342 AS DOUBLE) * x_px - CAST(0.037691 AS DOUBLE) * y_px + 42, 6) AS x, round(CAST(0.037691 AS DOUBLE) * x_px + CAST(1.079342 AS DOUBLE) * y_px + 18, 6) AS y, round(2 * (x_px - 50) + 110::DOUBLE, 6) AS manual_x FROM v_points", "v_points")
def gr_07(t: Tables) -> DataFrame:
    x, y = G.affine(c("x_px"), c("y_px"), MATRIX)
    manual = G.manual_affine(2.0, 0.0, 10.0, -5.0, (100, 100), (200, 200))
    return t.points.select("well_id", r6(x, "x"), r6(y, "y"), r6(G.affine(c("x_px"), c("y_px"), manual)[0], "manual_x"))


EXTENT = "e AS (SELECT CAST(max(x_px) + 1 AS BIGINT) AS aw, CAST(max(y_px) + 1 AS BIGINT) AS ah FROM v_points)"
TILES = f"""{EXTENT}, tx AS (SELECT unnest(range(0, (aw + 511) // 512)) AS u, aw FROM e), ty AS (SELECT unnest(range(0, (ah + 511) // 512)) AS v, ah FROM e),
tiles AS (SELECT CAST(v AS BIGINT) AS tile_y, CAST(u AS BIGINT) AS tile_x, u * 512 AS x0, v * 512 AS y0, least(512, aw - u * 512) AS w, least(512, ah - v * 512) AS h, aw FROM tx CROSS JOIN ty)"""


@query("gr_08", f"WITH {TILES} SELECT tile_y, tile_x, x0, y0, w, h, greatest(0, x0 - 96) AS halo_x0, least(aw, x0 + w + 96) AS halo_x1, count(well_id) AS wells FROM tiles LEFT JOIN v_points ON x_px >= x0 AND x_px < x0 + w AND y_px >= y0 AND y_px < y0 + h GROUP BY ALL", "v_points")
def gr_08(t: Tables) -> DataFrame:
    from gridlume.operators.tiles import tile_grid

    tiles = tile_grid(t.spark, *t.extent, 512, 96)
    at = t.points.where("x_px >= 0 AND y_px >= 0").groupBy(F.expr("x_px div 512").alias("tile_x"), F.expr("y_px div 512").alias("tile_y")).agg(F.count("*").alias("wells"))
    return tiles.join(at, ["tile_y", "tile_x"], "left").withColumn("wells", F.coalesce("wells", F.lit(0).cast("long")))


@query("gr_09", f"WITH {EXTENT} SELECT well_id, least((aw - 1) // 512, greatest(0, x_px) // 512) AS tile_x, least((ah - 1) // 512, greatest(0, y_px) // 512) AS tile_y FROM v_points CROSS JOIN e", "v_points")
def gr_09(t: Tables) -> DataFrame:
    width, height = t.extent
    at = lambda k, n: F.least(F.lit((n - 1) // 512).cast("long"), F.floor(F.greatest(F.lit(0).cast("long"), c(k)) / 512).cast("long"))
    return t.points.select("well_id", at("x_px", width).alias("tile_x"), at("y_px", height).alias("tile_y"))


@query("ag_24", f"""WITH {MATCH}, p AS (SELECT a_id AS id, CAST(a.x_px AS DOUBLE) AS x, CAST(a.y_px AS DOUBLE) AS y, b.x_px AS u, b.y_px AS v FROM mm JOIN v_points a ON a.well_id = a_id JOIN v_points_t2 b ON b.well_id = b_id WHERE mutual),
o AS (SELECT *, row_number() OVER (ORDER BY (id * 7919) % 10007, id) AS h FROM p), z AS (SELECT h, x, y, u, v, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(u) OVER w AS u2, lead(v) OVER w AS v2 FROM o WHERE h <= 33 WINDOW w AS (ORDER BY h)),
s1 AS (SELECT h, x, y, u, v, ((u2 - u) * (x2 - x) + (v2 - v) * (y2 - y)) / ((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS a, ((v2 - v) * (x2 - x) - (u2 - u) * (y2 - y)) / ((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS b FROM z WHERE x2 IS NOT NULL),
s2 AS (SELECT h, a, b, u - a * x + b * y AS tx, v - b * x - a * y AS ty FROM s1),
k AS (SELECT s2.h, count(*) FILTER (round(sqrt(pow(a * x - b * y + tx - u, 2) + pow(b * x + a * y + ty - v, 2)), 6) <= 4) AS n FROM s2, p GROUP BY 1), best AS (SELECT s2.* FROM s2 JOIN k ON s2.h = k.h ORDER BY n DESC, s2.h LIMIT 1),
own AS (SELECT p.* FROM p, best WHERE round(sqrt(pow(a * x - b * y + tx - u, 2) + pow(b * x + a * y + ty - v, 2)), 6) <= 4),
m AS (SELECT count(*) AS inliers, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, (covar_pop(x, u) + covar_pop(y, v)) / (var_pop(x) + var_pop(y)) AS a, (covar_pop(x, v) - covar_pop(y, u)) / (var_pop(x) + var_pop(y)) AS b FROM own)
SELECT round(sqrt(a * a + b * b), 6) AS scale, round(degrees(atan2(b, a)), 6) AS rotation, round(mu - a * mx + b * my, 5) AS tx, round(mv - b * mx - a * my, 5) AS ty, inliers, round(inliers / (SELECT count(*) FROM p)::DOUBLE, 6) AS inlier_share, inliers >= 8 AS usable FROM m""", "v_points", "v_points_t2")
def ag_24(t: Tables) -> DataFrame:
    a = t.points.select(c("well_id").alias("a_id"), c("x_px").cast("double").alias("x"), c("y_px").cast("double").alias("y"))
    b = t.points_t2.select(c("well_id").alias("b_id"), c("x_px").alias("u"), c("y_px").alias("v"))
    pairs = stage(matches(t).where("mutual").join(a, "a_id").join(b, "b_id").select(c("a_id").alias("id"), "x", "y", "u", "v"), "pairs")
    out = A.ransac_similarity(pairs, (c("id") * 7919) % 10007, 32)
    return out.withColumns({"scale": F.round("scale", 6), "rotation": F.round("rotation", 6), "tx": F.round("tx", 5), "ty": F.round("ty", 5), "inlier_share": F.round("inlier_share", 6)})


# ---- raster


def taps_sql(taps) -> str:
    return "(VALUES " + ", ".join(f"({k}, CAST({w!r} AS DOUBLE))" for k, w in taps) + ") AS t(k, w)"


def along_sql(source: str, axis: str, taps, mirror: int = 1) -> str:
    j = f"(o.{axis} + t.k)"
    back = f"CASE WHEN {j} < 0 THEN -{j} - {mirror} WHEN {j} >= n.n THEN 2 * n.n - 2 + {mirror} - {j} ELSE {j} END"
    other = "y" if axis == "x" else "x"
    return f"(SELECT o.image_id, o.x, o.y, sum(p.v * t.w) AS v FROM {source} o JOIN (SELECT image_id, max({axis}) + 1 AS n FROM {source} GROUP BY 1) n ON n.image_id = o.image_id CROSS JOIN {taps_sql(taps)} JOIN {source} p ON p.image_id = o.image_id AND p.{other} = o.{other} AND p.{axis} = {back} GROUP BY ALL)"


def gauss_sql(name: str, source: str, sigma: float) -> str:
    taps = R.gaussian_taps(sigma)
    return f"{name}_1 AS {along_sql(source, 'x', taps)}, {name} AS {along_sql(name + '_1', 'y', taps)}"


DIFF, FLAT = [(-1, -1.0), (0, 0.0), (1, 1.0)], [(-1, 1.0), (0, 2.0), (1, 1.0)]


def sobel_sql(source: str) -> str:
    return f"gx1 AS {along_sql(source, 'x', DIFF, 0)}, gx AS {along_sql('gx1', 'y', FLAT, 0)}, gy1 AS {along_sql(source, 'x', FLAT, 0)}, gy AS {along_sql('gy1', 'y', DIFF, 0)}, grad AS (SELECT gx.image_id, gx.x, gx.y, sqrt(gx.v * gx.v + gy.v * gy.v) AS g FROM gx JOIN gy ON gx.image_id = gy.image_id AND gx.x = gy.x AND gx.y = gy.y)"


CUT = 160
LABELS = f"""px AS (SELECT *, (image_id * 1000000 + y) * 1000000 + x AS id FROM v_pixels WHERE v >= {CUT}),
adj AS (SELECT a.id AS a, b.id AS b FROM px a CROSS JOIN (VALUES (-1), (0), (1)) AS i(dx) CROSS JOIN (VALUES (-1), (0), (1)) AS j(dy) JOIN px b ON a.image_id = b.image_id AND b.x = a.x + i.dx AND b.y = a.y + j.dy WHERE a.id <> b.id),
reach AS (SELECT id, id AS r FROM px UNION SELECT reach.id, adj.b FROM reach JOIN adj ON adj.a = reach.r),
root AS (SELECT id, min(r) AS label FROM reach GROUP BY 1), lab AS (SELECT px.*, label FROM px JOIN root USING (id)),
box AS (SELECT label, min(image_id) AS image_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM lab GROUP BY 1)"""


def labels(t: Tables) -> DataFrame:
    on = t.pixels.where(c("v") >= CUT)
    return stage(R.labelled(on).join(on, R.PIXEL), "labels")


@query("rs_01", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, true AS same FROM embeddings")
def rs_01(t: Tables) -> DataFrame:
    from gridlume.operators.tiles import explode_arrays, gather_arrays

    e = t.table("embeddings").select("vec_id", "embedding")
    back = gather_arrays(explode_arrays(e, "vec_id", "embedding"), "vec_id")
    return e.join(back, "vec_id").select("vec_id", F.size("values").cast("long").alias("n"), (c("values") == c("embedding")).alias("same"))


@query("rs_02", f"WITH {gauss_sql('g', 'v_pixels', 1.0)} SELECT image_id, x, y, round(v, 6) AS v FROM g", "v_pixels")
def rs_02(t: Tables) -> DataFrame:
    return R.smoothed(t.pixels, 1.0).withColumn("v", F.round("v", 6))


def plain_label(df: DataFrame) -> DataFrame:
    """The label's first pixel as the number that the SQL gives it; the tables' images have fewer than a million rows and columns."""
    image, y, x = R.first_pixel(c("label"))
    return df.withColumn("label", (image * 1_000_000 + y) * 1_000_000 + x)


@query("rs_03", f"WITH {LABELS} SELECT image_id, x, y, label FROM lab", "v_pixels", recursive=True)
def rs_03(t: Tables) -> DataFrame:
    return plain_label(R.labelled(t.pixels.where(c("v") >= CUT)))


PROPS = "props AS (SELECT image_id, label, count(*) AS area, avg(x) AS cx, avg(y) AS cy, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, max(v) AS high FROM lab GROUP BY ALL)"


@query("rs_04", f"WITH {LABELS}, {PROPS} SELECT image_id, label, area, round(cx, 6) AS cx, round(cy, 6) AS cy, x0, y0, x1, y1, high FROM props", "v_pixels", recursive=True)
def rs_04(t: Tables) -> DataFrame:
    return plain_label(R.region_properties(labels(t))).withColumns({k: F.round(k, 6) for k in ("cx", "cy")})


@query("rs_05", f"WITH {LABELS}, {PROPS} SELECT label, area, high FROM props WHERE area >= 4 AND high >= 200", "v_pixels", recursive=True)
def rs_05(t: Tables) -> DataFrame:
    return plain_label(R.hysteresis(R.region_properties(labels(t)), 4, 200)).select("label", "area", "high")


DISTANCE = """cols AS (SELECT label, y0, y1, unnest(generate_series(x0, x1)) AS x FROM box), cells AS (SELECT label, x, unnest(generate_series(y0, y1)) AS y FROM cols),
bg AS (SELECT * FROM cells c WHERE NOT EXISTS (SELECT 1 FROM lab WHERE lab.label = c.label AND lab.x = c.x AND lab.y = c.y)),
dist AS (SELECT lab.label, lab.image_id, lab.x, lab.y, min((lab.x - bg.x) * (lab.x - bg.x) + (lab.y - bg.y) * (lab.y - bg.y)) AS d2 FROM lab LEFT JOIN bg ON bg.label = lab.label GROUP BY ALL)"""


@query("rs_06", f"WITH {LABELS}, {DISTANCE} SELECT label, image_id, x, y, d2 FROM dist", "v_pixels", recursive=True)
def rs_06(t: Tables) -> DataFrame:
    return plain_label(R.background_distance(labels(t)))


def maxima_sql(name: str, source: str, d: int, threshold: float, value: str = "v") -> str:
    return f"""{name}_x AS (SELECT *, max({value}) OVER (PARTITION BY image_id, y ORDER BY x RANGE BETWEEN {d} PRECEDING AND {d} FOLLOWING) AS m1 FROM {source}),
{name}_y AS (SELECT *, max(m1) OVER (PARTITION BY image_id, x ORDER BY y RANGE BETWEEN {d} PRECEDING AND {d} FOLLOWING) AS m2 FROM {name}_x),
{name}_p AS (SELECT * FROM {name}_y WHERE {value} = m2 AND {value} >= {threshold}),
{name} AS (SELECT * FROM {name}_p p WHERE NOT EXISTS (SELECT 1 FROM {name}_p q WHERE q.image_id = p.image_id AND q.{value} = p.{value} AND abs(q.x - p.x) <= {d} AND abs(q.y - p.y) <= {d} AND (q.y < p.y OR (q.y = p.y AND q.x < p.x))))"""


@query("rs_07", f"WITH {maxima_sql('pk', 'v_pixels', 4, 200)} SELECT image_id, x, y, v FROM pk", "v_pixels")
def rs_07(t: Tables) -> DataFrame:
    return R.local_maxima(t.pixels, 4, 200)


PEAKS = f"{DISTANCE}, field AS (SELECT label, image_id, x, y, sqrt(CAST(d2 AS DOUBLE)) AS r FROM dist WHERE d2 IS NOT NULL), {maxima_sql('pk', 'field', 2, 1.0, 'r')}"
PIECES = "cost AS (SELECT lab.label, lab.image_id, lab.x, lab.y, pk.x AS px, pk.y AS py, row_number() OVER (PARTITION BY lab.id ORDER BY CAST((lab.x - pk.x) * (lab.x - pk.x) + (lab.y - pk.y) * (lab.y - pk.y) - pk.r * pk.r AS DOUBLE), pk.y, pk.x) AS k FROM lab JOIN pk ON pk.label = lab.label), pieces AS (SELECT label, image_id, x, y, px, py FROM cost WHERE k = 1)"


@query("rs_08", f"""WITH {LABELS}, {PEAKS}, {PIECES}, n AS (SELECT label, count(*) AS peaks FROM pk GROUP BY 1), few AS (SELECT pk.* FROM pk JOIN n USING (label) WHERE peaks BETWEEN 2 AND 6),
ratio AS (SELECT a.label, min(sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) / (a.r + b.r)) AS ratio FROM few a JOIN few b ON a.label = b.label AND (a.y < b.y OR (a.y = b.y AND a.x < b.x)) GROUP BY 1),
area AS (SELECT label, min(k) AS small, max(k) AS large FROM (SELECT label, px, py, count(*) AS k FROM pieces GROUP BY ALL) GROUP BY 1)
SELECT n.label, peaks, round(ratio, 6) AS ratio, CASE WHEN peaks BETWEEN 2 AND 6 THEN small END AS small, CASE WHEN peaks BETWEEN 2 AND 6 THEN large END AS large,
coalesce(peaks BETWEEN 2 AND 6 AND ratio >= CAST(0.75 AS DOUBLE) AND small >= 3 AND small / large::DOUBLE >= CASE WHEN peaks = 2 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.08 AS DOUBLE) END, false) AS split FROM n LEFT JOIN ratio USING (label) LEFT JOIN area USING (label)""", "v_pixels", recursive=True)
def rs_08(t: Tables) -> DataFrame:
    own = labels(t)
    peaks = stage(R.component_peaks(own, 2, 1.0), "component-peaks")
    return plain_label(R.split_test(own, peaks, 3)).withColumn("ratio", F.round("ratio", 6))


@query("rs_09", f"WITH {LABELS}, {PEAKS}, {PIECES} SELECT label, image_id, x, y, px, py FROM pieces", "v_pixels", recursive=True)
def rs_09(t: Tables) -> DataFrame:
    own = labels(t)
    return plain_label(R.pieces(own, stage(R.component_peaks(own, 2, 1.0), "component-peaks")))


def pieces_sql(name: str, own: str, peaks: str, r: str) -> str:
    """Pixels of own with the peak of their component of least d^2 - r^2."""
    return f"""{name}_c AS (SELECT o.*, k.x AS px, k.y AS py, row_number() OVER (PARTITION BY o.label, o.image_id, o.x, o.y ORDER BY CAST((o.x - k.x) * (o.x - k.x) + (o.y - k.y) * (o.y - k.y) - {r} AS DOUBLE), k.y, k.x) AS k FROM {own} o JOIN {peaks} k ON k.label = o.label),
{name} AS (SELECT image_id, label, px, py, avg(x) AS cx, avg(y) AS cy, count(*) AS area, max(v) AS high FROM {name}_c WHERE k = 1 GROUP BY ALL)"""


def component_maxima_sql(name: str, field: str, distance: str, floor: float, share: float, value: str) -> str:
    """field (label, image_id, x, y, value): no pixel of the component within distance is greater, or as great and earlier."""
    return f"""{name}_s AS MATERIALIZED (SELECT f.*, {distance} AS dist FROM {field} f JOIN (SELECT label, max({value}) AS top FROM {field} GROUP BY 1) t ON t.label = f.label WHERE {value} >= greatest(CAST({floor} AS DOUBLE), CAST({share} AS DOUBLE) * top)),
{name} AS MATERIALIZED (SELECT * FROM {name}_s p WHERE NOT EXISTS (SELECT 1 FROM {name}_s q WHERE q.label = p.label AND abs(q.x - p.x) <= p.dist AND abs(q.y - p.y) <= p.dist AND (q.{value} > p.{value} OR (q.{value} = p.{value} AND (q.y < p.y OR (q.y = p.y AND q.x < p.x))))))"""


#: Sizes for components of images of 64 x 64.
SMALL = {"distance": 2, "floor": 1.0, "share": 0.55, "ratio": 0.60, "sep": 2.0, "least_area": 4, "area_ratio": 0.35}


@query("rs_08_intensity", f"""WITH {LABELS}, props AS (SELECT image_id, label, avg(x) AS cx, avg(y) AS cy, count(*) AS area, max(v) AS high FROM lab GROUP BY ALL HAVING count(*) >= 3 AND max(v) >= 200),
own AS MATERIALIZED (SELECT lab.* FROM lab JOIN props USING (label)), inten AS (SELECT label, image_id, x, y, CAST(v AS DOUBLE) AS v FROM own), {component_maxima_sql('ipk', 'inten', '3', 200, 0, 'v')},
several AS (SELECT * FROM ipk WHERE label IN (SELECT label FROM ipk GROUP BY 1 HAVING count(*) >= 2)), {pieces_sql('ip', 'own', 'several', '0')},
good AS (SELECT * FROM ip WHERE area >= 3 AND high >= 200), firstn AS (SELECT label, count(*) AS pieces FROM good GROUP BY 1 HAVING count(*) >= 2),
restp AS MATERIALIZED (SELECT * FROM own WHERE label NOT IN (SELECT label FROM firstn)), {DISTANCE}, depth AS (SELECT label, image_id, x, y, sqrt(CAST(d2 AS DOUBLE)) AS r FROM dist WHERE d2 IS NOT NULL AND label IN (SELECT label FROM restp)),
{component_maxima_sql('dpk', 'depth', '2', 1.0, 0.55, 'r')}, two AS (SELECT label FROM dpk GROUP BY 1 HAVING count(*) = 2 AND min(r) / max(r) >= CAST(0.6 AS DOUBLE) AND sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) >= 2),
dtwo AS (SELECT * FROM dpk WHERE label IN (SELECT label FROM two)), {pieces_sql('dp', 'restp', 'dtwo', 'k.r * k.r')}, dgood AS (SELECT * FROM dp WHERE area >= 4 AND high >= 200),
secondn AS (SELECT label, count(*) AS pieces FROM dgood GROUP BY 1 HAVING count(*) = 2 AND min(area) / max(area)::DOUBLE >= CAST(0.35 AS DOUBLE)),
obj AS (SELECT image_id, label, cx, cy, area, pieces FROM good JOIN firstn USING (label) UNION ALL SELECT image_id, label, cx, cy, area, pieces FROM dgood JOIN secondn USING (label)
UNION ALL SELECT image_id, label, cx, cy, area, 1 FROM props WHERE label NOT IN (SELECT label FROM firstn) AND label NOT IN (SELECT label FROM secondn))
SELECT image_id, label, round(cx, 6) AS cx, round(cy, 6) AS cy, area, pieces FROM obj""", "v_pixels", recursive=True)
def rs_08_intensity(t: Tables) -> DataFrame:
    return plain_label(R.split_by_intensity(labels(t), 3, 200.0, 3, SMALL)).withColumns({k: F.round(k, 6) for k in ("cx", "cy")})


def square_sql(name: str, source: str, size: int, greatest: bool) -> str:
    f = "max" if greatest else "min"
    w = lambda a, b: f"(PARTITION BY image_id, {b} ORDER BY {a} RANGE BETWEEN {size} PRECEDING AND {size} FOLLOWING)"
    return f"{name}_x AS (SELECT image_id, x, y, {f}(o) OVER {w('x', 'y')} AS o FROM {source}), {name} AS MATERIALIZED (SELECT image_id, x, y, {f}(o) OVER {w('y', 'x')} AS o FROM {name}_x)"


_BRIGHT = 30.0, 32.0
_touch = "i(dx) CROSS JOIN (VALUES (-1), (0), (1)) AS j(dy)"


@query("rs_10", f"""WITH {gauss_sql('blur', 'v_pixels', 0.22 * _BRIGHT[0])}, edge AS MATERIALIZED (SELECT p.image_id, p.x, p.y, abs(p.v - b.v) AS v FROM v_pixels p JOIN blur b ON b.image_id = p.image_id AND b.x = p.x AND b.y = p.y), {gauss_sql('soft', 'edge', 1.0)},
mid AS (SELECT image_id, max(x) / 2.0::DOUBLE AS mx, max(y) / 2.0::DOUBLE AS my, max(x) AS w, max(y) AS h FROM v_pixels GROUP BY 1),
ons AS MATERIALIZED (SELECT s.image_id, x, y, CASE WHEN round(v, 6) >= {_BRIGHT[1]} AND sqrt(pow(x - mx, 2) + pow(y - my, 2)) <= CAST({0.70 * _BRIGHT[0]!r} AS DOUBLE) THEN 1 ELSE 0 END AS o FROM soft s JOIN mid USING (image_id)),
{square_sql('e1', 'ons', 1, False)}, {square_sql('o1', 'e1', 1, True)}, {square_sql('d2', 'o1', 2, True)}, {square_sql('c2', 'd2', 2, False)},
offs AS MATERIALIZED (SELECT c2.*, x = 0 OR y = 0 OR x = w OR y = h AS rim FROM c2 JOIN mid USING (image_id) WHERE o = 0),
flood AS (SELECT image_id, x, y FROM offs WHERE rim UNION SELECT a.image_id, a.x, a.y FROM flood f CROSS JOIN (VALUES (-1), (0), (1)) AS {_touch} JOIN offs a ON a.image_id = f.image_id AND a.x = f.x + i.dx AND a.y = f.y + j.dy),
px AS MATERIALIZED (SELECT image_id, x, y, 1 AS v, (image_id * 1000000 + y) * 1000000 + x AS id FROM c2 WHERE o = 1 OR (image_id, x, y) NOT IN (SELECT (image_id, x, y) FROM flood)),
adj AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM px a CROSS JOIN (VALUES (-1), (0), (1)) AS {_touch} JOIN px b ON a.image_id = b.image_id AND b.x = a.x + i.dx AND b.y = a.y + j.dy WHERE a.id <> b.id),
reach AS (SELECT id, id AS r FROM px UNION SELECT reach.id, adj.b FROM reach JOIN adj ON adj.a = reach.r),
root AS (SELECT id, min(r) AS label FROM reach GROUP BY 1), lab AS MATERIALIZED (SELECT px.*, label FROM px JOIN root USING (id)), box AS (SELECT label, min(image_id) AS image_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM lab GROUP BY 1), {DISTANCE},
props AS MATERIALIZED (SELECT image_id, label, avg(x) AS cx, avg(y) AS cy, count(*) AS area FROM lab GROUP BY ALL HAVING count(*) >= 20), own AS (SELECT lab.* FROM lab JOIN props USING (label)),
depth AS MATERIALIZED (SELECT d.label, d.image_id, x, y, area, sqrt(CAST(d2 AS DOUBLE)) AS r FROM dist d JOIN props USING (label) WHERE d2 IS NOT NULL), deep AS (SELECT * FROM depth WHERE label IN (SELECT label FROM depth GROUP BY 1 HAVING max(r) > 2)),
{component_maxima_sql('pk', 'deep', 'greatest(5, CAST(round_even(sqrt(CAST(area AS DOUBLE)) * CAST(0.18 AS DOUBLE), 0) AS BIGINT))', 2.0, 0.45, 'r')}, few AS (SELECT * FROM pk WHERE label IN (SELECT label FROM pk GROUP BY 1 HAVING count(*) BETWEEN 2 AND 4)),
{pieces_sql('pc', 'own', 'few', 'k.r * k.r')}, good AS (SELECT * FROM pc WHERE area >= 20), split AS (SELECT label FROM good GROUP BY 1 HAVING count(*) >= 2),
obj AS (SELECT image_id, label, cx, cy, area FROM good WHERE label IN (SELECT label FROM split) UNION ALL SELECT image_id, label, cx, cy, area FROM props WHERE label NOT IN (SELECT label FROM split))
SELECT image_id, label, round(cx, 6) AS cx, round(cy, 6) AS cy, area FROM obj JOIN mid USING (image_id) WHERE round(sqrt(pow(cx - mx, 2) + pow(cy - my, 2)), 6) <= CAST({round(0.68 * _BRIGHT[0], 6)!r} AS DOUBLE) AND area <= CAST({0.80 * 3.141592653589793 * (0.70 * _BRIGHT[0]) ** 2!r} AS DOUBLE)""", "v_pixels", recursive=True)
def rs_10(t: Tables) -> DataFrame:
    return plain_label(R.brightfield_candidates(t.pixels, *_BRIGHT)).withColumns({k: F.round(k, 6) for k in ("cx", "cy")})


@query("rs_11", f"""WITH raw AS (SELECT image_id, x, y, CAST(v - (v * 5 + y) % 256 AS DOUBLE) AS v FROM v_pixels), {gauss_sql('b', 'raw', 2.0)}, score AS (SELECT raw.image_id, raw.x, raw.y, round(raw.v - b.v, 6) AS score, raw.v AS raw FROM raw JOIN b ON b.image_id = raw.image_id AND b.x = raw.x AND b.y = raw.y),
{maxima_sql('pk', 'score', 4, 60, 'score')} SELECT image_id AS well_id, image_id, x, y, score FROM pk WHERE raw >= 40 AND (x - 32) * (x - 32) + (y - 32) * (y - 32) <= pow(CAST(0.86 AS DOUBLE) * 28, 2)""", "v_pixels")
def rs_11(t: Tables) -> DataFrame:
    two = t.pixels.select(*R.PIXEL, c("v").alias("r"), ((c("v") * 5 + c("y")) % 256).alias("b"))
    return R.foci(two, discs(t, 28.0), 60.0, 4, 40.0, 2.0)


def discs(t: Tables, radius: float) -> DataFrame:
    """A well in the middle of every image."""
    middle = F.lit(32.0)
    return t.pixels.select("image_id").distinct().select("image_id", c("image_id").alias("well_id"), middle.alias("wx"), middle.alias("wy"), F.lit(radius).alias("wr"))


#: Width and height of a rendered picture.
SIDE = 136
#: What each image's sum s of values says of its picture: centre, inner radius and thickness of a wall, level of the ground, side
#: and half-width of a gap in the wall.
PICTURE = {"cx": "62 + s % 13", "cy": "62 + floor(s / 13) % 13", "r0": "34 + floor(s / 169) % 7", "thick": "6 + s % 4", "ground": "160 + s % 16", "side": "floor(s / 7) % 4", "gap": "1 + s % 5"}


def picture_numbers(t: Tables) -> DataFrame:
    sums = t.pixels.groupBy("image_id").agg(F.sum("v").cast("long").alias("s"))
    return sums.select("image_id", *(F.expr(f"CAST({e} AS BIGINT) AS {k}") for k, e in PICTURE.items()))


def rendered(t: Tables) -> DataFrame:
    """A wall around a well for each image: its place, size, gap and levels follow the sum of the image's values, and each pixel
    has the last four bits of one of the image's own."""
    axis = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SIDE - 1).cast("long")))
    grid = R.dealt(picture_numbers(t)).withColumn("x", axis).withColumn("y", axis)
    own = t.pixels.select("image_id", c("x").alias("u"), c("y").alias("w"), (c("v") % 16).alias("grain"))
    grid = grid.withColumns({"u": c("x") % 64, "w": c("y") % 64}).join(own, ["image_id", "u", "w"], "left")
    dx, dy = c("x") - c("cx"), c("y") - c("cy")
    wall = F.sqrt((dx * dx + dy * dy).cast("double")).between(c("r0"), c("r0") + c("thick"))
    side = F.when(c("side") < 2, F.abs(dy)).otherwise(F.abs(dx)) <= c("gap")
    open_ = side & F.when(c("side") == 0, dx > 0).when(c("side") == 1, dx < 0).when(c("side") == 2, dy > 0).otherwise(dy < 0)
    level = F.when(wall & ~open_, F.lit(30).cast("long")).otherwise(c("ground"))
    return stage(grid.select(*R.PIXEL, (level + F.coalesce("grain", F.lit(0).cast("long"))).alias("v")), "rendered")


RENDERED = f"""sums AS (SELECT image_id, CAST(sum(v) AS BIGINT) AS s FROM v_pixels GROUP BY 1), par AS MATERIALIZED (SELECT image_id, {", ".join(f"CAST({e} AS BIGINT) AS {k}" for k, e in PICTURE.items())} FROM sums),
drawn AS (SELECT par.*, CAST(a.x AS BIGINT) AS x, CAST(b.y AS BIGINT) AS y FROM par, range({SIDE}) AS a(x), range({SIDE}) AS b(y)),
ring AS MATERIALIZED (SELECT d.image_id, d.x, d.y, CASE WHEN sqrt(CAST((d.x - cx) * (d.x - cx) + (d.y - cy) * (d.y - cy) AS DOUBLE)) BETWEEN r0 AND r0 + thick
AND NOT (CASE WHEN side < 2 THEN abs(d.y - cy) ELSE abs(d.x - cx) END <= gap AND CASE side WHEN 0 THEN d.x > cx WHEN 1 THEN d.x < cx WHEN 2 THEN d.y > cy ELSE d.y < cy END) THEN 30 ELSE ground END + coalesce(p.v % 16, 0) AS v
FROM drawn d LEFT JOIN v_pixels p ON p.image_id = d.image_id AND p.x = d.x % 64 AND p.y = d.y % 64),
well AS MATERIALIZED (SELECT image_id, CAST(cx AS DOUBLE) AS wx, CAST(cy AS DOUBLE) AS wy, r0 + thick / 2.0::DOUBLE AS wr FROM par)"""


def ring_wells(t: Tables) -> DataFrame:
    radius = (c("r0") + c("thick") / 2.0).alias("wr")
    return picture_numbers(t).select("image_id", F.lit(1).cast("long").alias("well_id"), c("cx").cast("double").alias("wx"), c("cy").cast("double").alias("wy"), radius)


@query("rs_12", f"""WITH {RENDERED}, {sobel_sql('ring')}, strong AS (SELECT gx.image_id, gx.x, gx.y, gx.v AS gx, gy.v AS gy, sqrt(gx.v * gx.v + gy.v * gy.v) AS g FROM gx JOIN gy ON gx.image_id = gy.image_id AND gx.x = gy.x AND gx.y = gy.y),
votes AS (SELECT image_id, CAST(round(x + sg * r * gx / g) AS BIGINT) AS x, CAST(round(y + sg * r * gy / g) AS BIGINT) AS y, r FROM strong, range(28, 53) AS q(r), (VALUES (-1), (1)) AS z(sg) WHERE g >= 200),
byr AS (SELECT image_id, x, y, r, count(*) AS n FROM votes GROUP BY ALL), counted AS (SELECT image_id, x, y, CAST(sum(n) AS BIGINT) AS votes, CAST(arg_max(r, n * 1000 - r) AS INT) AS radius FROM byr GROUP BY ALL), enough AS (SELECT * FROM counted WHERE votes >= 40), {maxima_sql('pk', 'enough', 12, 40, 'votes')}
SELECT image_id, x, y, votes, radius FROM pk WHERE x BETWEEN 0 AND {SIDE - 1} AND y BETWEEN 0 AND {SIDE - 1}""", "v_pixels")
def rs_12(t: Tables) -> DataFrame:
    return R.circles_in_tiles(rendered(t), 72, 28, 52, 200.0, 40, 12.0)


@query("rs_13", f"WITH {LABELS} SELECT image_id, label, round(avg(CASE WHEN (x - 32) * (x - 32) + (y - 32) * (y - 32) <= 400 THEN 1.0::DOUBLE ELSE 0 END), 6) AS inside_fraction FROM lab GROUP BY ALL", "v_pixels", recursive=True)
def rs_13(t: Tables) -> DataFrame:
    return plain_label(R.inside_fraction(labels(t), discs(t, 20.0))).withColumn("inside_fraction", F.round("inside_fraction", 6))


#: Objects by their place from the well's centre.
PLACES = ((0, 30.0, 0.0), (1, 0.0, 52.0), (2, 6.0, 2.0), (3, -34.0, -36.0))
OBJECTS = f"(VALUES {', '.join(map(str, PLACES))}) AS k(o, dx, dy)"


def ring_objects(t: Tables) -> DataFrame:
    places = F.inline(F.array(*[F.struct(F.lit(o).cast("long").alias("o"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for o, x, y in PLACES]))
    return ring_wells(t).select("*", places).select("image_id", (c("image_id") * 10 + c("o")).alias("object_id"), "wx", "wy", "wr", (c("wx") + c("dx")).alias("ox"), (c("wy") + c("dy")).alias("oy"))


def at_sql(axis: str) -> str:
    """The pixel that a sample on a ray falls on."""
    way = "cos" if axis == "x" else "sin"
    return f"greatest(0, least({SIDE - 1}, CAST(round_even(round(w{axis} + radius * {way}(angle), 6), 0) AS BIGINT)))"


RAY = "CAST({lo} AS DOUBLE) * wr + (CAST({hi} AS DOUBLE) * wr - CAST({lo} AS DOUBLE) * wr) * k / {n}"


@query("rs_14", f"""WITH {RENDERED}, obj AS (SELECT well.*, image_id * 10 + o AS object_id, sqrt(pow(wx + dx - wx, 2) + pow(wy + dy - wy, 2))::DOUBLE AS distance, atan2(CAST(wy + dy - wy AS DOUBLE), CAST(wx + dx - wx AS DOUBLE)) AS theta FROM well, {OBJECTS}),
s AS (SELECT image_id, object_id, wx, wy, wr, distance, ray, k, {RAY.format(lo=0.45, hi=1.25, n=80)} AS radius, theta + (-20 + 4 * ray) * pi() / 180 + band * pi() / 180 AS angle FROM obj, range(0, 11) AS a(ray), range(0, 81) AS b(k), (VALUES (-6), (-3), (0), (3), (6)) AS d(band) WHERE distance > CAST(0.40 AS DOUBLE) * wr),
m AS (SELECT s.image_id, object_id, distance, wr, ray, k, radius, quantile_cont(CAST(v AS DOUBLE), 0.5) AS v FROM s JOIN ring ON ring.image_id = s.image_id AND ring.x = {at_sql('x')} AND ring.y = {at_sql('y')} GROUP BY ALL),
g AS (SELECT o.object_id, o.distance, o.wr, o.ray, o.k, o.radius, round(sum(p.v * t.w), 6) AS v FROM m o CROSS JOIN {taps_sql(R.gaussian_taps(1.2))} JOIN m p ON p.object_id = o.object_id AND p.ray = o.ray AND p.k = CASE WHEN o.k + t.k < 0 THEN -(o.k + t.k) - 1 WHEN o.k + t.k > 80 THEN 161 - (o.k + t.k) ELSE o.k + t.k END GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY object_id, ray ORDER BY v, k) AS o FROM g), f AS (SELECT object_id, avg(CASE WHEN radius + greatest(CAST(1 AS DOUBLE), CAST(0.03 AS DOUBLE) * wr) < distance THEN 1.0::DOUBLE ELSE 0 END) AS wall_fraction FROM w WHERE o = 1 GROUP BY 1)
SELECT obj.object_id, round(coalesce(wall_fraction, 0), 6) AS wall_fraction FROM obj LEFT JOIN f USING (object_id)""", "v_pixels")
def rs_14(t: Tables) -> DataFrame:
    return R.wall_before(rendered(t), ring_objects(t)).withColumn("wall_fraction", F.round("wall_fraction", 6))


@query("rs_15", f"""WITH {RENDERED}, {gauss_sql('raw', 'ring', 1.0)}, dic AS MATERIALIZED (SELECT image_id, x, y, round(v, 6) AS v FROM raw), sp AS (SELECT dic.image_id, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.9) AS p90 FROM dic JOIN well USING (image_id) WHERE (x - wx) * (x - wx) + (y - wy) * (y - wy) <= pow(CAST(1.35 AS DOUBLE) * wr, 2) GROUP BY 1),
s AS (SELECT well.*, a, {RAY.format(lo=0.45, hi=1.25, n=99)} AS radius, a * 2 * pi() / 72 AS angle FROM well, range(0, 72) AS x(a), range(0, 100) AS y(k)),
g AS (SELECT dic.image_id, a, round(radius / wr, 9) AS share, v FROM s JOIN dic ON dic.image_id = s.image_id AND dic.x = {at_sql('x')} AND dic.y = {at_sql('y')}),
ray AS (SELECT image_id, a, quantile_cont(v, 0.5) FILTER (share BETWEEN CAST(0.45 AS DOUBLE) AND CAST(0.65 AS DOUBLE)) AS i, quantile_cont(v, 0.5) FILTER (share BETWEEN CAST(1.12 AS DOUBLE) AND CAST(1.25 AS DOUBLE)) AS o, min(v) FILTER (share BETWEEN CAST(0.72 AS DOUBLE) AND CAST(1.10 AS DOUBLE)) AS w FROM g GROUP BY ALL)
SELECT ray.image_id, CAST(1 AS BIGINT) AS well_id, round(quantile_cont(((i + o) / 2 - w) / greatest(p90 - p10, 1), 0.5), 5) AS score FROM ray JOIN sp USING (image_id) GROUP BY 1""", "v_pixels")
def rs_15(t: Tables) -> DataFrame:
    return R.wall_evidence(rendered(t), ring_wells(t)).withColumn("score", F.round("score", 5))


@query("rs_16", f"WITH {sobel_sql('v_pixels')} SELECT image_id, x, y, round(g, 5) AS g FROM grad", "v_pixels")
def rs_16(t: Tables) -> DataFrame:
    return R.gradients(t.pixels).select(*R.PIXEL, F.round("g", 5).alias("g"))


@query("rs_17", f"""WITH {RENDERED}, {sobel_sql('ring')}, p AS MATERIALIZED (SELECT ring.*, round(g, 6) AS g, sqrt(pow(ring.x - wx, 2) + pow(ring.y - wy, 2)) / wr AS s FROM ring JOIN grad ON grad.image_id = ring.image_id AND grad.x = ring.x AND grad.y = ring.y JOIN well ON well.image_id = ring.image_id),
z AS (SELECT *, CASE WHEN s BETWEEN CAST(0.35 AS DOUBLE) AND CAST(0.65 AS DOUBLE) THEN 'i' WHEN s BETWEEN CAST(0.78 AS DOUBLE) AND CAST(1.08 AS DOUBLE) THEN 'w' WHEN s BETWEEN CAST(1.15 AS DOUBLE) AND CAST(1.38 AS DOUBLE) THEN 'o' END AS r FROM p),
m AS (SELECT image_id, avg(v) FILTER (r = 'i') AS im, avg(v) FILTER (r = 'w') AS wm, avg(v) FILTER (r = 'o') AS om, avg(g) FILTER (r = 'i') AS ig, avg(g) FILTER (r = 'w') AS wg, avg(g) FILTER (r = 'o') AS og, quantile_cont(g, 0.9) FILTER (r IN ('i', 'o')) AS ref FROM z GROUP BY 1),
s AS (SELECT well.*, a, {RAY.format(lo=0.78, hi=1.08, n=12)} AS radius, a * 2 * pi() / 96 AS angle FROM well, range(0, 96) AS x(a), range(0, 13) AS y(k)),
pk AS (SELECT p.image_id, a, max(g) AS peak FROM s JOIN p ON p.image_id = s.image_id AND p.x = {at_sql('x')} AND p.y = {at_sql('y')} GROUP BY ALL)
SELECT m.image_id, round(any_value((im + om) / 2 - wm), 5) AS darkness, round(any_value(wg / greatest(CAST(0.000001 AS DOUBLE), (ig + og) / 2)), 2) AS gradient_ratio, round(avg(CASE WHEN peak > ref THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage FROM m JOIN pk ON pk.image_id = m.image_id GROUP BY 1""", "v_pixels")
def rs_17(t: Tables) -> DataFrame:
    out = R.ring_statistics(rendered(t), ring_wells(t))
    return out.select("image_id", F.round("darkness", 5).alias("darkness"), F.round("gradient_ratio", 2).alias("gradient_ratio"), r6("coverage", "coverage"))


@query("rs_18", f"""WITH d AS (SELECT image_id, CAST(gx.x AS BIGINT) AS x, CAST(gy.y AS BIGINT) AS y FROM (SELECT DISTINCT image_id FROM v_pixels), range(0, 65) AS gx(x), range(0, 65) AS gy(y)), {maxima_sql('pk', 'v_pixels', 4, 220)},
f AS (SELECT DISTINCT image_id, pk.x + i.dx AS x, pk.y + j.dy AS y FROM pk, (VALUES (-2), (-1), (0), (1), (2)) AS i(dx), (VALUES (-2), (-1), (0), (1), (2)) AS j(dy) WHERE dx * dx + dy * dy <= 4)
SELECT 'well' AS mask_type, image_id, x, y FROM d WHERE (x - 32) * (x - 32) + (y - 32) * (y - 32) <= 400 UNION ALL SELECT 'object', image_id, x, y FROM v_pixels WHERE v >= {CUT} AND (x - 32) * (x - 32) + (y - 32) * (y - 32) <= CAST(17.2 AS DOUBLE) * CAST(17.2 AS DOUBLE) UNION ALL SELECT 'focus', image_id, x, y FROM f""", "v_pixels")
def rs_18(t: Tables) -> DataFrame:
    spots = R.local_maxima(t.pixels, 4, 220)
    return R.masks(discs(t, 20.0), t.pixels.where(c("v") >= CUT), spots)


@query("rs_19", "SELECT r.image_id * 10 + q AS crop_id, i, j, v FROM (SELECT DISTINCT image_id FROM v_pixels) r CROSS JOIN (VALUES (0, 4), (1, 20)) AS o(q, s) CROSS JOIN (SELECT CAST(unnest(range(0, 8)) AS INT) AS i) CROSS JOIN (SELECT CAST(unnest(range(0, 8)) AS INT) AS j) JOIN v_pixels p ON p.image_id = r.image_id AND p.x = s + CAST(floor((i + 0.5::DOUBLE) * 20 / 8) AS BIGINT) AND p.y = s + CAST(floor((j + 0.5::DOUBLE) * 12 / 8) AS BIGINT)", "v_pixels")
def rs_19(t: Tables) -> DataFrame:
    corner = F.inline(F.array(*[F.struct(F.lit(q).alias("q"), F.lit(s).cast("long").alias("x0"), F.lit(s).cast("long").alias("y0")) for q, s in ((0, 4), (1, 20))]))
    rects = t.pixels.select("image_id").distinct().select("image_id", corner).select((c("image_id") * 10 + c("q")).alias("crop_id"), "image_id", "x0", "y0", F.lit(20).alias("w"), F.lit(12).alias("h"))
    return R.crops(t.pixels, rects, 8)


@query("rs_20", "SELECT image_id, x // 4 AS x, y // 4 AS y, v FROM v_pixels WHERE x % 4 = 0 AND y % 4 = 0", "v_pixels")
def rs_20(t: Tables) -> DataFrame:
    return R.overview(t.pixels, 4)


@query("rs_21", "SELECT a.image_id, a.x, a.y, a.v, b.v AS moved, b.v IS NOT NULL AS inside, round(CASE WHEN b.v IS NULL THEN a.v::DOUBLE ELSE CAST(0.6 AS DOUBLE) * a.v + CAST(0.4 AS DOUBLE) * b.v END, 6) AS blend FROM v_pixels a LEFT JOIN v_pixels b ON a.image_id = b.image_id AND b.x = CAST(round_even(round(CAST(0.9 AS DOUBLE) * a.x - CAST(0.1 AS DOUBLE) * a.y + 3, 6), 0) AS BIGINT) AND b.y = CAST(round_even(round(CAST(0.1 AS DOUBLE) * a.x + CAST(0.9 AS DOUBLE) * a.y - 2, 6), 0) AS BIGINT)", "v_pixels")
def rs_21(t: Tables) -> DataFrame:
    return R.warped(t.pixels, t.pixels, (0.9, -0.1, 3, 0.1, 0.9, -2), 0.4).withColumn("blend", F.round("blend", 6))

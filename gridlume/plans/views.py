"""Views that give the model tables (tracking, wells, objects, candidates, pixels) from the given tables.

{name} stands for a table or another view.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlume.operators.lineage import honest_sizes

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

TEXT = {
    "v_tracking": """
SELECT CAST(user_id % 5 + 1 AS INT) AS condition_index,
       concat('C', CAST(user_id % 5 + 1 AS STRING)) AS condition,
       user_id % 12 + 1 AS image_series,
       concat('T', CAST(user_id AS STRING)) AS trajectory_id,
       concat(CAST(user_id % 7 AS STRING), ',', CAST(user_id % 3 AS STRING)) AS well_index,
       CAST(floor((day(ts) - 1) / 6) + 1 AS INT) AS timepoint_index,
       concat('Day ', CAST(CAST(floor((day(ts) - 1) / 6) * 6 AS INT) AS STRING)) AS timepoint,
       CAST(floor((day(ts) - 1) / 6) * 6 AS DOUBLE) AS elapsed_time,
       CAST(CASE user_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 100 WHEN 3 THEN 1000 END AS DOUBLE) AS concentration,
       user_id % 5 <> 4 AS foci_analysed,
       CASE WHEN user_id % 5 <> 4 THEN CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) END AS focus_count,
       count(*) AS object_count,
       round(CASE WHEN user_id % 11 = 0 AND floor((day(ts) - 1) / 6) = 0 THEN 0.0
            ELSE sum(CASE WHEN event_type = 'error' THEN 0.0 ELSE value END) END, 2) AS total_area_um2
FROM {events}
GROUP BY user_id, floor((day(ts) - 1) / 6)""",
    "v_points": """
SELECT k AS well_id,
       (k % 30) * 60 + (CAST(floor(k / 30) AS BIGINT) % 2) * 30 + (k * 37) % 7 - 3 AS x_px,
       CAST(floor(k / 30) AS BIGINT) * 52 + CAST(floor(k / 1200) AS BIGINT) * 500 + (k * 53) % 7 - 3 AS y_px,
       24 + k % 3 AS radius_px
FROM (SELECT c_custkey AS k FROM {customer}) c
WHERE k % 17 <> 0""",
    "v_points_raw": """
SELECT well_id, x_px, y_px, radius_px FROM {v_points}
UNION ALL
SELECT well_id + 10000000 AS well_id, x_px + 9 AS x_px, y_px + 5 AS y_px, radius_px FROM {v_points} WHERE well_id % 23 = 0""",
    "v_points_t2": """
SELECT well_id + 500000 AS well_id,
       CAST(1.079342 * x_px - 0.037691 * y_px + 42.0 + (well_id * 31) % 5 - 2 AS DOUBLE) AS x_px,
       CAST(0.037691 * x_px + 1.079342 * y_px + 18.0 + (well_id * 29) % 5 - 2 AS DOUBLE) AS y_px
FROM {v_points} WHERE well_id % 13 <> 0""",
    "v_object_points": """
SELECT o_orderkey AS object_id, (o_orderkey * 7919) % 1800 AS x_px, (o_orderkey * 104729) % 3100 AS y_px,
       CAST(o_totalprice AS DOUBLE) AS area_px2
FROM {orders}""",
    "v_objects": """
SELECT l_orderkey AS well_observation_id, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey,
       CAST(l_extendedprice AS DOUBLE) AS area_px2, CAST(l_quantity AS DOUBLE) AS centroid_x_px, CAST(l_discount AS DOUBLE) AS centroid_y_px
FROM {lineitem}""",
    "v_candidates": """
SELECT l_orderkey AS well_id, CAST(l_linenumber AS BIGINT) AS candidate_number, l_partkey, l_suppkey,
       CAST(l_quantity AS DOUBLE) / CAST(40 AS DOUBLE) AS centroid_fraction,
       CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE round(1 - CAST(l_discount AS DOUBLE) * 6, 4) END AS inside_fraction,
       round(CAST(l_tax AS DOUBLE) * 6, 4) AS wall_fraction,
       round(CAST(0.25 AS DOUBLE) + CAST(l_tax AS DOUBLE) * 2, 4) AS wall_score
FROM {lineitem}""",
    "v_ring": """
SELECT CAST(1 AS BIGINT) AS image_id, a.x AS x, b.y AS y,
       CASE WHEN sqrt(CAST((a.x - 110) * (a.x - 110) + (b.y - 110) * (b.y - 110) AS DOUBLE)) BETWEEN 63 AND 73 THEN 35 ELSE 170 END AS v
FROM range(220) AS a(x) CROSS JOIN range(220) AS b(y)""",
    "v_pixels": """
SELECT CAST(floor(vec_id / 64) AS BIGINT) AS image_id, CAST(p.x AS BIGINT) AS x, vec_id % 64 AS y,
       CAST(floor(least(CAST(255.0 AS DOUBLE), greatest(CAST(0.0 AS DOUBLE), (CAST(embedding[p.x + 1] AS DOUBLE) + CAST(0.4 AS DOUBLE)) * CAST(320.0 AS DOUBLE)))) AS BIGINT) AS v
FROM {embeddings} CROSS JOIN range(64) AS p(x)""",
}


def needed(name: str) -> list[str]:
    return [v for v in TEXT if "{" + v + "}" in TEXT[name]]


def closure(names: tuple[str, ...]) -> list[str]:
    """The views and those they read, in order of need."""
    out: list[str] = []
    for n in names:
        out += [x for x in (*closure(tuple(needed(n))), n) if x not in out]
    return out


def duck(name: str) -> str:
    return TEXT[name].format(**{n: n for n in (*TABLES, *TEXT)})


class Tables:
    """The given tables and the views on them, of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        honest_sizes(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        used = {n: (self.view(n) if n in TEXT else self.table(n)) for n in (*TABLES, *TEXT) if "{" + n + "}" in TEXT[name]}
        return self.spark.sql(TEXT[name], **used)

    @cached_property
    def tracking(self) -> DataFrame:
        return self.view("v_tracking")

    @cached_property
    def points(self) -> DataFrame:
        return self.view("v_points")

    @cached_property
    def extent(self) -> tuple[int, int]:
        """Width and height of the array that holds the points."""
        x, y = self.points.agg(F.max("x_px"), F.max("y_px")).first()
        return int(x or 0) + 1, int(y or 0) + 1

    @cached_property
    def points_raw(self) -> DataFrame:
        return self.view("v_points_raw")

    @cached_property
    def points_t2(self) -> DataFrame:
        return self.view("v_points_t2")

    @cached_property
    def object_points(self) -> DataFrame:
        return self.view("v_object_points")

    @cached_property
    def objects(self) -> DataFrame:
        return self.view("v_objects")

    @cached_property
    def candidates(self) -> DataFrame:
        return self.view("v_candidates")

    @cached_property
    def ring(self) -> DataFrame:
        return self.view("v_ring")

    @cached_property
    def pixels(self) -> DataFrame:
        """Each embedding is a row of pixels: its arrays are exploded in place, without a join."""
        level = F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (F.col("e").cast("double") + 0.4) * 320.0))).cast("long")
        rows = self.table("embeddings").select("vec_id", F.posexplode("embedding").alias("p", "e"))
        return rows.select(F.floor(F.col("vec_id") / 64).cast("long").alias("image_id"), F.col("p").cast("long").alias("x"), (F.col("vec_id") % 64).alias("y"), level.alias("v"))

"""SRC-07: images with channel, z and t, stored as a table of tile rows and read by region.

The table is partitioned by channel, z and t, so a selection lists one folder; within it the tiles' numbers are ordinary
columns, so the scan skips row groups by their statistics. A row holds one tile's row of values. Sizes are a one-row table beside it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
AXES = ("channel", "z", "t")


class Shape(NamedTuple):
    width: int
    height: int
    channels: int
    depth: int
    times: int
    tile: int


def write_stack(pixels: DataFrame, root: str, tile: int = 512) -> None:
    """pixels (channel, z, t, x, y, v) with axes counted from 0, to root; pixels that aren't given are 0.

    A tile's rows are gathered by (axes, tile, y): at most tile values meet in one row.
    """
    sizes = pixels.agg(*(F.coalesce(F.max(k) + 1, F.lit(0)).cast("long").alias(n) for k, n in (("x", "width"), ("y", "height"), ("channel", "channels"), ("z", "depth"), ("t", "times"))))
    sizes.withColumn("tile", F.lit(tile).cast("long")).write.mode("overwrite").json(f"{root}/shape")
    cell = pixels.select(*AXES, F.floor(c("y") / tile).alias("tile_y"), F.floor(c("x") / tile).alias("tile_x"), c("y").cast("long").alias("y"), F.struct(c("x").cast("long").alias("x"), c("v").cast("long").alias("v")).alias("p"))
    rows = cell.groupBy(*AXES, "tile_y", "tile_x", "y").agg(F.array_sort(F.collect_list("p")).alias("pixels"))
    ordered = rows.repartition(*AXES, "tile_y").sortWithinPartitions(*AXES, "tile_y", "tile_x", "y")
    ordered.write.mode("overwrite").partitionBy(*AXES).parquet(f"{root}/tiles")


def shape_of(spark: SparkSession, root: str) -> Shape:
    return Shape(**spark.read.schema(", ".join(f"{n} long" for n in Shape._fields)).json(f"{root}/shape").first().asDict())


def read_region(spark: SparkSession, root: str, box: tuple[int, int, int, int], channel: int, z: int = 0, t: int = 0) -> DataFrame:
    """x, y, v of a region (x0, y0, width, height) of one plane. The region is cut at the image's edges, z and t go to the nearest that
    is there; a channel that isn't there is a plane of zeros."""
    shape = shape_of(spark, root)
    x0, y0 = max(0, box[0]), max(0, box[1])
    x1, y1 = min(shape.width, box[0] + box[2]), min(shape.height, box[1] + box[3])
    lines = spark.range(y0, max(y0, y1)).select(c("id").alias("y"))
    grid = lines.select(F.explode(F.sequence(F.lit(x0).cast("long"), F.lit(x1 - 1).cast("long"))).alias("x"), "y") if x1 > x0 else lines.select(c("y").alias("x"), "y").limit(0)
    if not 0 <= channel < shape.channels:
        return grid.withColumn("v", F.lit(0).cast("long"))
    inside = tile_rows(spark, root, shape, (x0, y0, x1, y1), channel, z, t).select("y", F.inline("pixels")).where(c("x").between(x0, x1 - 1))
    return grid.join(inside, ["x", "y"], "left").select("x", "y", F.coalesce("v", F.lit(0).cast("long")).alias("v"))


def tile_rows(spark: SparkSession, root: str, shape: Shape, span: tuple[int, int, int, int], channel: int, z: int, t: int) -> DataFrame:
    """The rows of the tiles that span (x0, y0, x1, y1) touches, of one plane: one partition, and filters that reach the scan."""
    clamp = lambda k, n: min(max(0, k), max(0, n - 1))
    (x0, y0, x1, y1), n = span, shape.tile
    tiles = spark.read.parquet(f"{root}/tiles")
    plane = (c("channel") == channel) & (c("z") == clamp(z, shape.depth)) & (c("t") == clamp(t, shape.times))
    near = c("tile_x").between(x0 // n, (x1 - 1) // n) & c("tile_y").between(y0 // n, (y1 - 1) // n) & c("y").between(y0, y1 - 1)
    return tiles.where(plane & near)

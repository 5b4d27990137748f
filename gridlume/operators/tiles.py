"""Tiles of large arrays: grids with halos, and arrays exploded to rows and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def tile_grid(spark: SparkSession, width: int, height: int, size: int, halo: int) -> DataFrame:
    """GR-08: tiles of an array (those at the edge are smaller), and their span in x with the halo."""
    count = lambda n: -(-n // size)
    ids = spark.range(count(width) * count(height)).select((c("id") % count(width)).alias("tile_x"), F.expr(f"id div {count(width)}").alias("tile_y"))
    t = ids.withColumns({"x0": c("tile_x") * size, "y0": c("tile_y") * size})
    t = t.withColumns({"w": F.least(F.lit(size).cast("long"), width - c("x0")), "h": F.least(F.lit(size).cast("long"), height - c("y0"))})
    zero = F.lit(0).cast("long")
    return t.select("tile_y", "tile_x", "x0", "y0", "w", "h", F.greatest(zero, c("x0") - halo).alias("halo_x0"), F.least(F.lit(width).cast("long"), c("x0") + c("w") + halo).alias("halo_x1"))


def explode_arrays(df: DataFrame, key: str, values: str) -> DataFrame:
    """RS-01: one row an element."""
    return df.select(key, F.posexplode(values).alias("position", "value"))


def gather_arrays(df: DataFrame, key: str) -> DataFrame:
    """RS-01: elements back to arrays, in order of position."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda e: e["value"]).alias("values"))


def tiled(pixels: DataFrame, size: int, halo: int, last: DataFrame | None = None) -> DataFrame:
    """pixels (image_id, x, y, ..) in every tile of size x size whose span with the halo holds them.

    The tile is the new image: image_id becomes a struct of image, tile_y, tile_x and the image's last x and y; x and y count
    from the tile's corner, halo included. No row depends on more than its own image's size. last: image_id and the image's last
    x and y (_x, _y), where pixels doesn't hold all of it.
    """
    last = (last if last is not None else pixels.groupBy("image_id").agg(F.max("x").alias("_x"), F.max("y").alias("_y"))).toDF("image_id", "_w", "_h")
    span = lambda k, n: F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((c(k) - halo) / size)), F.least(F.floor(c(n) / size), F.floor((c(k) + halo) / size))))
    out = pixels.join(last, "image_id").withColumn("_tx", span("x", "_w")).withColumn("_ty", span("y", "_h"))
    corner = lambda k: F.greatest(F.lit(0).cast("long"), c(k) * size - halo)
    tile = F.struct("image_id", c("_ty").alias("tile_y"), c("_tx").alias("tile_x"), c("_w").alias("last_x"), c("_h").alias("last_y"))
    return out.withColumns({"x": c("x") - corner("_tx"), "y": c("y") - corner("_ty"), "image_id": tile}).drop("_w", "_h", "_tx", "_ty")


def owned(found: DataFrame, size: int, halo: int) -> DataFrame:
    """FN-16: what was found in tiles (image_id as tiled() gives it, x, y, ..), back in the image's places, by the tile whose core
    (half-open) holds it, and inside the image: each place has one owner."""
    place = lambda k: c(k) + F.greatest(F.lit(0).cast("long"), c(f"image_id.tile_{k}") * size - halo)
    out = found.withColumns({"x": place("x"), "y": place("y")})
    mine = [(F.floor(c(k) / size) == c(f"image_id.tile_{k}")) & c(k).between(F.lit(0), c(f"image_id.last_{k}")) for k in "xy"]
    return out.where(mine[0] & mine[1]).withColumn("image_id", c("image_id.image_id"))

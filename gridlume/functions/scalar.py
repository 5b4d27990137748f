"""Column functions: names, identifiers, calibration, intensities, geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(text: Column, fallback: str = "unnamed") -> Column:
    """FN-01, FN-02: runs of other than A-Z a-z 0-9 . _ - become one underscore; none at the ends; empty gives fallback."""
    s = F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]+", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(fallback))


def stable_token(text: Column, fallback: str = "unknown") -> Column:
    s = slugify(text)
    return F.when(s == "unnamed", fallback).otherwise(s)


def padded(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), F.greatest(F.length(value.cast("string")), F.lit(width)), F.lit("0"))


def trajectory_id(experiment: Column, device: Column, lane: Column, field: Column, col: Column, row: Column) -> Column:
    """FN-03: names an array position over time."""
    return F.concat(stable_token(experiment, "Experiment_001"), F.lit("__"), stable_token(device, "Array_001"), F.lit("__L"), padded(lane, 2), F.lit("__F"), padded(field, 2), F.lit("__W"), col.cast("string"), F.lit("_"), row.cast("string"))


def observation_id(trajectory: Column, timepoint: Column) -> Column:
    return F.concat(trajectory, F.lit("__T"), padded(timepoint, 2))


def object_id(observation: Column, number: Column) -> Column:
    return F.concat(observation, F.lit("__PDO"), padded(number, 2))


def focus_id(observation: Column, number: Column) -> Column:
    return F.concat(observation, F.lit("__PSCFOCUS"), padded(number, 3))


def equivalent_diameter(area_px2: Column, um_per_px: Column) -> Column:
    """FN-04"""
    return 2 * F.sqrt(area_px2 / F.pi()) * um_per_px


def area_um2(area_px2: Column, um_per_px: Column) -> Column:
    """FN-05"""
    return area_px2 * um_per_px * um_per_px


def voxel_scale(x: Column, y: Column) -> Column:
    """FN-07: mean of positive finite x and y sizes; anything else is an error."""
    good = (x > 0) & (y > 0) & ~F.isnan(x) & ~F.isnan(y)
    return F.when(F.coalesce(good, F.lit(False)), (x + y) / 2).otherwise(F.raise_error(F.lit("no valid pixel size")).cast("double"))


def scan_settings(radius_px: Column, floors: tuple[int, int] = (2, 2)) -> dict[str, Column]:
    """FN-08: radius range and spacing for a physical radius, rounded half to even. floors: least rmin, least spacing."""
    rmin = F.greatest(F.lit(floors[0]), F.bround(0.8 * radius_px).cast("long"))
    rmax = F.greatest(rmin + 2, F.bround(1.2 * radius_px).cast("long"))
    return {"rmin": rmin, "rmax": rmax, "spacing": F.greatest(F.lit(floors[1]), F.bround(1.5 * radius_px).cast("long"))}


def rescaled(value: Column, old: Column, new: Column, power: int) -> Column:
    """FN-09: a length (power 1) or area (2) under a new calibration, where both are positive."""
    factor = new / old
    return F.when((old > 0) & (new > 0), value * (factor if power == 1 else factor * factor)).otherwise(value)


def to_uint8(value: Column, top: Column) -> Column:
    """FN-10: scaled to 0-255, clipped, truncated."""
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), value * 255.0 / top))).cast("int")


def window_end(end: Column, type_max: float) -> Column:
    """FN-12"""
    return F.coalesce(F.when(end > 0, end), F.lit(type_max))


def fully_visible(x: Column, y: Column, r: Column, width: Column, height: Column) -> Column:
    """FN-15: the circle lies at least two pixels inside the image."""
    return (x - r >= 2) & (y - r >= 2) & (x + r < width - 2) & (y + r < height - 2)


def in_core(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """FN-16: half-open"""
    return (x >= x0) & (x < x1) & (y >= y0) & (y < y1)


def truthy(text: Column) -> Column:
    """FN-28"""
    return F.coalesce(F.lower(F.trim(text)).isin("true", "1"), F.lit(False))


def crop_inside(centre: Column, size: int, whole: Column) -> Column:
    """FN-21: start of a fixed crop that slides inside the image."""
    return F.greatest(F.lit(0), F.least(centre - size // 2, whole - size))


def adaptive_half(radius: Column, equivalent_radius: Column) -> Column:
    """FN-21: half-width of a crop around an object."""
    return F.least(F.ceil(1.2 * radius), F.ceil(F.greatest(F.lit(28.0), 1.9 * equivalent_radius, 0.42 * radius)))


def frame_bytes(width: Column, height: Column, components: Column, item: Column) -> Column:
    """FN-26"""
    return width.cast("long") * height.cast("long") * components.cast("long") * item.cast("long")


def natural_key(name: Column) -> Column:
    """SRC-04: runs of digits compare as numbers of any length (their own length goes first), other text in lower case."""
    digits = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    return F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1)), lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(digits(p)).cast("string"), 10, "0"), digits(p))).otherwise(p))


def series_number(name: Column, fallback: Column) -> Column:
    """SRC-05"""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"(?i)series\s*0*(\d+)", 1), F.lit("")).cast("long"), fallback)


def source_type(uri: Column) -> Column:
    """SRC-17: by suffix, without the query string."""
    u = F.lower(F.substring_index(uri, "?", 1))
    return F.when(u.endswith(".nd2"), "nd2").when(u.contains(".zarr"), "zarr").when(u.endswith(".tif") | u.endswith(".tiff"), "tiff").otherwise("unknown")


def settings_problem(object_channel: Column, focus_channel: Column, channels: Column, wells: Column, responder_max: Column, resistant_min: Column) -> Column:
    """FN-27: what is wrong with a run's settings, the first of four guards; null if nothing. Raise on it, or count it."""
    missing = (object_channel >= channels) | (focus_channel >= channels)
    return (
        F.when(missing, "Selected channel does not exist.")
        .when(object_channel == focus_channel, "One channel cannot carry both signals.")
        .when(F.coalesce(wells, F.lit(0)) == 0, "No wells were detected.")
        .when(responder_max >= resistant_min, "Responder threshold must be lower than the resistant threshold.")
    )

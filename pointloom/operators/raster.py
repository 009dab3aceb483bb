"""Bird's-eye rasters as sparse pixel tables, and their mappings from pixels to points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import index
from ..schema import RGB, has
from .groups import attach


def pixels(points: DataFrame, resolution: float = 0.1, by: Sequence[str] = ("scan_id",)) -> DataFrame:
    """Add row, col of each point, counted from the corner of its group; rows grow to the north."""
    by = list(by)
    corner = points.groupBy(*by).agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"))
    joined = attach(points, corner, by)
    return joined.withColumns(
        {"row": index((F.col("y") - F.col("_y0")) / resolution), "col": index((F.col("x") - F.col("_x0")) / resolution)}
    ).drop("_x0", "_y0")


def bev(points: DataFrame, resolution: float = 0.1, by: Sequence[str] = ("scan_id",)) -> DataFrame:
    """Three channels per filled pixel: max_z, mean_intensity (0 without the column), density."""
    mean = F.avg("intensity") if has(points, "intensity") else F.lit(0.0)
    return pixels(points, resolution, by).groupBy(*by, "row", "col").agg(
        F.max("z").alias("max_z"), mean.alias("mean_intensity"), F.count("*").cast("double").alias("density")
    )


def qa_raster(points: DataFrame, resolution: float = 0.1, by: Sequence[str] = ("scan_id",)) -> DataFrame:
    """As ``bev`` with mean colours, summed in doubles."""
    aggs = [F.max("z").alias("max_z"), F.count("*").alias("n")]
    aggs += [F.avg(c).alias(f"mean_{c}") for c in ("intensity", *RGB) if c in points.columns]
    return pixels(points, resolution, by).groupBy(*by, "row", "col").agg(*aggs)


def image_pixels(points: DataFrame, resolution: float = 0.05, tile: float = 100.0) -> DataFrame:
    """Points of half-open tiles with px, py in image order (row 0 in the north).

    Tiles count from the scan's corner; points on the far edge of a scan whose extent is a whole
    number of tiles belong to none and go.
    """
    box = points.groupBy("scan_id").agg(*[f(c).alias(f"_{c}{n}") for c in "xy" for n, f in ((0, F.min), (1, F.max))])
    g = -int(-tile // resolution) if abs(tile / resolution - round(tile / resolution)) > 1e-9 else round(tile / resolution)
    joined = attach(points, box, ["scan_id"])
    tx, ty = (F.floor((F.col(c) - F.col(f"_{c}0")) / tile) for c in "xy")
    nx, ny = (F.greatest(F.ceil((F.col(f"_{c}1") - F.col(f"_{c}0")) / tile), F.lit(1)) for c in "xy")
    placed = joined.withColumns({"tile_ix": tx, "tile_iy": ty, "_nx": nx, "_ny": ny}).where("tile_ix < _nx and tile_iy < _ny")

    def inside(c: str, t: str):
        at = index((F.col(c) - (F.col(f"_{c}0") + F.col(t) * tile)) / resolution)
        return F.least(F.greatest(at, F.lit(0)), F.lit(g - 1))

    return placed.withColumns({"px": inside("x", "tile_ix"), "py": F.lit(g - 1) - inside("y", "tile_iy")}).drop(
        "_x0", "_x1", "_y0", "_y1", "_nx", "_ny"
    )


def bev6(points: DataFrame, resolution: float = 0.05, tile: float = 100.0) -> DataFrame:
    """Six channels per filled pixel of each tile: z_max, means of intensity and colours (0 if absent), density."""
    means = [(F.avg(c) if c in points.columns else F.lit(0.0)).alias(f"{c}_mean") for c in ("intensity", *RGB)]
    return image_pixels(points, resolution, tile).groupBy("scan_id", "tile_ix", "tile_iy", "px", "py").agg(
        F.max("z").alias("z_max"), *means, F.count("*").alias("density")
    )


def bev_mapping(points: DataFrame, resolution: float = 0.05, tile: float = 100.0) -> DataFrame:
    return image_pixels(points, resolution, tile).select("scan_id", "tile_ix", "tile_iy", "point_id", "px", "py")


def pixel_lists(mapping: DataFrame, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """The points of each pixel as a sorted array; all ids of one pixel meet in a row, so a pixel must fit a task."""
    return mapping.groupBy(*keys).agg(F.sort_array(F.collect_list("point_id")).alias("point_ids"))


def display_stretch(raster: DataFrame) -> DataFrame:
    """Add z_gray, i_gray and colours from 0 to 255: height between its extremes, the others over their maximum, per tile."""
    keys = ["scan_id", "tile_ix", "tile_iy"]
    names = ["intensity_mean", *(f"{c}_mean" for c in RGB)]
    top = raster.groupBy(*keys).agg(F.min("z_max").alias("_z0"), F.max("z_max").alias("_z1"), *[F.max(c).alias(f"_{c}") for c in names])
    joined = attach(raster, top, keys)
    z = (F.col("z_max") - F.col("_z0")) / F.greatest(F.col("_z1") - F.col("_z0"), F.lit(1e-3))
    out = {"z_gray": (z * 255).cast("int")}
    for c in names:
        share = F.when(F.col(f"_{c}") > 0, F.col(c) / F.nullif(F.col(f"_{c}"), F.lit(0.0))).otherwise(0.0)
        out[c.replace("_mean", "_gray")] = (share * 255).cast("int")
    return joined.withColumns(out).drop("_z0", "_z1", *[f"_{c}" for c in names])


def normalise_density(raster: DataFrame, keys: Sequence[str] = ("scan_id",), channel: str = "density") -> DataFrame:
    """A channel over its maximum in the image (or over 1)."""
    keys = list(keys)
    top = raster.groupBy(*keys).agg(F.max(channel).alias("_top"))
    return attach(raster, top, keys).withColumn(channel, F.col(channel) / F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0)).drop("_top")


def dense(raster: DataFrame, channels: Sequence[str], keys: Sequence[str], height: int, width: int) -> DataFrame:
    """One row per image with a row-major array of floats for each channel; empty pixels are 0.

    For export only: an image of height x width must fit one task.
    """
    keys, channels = list(keys), list(channels)
    cells = raster.groupBy(*keys).agg(
        *[F.map_from_entries(F.collect_list(F.struct(F.col("row") * width + F.col("col"), F.col(c)))).alias(c) for c in channels]
    )
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(height * width - 1).cast("bigint"))

    def filled(c: str):
        return F.transform(every, lambda k: F.coalesce(F.col(c)[k], F.lit(0.0)).cast("float")).alias(c)

    return cells.select(*keys, *[filled(c) for c in channels])

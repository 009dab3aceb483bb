"""Square tiles over a scan, and what is known of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..schema import RGB, has
from .groups import attach
from .metadata import box_columns, within


def assign(points: DataFrame, size: float = 20.0, origin: tuple[float, float] | None = None) -> DataFrame:
    """Add tile_i, tile_j counted from the scan's corner; points on the far edges belong to the last tile.

    A fixed ``origin`` (as streams need) takes the place of the corner, and then nothing is clamped.
    """
    if origin is not None:
        return points.withColumns({f"tile_{k}": F.floor((F.col(c) - F.lit(o)) / size) for k, c, o in zip("ij", "xy", origin)})
    box = points.groupBy("scan_id").agg(*[f(c).alias(f"_{c}{n}") for c in "xy" for n, f in ((0, F.min), (1, F.max))])

    def tile(c: str) -> Column:
        at = F.floor((F.col(c) - F.col(f"_{c}0")) / size)
        extent = F.col(f"_{c}1") - F.col(f"_{c}0")
        return F.when(extent > 0, F.least(at, F.ceil(extent / size) - 1)).otherwise(at)

    joined = attach(points, box, ["scan_id"])
    return joined.withColumn("tile_i", tile("x")).withColumn("tile_j", tile("y"))


def tiled(points: DataFrame, size: float = 20.0) -> DataFrame:
    return assign(points, size).drop("_x0", "_x1", "_y0", "_y1")


def tile_stats(points: DataFrame, config: Config | None = None) -> DataFrame:
    """One row per tile: box, count, density, attribute statistics and all QA flags, from a single aggregate.

    Flags of columns that are absent are true. ``ground_ok`` is the QA range (closed);
    ``ground_ok_tiler`` is the narrower open range 0.1 to 0.9 that tiling reports first.
    """
    config = config or Config()
    qa, size = config.qa, config.tile_size
    given = assign(points, size)
    aggs = [F.count("*").alias("point_count"), *box_columns(), F.first("_x0").alias("_x0"), F.first("_y0").alias("_y0")]
    flags: dict[str, Column] = {}
    if has(points, "intensity"):
        aggs += [F.avg("intensity").alias("intensity_mean"), F.stddev_pop("intensity").alias("intensity_std")]
        flags["intensity_ok"] = F.col("intensity_mean") >= qa.intensity
    if has(points, "is_ground"):
        aggs.append(F.avg(F.col("is_ground").cast("double")).alias("ground_fraction"))
        flags["ground_ok"] = F.col("ground_fraction").between(qa.ground_min, qa.ground_max)
        flags["ground_ok_tiler"] = (F.col("ground_fraction") > 0.1) & (F.col("ground_fraction") < 0.9)
    if has(points, *RGB):
        aggs += [F.least(*[F.min(c) for c in RGB]).alias("_low"), F.greatest(*[F.max(c) for c in RGB]).alias("_high")]
        flags["rgb_ok"] = (F.col("_low") >= qa.rgb_min) & (F.col("_high") <= qa.rgb_max)
    one = given.groupBy("scan_id", "tile_i", "tile_j").agg(*aggs)
    density = F.col("point_count") / F.lit(size * size)
    out = one.select(
        "scan_id",
        F.col("tile_i").alias("tile_idx_i"),
        F.col("tile_j").alias("tile_idx_j"),
        (F.col("_x0") + F.col("tile_i") * size).alias("bbox_x_min"),
        (F.col("_y0") + F.col("tile_j") * size).alias("bbox_y_min"),
        (F.col("_x0") + (F.col("tile_i") + 1) * size).alias("bbox_x_max"),
        (F.col("_y0") + (F.col("tile_j") + 1) * size).alias("bbox_y_max"),
        "point_count",
        density.alias("density"),
        (density >= qa.density).alias("density_ok"),
        *[F.col(c) for c in ("intensity_mean", "intensity_std", "ground_fraction") if c in one.columns],
        *[F.coalesce(flags.get(c, F.lit(True)), F.lit(False)).alias(c) for c in ("intensity_ok", "ground_ok", "rgb_ok")],
        within(qa).alias("crs_ok"),
        *([flags["ground_ok_tiler"].alias("ground_ok_tiler")] if "ground_ok_tiler" in flags else []),
    )
    return out


def generate_tiles(spark: SparkSession, x_min: float, y_min: float, x_max: float, y_max: float, size: float) -> DataFrame:
    """(x_min, y_min, x_max, y_max) of the tiles that cover a region, column by column; made by executors."""
    nx, ny = (max(0, -int(-(b - a) // size)) for a, b in ((x_min, x_max), (y_min, y_max)))
    n = F.col("id")
    i, j = F.floor(n / F.lit(max(ny, 1))), n % F.lit(max(ny, 1))
    x, y = F.lit(float(x_min)) + i * float(size), F.lit(float(y_min)) + j * float(size)
    return spark.range(nx * ny).select(x.alias("x_min"), y.alias("y_min"), (x + size).alias("x_max"), (y + size).alias("y_max"))

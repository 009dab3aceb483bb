"""Point filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import at_least, at_most
from ..functions.windows import CHUNK, median_of, over_neighbours
from ..schema import require
from .groups import attach


def filter_range(points: DataFrame, max_range: float) -> DataFrame:
    """Points measured from at most ``max_range`` metres away."""
    require(points, "range")
    return points.where(at_most(F.col("range"), max_range))


def filter_intensity_low(points: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Points of at least this intensity; NaN goes."""
    require(points, "intensity")
    return points.where(at_least(F.col("intensity"), threshold))


def spike_filter_z(points: DataFrame, kernel: int = 5, threshold: float = 1.0, by: str = "scan_id", order: str = "point_id", chunk: int = CHUNK) -> DataFrame:
    """Points whose height is within ``threshold`` of the running median of their scan."""
    out = over_neighbours(points, ["z"], kernel, by, order, median_of, chunk)
    return out.where(F.abs(F.col("z") - F.col("z_w")) <= threshold).drop("z_w")


def uniformize_density(points: DataFrame, target: float = 100.0, seed: int = 0) -> DataFrame:
    """Thin to about ``target`` points a square metre of the scan's box.

    Which points stay depends on 52 bits of the md5 of seed and id, so reruns agree.
    """
    box = points.groupBy("scan_id").agg(
        F.count("*").alias("_n"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("_area")
    )
    keep = F.when(F.col("_area") > 0, F.least(F.lit(1.0), F.lit(float(target)) * F.col("_area") / F.col("_n"))).otherwise(1.0)
    bits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("point_id").cast("string")).cast("binary")), 1, 13)
    draw = F.conv(bits, 16, 10).cast("double") / float(1 << 52)
    return attach(points, box, ["scan_id"]).where(draw < keep).drop("_n", "_area")

"""Heights relative to the ground."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import GroundConfig
from .groups import attach, same


def _quantile(column: str, q: float, accuracy: int | None):
    return F.percentile(column, F.lit(q)) if accuracy is None else F.percentile_approx(column, F.lit(q), accuracy).cast("double")


def normalise_simple(points: DataFrame, quantile: float = 0.05, accuracy: int | None = None) -> DataFrame:
    """Heights above one quantile of the whole scan.

    The exact quantile holds the distinct heights of a scan in memory; ``accuracy`` takes a sketch instead.
    """
    ground = points.groupBy("scan_id").agg(_quantile("z", quantile, accuracy).alias("_g"))
    return attach(points, ground, ["scan_id"]).withColumn("z", F.col("z") - F.col("_g")).drop("_g")


def local_ground(points: DataFrame, config: GroundConfig | None = None) -> DataFrame:
    """(scan_id, cell_i, cell_j, z_ground): quantile of the heights in each cell of a grid from the scan's corner."""
    config = config or GroundConfig()
    return _cells(points, config).groupBy("scan_id", "cell_i", "cell_j").agg(F.percentile("z", F.lit(config.quantile)).alias("z_ground"))


def _cells(points: DataFrame, config: GroundConfig) -> DataFrame:
    corner = points.groupBy("scan_id").agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"))
    return attach(points, corner, ["scan_id"]).select(
        *points.columns,
        F.floor((F.col("x") - F.col("_x0")) / config.grid).alias("cell_i"),
        F.floor((F.col("y") - F.col("_y0")) / config.grid).alias("cell_j"),
    )


def normalise_local(points: DataFrame, config: GroundConfig | None = None, strict: bool = False) -> DataFrame:
    """Heights above the ground of each point's cell, ``z_abs`` with the old ones, and ``is_ground``.

    ``strict`` raises ValueError on an empty table, which takes a job to find out.
    """
    config = config or GroundConfig()
    if strict and points.isEmpty():
        raise ValueError("no points")
    celled = _cells(points.drop("is_ground", "z_abs"), config)
    ground = celled.groupBy("scan_id", "cell_i", "cell_j").agg(F.percentile("z", F.lit(config.quantile)).alias("_g"))
    keys = {c: f"_of_{c}" for c in ("scan_id", "cell_i", "cell_j")}
    joined = celled.join(ground.withColumnsRenamed(keys), same([(F.col(c), F.col(k)) for c, k in keys.items()])).drop(*keys.values())
    height = F.col("z") - F.col("_g")
    return (
        joined.withColumn("is_ground", F.abs(height) <= config.threshold)
        .withColumn("z_abs", F.col("z"))
        .withColumn("z", height)
        .drop("_g", "cell_i", "cell_j")
    )

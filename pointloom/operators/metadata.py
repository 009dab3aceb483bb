"""Scan metadata: boxes, coordinate range and attribute checks in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import QAConfig
from ..schema import RGB, has


def box_columns() -> list[Column]:
    return [f(c).alias(f"{c}_{n}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y", "z")]


def within(qa: QAConfig) -> Column:
    """Whether a box of columns x_min to z_max lies in the coordinate ranges; false if there are no points."""
    tests = [
        (F.col(f"{c}_min") >= r[0]) & (F.col(f"{c}_max") <= r[1]) for c, r in zip("xyz", (qa.x_range, qa.y_range, qa.z_range))
    ]
    return F.coalesce(tests[0] & tests[1] & tests[2], F.lit(False))


def bbox(points: DataFrame, by: str = "scan_id") -> DataFrame:
    return points.groupBy(by).agg(*box_columns())


def scan_metadata(points: DataFrame, epsg: int | None = None, provider: str = "unknown", qa: QAConfig | None = None) -> DataFrame:
    """One row per scan: flags, count, box, and value ranges, from a single aggregate."""
    qa = qa or QAConfig()
    aggs = [F.count("*").alias("point_count"), *box_columns()]
    rgb, intensity = has(points, *RGB), has(points, "intensity")
    if rgb:
        aggs += [F.least(*[F.min(c) for c in RGB]).alias("rgb_min"), F.greatest(*[F.max(c) for c in RGB]).alias("rgb_max")]
    if intensity:
        aggs += [F.min("intensity").alias("intensity_min"), F.max("intensity").alias("intensity_max")]
    one = points.groupBy("scan_id").agg(*aggs)
    wrong = epsg is not None and epsg != qa.epsg
    crs_ok = F.lit(False) if wrong else within(qa)
    low, high = F.col("rgb_min").cast("int"), F.col("rgb_max").cast("int")
    has_rgb = F.coalesce((low >= 0) & (high <= 255), F.lit(False)) if rgb else F.lit(False)
    has_intensity = F.coalesce((F.col("intensity_min") >= 0) & (F.col("intensity_max") > 0), F.lit(False)) if intensity else F.lit(False)
    none_int, none_double = F.lit(None).cast("struct<min:int,max:int>"), F.lit(None).cast("struct<min:double,max:double>")
    return one.select(
        "scan_id",
        crs_ok.alias("crs_ok"),
        has_rgb.alias("has_rgb"),
        has_intensity.alias("has_intensity"),
        "point_count",
        F.struct(*[F.col(c) for c in ("x_min", "y_min", "z_min", "x_max", "y_max", "z_max")]).alias("bbox"),
        F.lit(provider).alias("provider"),
        (F.when(crs_ok, F.lit(qa.epsg)) if epsg is None else F.lit(epsg)).cast("int").alias("crs_epsg"),
        (F.struct(low.alias("min"), high.alias("max")) if rgb else none_int).alias("rgb_range"),
        (F.struct(F.col("intensity_min").alias("min"), F.col("intensity_max").alias("max")) if intensity else none_double).alias("intensity_range"),
    )

"""Quality reports over tiles, views and lanes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import has
from .groups import same


def approved(strict: bool = False) -> Column:
    """Whether a tile passes: density, intensity, ground and coordinates; ``strict`` asks for colours too."""
    flags = ["density_ok", "intensity_ok", "ground_ok", "crs_ok", *(["rgb_ok"] if strict else [])]
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(f), F.lit(False)) for f in flags])


def route(tiles: DataFrame) -> DataFrame:
    """Add qa_status: approved or review."""
    return tiles.withColumn("qa_status", F.when(approved(), F.lit("approved")).otherwise(F.lit("review")))


def flag_points(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """Points of the given tiles, with their tile's flags and statistics as qa_ columns; a scan without a name is one too."""
    flags = [c for c in tiles.columns if c.endswith("_ok") or c in ("intensity_mean", "intensity_std", "ground_fraction")]
    keys = {"scan_id": "scan_id", "tile_i": "tile_idx_i", "tile_j": "tile_idx_j"}
    own = tiles.select(*[F.col(c).alias(f"_of_{k}") for k, c in keys.items()], *[F.col(c).alias(f"qa_{c}") for c in flags])
    return points.join(own, same([(F.col(k), F.col(f"_of_{k}")) for k in keys])).drop(*[f"_of_{k}" for k in keys])


def all_flags(tiles: DataFrame) -> Column:
    """The summary's count of good tiles: every flag true and every statistic non-zero, colours included."""
    bools = [F.col(c) for c in ("density_ok", "intensity_ok", "ground_ok", "crs_ok", "rgb_ok")]
    numbers = [F.col(c) != 0 for c in ("intensity_mean", "intensity_std", "ground_fraction") if c in tiles.columns]
    return F.coalesce(reduce(lambda a, b: a & b, [*bools, *numbers]), F.lit(False))


def pass_rates(tiles: DataFrame) -> DataFrame:
    """(flag, pass_rate): share of tiles in percent for every flag."""
    flags = [c for c, kind in tiles.dtypes if kind == "boolean"]
    rates = tiles.agg(*[(F.avg(F.col(c).cast("int")) * 100).alias(c) for c in flags])
    return rates.unpivot([], flags, "flag", "pass_rate")


def density_histogram(tiles: DataFrame, bins: int = 30) -> DataFrame:
    """(bin, low, high, n): equal bins over the range of densities, the last one closed; empty bins have n 0."""
    span = tiles.agg(F.min("density").alias("lo"), F.max("density").alias("hi")).where("lo is not null")
    # one value alone spreads over half a unit to both sides
    flat = F.col("lo") == F.col("hi")
    span = span.select(F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.col("density") - F.col("lo")) / width), F.lit(bins - 1))
    found = tiles.crossJoin(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    edges = span.select("lo", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("b"))
    return edges.join(found, F.col("b") == F.col("bin"), "left").select(
        F.col("b").cast("bigint").alias("bin"),
        (F.col("lo") + F.col("b") * F.col("w")).alias("low"),
        (F.col("lo") + (F.col("b") + 1) * F.col("w")).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def overview(tiles: DataFrame) -> DataFrame:
    """One row: counts of tiles by status, and statistics of density and points."""
    return route(tiles).agg(
        F.count("*").alias("tiles"),
        F.count_if(F.col("qa_status") == "approved").alias("approved"),
        F.count_if(F.col("qa_status") == "review").alias("review"),
        F.avg("density").alias("density_mean"),
        F.min("density").alias("density_min"),
        F.max("density").alias("density_max"),
        F.sum("point_count").alias("points"),
        F.avg("point_count").alias("points_mean"),
    )


def views_overview(views: DataFrame, least: int = 1) -> DataFrame:
    """Per direction: views, passes and failures by their number of points, and statistics of it. Views: (direction, points)."""
    ok = F.col("points") >= least
    return views.groupBy("direction").agg(
        F.count("*").alias("views"),
        F.count_if(ok).alias("passed"),
        F.count_if(~ok).alias("failed"),
        F.sum("points").alias("points_sum"),
        F.avg("points").alias("points_mean"),
        F.min("points").alias("points_min"),
        F.max("points").alias("points_max"),
    )


def report_rollup(tiles: DataFrame) -> DataFrame:
    """Points and approved tiles by scan and tile column, with subtotals (an extension)."""
    return route(tiles).rollup("scan_id", "tile_idx_i").agg(
        F.sum("point_count").alias("points"), F.count_if(F.col("qa_status") == "approved").alias("approved")
    )


def point_cloud_qa(points: DataFrame, tile_size: float, density: float = 50.0, intensity: float = 1.0) -> DataFrame:
    """(scan_id, density_ok, intensity_ok) of points taken as one tile; without intensities their mean counts as 1."""
    mean = F.avg("intensity") if has(points, "intensity") else F.lit(1.0)
    return points.groupBy("scan_id").agg(
        (F.count("*") / F.lit(tile_size * tile_size) >= density).alias("density_ok"),
        F.coalesce(mean >= intensity, F.lit(False)).alias("intensity_ok"),
    )


def lane_separation(lanes: DataFrame, least: float = 3.0) -> DataFrame:
    """(pairs, mean_separation, lane_separation_ok): mean distance over all pairs of lanes(lane_id, seq, x, y).

    The longer of two lanes is sampled at the shorter one's number of points. No pair: separated.
    """
    size = lanes.groupBy("lane_id").agg(F.count("*").alias("n"))
    a, b = size.select(F.col("lane_id").alias("a"), F.col("n").alias("na")), size.select(F.col("lane_id").alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b, F.col("a") < F.col("b")).withColumn("m", F.least("na", "nb"))
    steps = pairs.withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("m") - 1).cast("int"))))

    def at(n: str) -> Column:
        return F.when(F.col("m") <= 1, F.lit(0)).otherwise((F.col("k") * ((F.col(n) - 1) / F.nullif(F.col("m") - 1, F.lit(0)))).cast("bigint"))

    wanted = steps.select("a", "b", "k", at("na").alias("sa"), at("nb").alias("sb"))
    pa = lanes.select(F.col("lane_id").alias("a"), F.col("seq").alias("sa"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    pb = lanes.select(F.col("lane_id").alias("b"), F.col("seq").alias("sb"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    apart = wanted.join(pa, ["a", "sa"]).join(pb, ["b", "sb"]).withColumn("d", F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")))
    per_pair = apart.groupBy("a", "b").agg(F.avg("d").alias("d"))
    return per_pair.agg(F.count("*").alias("pairs"), F.avg("d").alias("mean_separation")).withColumn(
        "lane_separation_ok", F.coalesce(F.col("mean_separation") >= least, F.lit(True))
    )

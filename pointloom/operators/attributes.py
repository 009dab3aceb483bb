"""Intensity and colour normalisation, marking contrast, and material classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AttributeConfig
from ..functions.scalar import clamp
from ..schema import RGB, has, require
from .groups import attach


def compensate_range(distance: Column, intensity: Column, reference: float = 50.0) -> Column:
    """Intensity scaled by the square of its distance over the reference; distances below 1 mm count as 1 mm."""
    d = F.greatest(distance, F.lit(1e-3)) / reference
    return intensity * d * d


def normalise_rgb(points: DataFrame, config: AttributeConfig | None = None) -> DataFrame:
    """Clip colours; with white balance, scale each channel's mean of the scan to their common mean and clip again."""
    config = config or AttributeConfig()
    clip = lambda c: clamp(c, config.rgb_min, config.rgb_max)
    out = points.withColumns({c: clip(F.col(c)) for c in RGB})
    if not config.white_balance:
        return out
    means = out.groupBy("scan_id").agg(*[F.avg(c).alias(f"_{c}") for c in RGB])
    grey = (F.col("_r") + F.col("_g") + F.col("_b")) / 3
    usable = (F.col("_r") > 0) & (F.col("_g") > 0) & (F.col("_b") > 0)
    joined = attach(out, means, ["scan_id"])
    return joined.withColumns(
        {c: F.when(usable, clip(F.col(c) * (grey / F.nullif(F.col(f"_{c}"), F.lit(0.0))))).otherwise(F.col(c)) for c in RGB}
    ).drop("_r", "_g", "_b")


def white_balance_means(points: DataFrame) -> DataFrame:
    """(scan_id, mean_r, mean_g, mean_b, grey)."""
    means = points.groupBy("scan_id").agg(*[F.avg(c).alias(f"mean_{c}") for c in RGB])
    return means.withColumn("grey", (F.col("mean_r") + F.col("mean_g") + F.col("mean_b")) / 3)


def marking_contrast(points: DataFrame, bright: float = 200.0, dark: float = 50.0) -> DataFrame:
    """(scan_id, n_bright, n_dark, ratio, contrast_ok): bright over dark points; ratio 0 and false if none is dark."""
    i = F.col("intensity")
    counts = points.groupBy("scan_id").agg(
        F.count_if((i >= bright) & ~F.isnan(i)).alias("n_bright"), F.count_if(i <= dark).alias("n_dark")
    )
    ratio = F.coalesce(F.try_divide(F.col("n_bright").cast("double"), F.col("n_dark").cast("double")), F.lit(0.0))
    return counts.withColumn("ratio", ratio).withColumn(
        "contrast_ok", (F.col("n_dark") > 0) & (F.col("n_bright") > 0) & (F.col("ratio") > 0.01)
    )


def normalise(points: DataFrame, config: AttributeConfig | None = None, roughness: bool = True) -> DataFrame:
    """Range-compensated and clamped intensity, clipped colours, and if asked for a roughness proxy: the distance from the mean height.

    Without range or intensity the points are returned as they are.
    """
    config = config or AttributeConfig()
    if not has(points, "range", "intensity"):
        return points
    i = compensate_range(F.col("range"), F.col("intensity"), config.reference_range)
    out = points.withColumn("intensity", clamp(i, config.intensity_min, config.intensity_max))
    if has(points, *RGB):
        out = normalise_rgb(out, config)
    if not roughness:
        return out
    mean = out.groupBy("scan_id").agg(F.avg("z").alias("_z"))
    return attach(out, mean, ["scan_id"]).withColumn("roughness", F.abs(F.col("z") - F.col("_z"))).drop("_z")


def preclassify(points: DataFrame, clusters: int = 3, seeds: tuple[int, ...] = (0, 1, 2, 3, 4), max_iter: int = 30) -> DataFrame:
    """Add ``material``: classes of (intensity, roughness) by k-means, numbered by ascending intensity of their centres.

    The best of several seeds counts; centres are fitted on executors and only they reach the driver.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    require(points, "intensity", "roughness")
    ready = VectorAssembler(inputCols=["intensity", "roughness"], outputCol="_f", handleInvalid="skip").transform(points)
    models = [KMeans(k=clusters, seed=s, featuresCol="_f", predictionCol="_k", maxIter=max_iter).fit(ready) for s in seeds]
    best = min(models, key=lambda m: m.summary.trainingCost)
    order = sorted(range(len(best.clusterCenters())), key=lambda k: tuple(best.clusterCenters()[k]))
    names = F.create_map(*[F.lit(x) for k, c in enumerate(order) for x in (c, k)])
    return best.transform(ready).withColumn("material", names[F.col("_k")]).drop("_f", "_k")

"""Road objects fitted to clusters of points (cluster_id, point_id, x, y, z).

Second moments are taken about each cluster's mean, in a second pass: national grid coordinates are
too large to square.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def centred(points: DataFrame) -> DataFrame:
    """Add the cluster's mean mx, my and the offsets u, v from it."""
    mean = points.groupBy("cluster_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return points.join(mean, "cluster_id").withColumns({"u": F.col("x") - F.col("mx"), "v": F.col("y") - F.col("my")})


def fit_circles(points: DataFrame) -> DataFrame:
    """(cluster_id, n, cx, cy, radius): algebraic least squares circles.

    Fewer than three points: the mean and radius 0. Points on one line have no circle: null.
    """
    u, v = F.col("u"), F.col("v")
    q = u * u + v * v
    m = centred(points).groupBy("cluster_id").agg(
        F.count("*").alias("n"), F.first("mx").alias("mx"), F.first("my").alias("my"),
        F.sum(u * u).alias("uu"), F.sum(v * v).alias("vv"), F.sum(u * v).alias("uv"), F.sum(u * q).alias("uq"), F.sum(v * q).alias("vq"),
    )
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    flat = det <= 1e-12 * F.greatest(F.col("uu") * F.col("vv"), F.lit(1e-300))
    d = F.when(~flat, det)
    a = (F.col("uq") * F.col("vv") - F.col("vq") * F.col("uv")) / (2 * d)
    b = (F.col("vq") * F.col("uu") - F.col("uq") * F.col("uv")) / (2 * d)
    few = F.col("n") < 3
    r = F.sqrt(a * a + b * b + (F.col("uu") + F.col("vv")) / F.col("n"))
    return m.select(
        "cluster_id", "n",
        F.when(few, F.col("mx")).otherwise(F.col("mx") + a).alias("cx"),
        F.when(few, F.col("my")).otherwise(F.col("my") + b).alias("cy"),
        F.when(few, F.lit(0.0)).otherwise(r).alias("radius"),
    )


def extract_manholes(points: DataFrame) -> DataFrame:
    return fit_circles(points).where("radius > 0.1 and radius < 1.5")


def extract_masts(points: DataFrame) -> DataFrame:
    """(cluster_id, cx, cy, radius, height) of upright cylinders: mean distance from the centre, range of heights."""
    fit = centred(points).groupBy("cluster_id").agg(
        F.count("*").alias("n"), F.first("mx").alias("cx"), F.first("my").alias("cy"),
        F.avg(F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))).alias("radius"), (F.max("z") - F.min("z")).alias("height"),
    )
    return fit.where("n >= 10 and radius > 0.02 and radius < 0.5 and height > 2.0").drop("n")


def sign_moments(points: DataFrame) -> DataFrame:
    """Centre, lowest height and sample covariances of clusters of five points or more."""
    mean = points.groupBy("cluster_id").agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
    off = points.join(mean, "cluster_id").withColumns({f"d{c}": F.col(c) - F.col(f"c{c}") for c in "xyz"})
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz")
    m = off.groupBy("cluster_id").agg(
        F.count("*").alias("n"), *[F.first(f"c{c}").alias(f"c{c}") for c in "xyz"], F.min("z").alias("height"),
        *[F.sum(F.col(f"d{p[0]}") * F.col(f"d{p[1]}")).alias(p) for p in pairs],
    )
    return m.where("n >= 5").withColumns({p: F.col(p) / (F.col("n") - 1) for p in pairs})


def extract_signs(points: DataFrame) -> DataFrame:
    """(cluster_id, cx, cy, cz, nx, ny, nz, height): planes by the direction of least variance, first non-zero component positive.

    The eigenvectors of one small matrix per cluster are the only work in Python.
    """
    m = sign_moments(points)

    @F.pandas_udf("struct<nx:double,ny:double,nz:double>")
    def normal(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        a = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=1).reshape(-1, 3, 3)
        v = np.linalg.eigh(a)[1][:, :, 0] if len(a) else np.zeros((0, 3))
        big = np.abs(v) > 1e-12
        lead = np.take_along_axis(v, big.argmax(axis=1)[:, None], axis=1)
        v = v * np.where(lead < 0, -1.0, 1.0)
        return pd.DataFrame(v, columns=["nx", "ny", "nz"])

    out = m.withColumn("_n", normal("xx", "xy", "xz", "yy", "yz", "zz"))
    return out.select("cluster_id", "cx", "cy", "cz", "_n.nx", "_n.ny", "_n.nz", "height")


def principal_angle(cxx: Column, cyy: Column, cxy: Column) -> Column:
    """Angle of the direction of most variance, within a quarter turn of the x axis."""
    return F.atan2(2 * cxy, cxx - cyy) / 2


def along_axis(points: DataFrame, least: int = 2) -> DataFrame:
    """Order clusters of ``least`` points or more along their principal axis: adds t (rounded for exact ties) and seq."""
    c = centred(points)
    u, v = F.col("u"), F.col("v")
    m = c.groupBy("cluster_id").agg(F.count("*").alias("n"), F.sum(u * u).alias("uu"), F.sum(v * v).alias("vv"), F.sum(u * v).alias("uv"))
    turned = m.where(F.col("n") >= least).select("cluster_id", "n", principal_angle(F.col("uu"), F.col("vv"), F.col("uv")).alias("a"))
    t = c.join(turned, "cluster_id").withColumn("t", F.round(u * F.cos("a") + v * F.sin("a"), 9))
    w = Window.partitionBy("cluster_id").orderBy("t", "point_id")
    return t.withColumn("seq", (F.row_number().over(w) - 1).cast("bigint")).drop("mx", "my", "u", "v", "a")


def extract_markings(points: DataFrame) -> DataFrame:
    """(cluster_id, seq, point_id, x, y): a polyline through each cluster."""
    return along_axis(points).select("cluster_id", "seq", "point_id", "x", "y")


def extract_guardrails(points: DataFrame, least_points: int = 10, least_length: float = 2.0) -> DataFrame:
    """(cluster_id, seq, point_id, x, y, z) of clusters that are long enough from end to end."""
    line = along_axis(points, least_points)
    ends = line.groupBy("cluster_id").agg(*[f(c, "seq").alias(f"{n}{c}") for n, f in (("a", F.min_by), ("b", F.max_by)) for c in ("x", "y")])
    far = ends.where(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) >= least_length).select("cluster_id")
    return line.join(far, "cluster_id", "left_semi").select("cluster_id", "seq", "point_id", "x", "y", "z")

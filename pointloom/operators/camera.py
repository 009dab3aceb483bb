"""Virtual cameras: pinhole projection, views along an axis, and the nearest point of each pixel."""

from __future__ import annotations

from math import cos, pi, sin, tan

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import index
from . import axis as axes

#: The six views around a pose and their angles to the axis, in degrees.
DIRECTIONS = (("front", 0.0), ("front_right", -60.0), ("back_right", -120.0), ("back", 180.0), ("back_left", 120.0), ("front_left", 60.0))


def project(points: DataFrame, yaw: float = 0.0, width: int = 1024, height: int = 768, focal: float = 800.0) -> DataFrame:
    """Add row, col, depth of points seen by a camera at the origin that looks along x, turned by ``yaw``.

    Points behind the camera go before the division; pixels are cut towards zero before the viewport test.
    """
    c, s = cos(yaw), sin(yaw)
    turned = points.withColumns({"depth": F.col("x") * c - F.col("y") * s, "_y": F.col("x") * s + F.col("y") * c}).where("depth > 0")
    u = F.lit(float(focal)) * (F.col("_y") / F.col("depth")) + width / 2
    v = F.lit(float(focal)) * (F.col("z") / F.col("depth")) + height / 2
    # tested as doubles: beside the camera a pixel is too far out for any integer. What lies in (-1, 0) is cut to 0.
    seen = turned.withColumns({"_u": u, "_v": v}).where((F.col("_u") > -1) & (F.col("_u") < width) & (F.col("_v") > -1) & (F.col("_v") < height))
    return seen.withColumns({"col": index(F.col("_u")), "row": index(F.col("_v"))}).drop("_y", "_u", "_v")


def directions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DIRECTIONS), "direction string, yaw_offset double")


def near_poses(poses: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Pairs of poses(pose columns px, py) and points within ``radius`` in the plane.

    A band join: points fall into square buckets as wide as the radius, poses are dealt to the nine
    buckets around theirs, and pairs that meet in a bucket are tested exactly.
    """
    cell = lambda c: F.floor(F.col(c) / float(radius))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    dealt = (
        poses.withColumn("_o", F.explode(around))
        .withColumn("_bx", cell("px") + F.col("_o.i"))
        .withColumn("_by", cell("py") + F.col("_o.j"))
        .drop("_o")
    )
    keyed = points.withColumn("_cx", cell("x")).withColumn("_cy", cell("y"))
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    hit = (F.col("_bx") == F.col("_cx")) & (F.col("_by") == F.col("_cy")) & (dx * dx + dy * dy <= float(radius) ** 2)
    return dealt.join(keyed, hit).drop("_bx", "_by", "_cx", "_cy")


def poses(axis: DataFrame, points: DataFrame, step: float, height: float = 2.0) -> DataFrame:
    """(axis_id, pose_idx, s, px, py, pz, yaw): samples of the axis, two metres above it or above the cloud's mean height."""
    at = axes.sample(axis, step)
    base = at.select("axis_id", F.col("i").alias("pose_idx"), "s", F.col("x").alias("px"), F.col("y").alias("py"), *([F.col("z").alias("_z")] if "z" in at.columns else []), F.atan2("ty", "tx").alias("yaw"))
    if "z" in at.columns:
        return base.withColumn("pz", F.col("_z") + height).drop("_z")
    mean = points.agg(F.avg("z").alias("_m"))
    return base.crossJoin(F.broadcast(mean)).withColumn("pz", F.col("_m") + height).drop("_m")


def project_views(pairs: DataFrame, views: DataFrame, width: int = 1920, height: int = 1080, fov_deg: float = 60.0) -> DataFrame:
    """Pixels u, v and depth of every pair of pose and point in each view that holds it."""
    fx = width / (2.0 * tan(fov_deg * pi / 180.0 / 2.0))
    all_views = pairs.crossJoin(F.broadcast(views))  # six rows
    yaw = F.col("yaw") + F.radians("yaw_offset")
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    turned = all_views.withColumn("view_yaw", yaw).withColumns(
        {"depth": F.cos("view_yaw") * dx + F.sin("view_yaw") * dy, "_y": -F.sin("view_yaw") * dx + F.cos("view_yaw") * dy}
    )
    front = turned.where("depth > 0")
    u = F.rint(F.lit(fx) * (F.col("_y") / F.col("depth")) + width / 2.0)
    v = F.rint(F.lit(fx) * ((F.col("pz") - F.col("z")) / F.col("depth")) + height / 2.0)
    # tested as rounded doubles, before the cast: beside the camera a pixel is too far out for any integer
    seen = front.withColumns({"_u": u, "_v": v}).where((F.col("_u") >= 0) & (F.col("_u") < width) & (F.col("_v") >= 0) & (F.col("_v") < height))
    return seen.withColumns({"u": F.col("_u").cast("bigint"), "v": F.col("_v").cast("bigint")}).drop("_y", "_u", "_v")


def z_buffer(projected: DataFrame, keys: list[str]) -> DataFrame:
    """The nearest point of each pixel; of equally near ones the smallest id."""
    w = Window.partitionBy(*keys).orderBy("depth", "point_id")
    return projected.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def views_along_axis(points: DataFrame, axis: DataFrame, width: int = 1920, height: int = 1080, fov_deg: float = 60.0, step: float = 10.0, radius: float = 30.0) -> DataFrame:
    """Mapping of six views at every pose along an axis: (axis_id, pose_idx, s, direction, yaw_deg, scan_id, point_id, px, py, depth)."""
    pairs = near_poses(poses(axis, points, step), points, radius)
    seen = project_views(pairs, directions(points.sparkSession), width, height, fov_deg)
    nearest = z_buffer(seen, ["axis_id", "pose_idx", "direction", "u", "v"])
    return nearest.select(
        "axis_id", "pose_idx", "s", "direction", F.degrees("view_yaw").alias("yaw_deg"), "scan_id", "point_id",
        F.col("u").alias("px"), F.col("v").alias("py"), "depth", *[c for c in ("r", "g", "b") if c in points.columns],
    )

"""A simple road model: encoded markings, lanes and elevation profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import gradient
from . import axis as axes

CORRIDOR = 2.5


def encode_markings(lines: DataFrame, width_mm: float = 100.0) -> DataFrame:
    """(cluster_id, geometry, marking_type, width_mm, pattern_length_m) of polylines (cluster_id, seq, x, y)."""
    w = Window.partitionBy("cluster_id").orderBy("seq")
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    steps = lines.select("cluster_id", "seq", "x", "y", step.alias("d"))
    ordered = F.sort_array(F.collect_list(F.struct("seq", "x", "y")))
    return steps.groupBy("cluster_id").agg(
        F.transform(ordered, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("geometry"),
        F.lit("solid").alias("marking_type"),
        F.lit(float(width_mm)).alias("width_mm"),
        F.sum("d").alias("pattern_length_m"),
    )


def encode_geometries(lines: DataFrame, width_mm: float = 100.0) -> DataFrame:
    """The same for polylines held as arrays (``geometry``); empty ones go."""
    g = F.col("geometry")
    pairs = F.zip_with(F.slice(g, 1, F.size(g) - 1), F.slice(g, 2, F.size(g) - 1), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, d: acc + d)
    return lines.where(F.size("geometry") > 0).select(
        *[c for c in lines.columns if c != "geometry"], "geometry",
        F.lit("solid").alias("marking_type"), F.lit(float(width_mm)).alias("width_mm"), total.alias("pattern_length_m"),
    )


def construct_lanes(centre: DataFrame, lane_width: float, num_lanes: int = 2) -> DataFrame:
    """(axis_id, lane_id, seq, x, y): lines beside a centre line (axis_id, seq, x, y), along its normals."""
    w = Window.partitionBy("axis_id").orderBy("seq")
    g = centre.select("axis_id", "seq", "x", "y", gradient("x", w).alias("gx"), gradient("y", w).alias("gy"))
    n = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    n = F.when(n == 0, 1.0).otherwise(n)
    lanes = F.explode(F.sequence(F.lit(0), F.lit(num_lanes - 1))) if num_lanes > 0 else F.explode(F.array().cast("array<int>"))
    offset = (F.col("lane_id") - (num_lanes - 1) / 2) * float(lane_width)
    return g.withColumns({"nx": -F.col("gy") / n, "ny": F.col("gx") / n}).withColumn("lane_id", lanes).select(
        "axis_id", "lane_id", "seq", (F.col("x") + F.col("nx") * offset).alias("x"), (F.col("y") + F.col("ny") * offset).alias("y")
    )


def profile_samples(alignment: DataFrame, step: float = 0.5) -> DataFrame:
    """(axis_id, i, s, ax, ay, nx, ny, tx, ty): samples with normal and tangent; the last may lie past the end."""
    at = axes.locate(axes.sample_positions(alignment, step, past_end=True), alignment, closed_left=True)
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    length = F.sqrt(dx * dx + dy * dy)
    t = (F.col("s") - F.col("s0")) / F.greatest(length, F.lit(1e-6))
    unit = length + 1e-12
    return at.select(
        "axis_id", "i", "s", (F.col("x0") + t * dx).alias("ax"), (F.col("y0") + t * dy).alias("ay"),
        (-dy / unit).alias("nx"), (dx / unit).alias("ny"), (dx / unit).alias("tx"), (dy / unit).alias("ty"), "k",
    )


def elevation_profiles(points: DataFrame, alignment: DataFrame, step: float = 0.5, strict: bool = False, reach: float = 50.0) -> DataFrame:
    """(axis_id, i, s, z_median) at every sample; null where the corridor is empty.

    The default corridor has no bound along the axis. All samples of a segment share its line, so each segment's corridor is laid
    over square cells of ``reach`` metres within the points' box, and points meet the segments of their cell. ``strict`` takes
    only points within half a step along the axis, by a band join on buckets of ``reach`` metres.
    """
    samples = profile_samples(alignment, step)
    across = F.abs((F.col("x") - F.col("ax")) * F.col("nx") + (F.col("y") - F.col("ay")) * F.col("ny")) < CORRIDOR
    if strict:
        along = F.abs((F.col("x") - F.col("ax")) * F.col("tx") + (F.col("y") - F.col("ay")) * F.col("ty")) <= step / 2
        around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        dealt = samples.drop("k").withColumn("_o", F.explode(around)).select(
            "*", (F.floor(F.col("ax") / reach) + F.col("_o.i")).alias("_bx"), (F.floor(F.col("ay") / reach) + F.col("_o.j")).alias("_by")
        )
        keyed = points.select("x", "y", "z", F.floor(F.col("x") / reach).alias("_cx"), F.floor(F.col("y") / reach).alias("_cy"))
        hit = dealt.join(keyed, (F.col("_bx") == F.col("_cx")) & (F.col("_by") == F.col("_cy")) & across & along)
    else:
        near = points.select("x", "y", "z", F.floor(F.col("x") / reach).alias("_cx"), F.floor(F.col("y") / reach).alias("_cy"))
        met = near.join(corridor_cells(samples, points, reach), ["_cx", "_cy"]).drop("_cx", "_cy")
        mine = samples.withColumnsRenamed({"axis_id": "_axis", "k": "_seg"})
        hit = met.join(mine, F.col("axis_id").eqNullSafe(F.col("_axis")) & (F.col("k") == F.col("_seg")) & across).drop("_axis", "_seg")
    medians = hit.groupBy("axis_id", "i").agg(F.median("z").alias("z_median"))
    return samples.select("axis_id", "i", "s").join(medians, ["axis_id", "i"], "left")


def corridor_cells(samples: DataFrame, points: DataFrame, reach: float) -> DataFrame:
    """(axis_id, k, _cx, _cy): the cells of ``reach`` metres in the points' box that the corridor of segment k touches.

    A segment without length has no direction, and its corridor is everything.
    """
    box = points.agg(*[f(c).alias(f"_{c}{n}") for c in "xy" for n, f in ((0, F.min), (1, F.max))]).where("_x0 is not null")
    lines = samples.groupBy("axis_id", "k").agg(*[F.min_by(c, "i").alias(c) for c in ("ax", "ay", "nx", "ny")])
    flat = F.abs("ny") >= F.abs("nx")  # closer to the x axis: walk along x, else along y

    def turned(x: str, y: str) -> Column:
        return F.when(flat, F.col(x)).otherwise(F.col(y))

    cell = lambda c: F.floor(c / reach)
    walk = lines.crossJoin(F.broadcast(box)).select(  # one row
        "axis_id", "k", flat.alias("flat"), turned("ax", "ay").alias("u"), turned("ay", "ax").alias("v"),
        F.try_divide(turned("nx", "ny"), turned("ny", "nx")).alias("fall"), F.try_divide(F.lit(CORRIDOR + 1e-3), F.abs(turned("ny", "nx"))).alias("half"),
        turned("_x0", "_y0").alias("u0"), turned("_x1", "_y1").alias("u1"), turned("_y0", "_x0").alias("v0"), turned("_y1", "_x1").alias("v1"),
    )
    each = walk.withColumn("c", F.explode(F.sequence(cell(F.col("u0")), cell(F.col("u1")))))
    ends = [F.col("v") - F.col("fall") * (end * reach - F.col("u")) for end in (F.col("c"), F.col("c") + 1)]
    low = F.greatest(F.col("v0"), F.coalesce(F.least(*ends) - F.col("half"), F.col("v0")))
    high = F.least(F.col("v1"), F.coalesce(F.greatest(*ends) + F.col("half"), F.col("v1")))
    crossed = each.withColumns({"low": low, "high": high}).where("low <= high").withColumn("d", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    pick = lambda a, b: F.when(F.col("flat"), F.col(a)).otherwise(F.col(b))
    return crossed.select("axis_id", "k", pick("c", "d").alias("_cx"), pick("d", "c").alias("_cy"))


def cross_slope(points: DataFrame, bin_length: float = 10.0) -> DataFrame:
    """Slope of heights across the axis by bin of chainage, from points(s, d, z) (an extension)."""
    return points.groupBy(F.floor(F.col("s") / bin_length).alias("bin")).agg(F.regr_slope("z", "d").alias("slope"), F.count("*").alias("n"))

"""Axes: chainage, segments, regular samples and tangents. An axis is (axis_id, seq, x, y[, z])."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import unit


def chainage(axis: DataFrame) -> DataFrame:
    """Add s, the length of the axis up to each vertex."""
    w = Window.partitionBy("axis_id").orderBy("seq")
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    return axis.withColumn("_d", step).withColumn("s", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def segments(axis: DataFrame) -> DataFrame:
    """(axis_id, k, n, s0, s1, x0, y0, x1, y1[, z0, z1]) of the n segments of each axis, k from 0."""
    w = Window.partitionBy("axis_id").orderBy("seq")
    z = [c for c in ("z",) if c in axis.columns]
    ends = chainage(axis).select(
        "axis_id",
        (F.row_number().over(w) - 1).alias("k"),
        (F.count("*").over(Window.partitionBy("axis_id")) - 1).alias("n"),
        *[F.col(c).alias(f"{c}0") for c in ("s", "x", "y", *z)],
        *[F.lead(c).over(w).alias(f"{c}1") for c in ("s", "x", "y", *z)],
    )
    return ends.where("s1 is not null")


def sample_positions(axis: DataFrame, step: float, strict: bool = False, past_end: bool = False) -> DataFrame:
    """(axis_id, i, s) every ``step`` from 0 to the end; ``past_end`` adds the sample that may lie beyond it.

    Axes without length give no sample; ``strict`` raises ValueError if there are any.
    """
    total = chainage(axis).groupBy("axis_id").agg(F.max("s").alias("total"))
    if strict and not total.where("total <= 0").isEmpty():
        raise ValueError("an axis has no length")
    ok = total.where("total > 0")
    last = F.ceil((F.col("total") + step) / step) - 1 if past_end else F.floor(F.col("total") / step)
    i = F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")))
    return ok.select("axis_id", i.alias("i")).withColumn("s", F.col("i") * F.lit(float(step)))


def locate(samples: DataFrame, axis: DataFrame, closed_left: bool = False) -> DataFrame:
    """Join each sample to its segment: the last whose start is below s (``closed_left``: at or below), clamped to the axis.

    Segments are far fewer than points; the join is an equi-join on the axis with a range condition.
    """
    seg = segments(axis).withColumnRenamed("axis_id", "_axis")
    s = F.col("s")
    if closed_left:
        hit = ((s >= F.col("s0")) | (F.col("k") == 0)) & ((s < F.col("s1")) | (F.col("k") == F.col("n") - 1))
    else:
        hit = ((s > F.col("s0")) | (F.col("k") == 0)) & ((s <= F.col("s1")) | (F.col("k") == F.col("n") - 1))
    return samples.join(seg, (F.col("axis_id") == F.col("_axis")) & hit).drop("_axis")


def sample(axis: DataFrame, step: float, strict: bool = False) -> DataFrame:
    """(axis_id, i, s, x, y[, z], tx, ty): interpolated positions with the unit tangent of their segment."""
    at = locate(sample_positions(axis, step, strict), axis)
    t = F.when(F.col("s1") == F.col("s0"), 0.0).otherwise((F.col("s") - F.col("s0")) / F.nullif(F.col("s1") - F.col("s0"), F.lit(0.0)))
    tx, ty = unit(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    mid = [((1.0 - F.col("_t")) * F.col(f"{c}0") + F.col("_t") * F.col(f"{c}1")).alias(c) for c in ("x", "y", "z") if f"{c}0" in at.columns]
    return at.withColumn("_t", t).select("axis_id", "i", "s", *mid, tx.alias("tx"), ty.alias("ty"))

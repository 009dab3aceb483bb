"""Ordered windows whose edges repeat the first and last value, exact in chunks.

A scan may hold any number of points, so an ordered window over a whole scan would be one task. Rows get a dense
rank in two levels (counts of key ranges, then ranks inside a range), chunks of ranks are windowed each by itself,
and the rows at a chunk's borders are copied to its neighbour as a halo, which bounded offsets never
look beyond.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the ranges of the order key, and rows of a chunk.
KEY_RANGE = 200_000
CHUNK = 200_000


def dense_rank_by(df: DataFrame, by: str, order: str, name: str = "_rank", key_range: int = KEY_RANGE) -> DataFrame:
    """Add the 0-based rank of each row by the integer column ``order`` within ``by``."""
    keyed = df.withColumn("_range", F.floor(F.col(order) / F.lit(key_range)))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        keyed.groupBy(by, "_range")
        .agg(F.count("*").alias("_n"))
        .select(F.col(by).alias("_by"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    inside = F.row_number().over(Window.partitionBy(by, "_range").orderBy(order)) - 1
    ranked = keyed.withColumn("_inside", inside)
    joined = ranked.join(base, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn(name, F.col("_base") + F.col("_inside")).drop("_range", "_inside", "_by", "_r", "_base")


def neighbours(value: Column, half: int, w) -> list[Column]:
    """The value with ``half`` neighbours on either side, edges repeated."""
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    before = [F.coalesce(F.lag(value, k).over(w), first) for k in range(half, 0, -1)]
    after = [F.coalesce(F.lead(value, k).over(w), last) for k in range(1, half + 1)]
    return [*before, value, *after]


def over_neighbours(df: DataFrame, columns: Sequence[str], kernel: int, by: str, order: str, make, chunk: int = CHUNK) -> DataFrame:
    """Add ``make(list of columns)`` of each column's neighbourhood as ``<column>_w``."""
    if kernel < 1 or kernel % 2 == 0:
        raise ValueError("the window must be a positive odd number")
    half = kernel // 2
    if half >= chunk:
        raise ValueError("the window must be smaller than a chunk")
    ranked = dense_rank_by(df, by, order)
    own = F.floor(F.col("_rank") / F.lit(chunk))
    at = F.col("_rank") % F.lit(chunk)
    copies = F.array_compact(
        F.array(
            own,
            F.when((at < half) & (own > 0), own - 1),
            F.when(at >= chunk - half, own + 1),
        )
    )
    dealt = ranked.withColumn("_own", own).withColumn("_chunk", F.explode(copies))
    w = Window.partitionBy(by, "_chunk").orderBy("_rank")
    out = dealt.select("*", *[make(neighbours(F.col(c), half, w)).alias(f"{c}_w") for c in columns])
    return out.where("_chunk = _own").drop("_rank", "_own", "_chunk")


def median_of(values: list[Column]) -> Column:
    return F.element_at(F.array_sort(F.array(*values)), len(values) // 2 + 1)


def mean_of(values: list[Column]) -> Column:
    total = values[0]
    for v in values[1:]:
        total = total + v
    return total / len(values)


def gradient(value: str, w) -> Column:
    """Central differences, one-sided at the ends; 0 for a single row."""
    after, before = F.lead(value).over(w), F.lag(value).over(w)
    steps = F.when(after.isNotNull() & before.isNotNull(), 2.0).otherwise(1.0)
    return (F.coalesce(after, F.col(value)) - F.coalesce(before, F.col(value))) / steps

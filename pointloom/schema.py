"""Schemas of points and what is derived from them, and capability checks by column name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.StructType(
    [T.StructField("scan_id", T.StringType(), False), T.StructField("point_id", T.LongType(), False)]
    + [T.StructField(c, T.DoubleType()) for c in ("x", "y", "z", "range", "intensity", "r", "g", "b")]
    + [T.StructField("is_ground", T.BooleanType())]
)
#: Names of positional columns, in order.
POSITIONAL = ("x", "y", "z", "range", "intensity", "r", "g", "b", "is_ground")
RGB = ("r", "g", "b")
MARKING = T.StructType(
    [
        T.StructField("geometry", T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))),
        T.StructField("marking_type", T.StringType()),
        T.StructField("width_mm", T.DoubleType()),
        T.StructField("pattern_length_m", T.DoubleType()),
    ]
)


def has(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def named(df: DataFrame) -> DataFrame:
    """Name positional columns by arity; further ones become col_9, col_10 and so on."""
    names = [POSITIONAL[i] if i < len(POSITIONAL) else f"col_{i}" for i in range(len(df.columns))]
    out = df.toDF(*names)
    return out.withColumn("is_ground", F.col("is_ground").cast("boolean")) if "is_ground" in names else out

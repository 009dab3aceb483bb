"""From pixels back to points, and fusion of point sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import same


def backproject(mapping: DataFrame, pixels: DataFrame, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """(point_id, ord): points of the pixels(ord, *keys) in the order they are first met; ord is that of the pixel.

    Pixels without points are passed over; order by (ord, point_id). A null key equals a null key.
    """
    asked = pixels.select("ord", *[F.col(c).alias(f"_of_{c}") for c in keys])
    hit = mapping.join(asked, same([(F.col(c), F.col(f"_of_{c}")) for c in keys]))
    return hit.groupBy("point_id").agg(F.min("ord").alias("ord"))


def in_boxes(mapping: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points whose pixel lies in a detection box (image_id, class_id, conf, x1, y1, x2, y2), ends included."""
    hit = (F.col("px").between(F.col("x1"), F.col("x2"))) & (F.col("py").between(F.col("y1"), F.col("y2")))
    return mapping.join(boxes, "image_id").where(hit).select("image_id", "class_id", "conf", "point_id")


def fuse(*sets: DataFrame) -> DataFrame:
    """The ids that are in any of the sets, each once, in order."""
    ids = [s.select("point_id") for s in sets]
    return reduce(DataFrame.unionAll, ids).distinct().orderBy("point_id")


def label_conflicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Points with a label in both sets that differ (an extension)."""
    return a.select("point_id", F.col("label").alias("label_a")).join(b.select("point_id", F.col("label").alias("label_b")), "point_id").where(
        "label_a <> label_b"
    )

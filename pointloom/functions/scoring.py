"""Plug-in point for pixel and image scorers."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class PixelScorer(Protocol):
    def __call__(self, raster: DataFrame) -> DataFrame:
        """Add ``label int`` to a pixel table."""


def threshold_scorer(column: str = "mean_intensity", limit: float = 200.0) -> PixelScorer:
    """Label 1 where a channel is above a limit: a rule in place of a trained model."""
    return lambda raster: raster.withColumn("label", (F.col(column) > limit).cast("int"))


def argmax_class(scores: Column) -> Column:
    """Index of the largest score, the first of equal ones."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def detect(images: DataFrame, detector, schema: str = "image_id string, class_id int, conf double, x1 int, y1 int, x2 int, y2 int") -> DataFrame:
    """Apply a detector, a function of pandas batches of (image_id, content), on the executors."""

    def run(batches):
        for pdf in batches:
            yield detector(pdf)

    return images.mapInPandas(run, schema)

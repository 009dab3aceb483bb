"""Trajectory smoothing and offsets; boresight correction of points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import CHUNK, mean_of, over_neighbours


def smooth(positions: DataFrame, window: int = 11, by: str = "traj_id", order: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """Replace x, y, z by their moving average in order, edges repeated."""
    out = over_neighbours(positions, ["x", "y", "z"], window, by, order, mean_of, chunk)
    return out.withColumns({c: F.col(f"{c}_w") for c in "xyz"}).drop("x_w", "y_w", "z_w")


def apply_offset(positions: DataFrame, offset: Sequence[float]) -> DataFrame:
    if len(offset) != 3:
        raise ValueError("the offset needs three numbers")
    return positions.withColumns({c: F.col(c) + F.lit(float(v)) for c, v in zip("xyz", offset)})


def apply_boresight(points: DataFrame, offset: Sequence[float] = (0.0, 0.0, 0.0), rotation: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """Rotate coordinates by a 3 x 3 matrix if one is given, then add the offset; other columns stay."""
    if rotation is not None and (len(rotation) != 3 or any(len(r) != 3 for r in rotation)):
        raise ValueError("the rotation needs three rows of three")
    if len(offset) != 3:
        raise ValueError("the offset needs three numbers")
    rows = rotation if rotation is not None else ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))

    def turned(row):
        terms = [F.col(c) * F.lit(float(v)) for c, v in zip("xyz", row)]
        return terms[0] + terms[1] + terms[2]

    return points.withColumns(
        {c: (turned(row) if rotation is not None else F.col(c)) + F.lit(float(o)) for c, row, o in zip("xyz", rows, offset)}
    )

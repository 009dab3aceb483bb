"""Scalar column expressions; NaN and division by zero are handled as array arithmetic does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6_371_000.0


def clamp(c: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; NaN stays NaN, null stays null."""
    return F.when(F.isnan(c), c).when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def at_most(c: Column, limit: float) -> Column:
    return c <= F.lit(float(limit))


def at_least(c: Column, limit: float) -> Column:
    """Spark orders NaN above all numbers; here it is never large enough."""
    return (c >= F.lit(float(limit))) & ~F.isnan(c)


def index(c: Column) -> Column:
    """Integer part, cut towards zero."""
    return c.cast("bigint")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres between points in degrees."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def tile_name(i: Column, j: Column) -> Column:
    return F.format_string("tile_%04d_%04d", i, j)


def image_name(stem: Column, s: Column, direction: Column) -> Column:
    """Name of a view; chainage in centimetres, so that steps below a metre stay apart."""
    return F.format_string("%s_s%08d_%s", stem, F.round(s * 100).cast("bigint"), direction)


def unit(dx: Column, dy: Column) -> tuple[Column, Column]:
    """Direction of length one; (1, 0) where the length is zero."""
    n = F.hypot(dx, dy)
    return F.when(n == 0, F.lit(1.0)).otherwise(dx / F.nullif(n, F.lit(0.0))), F.when(n == 0, F.lit(0.0)).otherwise(dy / F.nullif(n, F.lit(0.0)))


def rgb_to_bytes(r: Column, g: Column, b: Column) -> list[Column]:
    """Colours as whole numbers to 255: scaled by their largest where that is above it."""
    top = F.greatest(r, g, b, F.lit(1.0))
    scale = F.when(top > 255, F.lit(255.0) / top).otherwise(F.lit(1.0))
    return [(c * scale).cast("int") for c in (r, g, b)]


def depth_shade(depth: Column) -> Column:
    """Grey level of a depth: white at 0 m, black from 100 m."""
    return ((1.0 - F.least(F.greatest(depth / 100.0, F.lit(0.0)), F.lit(1.0))) * 255).cast("int")

"""Pictures of rasters and views, one row with the PNG of each; an image must fit a task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import depth_shade, rgb_to_bytes
from ..schema import RGB, has
from .raster import display_stretch


def png(cells: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    """(keys, png) from cells(keys, px, py, red, green, blue); pixels that have no cell are black."""
    keys = list(keys)

    def draw(pdf):
        import numpy as np
        import pandas as pd

        from ..functions.png import encode

        pixels = np.zeros((height, width, 3), np.uint8)
        pixels[pdf["py"], pdf["px"]] = pdf[["red", "green", "blue"]].to_numpy()
        return pd.DataFrame([[*pdf.iloc[0][keys], encode(pixels)]], columns=[*keys, "png"])

    kinds = dict(cells.dtypes)
    wanted = cells.select(*keys, *[F.col(c).cast("int").alias(c) for c in ("px", "py", "red", "green", "blue")])
    return wanted.groupBy(*keys).applyInPandas(draw, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "png binary"]))


def raster_colours(raster: DataFrame, colours: bool = True, intensity: bool = True) -> DataFrame:
    """Cells of a six-channel raster with red, green, blue for display: its colours, or height and intensity without them."""
    shown = display_stretch(raster)
    height, mid = "z_gray", "intensity_gray" if intensity else "z_gray"
    pick = [f"{c}_gray" for c in RGB] if colours else [height, mid, height]
    return shown.select("scan_id", "tile_ix", "tile_iy", "px", "py", *[F.col(c).alias(n) for c, n in zip(pick, ("red", "green", "blue"))])


def raster_images(raster: DataFrame, pixels: int, colours: bool = True, intensity: bool = True) -> DataFrame:
    """(scan_id, tile_ix, tile_iy, png): a square picture of ``pixels`` by ``pixels`` for each tile of a six-channel raster."""
    return png(raster_colours(raster, colours, intensity), ["scan_id", "tile_ix", "tile_iy"], pixels, pixels)


def tile_panels(raster: DataFrame, pixels: int) -> DataFrame:
    """(scan_id, tile_ix, tile_iy, png): height, intensity, density and colours of each tile, as four pictures in a square."""
    keys = ["scan_id", "tile_ix", "tile_iy"]
    top = Window.partitionBy(*keys)
    shown = display_stretch(raster).withColumn("density_gray", (F.col("density") / F.max("density").over(top) * 255).cast("int"))
    greys = [[F.col(f"{c}_gray")] * 3 for c in ("z", "intensity", "density")]
    panels = [*greys, [F.col(f"{c}_gray") for c in RGB]]
    cells = [
        F.struct((F.col("px") + k % 2 * pixels).alias("px"), (F.col("py") + k // 2 * pixels).alias("py"), *[c.alias(n) for c, n in zip(panel, ("red", "green", "blue"))])
        for k, panel in enumerate(panels)
    ]
    return png(shown.select(*keys, F.explode(F.array(*cells)).alias("cell")).select(*keys, "cell.*"), keys, 2 * pixels, 2 * pixels)


def view_colours(mapping: DataFrame) -> DataFrame:
    """Pixels of views with red, green, blue: the point's colours, or greys by depth where it has none."""
    grey = depth_shade(F.col("depth"))
    own = rgb_to_bytes(*[F.col(c) for c in RGB]) if has(mapping, *RGB) else [F.lit(None).cast("int")] * 3
    known = F.coalesce(*[F.col(c).isNotNull() for c in RGB]) if has(mapping, *RGB) else F.lit(False)
    return mapping.select("axis_id", "pose_idx", "s", "direction", "px", "py", *[F.when(known, c).otherwise(grey).alias(n) for c, n in zip(own, ("red", "green", "blue"))])


def view_images(mapping: DataFrame, width: int = 1920, height: int = 1080) -> DataFrame:
    """(axis_id, pose_idx, s, direction, png): the picture of each view that holds a point."""
    return png(view_colours(mapping), ["axis_id", "pose_idx", "s", "direction"], width, height)

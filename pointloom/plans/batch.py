"""Batch drivers over many files: rasters, views along axes, and QA overviews."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from ..operators import camera, qa, raster
from ..sources import readers, writers


def bev_batch(spark: SparkSession, paths: list[str], output: str, resolution: float = 0.05, tile: float = 100.0) -> None:
    """Six-channel rasters and mappings of all scans in one pass over the files; unreadable files are passed over."""
    if not paths:
        raise ValueError("no files")
    points = readers.read_points(spark, *sorted(paths), skip_corrupt=True)
    writers.write_mapping(raster.bev6(points, resolution, tile), f"{output.rstrip('/')}/bev")
    writers.write_mapping(raster.bev_mapping(points, resolution, tile), f"{output.rstrip('/')}/mapping")


def views(points: DataFrame, axis: DataFrame, output: str | None = None, **camera_params) -> DataFrame:
    """Views of one or more scans along an axis; scans without colours mix with those that have them."""
    mapping = camera.views_along_axis(points, axis, **camera_params)
    if output:
        writers.write_views(mapping, output)
    return mapping


def pair_files(points: list[str], axes: list[str]) -> tuple[list[tuple[str, str]], list[str]]:
    """(points, axis) paths of equal stem, the axis file with or without the ending _axis, and the points that have no axis."""

    def stem(path: str) -> str:
        return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]

    by = {stem(a).removesuffix("_axis"): a for a in sorted(axes, reverse=True)}
    return [(p, by[stem(p)]) for p in sorted(points) if stem(p) in by], [p for p in sorted(points) if stem(p) not in by]


def views_batch(spark: SparkSession, points: list[str], axes: list[str], output: str, threads: int = 4, **camera_params) -> list[str]:
    """Views of every scan that has an axis of its name, in a folder of that name; returns the paths that have none.

    The jobs of a few scans run at a time, so that small scans do not wait for each other's stages.
    """
    pairs, skipped = pair_files(points, axes)

    def one(pair: tuple[str, str]) -> None:
        name = pair[0].rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        views(readers.read_points(spark, pair[0]), readers.read_axis_csv(spark, pair[1]), f"{output.rstrip('/')}/{name}", **camera_params)

    with ThreadPoolExecutor(max_workers=threads) as pool:
        list(pool.map(one, pairs))
    return skipped


def tile_overview(tiles: DataFrame) -> dict[str, DataFrame]:
    """The tables behind a QA overview of tiles."""
    return {"summary": qa.overview(tiles), "pass_rates": qa.pass_rates(tiles), "density": qa.density_histogram(tiles)}

"""Sinks: scan metadata, tiles by status, rasters and mappings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.qa import flag_points, route


def metadata_json(metadata: DataFrame) -> str:
    """One scan's metadata as indented JSON; raises if there is not exactly one."""
    rows = metadata.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).take(2)
    if len(rows) != 1:
        raise ValueError("metadata of exactly one scan is needed")
    return json.dumps(json.loads(rows[0]["j"]), indent=2)


def save_metadata(metadata: DataFrame, path: str) -> None:
    """Write the JSON form through Spark, as one text file of one line per scan, so any store will do."""
    metadata.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def export_tile_metadata(tiles: DataFrame, directory: str) -> None:
    tiles.write.mode("overwrite").parquet(f"{directory.rstrip('/')}/tiles_metadata.parquet")


def export_tiles(points: DataFrame, tiles: DataFrame, directory: str) -> None:
    """Points by folders of scan and tile, with their tile's flags as qa_ columns."""
    keys = ["scan_id", "tile_i", "tile_j"]
    flag_points(points, tiles).repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(directory)


def export_routed(points: DataFrame, tiles: DataFrame, directory: str) -> None:
    """Metadata to pre_tiles, points of approved tiles and of the rest to folders of their own; empty ones are not made."""
    root = directory.rstrip("/")
    export_tile_metadata(tiles, f"{root}/pre_tiles")
    routed = route(tiles)
    for status, name in (("approved", "tiles_approved"), ("review", "qa_review")):
        own = routed.where(F.col("qa_status") == status).drop("qa_status")
        if not own.isEmpty():
            export_tiles(points, own, f"{root}/{name}")


def write_views(mapping: DataFrame, directory: str) -> None:
    mapping.write.mode("overwrite").partitionBy("pose_idx", "direction").parquet(directory)


def save_files(images: DataFrame, directory: str) -> int:
    """Write (name, png) rows as files below a folder that all executors mount; a task that runs twice writes the same. Returns their number."""

    def run(batches):
        import os

        import pandas as pd

        os.makedirs(directory, exist_ok=True)
        for pdf in batches:
            for name, data in zip(pdf["name"], pdf["png"]):
                path = os.path.join(directory, f"{name}.png")
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    f.write(data)
                os.replace(f.name, path)
            yield pd.DataFrame({"n": [len(pdf)]})

    done = images.select("name", "png").mapInPandas(run, "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_mapping(mapping: DataFrame, path: str) -> None:
    mapping.write.mode("overwrite").parquet(path)


def geojson(lines: DataFrame, key: str = "cluster_id") -> DataFrame:
    """(feature) one GeoJSON string per polyline with a geometry array (an extension)."""
    coords = F.transform("geometry", lambda p: F.array(p["x"], p["y"]))
    return lines.select(
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"),
                F.struct(F.col(key).alias("id")).alias("properties"),
                F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates")).alias("geometry"),
            )
        ).alias("feature")
    )

"""Preprocessing of scans, from raw points to quality-flagged tiles, as one lazy plan."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import attributes, filters, ground, metadata, qa, tiling
from ..schema import has
from ..sources import writers


class Preprocess:
    """The steps of preprocessing. They are lazy but for the small tables of one row per scan, and ``run``."""

    def __init__(self, config: Config | None = None):
        self.config = config or Config()

    def validate(self, points: DataFrame, epsg: int | None = None) -> DataFrame:
        return metadata.scan_metadata(points, epsg, self.config.provider, self.config.qa)

    def filter(self, points: DataFrame) -> DataFrame:
        f = self.config.filters
        if has(points, "range"):
            points = filters.filter_range(points, f.max_range)
        if has(points, "intensity"):
            points = filters.filter_intensity_low(points, f.min_intensity)
        return filters.spike_filter_z(points, f.spike_kernel, f.spike_threshold)

    def normalise_ground(self, points: DataFrame) -> DataFrame:
        return ground.normalise_local(points, self.config.ground)

    def normalise_attributes(self, points: DataFrame) -> DataFrame:
        return attributes.normalise(points, self.config.attributes, roughness=False)

    def prepared(self, points: DataFrame) -> DataFrame:
        """Filtered points with relative heights and normalised attributes.

        Scans of coordinates alone carry no ground flag on, as their tiles are not judged by it.
        """
        full = has(points, "range", "intensity", "r", "g", "b")
        out = self.normalise_attributes(self.normalise_ground(self.filter(points)))
        return out if full else out.drop("is_ground")

    def tiles(self, prepared: DataFrame) -> DataFrame:
        return tiling.tile_stats(prepared, self.config)

    def summary(self, points: DataFrame, tiles: DataFrame, epsg: int | None = None) -> DataFrame:
        """One row: counts, and metadata flags of all scans together. Every filtered point lies in one tile, so tiles count them.

        ``qa_approved_tiles`` counts tiles whose every flag and statistic holds; ``qa_exported_tiles`` those that are exported
        as approved.
        """
        meta = self.validate(points, epsg).agg(
            F.sum("point_count").alias("input_points"), F.min("crs_ok").alias("crs_ok"), F.min("has_rgb").alias("has_rgb"), F.min("has_intensity").alias("has_intensity")
        )
        counts = tiles.agg(
            F.coalesce(F.sum("point_count"), F.lit(0)).alias("filtered_points"),
            F.count("*").alias("total_tiles"),
            F.count_if(qa.all_flags(tiles)).alias("qa_approved_tiles"),
            F.count_if(qa.approved()).alias("qa_exported_tiles"),
        )
        one = meta.crossJoin(F.broadcast(counts))  # one row each
        return one.select("input_points", "filtered_points", "total_tiles", "qa_approved_tiles", "qa_exported_tiles", "crs_ok", "has_rgb", "has_intensity")

    def run(self, points: DataFrame, output: str, epsg: int | None = None) -> dict:
        """Write metadata and routed tiles, and return the summary."""
        prepared, tiles = tiling.tiled(self.prepared(points), self.config.tile_size).persist(StorageLevel.MEMORY_AND_DISK), None
        try:
            plain = prepared.drop("tile_i", "tile_j")
            tiles = self.tiles(plain).persist(StorageLevel.MEMORY_AND_DISK)
            writers.save_metadata(self.validate(points, epsg), f"{output.rstrip('/')}/meta_scan.json")
            writers.export_routed(prepared, tiles, output)
            return self.summary(points, tiles, epsg).first().asDict()
        finally:
            prepared.unpersist()
            if tiles is not None:
                tiles.unpersist()

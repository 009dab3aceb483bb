"""Streams of scans and events. The grid has a fixed origin, as a stream's corner is not known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import filters, tiling
from ..schema import POINTS


def read_point_stream(spark: SparkSession, directory: str, files_per_trigger: int = 10) -> DataFrame:
    return spark.readStream.schema(POINTS).option("maxFilesPerTrigger", files_per_trigger).parquet(directory)


def tile_counts(points: DataFrame, size: float = 20.0, origin: tuple[float, float] = (0.0, 0.0), config: Config | None = None) -> DataFrame:
    """Running count and mean intensity per tile of a fixed grid, for batch or stream (output mode update or complete)."""
    f = (config or Config()).filters
    kept = filters.filter_intensity_low(filters.filter_range(points, f.max_range), f.min_intensity)
    placed = tiling.assign(kept, size, origin)
    return placed.groupBy("scan_id", "tile_i", "tile_j").agg(F.count("*").alias("point_count"), F.avg("intensity").alias("intensity_mean"))


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by tumbling window and type; rows later than ``late`` go once their window is closed."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", length).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: runs of events less than ``gap`` apart."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def start_tile_stream(points: DataFrame, path: str, checkpoint: str, size: float = 20.0, origin: tuple[float, float] = (0.0, 0.0)):
    """Write each batch's tile table to a folder of its own, so a batch that runs again overwrites itself."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")

    return (
        tile_counts(points, size, origin)
        .writeStream.outputMode("update")
        .foreachBatch(put)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

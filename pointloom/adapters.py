"""Point, trajectory and cluster views over the driver's tables, defined once for Spark and for SQL.

Points are of three scans and of one without a name, over the same ground.

``{D}`` marks double literals, whose spelling differs. Fractions are dyadic, so that sums are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POINTS = {
    "scan_id": "CASE WHEN event_id % 4 < 3 THEN 'scan' || CAST(event_id % 4 AS STRING) END",
    "point_id": "event_id",
    "user_id": "user_id",
    "x": "100000 + ((event_id * 37) % 397) / 4.0{D}",
    "y": "450000 + ((event_id * 53) % 401) / 4.0{D}",
    "z": "CASE WHEN event_id % 10 < 7 THEN 0.0{D} ELSE (8 + event_id % 24) / 8.0{D} END + ((event_id * 37) % 397) / 256.0{D}",
    "range": "5 + ((event_id * 11) % 1000) / 8.0{D}",
    "intensity": "CAST((event_id * 29) % 300 AS DOUBLE)",
    "r": "CAST((event_id * 7) % 256 AS DOUBLE)",
    "g": "CAST((event_id * 13) % 256 AS DOUBLE)",
    "b": "CAST((event_id * 17) % 256 AS DOUBLE)",
}
_BASE = {"cid": "event_id % 60", "kind": "event_id % 60 % 5", "k": "CAST((event_id - event_id % 60) / 60 AS BIGINT)"}
_CENTRE = {
    "cx": "100000 + 10.0{D} * (cid % 10)",
    "cy": "450000 + 10.0{D} * floor(cid / 10.0{D})",
    "a": "2 * pi() * (k % 16) / 16.0{D}",
}
CLUSTERS = {
    "cluster_id": "cid",
    "kind": "kind",
    "point_id": "event_id",
    "x": "CASE kind WHEN 0 THEN cx + (k % 40) / 4.0{D} WHEN 1 THEN cx + 0.4{D} * cos(a) WHEN 2 THEN cx + 0.08{D} * cos(a) "
    "WHEN 3 THEN cx + (k % 7) / 16.0{D} ELSE cx + (k % 64) / 4.0{D} END",
    "y": "CASE kind WHEN 0 THEN cy + ((k % 40) % 3) / 64.0{D} WHEN 1 THEN cy + 0.4{D} * sin(a) WHEN 2 THEN cy + 0.08{D} * sin(a) "
    "WHEN 3 THEN cy + (k % 3) / 128.0{D} ELSE cy + ((k % 64) % 2) / 32.0{D} END",
    "z": "CASE kind WHEN 2 THEN (k % 41) / 4.0{D} WHEN 3 THEN 2 + (k % 11) / 16.0{D} WHEN 4 THEN 0.75{D} ELSE 0.0{D} END",
}
#: Vertices of a bent road through the cloud.
ROAD = tuple((0, k, 100000.0 + 12.5 * k, 450000.0 + (40.0 if k % 4 in (1, 2) else 25.0)) for k in range(8))


def _spark(columns: dict[str, str]) -> list[str]:
    return [f"{e.format(D='D')} AS {n}" for n, e in columns.items()]


def _sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{e.format(D='::DOUBLE')} AS {n}" for n, e in columns.items())


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(*_spark(POINTS))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = events(spark, sf_dir).selectExpr("event_id", *_spark(_BASE)).selectExpr("*", *_spark(_CENTRE))
    return base.selectExpr(*_spark(CLUSTERS))


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One axis per user, through the user's points in order."""
    return points(spark, sf_dir).selectExpr("user_id AS axis_id", "point_id AS seq", "x", "y", "z")


def road(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ROAD), "axis_id long, seq long, x double, y double")


POINTS_SQL = f"SELECT {_sql(POINTS)} FROM events"
CLUSTERS_SQL = f"SELECT {_sql(CLUSTERS)} FROM (SELECT *, {_sql(_CENTRE)} FROM (SELECT event_id, {_sql(_BASE)} FROM events) b) c"
AXES_SQL = "SELECT user_id AS axis_id, point_id AS seq, x, y, z FROM p"
ROAD_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({a}, {k}, {x}::DOUBLE, {y}::DOUBLE)" for a, k, x, y in ROAD) + ") t(axis_id, seq, x, y)"

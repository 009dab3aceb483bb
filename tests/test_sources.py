"""Readers, writers, whole plans and streams."""

import io
import json
import os
import struct

import numpy as np
import pytest
from pointloom import schema
from pointloom.config import Config, QAConfig
from pointloom.functions.scoring import argmax_class, detect, threshold_scorer
from pointloom.operators import groups, qa, tiling
from pointloom.plans import batch
from pointloom.plans.preprocess import Preprocess
from pointloom.sources import laz, readers, writers
from pointloom.streaming import ingest
from pyspark.sql import functions as F


def test_synthetic_scan_is_repeatable(spark):
    a = readers.synthetic_scan(spark, 3000)
    assert a.count() == 3000 and set(schema.POINTS.fieldNames()) - {"is_ground"} == set(a.columns)
    assert a.agg(F.sum("z")).first() == readers.synthetic_scan(spark, 3000).agg(F.sum("z")).first()
    plain = readers.synthetic_scan(spark, 3000, kind="plain")
    low = plain.where("z < 0.9").count() / 3000
    assert 0.6 < low < 0.8 and plain.agg(F.max("z")).first()[0] <= 5


def test_from_array(spark):
    a = np.arange(20.0).reshape(2, 10)
    df = readers.from_array(spark, a)
    assert df.columns == ["scan_id", "point_id", *schema.POSITIONAL, "col_9"]
    r = df.orderBy("point_id").first()
    assert r.x == 0 and r.is_ground is True and r.col_9 == 9
    assert readers.from_array(spark, a[:, :3]).columns == ["scan_id", "point_id", "x", "y", "z"]


def test_scans_with_and_without_colours(spark, tmp_path):
    full = readers.synthetic_scan(spark, 10).drop("scan_id")
    full.write.parquet(str(tmp_path / "one.parquet"))
    full.select("point_id", "x", "y", "z").write.parquet(str(tmp_path / "two.parquet"))
    both = readers.read_points(spark, str(tmp_path / "one.parquet"), str(tmp_path / "two.parquet"))
    assert both.count() == 20 and both.where("r is null").count() == 10
    mixed = readers.concat_scans(full, full.select("point_id", "x", "y", "z"))
    assert mixed.where("intensity is null").count() == 10
    with pytest.raises(ValueError):
        (tmp_path / "bad").mkdir()
        spark.range(3).write.mode("overwrite").parquet(str(tmp_path / "bad"))
        readers.read_points(spark, str(tmp_path / "bad"))


def test_axis_csv(spark, tmp_path):
    p = tmp_path / "road_axis.csv"
    p.write_text("x,y,z\n1,2,3\n4,5,6\n")
    rows = readers.read_axis_csv(spark, str(p)).orderBy("seq").collect()
    assert [(r.axis_id, r.x, r.y, r.z) for r in rows] == [("road", 1, 2, 3), ("road", 4, 5, 6)]
    p.write_text("x,q\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_axis_csv(spark, str(p))


def test_labels_and_pairs(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.txt").write_text("1 0.5 0.5 0.2 0.4\n\nbad line\n 0  0.1 0.1 0.2 0.2 \n")
    rows = readers.read_labels(spark, str(tmp_path / "l"), 100, 50).orderBy("class_id").collect()
    assert [(r.image_id, r.class_id, round(r.x1), round(r.y1), round(r.x2), round(r.y2)) for r in rows] == [("a", 0, 0, 0, 20, 10), ("a", 1, 40, 15, 60, 35)]
    for d, names in (("i", ("a.npz", "b.npz")), ("m", ("a.png", "c.png"))):
        (tmp_path / d).mkdir()
        for n in names:
            data = io.BytesIO()
            np.savez(data, image=np.ones((2, 3)))
            (tmp_path / d / n).write_bytes(data.getvalue())
    pairs = readers.read_image_pairs(spark, str(tmp_path / "i"), str(tmp_path / "m"))
    assert [r.stem for r in pairs.select("stem").collect()] == ["a"]
    assert readers.decode_npz(pairs).first().shape == [2, 3]
    a = spark.createDataFrame([("/d/s1.laz",), ("/d/s2.laz",)], "path string")
    b = spark.createDataFrame([("/e/s1_axis.csv",)], "path string")
    found, skipped = readers.pair_by_stem(a, b, "_axis")
    assert [r.stem for r in found.collect()] == ["s1"] and [r.stem for r in skipped.collect()] == ["s2"]


def write_las(path, kind, points, minor=2, compressed=False):
    """A LAS file of (x, y, z, intensity, r, g, b) rows in centimetres."""
    size = {0: 20, 2: 26, 7: 36}[kind]
    head = bytearray(375 if minor >= 4 else 227)
    head[:4], head[24], head[25], head[104] = b"LASF", 1, minor, kind | (128 if compressed else 0)
    struct.pack_into("<HI", head, 94, len(head), len(head))
    struct.pack_into("<HI", head, 105, size, 0 if minor >= 4 else len(points))
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 100_000.0, 450_000.0, 0.0)
    if minor >= 4:
        struct.pack_into("<Q", head, 247, len(points))
    records = bytearray()
    for x, y, z, i, *rgb in points:
        record = bytearray(size)
        struct.pack_into("<iiiH", record, 0, x, y, z, i)
        if kind in laz.RGB_AT:
            struct.pack_into("<3H", record, laz.RGB_AT[kind], *rgb)
        records += record
    path.write_bytes(bytes(head) + bytes(records))


def test_las_files(spark, tmp_path):
    rows = [(k * 100, k * 50, -k, k % 9, k % 256, 7, 9) for k in range(25)]
    for kind, minor in ((0, 2), (2, 2), (7, 4)):
        write_las(tmp_path / f"s{kind}.las", kind, rows, minor)
    laz.register(spark)
    paths = ",".join(str(tmp_path / f"s{k}.las") for k in (7, 2, 0))
    df = spark.read.format("laz").option("path", paths).option("chunk", "10").load()
    assert df.rdd.getNumPartitions() == 9 and df.count() == 75
    for kind in (0, 2, 7):
        own = df.where(F.col("scan_id") == f"s{kind}").orderBy("point_id").collect()
        assert [r.point_id for r in own] == list(range(25))
        for r, (x, y, z, i, *rgb) in zip(own, rows):
            assert (r.x, r.y, r.z, r.intensity) == pytest.approx((100_000 + x / 100, 450_000 + y / 100, z / 100, i))
            assert (r.r, r.g, r.b) == ((None,) * 3 if kind == 0 else tuple(rgb))
    (tmp_path / "no.las").write_bytes(b"x" * 400)
    with pytest.raises(Exception, match="not a LAS file"):
        spark.read.format("laz").option("path", str(tmp_path / "no.las")).load().count()


def test_compressed_files_need_their_package(spark, tmp_path):
    laz.register(spark)
    write_las(tmp_path / "c.laz", 2, [(1, 2, 3, 4, 5, 6, 7)], compressed=True)
    with pytest.raises(Exception, match="laspy"):
        spark.read.format("laz").option("path", str(tmp_path / "c.laz")).load().collect()


def test_pipeline_end_to_end(spark, tmp_path):
    points = readers.synthetic_scan(spark, 4000, kind="plain")
    plan = Preprocess(Config(qa=QAConfig(density=0.3)))
    out = plan.run(points, str(tmp_path))
    assert out["input_points"] == 4000 and 0 < out["filtered_points"] <= 4000 and out["total_tiles"] == 25
    meta = json.loads(spark.read.text(str(tmp_path / "meta_scan.json")).first()[0])
    assert meta["point_count"] == 4000 and meta["crs_epsg"] == 28992
    table = readers.read_tile_metadata(spark, str(tmp_path / "pre_tiles"))
    assert table.count() == 25 and readers.first_tiles(table, 3).count() == 3
    parts = [str(tmp_path / d) for d in ("tiles_approved", "qa_review") if os.path.exists(tmp_path / d)]
    assert sum(spark.read.parquet(p).count() for p in parts) == out["filtered_points"]
    approved = readers.read_tiles(spark, str(tmp_path / "tiles_approved"))
    one = approved.select("tile_i", "tile_j").first()
    assert readers.read_tiles(spark, str(tmp_path / "tiles_approved"), [tuple(one)]).select("tile_i", "tile_j").distinct().count() == 1
    assert "qa_density_ok" in approved.columns
    assert out == plan.run(points, str(tmp_path / "again"))
    poor = Preprocess(Config(qa=QAConfig(density=1e6))).run(points, str(tmp_path / "poor"))
    assert poor["qa_exported_tiles"] == 0 and not os.path.exists(tmp_path / "poor" / "tiles_approved")
    assert json.loads(writers.metadata_json(plan.validate(points)))["provider"] == "unknown"


def test_tiles_of_several_scans_stay_apart(spark, tmp_path):
    one = readers.synthetic_scan(spark, 200)
    scans = one.unionByName(one.withColumns({"scan_id": F.lit("7"), "point_id": F.col("point_id") + 1000})).unionByName(one.withColumn("scan_id", F.lit(None).cast("string")))
    tiles = tiling.tile_stats(scans)
    assert tiles.select("scan_id").distinct().count() == 3 and tiles.agg(F.sum("point_count")).first()[0] == 600
    writers.export_tiles(tiling.tiled(scans), tiles, str(tmp_path / "tiles"))
    back = readers.read_tiles(spark, str(tmp_path / "tiles"))
    assert back.count() == 600 and {r.scan_id for r in back.select("scan_id").distinct().collect()} == {"synthetic", "7", None}


def test_groups_beyond_the_bound_are_joined_by_a_shuffle(spark):
    rows = spark.createDataFrame([(k % 5 if k % 7 else None, k) for k in range(100)], "g int, v int")
    top = rows.groupBy("g").agg(F.max("v").alias("top"))
    few, many = groups.attach(rows, top, ["g"]), groups.attach(rows, top, ["g"], most=2)
    assert sorted(few.collect(), key=str) == sorted(many.collect(), key=str) and few.count() == 100
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(few) and "strategy=broadcast" not in plan(many)
    scans = tiling.tiled(readers.synthetic_scan(spark, 50))
    assert "hashpartitioning" not in scans._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]  # points stay where they are


def test_pipeline_of_coordinates_alone(spark):
    points = readers.synthetic_scan(spark, 1500).select("scan_id", "point_id", "x", "y", "z")
    plan = Preprocess(Config(qa=QAConfig(density=0.0)))
    ready = plan.prepared(points)
    tiles = plan.tiles(ready)
    assert "is_ground" not in ready.columns and tiles.where("ground_ok and rgb_ok and intensity_ok").count() == tiles.count()


def test_batches(spark, tmp_path):
    for k in range(2):
        readers.synthetic_scan(spark, 300, seed=k).drop("scan_id").write.parquet(str(tmp_path / f"s{k}.parquet"))
    paths = [str(tmp_path / f"s{k}.parquet") for k in range(2)]
    batch.bev_batch(spark, paths, str(tmp_path / "out"), 1.0, 50.0)
    assert spark.read.parquet(str(tmp_path / "out" / "mapping")).count() <= 600
    (tmp_path / "s0_axis.csv").write_text("x,y\n100000,450050\n100100,450050\n")
    assert batch.pair_files(["b.parquet", "x/a.parquet"], ["y/a.csv", "y/a_axis.csv", "c.csv"]) == ([("x/a.parquet", "y/a.csv")], ["b.parquet"])
    skipped = batch.views_batch(spark, paths, [str(tmp_path / "s0_axis.csv")], str(tmp_path / "views"), step=50.0)
    assert skipped == [paths[1]]
    views = spark.read.parquet(str(tmp_path / "views" / "s0"))
    assert {"pose_idx", "direction", "px", "py", "depth"} <= set(views.columns)
    with pytest.raises(ValueError):
        batch.bev_batch(spark, [], str(tmp_path / "none"))
    tiles = tiling.tile_stats(readers.synthetic_scan(spark, 500))
    assert set(batch.tile_overview(tiles)) == {"summary", "pass_rates", "density"}
    assert qa.views_overview(spark.createDataFrame([("front", 3), ("front", 0), ("back", 9)], "direction string, points long"), 1).count() == 2


def test_geojson_and_scoring(spark):
    lines = spark.createDataFrame([(7, [(0.0, 0.0), (3.0, 4.0)])], "cluster_id int, geometry array<struct<x:double,y:double>>")
    feature = json.loads(writers.geojson(lines).first().feature)
    assert feature["geometry"]["coordinates"] == [[0.0, 0.0], [3.0, 4.0]] and feature["properties"]["id"] == 7
    r = spark.createDataFrame([(250.0,), (10.0,)], "mean_intensity double")
    assert sorted(x.label for x in threshold_scorer()(r).collect()) == [0, 1]
    assert spark.range(1).select(argmax_class(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))).first()[0] == 1

    def fake(pdf):
        import pandas as pd

        return pd.DataFrame([(i, 1, 0.5, 0, 0, 2, 2) for i in pdf["image_id"]], columns=["image_id", "class_id", "conf", "x1", "y1", "x2", "y2"])

    assert detect(spark.createDataFrame([("a", b"x")], "image_id string, content binary"), fake).first().conf == 0.5


def test_streams(spark, tmp_path):
    points = readers.synthetic_scan(spark, 600).withColumn("is_ground", F.lit(None).cast("boolean"))
    points.select(*schema.POINTS.fieldNames()).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.read_point_stream(spark, str(tmp_path / "in"), 1)
    q = ingest.start_tile_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 20.0, (100_000.0, 450_000.0))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    want = ingest.tile_counts(points, 20.0, (100_000.0, 450_000.0))
    last = out.groupBy("tile_i", "tile_j").agg(F.max_by("point_count", "batch_id").alias("n"))
    assert sorted((r.tile_i, r.tile_j, r.n) for r in last.collect()) == sorted((r.tile_i, r.tile_j, r.point_count) for r in want.collect())
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a", 1.0), (1, "2024-01-01 00:20:00", "a", 2.0), (1, "2024-01-01 02:00:00", "b", 4.0)], "user_id int, t string, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    assert sorted((r.event_type, r.n, r.total) for r in ingest.event_windows(events).collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]
    assert sorted(r.n for r in ingest.event_sessions(events).collect()) == [1, 2]

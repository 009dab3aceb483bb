"""Pictures: the PNG codec, rasters and views as images, masks."""

import io
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pointloom.functions import png
from pointloom.operators import camera, images, raster
from pointloom.sources import readers, writers
from pyspark.sql import functions as F


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([0, 3]), st.integers(0, 99))
def test_round_trip(height, width, colours, seed):
    a = np.random.default_rng(seed).integers(0, 256, (height, width, *([3] if colours else [])), np.uint8)
    assert (png.decode(png.encode(a)) == a).all()


@pytest.mark.parametrize("step, colour", [(1, 0), (3, 2), (4, 6)])
def test_every_filter(step, colour):
    a = np.random.default_rng(step).integers(0, 256, (10, 7 * step)).astype(int)
    lines = b""
    for k in range(10):
        up = a[k - 1] if k else np.zeros(7 * step, int)
        left, corner = (np.concatenate([np.zeros(step, int), x[:-step]]) for x in (a[k], up))
        guess = left + up - corner
        near = np.where((abs(guess - left) <= abs(guess - up)) & (abs(guess - left) <= abs(guess - corner)), left, np.where(abs(guess - up) <= abs(guess - corner), up, corner))
        minus = [0, left, up, (left + up) // 2, near][k % 5]
        lines += bytes([k % 5]) + ((a[k] - minus) % 256).astype(np.uint8).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    data = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 10, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (png.decode(data).reshape(10, -1) == a).all()
    with pytest.raises(ValueError):
        png.decode(b"GIF89a" + data)
    with pytest.raises(ValueError):
        png.decode(data.replace(struct.pack(">IIBB", 7, 10, 8, colour), struct.pack(">IIBB", 7, 10, 16, colour)))


def test_raster_and_view_images(spark, tmp_path):
    points = readers.synthetic_scan(spark, 2000)
    six = raster.bev6(points, 1.0, 50.0).persist()
    made = images.raster_images(six, 50).collect()
    assert len(made) == six.select("tile_ix", "tile_iy").distinct().count()
    one = made[0]
    shown = raster.display_stretch(six.where((F.col("tile_ix") == one.tile_ix) & (F.col("tile_iy") == one.tile_iy))).collect()
    pixels = png.decode(bytes(one.png))
    assert pixels.shape == (50, 50, 3) and (pixels > 0).any(axis=2).sum() <= len(shown)
    assert all(tuple(pixels[r.py, r.px]) == (r.r_gray, r.g_gray, r.b_gray) for r in shown)
    plain = png.decode(bytes(images.raster_images(six, 50, colours=False).where((F.col("tile_ix") == one.tile_ix) & (F.col("tile_iy") == one.tile_iy)).first().png))
    assert all(tuple(plain[r.py, r.px]) == (r.z_gray, r.intensity_gray, r.z_gray) for r in shown)
    four = images.tile_panels(six, 50).where((F.col("tile_ix") == one.tile_ix) & (F.col("tile_iy") == one.tile_iy)).first()
    square = png.decode(bytes(four.png))
    assert square.shape == (100, 100, 3) and (square[50:, 50:] == pixels).all() and square[50:, :50].max() == 255
    assert all(square[r.py, r.px, 0] == r.z_gray and square[r.py, 50 + r.px, 1] == r.intensity_gray for r in shown)
    axis = spark.createDataFrame([(0, 0, 100_000.0, 450_050.0), (0, 1, 100_100.0, 450_050.0)], "axis_id long, seq long, x double, y double")
    mapping = camera.views_along_axis(points.drop("r", "g", "b"), axis, width=64, height=48, step=50.0).persist()
    views = images.view_images(mapping, 64, 48).select(F.format_string("v%d_%s", "pose_idx", "direction").alias("name"), "png")
    n = mapping.select("pose_idx", "direction").distinct().count()
    assert writers.save_files(views, str(tmp_path / "views")) == n == len(list((tmp_path / "views").glob("*.png")))
    r = mapping.first()
    seen = png.decode((tmp_path / "views" / f"v{r.pose_idx}_{r.direction}.png").read_bytes())
    assert (seen[r.py, r.px] == int((1 - min(max(r.depth / 100, 0), 1)) * 255)).all()


def test_masks(spark, tmp_path):
    (tmp_path / "i").mkdir()
    (tmp_path / "m").mkdir()
    mask = np.arange(12, dtype=np.uint8).reshape(3, 4)
    for k in range(2):
        held = io.BytesIO()
        np.savez(held, image=np.full((3, 3, 4), k, np.float32))
        (tmp_path / "i" / f"t{k}.npz").write_bytes(held.getvalue())
    (tmp_path / "m" / "t1.png").write_bytes(png.encode(mask))
    pairs = readers.read_image_pairs(spark, str(tmp_path / "i"), str(tmp_path / "m"))
    r = readers.decode_masks(pairs).collect()
    assert [(x.stem, list(x.shape), list(x.labels)) for x in r] == [("t1", [3, 4], list(range(12)))]
    assert readers.decode_npz(pairs).first().stem == "t1"

"""Scans: points, axes, tiles, labels and synthetic clouds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import POINTS, require


def _stem(column, suffix: str = ""):
    return F.regexp_extract(column, rf"([^/]+?){suffix}(?:\.[^./]+)?$", 1)


def read_points(spark: SparkSession, *paths: str, format: str = "parquet", skip_corrupt: bool = False) -> DataFrame:
    """Points of many files in one scan; a missing scan_id is the stem of the file.

    Files with and without colours mix: absent columns are null. ``skip_corrupt`` passes over unreadable files.
    """
    reader = spark.read.format(format).option("mergeSchema", "true").option("ignoreCorruptFiles", str(skip_corrupt).lower())
    df = reader.load(list(paths))
    require(df, "x", "y", "z")
    if "scan_id" not in df.columns:
        df = df.withColumn("scan_id", _stem(F.col("_metadata.file_path")))
    kinds = {f.name: f.dataType for f in POINTS.fields}
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])


def concat_scans(*scans: DataFrame) -> DataFrame:
    """All points of several scans by column name; what a scan lacks is null."""
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def read_axis_csv(spark: SparkSession, path: str) -> DataFrame:
    """(axis_id, seq, x, y[, z]) from CSV files with a header; without a column seq, rows count in file order.

    File order holds for one file of one split, so a larger axis must bring its seq.
    """
    df = spark.read.option("header", "true").csv(path)
    require(df, "x", "y")
    own = ["x", "y", *(["z"] if "z" in df.columns else [])]
    axis = _stem(F.input_file_name(), "(?:_axis)?")
    seq = F.col("seq").cast("bigint") if "seq" in df.columns else F.monotonically_increasing_id()
    return df.select(axis.alias("axis_id"), seq.alias("seq"), *[F.col(c).cast("double").alias(c) for c in own])


def read_tiles(spark: SparkSession, directory: str, tiles: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """Tile points of an export, only the folders of ``tiles`` (of every scan) if they are named."""
    df = spark.read.parquet(directory)
    df = df.withColumn("scan_id", F.col("scan_id").cast("string"))
    if tiles is None:
        return df
    wanted = F.lit(False)
    for i, j in tiles:
        wanted = wanted | ((F.col("tile_i") == i) & (F.col("tile_j") == j))
    return df.where(wanted)


def read_tile_metadata(spark: SparkSession, directory: str) -> DataFrame:
    """The table of tiles; raises if the folder has none."""
    return spark.read.parquet(f"{directory.rstrip('/')}/tiles_metadata.parquet")


def first_tiles(tiles: DataFrame, n: int = 10) -> DataFrame:
    return tiles.orderBy("tile_idx_i", "tile_idx_j").limit(n)


def pair_by_stem(left: DataFrame, right: DataFrame, right_suffix: str = "") -> tuple[DataFrame, DataFrame]:
    """(pairs, left rows without a partner) of two tables with a column path, by the stem of their files."""
    a = left.withColumn("stem", _stem(F.col("path")))
    b = right.withColumn("stem", _stem(F.col("path"), right_suffix)).withColumnRenamed("path", "partner")
    return a.join(b, "stem"), a.join(b, "stem", "left_anti")


def read_image_pairs(spark: SparkSession, images: str, masks: str, image_glob: str = "*.npz", mask_glob: str = "*.png") -> DataFrame:
    """(stem, image bytes, mask bytes) of files that have a partner."""
    read = lambda d, g: spark.read.format("binaryFile").option("pathGlobFilter", g).load(d).select("path", "content")
    a = read(images, image_glob).select(_stem(F.col("path")).alias("stem"), F.col("content").alias("image"))
    b = read(masks, mask_glob).select(_stem(F.col("path")).alias("stem"), F.col("content").alias("mask"))
    return a.join(b, "stem")


def decode_npz(pairs: DataFrame, key: str = "image") -> DataFrame:
    """(stem, shape, values) of the arrays held in a column of npz bytes, as floats in row-major order."""

    def run(batches):
        import io

        import numpy as np
        import pandas as pd

        for pdf in batches:
            rows = []
            for stem, data in zip(pdf["stem"], pdf["image"]):
                with np.load(io.BytesIO(data)) as z:
                    a = z[key if key in z else z.files[0]]
                rows.append((stem, list(a.shape), a.astype("float32").ravel()))
            yield pd.DataFrame(rows, columns=["stem", "shape", "values"])

    return pairs.select("stem", "image").mapInPandas(run, "stem string, shape array<int>, values array<float>")


def decode_masks(pairs: DataFrame) -> DataFrame:
    """(stem, shape, labels) of the masks held in a column of PNG bytes, as whole numbers in row-major order."""

    def run(batches):
        import pandas as pd

        from ..functions.png import decode

        for pdf in batches:
            rows = [(stem, a.shape, a.ravel().astype("int64")) for stem, a in zip(pdf["stem"], map(decode, pdf["mask"]))]
            yield pd.DataFrame(rows, columns=["stem", "shape", "labels"])

    return pairs.select("stem", "mask").mapInPandas(run, "stem string, shape array<int>, labels array<bigint>")


def parse_boxes(lines: DataFrame, width: int, height: int) -> DataFrame:
    """Corner boxes from label lines (image_id, value): class and normalised centre and size; lines of other lengths go."""
    f = F.split(F.trim("value"), r"\s+")
    cut = lines.withColumn("_f", f).where(F.size("_f") == 5)
    n = lambda k: F.col("_f")[k].cast("double")
    return cut.select(
        "image_id", F.col("_f")[0].cast("int").alias("class_id"),
        ((n(1) - n(3) / 2) * width).alias("x1"), ((n(2) - n(4) / 2) * height).alias("y1"),
        ((n(1) + n(3) / 2) * width).alias("x2"), ((n(2) + n(4) / 2) * height).alias("y2"),
    )


def read_labels(spark: SparkSession, directory: str, width: int, height: int) -> DataFrame:
    text = spark.read.text(directory).select(_stem(F.input_file_name()).alias("image_id"), "value")
    return parse_boxes(text, width, height)


def synthetic_scan(spark: SparkSession, n: int = 50_000, area: float = 100.0, origin: tuple[float, float] = (100_000.0, 450_000.0), seed: int = 42, kind: str = "demo") -> DataFrame:
    """A cloud made by the executors. ``demo``: sloped ground, markings, poles and objects; ``plain``: ground and objects."""
    u = F.rand(seed)
    shares = (0.6, 0.7, 0.75) if kind == "demo" else (0.7, 0.7, 0.7)
    slope = 0.01 if kind == "demo" else 0.0
    base = spark.range(n).select(
        F.lit("synthetic").alias("scan_id"), F.col("id").alias("point_id"), u.alias("u"),
        (F.rand(seed + 1) * area).alias("dx"), (F.rand(seed + 2) * area).alias("dy"), F.randn(seed + 3).alias("e"), F.rand(seed + 4).alias("h"),
    )
    role = F.when(F.col("u") < shares[0], "ground").when(F.col("u") < shares[1], "marking").when(F.col("u") < shares[2], "pole").otherwise("object")
    rows = base.withColumn("role", role)
    line, corner = (F.floor(F.col("h") * 4) + 1) * (area / 5), F.floor(F.col("h") * 4)
    dx = F.when(F.col("role") == "pole", F.when(corner % 2 == 0, 0.1 * area).otherwise(0.9 * area) + F.col("e") * 0.05).otherwise(F.col("dx"))
    dy = F.when(F.col("role") == "marking", line + F.col("e") * 0.05).when(F.col("role") == "pole", F.when(corner < 2, 0.1 * area).otherwise(0.9 * area) + F.col("e") * 0.05).otherwise(F.col("dy"))
    placed = rows.withColumns({"dx": dx, "dy": dy})
    ground = F.col("dx") * slope
    z = F.when(F.col("role") == "ground", ground + F.col("e") * 0.1).when(F.col("role") == "marking", ground + F.col("e") * 0.02).when(
        F.col("role") == "pole", ground + F.col("h") * 6
    ).otherwise(ground + 1 + F.col("h") * 4)
    bright = (F.col("role") == "marking") if kind == "demo" else (F.col("h") < 0.1)
    colour = lambda k: F.floor(80 + 100 * F.rand(seed + k)).cast("double")
    return placed.select(
        "scan_id", "point_id", (F.col("dx") + origin[0]).alias("x"), (F.col("dy") + origin[1]).alias("y"), z.alias("z"),
        F.hypot(F.col("dx") - area / 2, F.col("dy") - area / 2).alias("range"),
        F.when(bright, 200 + 55 * F.rand(seed + 5)).otherwise(20 + 60 * F.rand(seed + 5)).alias("intensity"),
        colour(6).alias("r"), colour(7).alias("g"), colour(8).alias("b"),
    )


def from_array(spark: SparkSession, array, scan_id: str = "array") -> DataFrame:
    """Points of a two-dimensional array with positional columns."""
    import pandas as pd

    from ..schema import named

    pdf = pd.DataFrame(array).astype(float)
    df = named(spark.createDataFrame(pdf, schema=", ".join(f"c{k} double" for k in range(pdf.shape[1]))))
    ids = spark.createDataFrame(pdf.assign(point_id=range(len(pdf))), schema=", ".join([*(f"c{k} double" for k in range(pdf.shape[1])), "point_id long"]))
    out = ids.select(F.lit(scan_id).alias("scan_id"), "point_id", *[F.col(f"c{k}").alias(c) for k, c in enumerate(df.columns)])
    return out.withColumn("is_ground", F.col("is_ground").cast("boolean")) if "is_ground" in out.columns else out

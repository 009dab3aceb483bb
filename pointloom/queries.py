"""Queries over the driver's tables, one per operator, with their SQL equivalents.

Computed doubles are rounded, as sums run in another order in either engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as A
from .config import AttributeConfig, Config, QAConfig
from .functions.scalar import depth_shade, haversine, image_name, rgb_to_bytes, tile_name
from .functions.scoring import argmax_class, threshold_scorer
from .operators import attributes, axis, camera, filters, ground, images, mapping, metadata, objects, qa, raster, road, tiling, trajectory
from .plans.preprocess import Preprocess
from .schema import named
from .sources import readers
from .streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Tile densities of the point view lie about a quarter of a point per square metre and scan at the checked size.
TILES = Config(qa=QAConfig(density=0.25))


def query(sql: str | None = None):
    """Register a function under its name, with SQL in which p, c and road stand for points, clusters and the road."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH p AS ({A.POINTS_SQL}), c AS ({A.CLUSTERS_SQL}), road AS ({A.ROAD_SQL}) {sql}"
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, nudge: float = 0.0, **by_name: int) -> DataFrame:
    """Doubles to so many decimals; negative zero becomes zero. ``nudge`` is added first where values may lie half way between two."""

    def one(name: str, kind: str) -> Column:
        c = F.col(name)
        return (F.round(c + F.lit(nudge), by_name.get(name, digits)) + F.lit(0.0)).alias(name) if kind == "double" else c

    return df.select(*[one(n, k) for n, k in df.dtypes])


# --- metadata and filters -----------------------------------------------------------------------


@query(
    """SELECT scan_id, min(x) >= -7000 AND max(x) <= 300000 AND min(y) >= 289000 AND max(y) <= 629000 AND min(z) >= -20 AND max(z) <= 400 AS crs_ok,
    least(min(r), min(g), min(b)) >= 0 AND greatest(max(r), max(g), max(b)) <= 255 AS has_rgb, min(intensity) >= 0 AND max(intensity) > 0 AS has_intensity,
    count(*) AS point_count, min(x) AS x_min, min(y) AS y_min, min(z) AS z_min, max(x) AS x_max, max(y) AS y_max, max(z) AS z_max, 'unknown' AS provider,
    CASE WHEN min(x) >= -7000 AND max(x) <= 300000 AND min(y) >= 289000 AND max(y) <= 629000 AND min(z) >= -20 AND max(z) <= 400 THEN 28992 END AS crs_epsg,
    CAST(least(min(r), min(g), min(b)) AS INTEGER) AS rgb_low, CAST(greatest(max(r), max(g), max(b)) AS INTEGER) AS rgb_high,
    min(intensity) AS i_low, max(intensity) AS i_high FROM p GROUP BY scan_id"""
)
def scan_metadata(spark, sf_dir):
    m = metadata.scan_metadata(A.points(spark, sf_dir))
    return m.select(
        "scan_id", "crs_ok", "has_rgb", "has_intensity", "point_count", "bbox.*", "provider", "crs_epsg",
        F.col("rgb_range.min").alias("rgb_low"), F.col("rgb_range.max").alias("rgb_high"),
        F.col("intensity_range.min").alias("i_low"), F.col("intensity_range.max").alias("i_high"),
    )


@query("SELECT scan_id, 4326 = 28992 AND min(x) >= -7000 AS crs_ok, 4326 AS crs_epsg FROM p GROUP BY scan_id")
def crs_check(spark, sf_dir):
    return metadata.scan_metadata(A.points(spark, sf_dir), epsg=4326).select("scan_id", "crs_ok", "crs_epsg")


@query("SELECT point_id, range FROM p WHERE range <= 120")
def filter_range(spark, sf_dir):
    return filters.filter_range(A.points(spark, sf_dir), 120.0).select("point_id", "range")


@query("SELECT point_id, intensity FROM p WHERE intensity >= 50")
def filter_intensity(spark, sf_dir):
    return filters.filter_intensity_low(A.points(spark, sf_dir), 50.0).select("point_id", "intensity")


SPIKES = """(SELECT * FROM (SELECT *, list_sort([coalesce(lag(z, 2) OVER w, first_value(z) OVER a), coalesce(lag(z, 1) OVER w, first_value(z) OVER a), z,
    coalesce(lead(z, 1) OVER w, last_value(z) OVER a), coalesce(lead(z, 2) OVER w, last_value(z) OVER a)])[3] AS med
    FROM {src} WINDOW w AS (PARTITION BY scan_id ORDER BY point_id), a AS (PARTITION BY scan_id ORDER BY point_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) s WHERE abs(z - med) <= 1.0)"""


@query("SELECT point_id, z FROM " + SPIKES.format(src="p"))
def spike_filter(spark, sf_dir):
    return filters.spike_filter_z(A.points(spark, sf_dir), 5, 1.0).select("point_id", "z")


@query("""SELECT point_id FROM (SELECT *, count(*) OVER w AS n, (max(x) OVER w - min(x) OVER w) * (max(y) OVER w - min(y) OVER w) AS area FROM p WINDOW w AS (PARTITION BY scan_id)) t
    WHERE CAST('0x' || substr(md5('0:' || CAST(point_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE < least(1.0::DOUBLE, 0.125::DOUBLE * area / n)""")
def thin_density(spark, sf_dir):
    return filters.uniformize_density(A.points(spark, sf_dir), 0.125).select("point_id")


# --- ground and attributes --------------------------------------------------------------------------


@query("SELECT point_id, round(z - quantile_cont(z, 0.05) OVER (PARTITION BY scan_id), 12) + 0.0::DOUBLE AS z FROM p")
def ground_simple(spark, sf_dir):
    return rounded(ground.normalise_simple(A.points(spark, sf_dir)).select("point_id", "z"), 12)


GROUND = """(SELECT *, z - zg AS h FROM (SELECT *, quantile_cont(z, 0.05) OVER (PARTITION BY scan_id, gi, gj) AS zg FROM
    (SELECT *, floor((x - min(x) OVER (PARTITION BY scan_id)) / 2) AS gi, floor((y - min(y) OVER (PARTITION BY scan_id)) / 2) AS gj FROM {src}) a) b)"""


@query("SELECT point_id, round(h, 12) + 0.0::DOUBLE AS z, round(z, 12) AS z_abs, abs(h) <= 0.2 AS is_ground FROM " + GROUND.format(src="p"))
def ground_local(spark, sf_dir):
    return rounded(ground.normalise_local(A.points(spark, sf_dir)).select("point_id", "z", "z_abs", "is_ground"), 12)


@query("SELECT scan_id, CAST(gi AS BIGINT) AS cell_i, CAST(gj AS BIGINT) AS cell_j, round(min(zg), 12) + 0.0::DOUBLE AS z_ground FROM " + GROUND.format(src="p") + " GROUP BY scan_id, gi, gj")
def ground_cells(spark, sf_dir):
    return rounded(ground.local_ground(A.points(spark, sf_dir)), 12)


INTENSITY = "least(greatest(intensity * (greatest(range, 0.001::DOUBLE) / 50) * (greatest(range, 0.001::DOUBLE) / 50), 1), 255)"


@query(f"SELECT point_id, round({INTENSITY}, 6) + 0.0::DOUBLE AS intensity, r, g, b, round(abs(z - avg(z) OVER (PARTITION BY scan_id)), 12) + 0.0::DOUBLE AS roughness FROM p")
def attributes_normalise(spark, sf_dir):
    return rounded(attributes.normalise(A.points(spark, sf_dir)).select("point_id", "intensity", "r", "g", "b", "roughness"), roughness=12)


@query("""SELECT point_id, round(least(greatest(r * (grey / mr), 0), 255), 6) + 0.0::DOUBLE AS r, round(least(greatest(g * (grey / mg), 0), 255), 6) + 0.0::DOUBLE AS g,
    round(least(greatest(b * (grey / mb), 0), 255), 6) + 0.0::DOUBLE AS b FROM (SELECT *, (mr + mg + mb) / 3 AS grey FROM (SELECT *, avg(r) OVER w AS mr, avg(g) OVER w AS mg, avg(b) OVER w AS mb FROM p WINDOW w AS (PARTITION BY scan_id)) n) m""")
def rgb_white_balance(spark, sf_dir):
    balanced = attributes.normalise_rgb(A.points(spark, sf_dir), AttributeConfig(white_balance=True))
    return rounded(balanced.select("point_id", "r", "g", "b"))


@query("SELECT scan_id, round(avg(r), 6) AS mean_r, round(avg(g), 6) AS mean_g, round(avg(b), 6) AS mean_b, round((avg(r) + avg(g) + avg(b)) / 3, 6) AS grey FROM p GROUP BY scan_id")
def white_balance_means(spark, sf_dir):
    return rounded(attributes.white_balance_means(A.points(spark, sf_dir)))


@query("""SELECT scan_id, n_bright, n_dark, round(coalesce(n_bright / nullif(n_dark, 0)::DOUBLE, 0), 6) + 0.0::DOUBLE AS ratio, n_dark > 0 AND n_bright > 0 AND n_bright > 0.01 * n_dark AS contrast_ok
    FROM (SELECT scan_id, count(*) FILTER (intensity >= 200) AS n_bright, count(*) FILTER (intensity <= 50) AS n_dark FROM p GROUP BY 1) s""")
def marking_contrast(spark, sf_dir):
    return rounded(attributes.marking_contrast(A.points(spark, sf_dir)))


@query()
def kmeans_materials(spark, sf_dir):
    ready = attributes.normalise(A.points(spark, sf_dir))
    return attributes.preclassify(ready).groupBy("material").agg(F.count("*").alias("n"), F.round(F.avg("intensity"), 3).alias("intensity"))


# --- tiles and QA -----------------------------------------------------------------------------------

TILED = """(SELECT s.*, CASE WHEN x1 > x0 THEN least(floor((x - x0) / 20), ceil((x1 - x0) / 20) - 1) ELSE floor((x - x0) / 20) END AS ti,
    CASE WHEN y1 > y0 THEN least(floor((y - y0) / 20), ceil((y1 - y0) / 20) - 1) ELSE floor((y - y0) / 20) END AS tj
    FROM (SELECT *, min(x) OVER w AS x0, max(x) OVER w AS x1, min(y) OVER w AS y0, max(y) OVER w AS y1 FROM {src} WINDOW w AS (PARTITION BY scan_id)) s)"""


@query("SELECT scan_id, point_id, CAST(ti AS BIGINT) AS tile_i, CAST(tj AS BIGINT) AS tile_j, 'tile_' || lpad(CAST(CAST(ti AS BIGINT) AS VARCHAR), 4, '0') || '_' || lpad(CAST(CAST(tj AS BIGINT) AS VARCHAR), 4, '0') AS name FROM " + TILED.format(src="p"))
def tile_assign(spark, sf_dir):
    return tiling.tiled(A.points(spark, sf_dir)).select("scan_id", "point_id", "tile_i", "tile_j", tile_name(F.col("tile_i"), F.col("tile_j")).alias("name"))


def tiles_sql(src: str, density: float = 0.25, ground: str = "is_ground") -> str:
    return f"""(SELECT scan_id, CAST(ti AS BIGINT) AS tile_idx_i, CAST(tj AS BIGINT) AS tile_idx_j, min(x0) + ti * 20 AS bbox_x_min, min(y0) + tj * 20 AS bbox_y_min, min(x0) + (ti + 1) * 20 AS bbox_x_max,
    min(y0) + (tj + 1) * 20 AS bbox_y_max, count(*) AS point_count, count(*) / 400.0::DOUBLE AS density, count(*) / 400.0::DOUBLE >= {density} AS density_ok,
    avg(intensity) AS intensity_mean, stddev_pop(intensity) AS intensity_std, avg(CASE WHEN {ground} THEN 1.0::DOUBLE ELSE 0.0 END) AS ground_fraction,
    avg(intensity) >= 1 AS intensity_ok, avg(CASE WHEN {ground} THEN 1.0::DOUBLE ELSE 0.0 END) BETWEEN 0.05 AND 0.95 AS ground_ok,
    least(min(r), min(g), min(b)) >= 0 AND greatest(max(r), max(g), max(b)) <= 255 AS rgb_ok,
    min(x) >= -7000 AND max(x) <= 300000 AND min(y) >= 289000 AND max(y) <= 629000 AND min(z) >= -20 AND max(z) <= 400 AS crs_ok
    FROM {TILED.format(src=src)} t GROUP BY scan_id, ti, tj)"""


FLAGGED = "(SELECT *, point_id % 10 < 7 AS is_ground FROM p)"
TILE_COLUMNS = [
    "scan_id", "tile_idx_i", "tile_idx_j", "bbox_x_min", "bbox_y_min", "bbox_x_max", "bbox_y_max", "point_count", "density", "density_ok",
    "intensity_mean", "intensity_std", "ground_fraction", "intensity_ok", "ground_ok", "rgb_ok", "crs_ok",
]
TILE_ROUND = ", ".join(f"round({c} + 1e-9, 6) + 0.0::DOUBLE AS {c}" if c.startswith(("bbox", "intensity_m", "intensity_s", "ground_f")) or c == "density" else c for c in TILE_COLUMNS)


def flagged_tiles(spark, sf_dir):
    return tiling.tile_stats(A.points(spark, sf_dir).withColumn("is_ground", F.col("point_id") % 10 < 7), TILES)


@query(f"SELECT {TILE_ROUND} FROM {tiles_sql(FLAGGED)} t")
def tile_qa(spark, sf_dir):
    return rounded(flagged_tiles(spark, sf_dir).select(*TILE_COLUMNS), nudge=1e-9)


PASS = "coalesce(density_ok AND intensity_ok AND ground_ok AND crs_ok, false)"


@query(f"SELECT scan_id, tile_idx_i, tile_idx_j, point_count FROM {tiles_sql(FLAGGED)} t WHERE {PASS}")
def qa_route_approved(spark, sf_dir):
    return qa.route(flagged_tiles(spark, sf_dir)).where("qa_status = 'approved'").select("scan_id", "tile_idx_i", "tile_idx_j", "point_count")


@query(f"SELECT scan_id, tile_idx_i, tile_idx_j, point_count FROM {tiles_sql(FLAGGED)} t WHERE NOT {PASS}")
def qa_route_review(spark, sf_dir):
    return qa.route(flagged_tiles(spark, sf_dir)).where("qa_status = 'review'").select("scan_id", "tile_idx_i", "tile_idx_j", "point_count")


_RATES = " UNION ALL ".join(
    f"SELECT '{c}' AS flag, round(avg(CASE WHEN {e} THEN 1.0::DOUBLE ELSE 0.0 END) * 100, 6) AS pass_rate FROM t"
    for c, e in [(c, c) for c in ("density_ok", "intensity_ok", "ground_ok", "rgb_ok", "crs_ok")] + [("ground_ok_tiler", "ground_fraction > 0.1 AND ground_fraction < 0.9")]
)


@query(f", t AS (SELECT * FROM {tiles_sql(FLAGGED)} q) {_RATES}")
def qa_pass_rates(spark, sf_dir):
    rates = qa.pass_rates(flagged_tiles(spark, sf_dir))
    return rounded(rates)


@query(f""", t AS (SELECT density FROM {tiles_sql(FLAGGED)} q), o AS (SELECT CASE WHEN min(density) = max(density) THEN min(density) - 0.5 ELSE min(density) END AS lo,
    CASE WHEN min(density) = max(density) THEN max(density) + 0.5 ELSE max(density) END AS hi FROM t),
    n AS (SELECT least(floor((density - lo) / ((hi - lo) / 30)), 29) AS k, count(*) AS n FROM t, o GROUP BY 1)
    SELECT CAST(b AS BIGINT) AS bin, round(lo + b * ((hi - lo) / 30), 6) AS low, round(lo + (b + 1) * ((hi - lo) / 30), 6) AS high, coalesce(n, 0) AS n
    FROM o CROSS JOIN (SELECT unnest(generate_series(0, 29)) AS b) s LEFT JOIN n ON n.k = s.b""")
def density_hist(spark, sf_dir):
    return rounded(qa.density_histogram(flagged_tiles(spark, sf_dir)))


@query(f"""SELECT count(*) AS tiles, count(*) FILTER ({PASS}) AS approved, count(*) FILTER (NOT {PASS}) AS review, round(avg(density), 6) AS density_mean, round(min(density), 6) AS density_min,
    round(max(density), 6) AS density_max, CAST(sum(point_count) AS BIGINT) AS points, round(avg(point_count), 6) AS points_mean FROM {tiles_sql(FLAGGED)} t""")
def qa_overview(spark, sf_dir):
    return rounded(qa.overview(flagged_tiles(spark, sf_dir)))


@query(f"""SELECT coalesce(t.scan_id, 'all') AS scan_id, coalesce(t.tile_idx_i, -1) AS tile_idx_i, CAST(sum(point_count) AS BIGINT) AS points, CAST(sum(CASE WHEN {PASS} THEN 1 ELSE 0 END) AS BIGINT) AS approved
    FROM {tiles_sql(FLAGGED)} t GROUP BY ROLLUP (t.scan_id, t.tile_idx_i)""")
def qa_rollup(spark, sf_dir):
    report = qa.report_rollup(flagged_tiles(spark, sf_dir))
    return report.withColumns({"scan_id": F.coalesce("scan_id", F.lit("all")), "tile_idx_i": F.coalesce("tile_idx_i", F.lit(-1).cast("bigint"))})


@query("SELECT scan_id, count(*) / 10000.0 >= 0.25 AS density_ok, avg(intensity) >= 1 AS intensity_ok FROM p GROUP BY scan_id")
def point_cloud_qa(spark, sf_dir):
    return qa.point_cloud_qa(A.points(spark, sf_dir), 100.0, density=0.25)


_CLEAN = "(SELECT * FROM p WHERE range <= 120 AND intensity >= 0)"
PREPARED = f""", f AS (SELECT * EXCLUDE (med) FROM {SPIKES.format(src=_CLEAN)} q),
    h AS (SELECT * FROM {GROUND.format(src="f")} q),
    n AS (SELECT scan_id, point_id, x, y, h AS z, abs(h) <= 0.2 AS is_ground, {INTENSITY} AS intensity, r, g, b FROM h)"""
PIPELINE = Config(qa=QAConfig(density=0.2))


@query(PREPARED + f"""SELECT (SELECT count(*) FROM p) AS input_points, (SELECT count(*) FROM n) AS filtered_points, count(*) AS total_tiles,
    count(*) FILTER (density_ok AND intensity_ok AND ground_ok AND crs_ok AND rgb_ok AND intensity_mean <> 0 AND intensity_std <> 0 AND ground_fraction <> 0) AS qa_approved_tiles,
    count(*) FILTER ({PASS}) AS qa_exported_tiles, true AS crs_ok, true AS has_rgb, true AS has_intensity FROM {tiles_sql("n", 0.2)} t""")
def pipeline_summary(spark, sf_dir):
    plan, points = Preprocess(PIPELINE), A.points(spark, sf_dir)
    return plan.summary(points, plan.tiles(plan.prepared(points)))


@query(PREPARED + f"SELECT {TILE_ROUND} FROM {tiles_sql('n', 0.2)} t")
def pipeline_tiles(spark, sf_dir):
    plan = Preprocess(PIPELINE)
    return rounded(plan.tiles(plan.prepared(A.points(spark, sf_dir))).select(*TILE_COLUMNS), nudge=1e-9)


@query(f"""SELECT t.scan_id, point_id, density_ok AS qa_density_ok, ground_ok AS qa_ground_ok, round(ground_fraction, 6) AS qa_ground_fraction
    FROM {TILED.format(src=FLAGGED)} t JOIN {tiles_sql(FLAGGED)} q ON t.scan_id IS NOT DISTINCT FROM q.scan_id AND ti = tile_idx_i AND tj = tile_idx_j WHERE density_ok""")
def tile_flags(spark, sf_dir):
    points = A.points(spark, sf_dir).withColumn("is_ground", F.col("point_id") % 10 < 7)
    marked = qa.flag_points(tiling.tiled(points), flagged_tiles(spark, sf_dir).where("density_ok"))
    return rounded(marked.select("scan_id", "point_id", "qa_density_ok", "qa_ground_ok", "qa_ground_fraction"))


@query(f"SELECT tile_idx_i, tile_idx_j, point_count FROM {tiles_sql(FLAGGED)} t WHERE scan_id = 'scan1' ORDER BY 1, 2 LIMIT 10")
def first_tiles(spark, sf_dir):
    return readers.first_tiles(flagged_tiles(spark, sf_dir).where("scan_id = 'scan1'")).select("tile_idx_i", "tile_idx_j", "point_count")


# --- rasters ----------------------------------------------------------------------------------------

PIXELS = "(SELECT *, CAST(trunc((y - min(y) OVER (PARTITION BY scan_id)) / {res}) AS BIGINT) AS row, CAST(trunc((x - min(x) OVER (PARTITION BY scan_id)) / {res}) AS BIGINT) AS col FROM p)"


@query("SELECT scan_id, row, col, round(max(z), 6) AS max_z, round(avg(intensity), 6) + 0.0::DOUBLE AS mean_intensity, CAST(count(*) AS DOUBLE) AS density FROM " + PIXELS.format(res="1.0") + " t GROUP BY 1, 2, 3")
def bev3(spark, sf_dir):
    return rounded(raster.bev(A.points(spark, sf_dir), 1.0))


@query("SELECT scan_id, row, col, round(max(z), 6) AS max_z, count(*) AS n, round(avg(intensity), 6) + 0.0::DOUBLE AS mean_intensity, round(avg(r), 6) + 0.0::DOUBLE AS mean_r, round(avg(g), 6) + 0.0::DOUBLE AS mean_g, round(avg(b), 6) + 0.0::DOUBLE AS mean_b FROM " + PIXELS.format(res="1.0") + " t GROUP BY 1, 2, 3")
def qa_raster(spark, sf_dir):
    return rounded(raster.qa_raster(A.points(spark, sf_dir), 1.0))


@query("SELECT scan_id, row, col, string_agg(CAST(point_id AS VARCHAR), ',' ORDER BY point_id) AS point_ids FROM " + PIXELS.format(res="1.0") + " t GROUP BY 1, 2, 3")
def pixel_points(spark, sf_dir):
    lists = raster.pixel_lists(raster.pixels(A.points(spark, sf_dir), 1.0), ("scan_id", "row", "col"))
    return lists.select("scan_id", "row", "col", F.array_join(F.transform("point_ids", lambda p: p.cast("string")), ",").alias("point_ids"))


IMAGE = """(SELECT *, least(greatest(CAST(trunc((x - (x0 + tile_ix * 25)) / 0.5) AS BIGINT), 0), 49) AS px, 49 - least(greatest(CAST(trunc((y - (y0 + tile_iy * 25)) / 0.5) AS BIGINT), 0), 49) AS py
    FROM (SELECT *, CAST(floor((x - x0) / 25) AS BIGINT) AS tile_ix, CAST(floor((y - y0) / 25) AS BIGINT) AS tile_iy FROM (SELECT *, min(x) OVER w AS x0, max(x) OVER w AS x1, min(y) OVER w AS y0, max(y) OVER w AS y1 FROM p WINDOW w AS (PARTITION BY scan_id)) o) i
    WHERE tile_ix < greatest(ceil((x1 - x0) / 25), 1) AND tile_iy < greatest(ceil((y1 - y0) / 25), 1))"""
_SIX = "scan_id, tile_ix, tile_iy, px, py, max(z) AS z_max, avg(intensity) AS intensity_mean, avg(r) AS r_mean, avg(g) AS g_mean, avg(b) AS b_mean, count(*) AS density"


@query(f"SELECT scan_id, tile_ix, tile_iy, px, py, round(z_max, 6) AS z_max, {', '.join(f'round({c}, 6) + 0.0::DOUBLE AS {c}' for c in ('intensity_mean', 'r_mean', 'g_mean', 'b_mean'))}, density FROM (SELECT {_SIX} FROM {IMAGE} t GROUP BY 1, 2, 3, 4, 5) s")
def bev6(spark, sf_dir):
    return rounded(raster.bev6(A.points(spark, sf_dir), 0.5, 25.0))


@query(f"SELECT scan_id, tile_ix, tile_iy, point_id, px, py FROM {IMAGE} t")
def bev_mapping(spark, sf_dir):
    return raster.bev_mapping(A.points(spark, sf_dir), 0.5, 25.0)


_GRAYS = ("intensity", "r", "g", "b")


@query(f"""SELECT scan_id, tile_ix, tile_iy, px, py, CAST(trunc((z_max - z0) / greatest(z1 - z0, 0.001) * 255) AS INTEGER) AS z_gray,
    {', '.join(f"CAST(trunc(CASE WHEN {c}_top > 0 THEN {c}_mean / {c}_top ELSE 0 END * 255) AS INTEGER) AS {c}_gray" for c in _GRAYS)}
    FROM (SELECT *, min(z_max) OVER w AS z0, max(z_max) OVER w AS z1, {', '.join(f"max({c}_mean) OVER w AS {c}_top" for c in _GRAYS)}
    FROM (SELECT {_SIX} FROM {IMAGE} t GROUP BY 1, 2, 3, 4, 5) s WINDOW w AS (PARTITION BY scan_id, tile_ix, tile_iy)) d""")
def bev_display(spark, sf_dir):
    shown = raster.display_stretch(raster.bev6(A.points(spark, sf_dir), 0.5, 25.0))
    return shown.select("scan_id", "tile_ix", "tile_iy", "px", "py", "z_gray", *[f"{c}_gray" for c in _GRAYS])


@query("SELECT scan_id, row, col, round(n / max(n) OVER (PARTITION BY scan_id), 6) AS density FROM (SELECT scan_id, row, col, CAST(count(*) AS DOUBLE) AS n FROM " + PIXELS.format(res="1.0") + " t GROUP BY 1, 2, 3) s")
def density_channel(spark, sf_dir):
    return rounded(raster.normalise_density(raster.bev(A.points(spark, sf_dir), 1.0)).select("scan_id", "row", "col", "density"))


# --- mapping and fusion -------------------------------------------------------------------------------

ASKED = "(SELECT DISTINCT scan_id, row, col FROM (SELECT scan_id, row, col, avg(intensity) AS i FROM " + PIXELS.format(res="1.0") + " t GROUP BY 1, 2, 3) s WHERE i > 200)"


@query("SELECT t.point_id, min(q.row * 100000 + q.col) AS ord FROM " + PIXELS.format(res="1.0") + f" t JOIN {ASKED} q ON t.row = q.row AND t.col = q.col AND t.scan_id IS NOT DISTINCT FROM q.scan_id GROUP BY 1")
def backproject(spark, sf_dir):
    points = A.points(spark, sf_dir)
    labelled = threshold_scorer("mean_intensity", 200.0)(raster.bev(points, 1.0)).where("label = 1")
    pixels = labelled.select((F.col("row") * 100_000 + F.col("col")).alias("ord"), "scan_id", "row", "col")
    return mapping.backproject(raster.pixels(points, 1.0).select("scan_id", "row", "col", "point_id"), pixels, ("scan_id", "row", "col"))


@query("SELECT DISTINCT point_id FROM p WHERE intensity > 250 OR r > 200 OR z > 3")
def fuse_union(spark, sf_dir):
    p = A.points(spark, sf_dir)
    return mapping.fuse(p.where("intensity > 250"), p.where("r > 200"), p.where("z > 3"))


@query("SELECT point_id, round(x + 0.5, 6) AS x, round(y - 0.25, 6) AS y, round(z + 0.125, 6) AS z FROM p")
def traj_offset(spark, sf_dir):
    return rounded(trajectory.apply_offset(A.points(spark, sf_dir), (0.5, -0.25, 0.125)).select("point_id", "x", "y", "z"))


@query("SELECT point_id, round(-y + 1, 6) AS x, round(x + 2, 6) AS y, round(z + 3, 6) AS z FROM p")
def boresight(spark, sf_dir):
    turned = trajectory.apply_boresight(A.points(spark, sf_dir), (1.0, 2.0, 3.0), ((0.0, -1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0)))
    return rounded(turned.select("point_id", "x", "y", "z"))


def _smoothed(c: str) -> str:
    parts = [f"coalesce(lag({c}, {k}) OVER w, first_value({c}) OVER a)" for k in range(5, 0, -1)] + [c]
    parts += [f"coalesce(lead({c}, {k}) OVER w, last_value({c}) OVER a)" for k in range(1, 6)]
    return f"round(({' + '.join(parts)}) / 11, 6) AS {c}"


@query(f"SELECT user_id AS traj_id, point_id AS seq, {_smoothed('x')}, {_smoothed('y')}, {_smoothed('z')} FROM p WINDOW w AS (PARTITION BY user_id ORDER BY point_id), a AS (PARTITION BY user_id ORDER BY point_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def traj_smooth(spark, sf_dir):
    return rounded(trajectory.smooth(A.axes(spark, sf_dir).withColumnRenamed("axis_id", "traj_id"), 11))


# --- axes and cameras ---------------------------------------------------------------------------------


def chain_sql(src: str) -> str:
    return f"""(SELECT *, sum(d) OVER (PARTITION BY axis_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM
    (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS d FROM {src} WINDOW w AS (PARTITION BY axis_id ORDER BY seq)) l)"""


def segment_sql(src: str) -> str:
    return f"""(SELECT * FROM (SELECT axis_id, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY axis_id) - 1 AS n, s AS s0, x AS x0, y AS y0, lead(s) OVER w AS s1, lead(x) OVER w AS x1, lead(y) OVER w AS y1
    FROM {chain_sql(src)} g WINDOW w AS (PARTITION BY axis_id ORDER BY seq)) e WHERE s1 IS NOT NULL)"""


def sample_sql(src: str, step: float) -> str:
    return f"""(SELECT m.axis_id, i, m.s, x0 + t * (x1 - x0) AS x, y0 + t * (y1 - y0) AS y, CASE WHEN len = 0 THEN 1.0 ELSE (x1 - x0) / len END AS tx, CASE WHEN len = 0 THEN 0.0 ELSE (y1 - y0) / len END AS ty FROM
    (SELECT q.*, k, n, s0, s1, x0, y0, x1, y1, CASE WHEN s1 = s0 THEN 0 ELSE (q.s - s0) / nullif(s1 - s0, 0) END AS t, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM
    (SELECT axis_id, i, i * {step}::DOUBLE AS s FROM (SELECT axis_id, unnest(generate_series(0, CAST(floor(max(s) / {step}) AS BIGINT))) AS i FROM {chain_sql(src)} g GROUP BY axis_id HAVING max(s) > 0) u) q
    JOIN {segment_sql(src)} v ON v.axis_id = q.axis_id AND (q.s > s0 OR k = 0) AND (q.s <= s1 OR k = n - 1)) m)"""


AX = f", ax AS ({A.AXES_SQL}) "


@query(AX + f"SELECT axis_id, seq, round(s, 6) AS s FROM {chain_sql('ax')} t")
def axis_chainage(spark, sf_dir):
    return rounded(axis.chainage(A.axes(spark, sf_dir)).select("axis_id", "seq", "s"))


@query(AX + f"SELECT axis_id, i, round(s, 6) AS s, round(x, 6) AS x, round(y, 6) AS y FROM {sample_sql('ax', 50)} t")
def axis_sample(spark, sf_dir):
    return rounded(axis.sample(A.axes(spark, sf_dir).drop("z"), 50.0).select("axis_id", "i", "s", "x", "y"))


@query(AX + f"SELECT axis_id, i, round(tx, 6) + 0.0::DOUBLE AS tx, round(ty, 6) + 0.0::DOUBLE AS ty FROM {sample_sql('ax', 50)} t")
def axis_tangent(spark, sf_dir):
    return rounded(axis.sample(A.axes(spark, sf_dir).drop("z"), 50.0).select("axis_id", "i", "tx", "ty"))


@query(f"SELECT s.i AS pose_idx, p.point_id FROM {sample_sql('road', 10)} s JOIN p ON (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) <= 900")
def pose_radius_join(spark, sf_dir):
    points = A.points(spark, sf_dir)
    return camera.near_poses(camera.poses(A.road(spark), points, 10.0), points, 30.0).select("pose_idx", "point_id")


_YAW = 0.5
@query(f"""SELECT point_id, CAST(trunc(800.0 * (v / depth) + 384.0) AS BIGINT) AS row, CAST(trunc(800.0 * (u / depth) + 512.0) AS BIGINT) AS col, round(depth, 6) AS depth FROM
    (SELECT point_id, (x - 100000) * cos({_YAW}) - (y - 450050) * sin({_YAW}) AS depth, (x - 100000) * sin({_YAW}) + (y - 450050) * cos({_YAW}) AS u, z AS v FROM p) t
    WHERE depth > 0 AND trunc(800.0 * (v / depth) + 384.0) >= 0 AND trunc(800.0 * (v / depth) + 384.0) < 768 AND trunc(800.0 * (u / depth) + 512.0) >= 0 AND trunc(800.0 * (u / depth) + 512.0) < 1024""")
def camera_project(spark, sf_dir):
    local = A.points(spark, sf_dir).withColumns({"x": F.col("x") - 100_000, "y": F.col("y") - 450_050})
    return rounded(camera.project(local, _YAW).select("point_id", "row", "col", "depth"))


VIEWS = ", ".join(f"('{n}', {v}::DOUBLE)" for n, v in camera.DIRECTIONS)
SEEN = f"""(SELECT * FROM (SELECT *, round_even(fx * (yc / depth) + 960.0, 0) AS u, round_even(fx * ((pz - z) / depth) + 540.0, 0) AS v FROM
    (SELECT *, cos(vy) * (x - px) + sin(vy) * (y - py) AS depth, -sin(vy) * (x - px) + cos(vy) * (y - py) AS yc, 1920 / (2.0 * tan(60.0 * pi() / 180.0 / 2.0)) AS fx FROM
    (SELECT s.i AS pose_idx, s.x AS px, s.y AS py, m + 2.0 AS pz, p.point_id, p.x, p.y, p.z, direction, atan2(ty, tx) + radians(off) AS vy
    FROM {sample_sql('road', 10)} s JOIN p ON (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) <= 900, (SELECT avg(z) AS m FROM p) h, (VALUES {VIEWS}) d(direction, off)) a) b WHERE depth > 0) c
    WHERE u >= 0 AND u < 1920 AND v >= 0 AND v < 1080)"""


@query(f"""SELECT pose_idx, direction, point_id, CAST(u AS BIGINT) AS px, CAST(v AS BIGINT) AS py, round(depth, 6) AS depth FROM
    (SELECT *, row_number() OVER (PARTITION BY pose_idx, direction, u, v ORDER BY depth, point_id) AS k FROM {SEEN} t) z WHERE k = 1""")
def camera_zbuffer(spark, sf_dir):
    seen = camera.views_along_axis(A.points(spark, sf_dir), A.road(spark))
    return rounded(seen.select("pose_idx", "direction", "point_id", "px", "py", "depth"))


@query(f"""SELECT pose_idx, direction, CAST(u AS BIGINT) AS px, CAST(v AS BIGINT) AS py, CAST(r AS INTEGER) AS red, CAST(g AS INTEGER) AS green, CAST(b AS INTEGER) AS blue FROM
    (SELECT t.*, q.r, q.g, q.b, row_number() OVER (PARTITION BY pose_idx, direction, u, v ORDER BY depth, t.point_id) AS k FROM {SEEN} t JOIN p q ON t.point_id = q.point_id) z WHERE k = 1""")
def view_colours(spark, sf_dir):
    seen = images.view_colours(camera.views_along_axis(A.points(spark, sf_dir), A.road(spark)))
    return seen.select("pose_idx", "direction", "px", "py", "red", "green", "blue")


@query(f"""SELECT direction, count(*) AS views, count(*) FILTER (n >= 100) AS passed, count(*) FILTER (n < 100) AS failed, CAST(sum(n) AS BIGINT) AS points_sum, round(avg(n), 6) AS points_mean, min(n) AS points_min, max(n) AS points_max
    FROM (SELECT pose_idx, direction, count(*) AS n FROM (SELECT DISTINCT pose_idx, direction, u, v FROM {SEEN} t) x GROUP BY 1, 2) y GROUP BY direction""")
def views_overview(spark, sf_dir):
    seen = camera.views_along_axis(A.points(spark, sf_dir), A.road(spark))
    return rounded(qa.views_overview(seen.groupBy("pose_idx", "direction").agg(F.count("*").alias("points")), 100))


@query("""SELECT point_id, 'scan_s' || lpad(CAST(point_id AS VARCHAR), 8, '0') || '_front' AS name, CAST(trunc(r * (CASE WHEN greatest(r * 2, g, b, 1) > 255 THEN 255.0::DOUBLE / greatest(r * 2, g, b, 1) ELSE 1.0 END) * 2) AS INTEGER) AS r2 FROM p""")
def display_values(spark, sf_dir):
    red = rgb_to_bytes(F.col("r") * 2, F.col("g"), F.col("b"))[0]
    return A.points(spark, sf_dir).select("point_id", image_name(F.lit("scan"), F.col("point_id") / 100.0, F.lit("front")).alias("name"), red.alias("r2"))


# --- objects ------------------------------------------------------------------------------------------

_MEAN = "(SELECT c.*, c.x - mx AS u, c.y - my AS v, mx, my FROM c JOIN (SELECT cluster_id, avg(x) AS mx, avg(y) AS my FROM c GROUP BY 1) m ON c.cluster_id = m.cluster_id)"
CIRCLE = f"""(SELECT cluster_id, n, mx + a AS cx, my + b AS cy, sqrt(a * a + b * b + (uu + vv) / n) AS radius FROM (SELECT *, (uq * vv - vq * uv) / (2 * d) AS a, (vq * uu - uq * uv) / (2 * d) AS b FROM
    (SELECT *, CASE WHEN uu * vv - uv * uv <= 1e-12 * greatest(uu * vv, 1e-300) THEN NULL ELSE uu * vv - uv * uv END AS d FROM
    (SELECT cluster_id, count(*) AS n, min(mx) AS mx, min(my) AS my, sum(u * u) AS uu, sum(v * v) AS vv, sum(u * v) AS uv, sum(u * (u * u + v * v)) AS uq, sum(v * (u * u + v * v)) AS vq FROM {_MEAN} q GROUP BY 1) s) t) w)"""


@query(f"SELECT cluster_id, n, round(cx, 3) AS cx, round(cy, 3) AS cy, round(radius, 3) AS radius FROM {CIRCLE} t")
def circle_fit(spark, sf_dir):
    return rounded(objects.fit_circles(A.clusters(spark, sf_dir)), 3)


@query(f"SELECT cluster_id, round(cx, 3) AS cx, round(cy, 3) AS cy, round(radius, 3) AS radius FROM {CIRCLE} t WHERE radius > 0.1 AND radius < 1.5")
def manholes(spark, sf_dir):
    return rounded(objects.extract_manholes(A.clusters(spark, sf_dir)).drop("n"), 3)


@query(f"SELECT cluster_id, round(cx, 3) AS cx, round(cy, 3) AS cy, round(radius, 3) AS radius, round(height, 3) AS height FROM (SELECT cluster_id, count(*) AS n, min(mx) AS cx, min(my) AS cy, avg(sqrt(u * u + v * v)) AS radius, max(z) - min(z) AS height FROM {_MEAN} q GROUP BY 1) t WHERE n >= 10 AND radius > 0.02 AND radius < 0.5 AND height > 2.0")
def mast_fit(spark, sf_dir):
    return rounded(objects.extract_masts(A.clusters(spark, sf_dir)), 3)


def line_sql(least: int) -> str:
    return f"""(SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY t, point_id) - 1 AS seq FROM (SELECT q.*, round(u * cos(a) + v * sin(a), 9) AS t FROM {_MEAN} q JOIN
    (SELECT cluster_id, atan2(2 * sum(u * v), sum(u * u) - sum(v * v)) / 2 AS a FROM {_MEAN} q GROUP BY 1 HAVING count(*) >= {least}) m ON q.cluster_id = m.cluster_id) l)"""


@query(f"SELECT cluster_id, seq, point_id, round(x, 6) AS x, round(y, 6) AS y FROM {line_sql(2)} t WHERE kind = 0")
def marking_polyline(spark, sf_dir):
    return rounded(objects.extract_markings(A.clusters(spark, sf_dir).where("kind = 0")))


@query(f"""SELECT l.cluster_id, seq, point_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM {line_sql(10)} l JOIN (SELECT cluster_id FROM {line_sql(10)} q GROUP BY 1
    HAVING sqrt(pow(arg_max(x, seq) - arg_min(x, seq), 2) + pow(arg_max(y, seq) - arg_min(y, seq), 2)) >= 2) g ON l.cluster_id = g.cluster_id WHERE kind = 4""")
def guardrail_polyline(spark, sf_dir):
    return rounded(objects.extract_guardrails(A.clusters(spark, sf_dir).where("kind = 4")))


@query("""SELECT cluster_id, round(min(mx), 3) AS cx, round(min(my), 3) AS cy, round(min(mz), 3) AS cz, round(min(z), 6) AS height, round(sum((x - mx) * (x - mx)) / (count(*) - 1), 6) + 0.0::DOUBLE AS xx,
    round(sum((y - my) * (y - my)) / (count(*) - 1), 6) + 0.0::DOUBLE AS yy, round(sum((z - mz) * (z - mz)) / (count(*) - 1), 6) + 0.0::DOUBLE AS zz FROM
    (SELECT c.*, mx, my, mz FROM c JOIN (SELECT cluster_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM c GROUP BY 1) m ON c.cluster_id = m.cluster_id) t GROUP BY cluster_id HAVING count(*) >= 5""")
def sign_moments(spark, sf_dir):
    m = objects.sign_moments(A.clusters(spark, sf_dir)).select("cluster_id", "cx", "cy", "cz", "height", "xx", "yy", "zz")
    return rounded(m, cx=3, cy=3, cz=3)


_NORMAL = """(SELECT *, sqrt(ux * ux + uy * uy + uz * uz) AS nu, sqrt(vx * vx + vy * vy + vz * vz) AS nv, sqrt(wx * wx + wy * wy + wz * wz) AS nw FROM
    (SELECT *, xy * yz - xz * b AS ux, xz * xy - a * yz AS uy, a * b - xy * xy AS uz, xy * c - xz * yz AS vx, xz * xz - a * c AS vy, a * yz - xy * xz AS vz,
    b * c - yz * yz AS wx, yz * xz - xy * c AS wy, xy * yz - b * xz AS wz FROM
    (SELECT *, xx - l AS a, yy - l AS b, zz - l AS c FROM (SELECT *, q + 2 * p * cos(acos(greatest(-1.0, least(1.0, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz)
    + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p)))) / 3 + 2 * pi() / 3) AS l FROM
    (SELECT *, (xx + yy + zz) / 3 AS q, sqrt((pow(xx - (xx + yy + zz) / 3, 2) + pow(yy - (xx + yy + zz) / 3, 2) + pow(zz - (xx + yy + zz) / 3, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM
    (SELECT cluster_id, min(mx) AS cx, min(my) AS cy, min(mz) AS cz, min(z) AS height, covar_samp(x, x) AS xx, covar_samp(x, y) AS xy, covar_samp(x, z) AS xz, covar_samp(y, y) AS yy,
    covar_samp(y, z) AS yz, covar_samp(z, z) AS zz FROM (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my, avg(z) OVER w AS mz FROM c WHERE kind = 3 WINDOW w AS (PARTITION BY cluster_id)) m
    GROUP BY cluster_id HAVING count(*) >= 5) s1) s2) s3) s4) s5)"""


def _component(k: str) -> str:
    pick = f"CASE WHEN nu >= nv AND nu >= nw THEN u{k} / nu WHEN nv >= nw THEN v{k} / nv ELSE w{k} / nw END"
    return f"{pick} AS n{k}"


@query(f"""SELECT cluster_id, round(cx, 3) AS cx, round(cy, 3) AS cy, round(cz, 3) AS cz, round(nx * g, 4) + 0.0::DOUBLE AS nx, round(ny * g, 4) + 0.0::DOUBLE AS ny, round(nz * g, 4) + 0.0::DOUBLE AS nz, round(height, 6) AS height
    FROM (SELECT *, CASE WHEN abs(nx) > 1e-9 THEN sign(nx) WHEN abs(ny) > 1e-9 THEN sign(ny) ELSE sign(nz) END AS g FROM
    (SELECT *, {', '.join(map(_component, 'xyz'))} FROM {_NORMAL} a) b) d""")
def sign_normals(spark, sf_dir):
    return rounded(objects.extract_signs(A.clusters(spark, sf_dir).where("kind = 3")), 4, cx=3, cy=3, cz=3, height=6)


# --- road model ---------------------------------------------------------------------------------------


@query(f"""SELECT cluster_id, 'solid' AS marking_type, 100.0::DOUBLE AS width_mm, count(*) AS points, round(sum(d), 6) AS pattern_length_m FROM (SELECT cluster_id, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS d
    FROM {line_sql(2)} t WHERE kind = 0 WINDOW w AS (PARTITION BY cluster_id ORDER BY seq)) s GROUP BY 1""")
def crow_encode(spark, sf_dir):
    lines = objects.extract_markings(A.clusters(spark, sf_dir).where("kind = 0"))
    coded = road.encode_markings(lines).withColumn("points", F.size("geometry").cast("bigint"))
    return rounded(coded.select("cluster_id", "marking_type", "width_mm", "points", "pattern_length_m"))


LANES = """(SELECT axis_id, lane_id, seq, x - gy / n * ((lane_id - 1.0) * 3.5) AS x, y + gx / n * ((lane_id - 1.0) * 3.5) AS y FROM (SELECT *, CASE WHEN gx = 0 AND gy = 0 THEN 1.0 ELSE sqrt(gx * gx + gy * gy) END AS n FROM
    (SELECT axis_id, seq, x, y, (coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x)) / (CASE WHEN lead(x) OVER w IS NOT NULL AND lag(x) OVER w IS NOT NULL THEN 2.0 ELSE 1.0 END) AS gx,
    (coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y)) / (CASE WHEN lead(y) OVER w IS NOT NULL AND lag(y) OVER w IS NOT NULL THEN 2.0 ELSE 1.0 END) AS gy FROM {src} WINDOW w AS (PARTITION BY axis_id ORDER BY seq)) g) h, (VALUES (0), (1), (2)) l(lane_id))"""


@query(AX + f"SELECT axis_id, CAST(lane_id AS INTEGER) AS lane_id, seq, round(x, 6) AS x, round(y, 6) AS y FROM {LANES.format(src='ax')} t")
def lanes(spark, sf_dir):
    return rounded(road.construct_lanes(A.axes(spark, sf_dir), 3.5, 3))


@query(f"""SELECT count(*) AS pairs, round(avg(d), 6) AS mean_separation, avg(d) >= 3.0 AS lane_separation_ok FROM (SELECT a.lane_id, b.lane_id, avg(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d
    FROM {LANES.format(src='road')} a JOIN {LANES.format(src='road')} b ON a.lane_id < b.lane_id AND a.seq = b.seq GROUP BY 1, 2) s""")
def lane_separation(spark, sf_dir):
    return rounded(qa.lane_separation(road.construct_lanes(A.road(spark), 3.5, 3)))


_UNEVEN = f"(SELECT * FROM {LANES.format(src='road')} q WHERE seq < 8 - 2 * lane_id)"


@query(f""", n AS (SELECT lane_id, count(*) AS n FROM {_UNEVEN} q GROUP BY 1), k AS (SELECT a.lane_id AS a, b.lane_id AS b, a.n AS na, b.n AS nb, least(a.n, b.n) AS m,
    unnest(generate_series(0, least(a.n, b.n) - 1)) AS k FROM n a JOIN n b ON a.lane_id < b.lane_id)
    SELECT count(*) AS pairs, round(avg(d), 6) AS mean_separation, avg(d) >= 3.0 AS lane_separation_ok FROM (SELECT k.a, k.b, avg(sqrt(pow(x.x - y.x, 2) + pow(x.y - y.y, 2))) AS d
    FROM k JOIN {_UNEVEN} x ON x.lane_id = k.a AND x.seq = CAST(trunc(k.k * ((na - 1) / (m - 1)::DOUBLE)) AS BIGINT)
    JOIN {_UNEVEN} y ON y.lane_id = k.b AND y.seq = CAST(trunc(k.k * ((nb - 1) / (m - 1)::DOUBLE)) AS BIGINT) GROUP BY 1, 2) s""")
def lane_separation_uneven(spark, sf_dir):
    lanes = road.construct_lanes(A.road(spark), 3.5, 3).where("seq < 8 - 2 * lane_id")
    return rounded(qa.lane_separation(lanes))


@query("""SELECT cluster_id, 'solid' AS marking_type, 100.0::DOUBLE AS width_mm, count(*) AS points, round(sum(d), 6) AS pattern_length_m FROM
    (SELECT cluster_id, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS d
    FROM c WHERE kind = 0 WINDOW w AS (PARTITION BY cluster_id ORDER BY point_id)) s GROUP BY 1""")
def encode_geometries(spark, sf_dir):
    point = F.when(F.col("kind") == 0, F.struct("point_id", "x", "y"))
    lines = A.clusters(spark, sf_dir).groupBy("cluster_id").agg(F.sort_array(F.collect_list(point)).alias("geometry"))  # empty for other kinds
    coded = road.encode_geometries(lines).withColumn("points", F.size("geometry").cast("bigint"))
    return rounded(coded.select("cluster_id", "marking_type", "width_mm", "points", "pattern_length_m"))


@query(f"""SELECT s.i, round(s.s, 6) AS s, round(m.z, 6) + 0.0::DOUBLE AS z_median FROM (SELECT axis_id, i, i * 5.0::DOUBLE AS s FROM (SELECT axis_id, unnest(generate_series(0, CAST(ceil((max(s) + 5) / 5) AS BIGINT) - 1)) AS i FROM {chain_sql('road')} g GROUP BY axis_id) u) s
    LEFT JOIN (SELECT i, median(z) AS z FROM (SELECT q.i, p.z FROM (SELECT u.i, x0 + (u.s - s0) / greatest(len, 1e-6) * (x1 - x0) AS ax, y0 + (u.s - s0) / greatest(len, 1e-6) * (y1 - y0) AS ay, -(y1 - y0) / (len + 1e-12) AS nx, (x1 - x0) / (len + 1e-12) AS ny
    FROM (SELECT axis_id, i, i * 5.0::DOUBLE AS s FROM (SELECT axis_id, unnest(generate_series(0, CAST(ceil((max(s) + 5) / 5) AS BIGINT) - 1)) AS i FROM {chain_sql('road')} g GROUP BY axis_id) u0) u
    JOIN (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM {segment_sql('road')} v0) v ON v.axis_id = u.axis_id AND (u.s >= s0 OR k = 0) AND (u.s < s1 OR k = n - 1)) q
    JOIN p ON abs((p.x - q.ax) * q.nx + (p.y - q.ay) * q.ny) < 2.5) h GROUP BY i) m ON m.i = s.i""")
def elevation_profile(spark, sf_dir):
    return rounded(road.elevation_profiles(A.points(spark, sf_dir), A.road(spark), 5.0).select("i", "s", "z_median"))


# --- small functions ------------------------------------------------------------------------------------


@query("""SELECT point_id, round(2 * 6371000.0::DOUBLE * atan2(sqrt(a), sqrt(1 - a)), 3) AS metres FROM (SELECT point_id, pow(sin(radians(intensity / 100 - r / 100) / 2), 2) + cos(radians(r / 100)) * cos(radians(intensity / 100)) * pow(sin(radians(b / 100 - g / 100) / 2), 2) AS a FROM p) t""")
def haversine_distance(spark, sf_dir):
    deg = lambda c: F.col(c) / 100
    d = haversine(deg("r"), deg("g"), deg("intensity"), deg("b"))
    return A.points(spark, sf_dir).select("point_id", F.round(d, 3).alias("metres"))


@query("SELECT 100000.0::DOUBLE + i * 15.0 AS x_min, 450000.0::DOUBLE + j * 15.0 AS y_min, 100000.0::DOUBLE + (i + 1) * 15.0 AS x_max, 450000.0::DOUBLE + (j + 1) * 15.0 AS y_max FROM (SELECT unnest(generate_series(0, 6)) AS i) a, (SELECT unnest(generate_series(0, 4)) AS j) b")
def tile_grid(spark, sf_dir):
    return tiling.generate_tiles(spark, 100_000.0, 450_000.0, 100_100.0, 450_075.0, 15.0)


@query("SELECT point_id, CAST(trunc((1.0::DOUBLE - least(greatest(range / 100.0::DOUBLE, 0.0), 1.0)) * 255) AS INTEGER) AS grey FROM p")
def depth_shading(spark, sf_dir):
    return A.points(spark, sf_dir).select("point_id", depth_shade(F.col("range")).alias("grey"))


@query("""SELECT scan_id, point_id, x, CASE WHEN point_id % 2 = 0 THEN r END AS r FROM p""")
def concat_scans(spark, sf_dir):
    points = A.points(spark, sf_dir)
    coloured, plain = points.where("point_id % 2 = 0"), points.where("point_id % 2 = 1").drop("r", "g", "b")
    return readers.concat_scans(coloured, plain).select("scan_id", "point_id", "x", "r")


@query("SELECT point_id AS seq, x, y, z, range, intensity, r, g, b, point_id % 10 < 7 AS is_ground FROM p")
def named_columns(spark, sf_dir):
    columns = [*[F.col(c) for c in ("x", "y", "z", "range", "intensity", "r", "g", "b")], F.col("point_id") % 10 < 7, F.col("point_id")]
    positional = A.points(spark, sf_dir).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)])
    return named(positional).withColumnRenamed("col_9", "seq")


_IMAGES = "SELECT 'scans/' || CAST(point_id AS VARCHAR) || '.npz' AS path, CAST(point_id AS VARCHAR) AS stem FROM p WHERE point_id % 3 > 0"
_AXES = "SELECT 'axes/' || CAST(point_id AS VARCHAR) || '_axis.csv' AS partner, CAST(point_id AS VARCHAR) AS stem FROM p WHERE point_id % 2 = 0"


def _files(spark, sf_dir):
    ids, name = A.points(spark, sf_dir), F.col("point_id").cast("string")
    left = ids.where("point_id % 3 > 0").select(F.concat(F.lit("scans/"), name, F.lit(".npz")).alias("path"))
    right = ids.where("point_id % 2 = 0").select(F.concat(F.lit("axes/"), name, F.lit("_axis.csv")).alias("path"))
    return readers.pair_by_stem(left, right, "_axis")


@query(f"SELECT i.stem, path, partner FROM ({_IMAGES}) i JOIN ({_AXES}) a ON i.stem = a.stem")
def paired_files(spark, sf_dir):
    return _files(spark, sf_dir)[0].select("stem", "path", "partner")


@query(f"SELECT path FROM ({_IMAGES}) i WHERE stem NOT IN (SELECT stem FROM ({_AXES}) a)")
def unpaired_files(spark, sf_dir):
    return _files(spark, sf_dir)[1].select("path")


@query("SELECT point_id AS image_id, CAST(point_id % 5 AS INTEGER) AS class_id, round((0.5 - 0.25 / 2) * 640, 6) AS x1, round((0.5 - 0.5 / 2) * 480, 6) AS y1, round((0.5 + 0.25 / 2) * 640, 6) AS x2, round((0.5 + 0.5 / 2) * 480, 6) AS y2 FROM p WHERE point_id % 7 <> 3")
def yolo_boxes(spark, sf_dir):
    line = F.concat((F.col("point_id") % 5).cast("string"), F.lit("  0.5 0.5 0.25 0.5"), F.when(F.col("point_id") % 7 == 3, F.lit(" x")).otherwise(F.lit(" ")))
    return rounded(readers.parse_boxes(A.points(spark, sf_dir).select(F.col("point_id").alias("image_id"), line.alias("value")), 640, 480))


@query("SELECT point_id, CASE WHEN r >= g AND r >= b THEN 0 WHEN g >= b THEN 1 ELSE 2 END AS label FROM p")
def argmax_label(spark, sf_dir):
    return A.points(spark, sf_dir).select("point_id", argmax_class(F.array("r", "g", "b")).alias("label"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return rounded(ingest.event_windows(A.events(spark, sf_dir)), 4)


@query("SELECT scan_id, CAST(floor((x - 100000) / 20) AS BIGINT) AS tile_i, CAST(floor((y - 450000) / 20) AS BIGINT) AS tile_j, count(*) AS point_count, round(avg(intensity), 6) + 0.0::DOUBLE AS intensity_mean FROM p WHERE range <= 120 AND intensity >= 0 GROUP BY 1, 2, 3")
def stream_tile_counts(spark, sf_dir):
    return rounded(ingest.tile_counts(A.points(spark, sf_dir), 20.0, (100_000.0, 450_000.0)))


@query()
def synthetic_scan(spark, sf_dir):
    return readers.synthetic_scan(spark, 50_000)

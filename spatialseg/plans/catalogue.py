"""One query for each operator, over the driver's tables, with its DuckDB SQL where it can be said in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatialseg import adapters as A
from spatialseg.operators import classify as M
from spatialseg.operators import cloud as C
from spatialseg.operators import filament as L
from spatialseg.operators import graph as G
from spatialseg.operators import knn as K
from spatialseg.operators import metrics as E
from spatialseg.operators import norm as N
from spatialseg.operators import project as P
from spatialseg.operators import raster as R
from spatialseg.operators import tiles as T
from spatialseg.runtime import cut, table, work_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def sql(views: str, body: str, cols: str, nums: str = "", ctes: str = "") -> str:
    """SQL with views, further CTEs, the query's body, its plain and its rounded columns."""
    parts = [A.VIEWS[v] for v in views.split()] + ([ctes] if ctes else []) + [f"q AS ({body})"]
    out = [c for c in (cols, ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in nums.split())) if c]
    return f"WITH {'RECURSIVE ' if 'reach(' in ctes else ''}{', '.join(parts)} SELECT {', '.join(out)} FROM q"


def query(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, d: rounded(f(spark, d))
        if oracle:
            SQL[name] = oracle
        return f

    return add


def both(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Voxels and images, the voxels aggregated once."""
    return A.voxels(s, d), A.images(s, d)


def scale_images(s: SparkSession, d: str) -> DataFrame:
    """An image row for each cloud of ``points``."""
    return A.points(s, d).select("cloud_id").distinct().select("cloud_id", F.length("cloud_id").cast("double").alias("pixel_size"), F.lit(10.0).alias("off_x"), F.lit(20.0).alias("off_y"), F.lit(30.0).alias("off_z"))


def tracks(s: SparkSession, d: str) -> DataFrame:
    """Polylines inside the frame of ``voxels``."""
    e = F.col("event_id")
    return table(s, d, "events").select((F.col("user_id") % 8).alias("cloud_id"), F.col("user_id").alias("seg_id"), e.alias("point_id"), e.alias("ord"), (e * 31 % 64).cast("double").alias("x"), (e * 17 % 51).cast("double").alias("y"), (e % 7).cast("double").alias("z"))


def binary(s: SparkSession, d: str) -> DataFrame:
    return P.threshold(A.voxels(s, d), 50000.0)


TRACKS = "tracks AS (SELECT user_id % 8 AS cloud_id, user_id AS seg_id, event_id AS point_id, event_id AS ord, (event_id * 31 % 64)::DOUBLE AS x, (event_id * 17 % 51)::DOUBLE AS y, (event_id % 7)::DOUBLE AS z FROM events)"
SCALE = "imgs AS (SELECT DISTINCT cloud_id, length(cloud_id)::DOUBLE AS px FROM points)"
CELL, XYZ = "image_id, z, y, x", "x y z"
SEG = "cloud_id, seg_id"

# 2.1 tables of sources and sinks ------------------------------------------------------------


@query("s9_pair_images_masks", "WITH i AS (SELECT c_custkey AS stem FROM customer), m AS (SELECT o_custkey AS stem, o_orderkey AS mask, o_orderkey % 3 AS priority FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY priority, mask) AS r FROM m) SELECT i.stem, b.mask, b.mask IS NOT NULL AS paired FROM i LEFT JOIN b ON i.stem = b.stem AND r = 1")
def _(s, d):
    from spatialseg.sources.tables import pair_images_masks

    images = table(s, d, "customer").select(F.col("c_custkey").alias("stem"))
    masks = table(s, d, "orders").select(F.col("o_custkey").alias("stem"), F.col("o_orderkey").alias("mask"), (F.col("o_orderkey") % 3).alias("priority"))
    return pair_images_masks(images, masks)


@query("s11_to_spatial_graph_tables", sql("points", "SELECT cloud_id, dense_rank() OVER (PARTITION BY cloud_id ORDER BY seg_id) - 1 AS edge_id, count(*) AS n_points, arg_min(x, ord) AS ax, arg_max(x, ord) AS bx FROM points GROUP BY cloud_id, seg_id", "cloud_id, edge_id, edge_id * 2 AS v0, edge_id * 2 + 1 AS v1, n_points", "ax bx"))
def _(s, d):
    from spatialseg.sources.tables import to_spatial_graph_tables

    t = to_spatial_graph_tables(A.points(s, d))
    v = t["sg_vertex"].select("cloud_id", "v_id", "x")
    return t["sg_edge"].join(v.toDF("cloud_id", "v0", "ax"), ["cloud_id", "v0"]).join(v.toDF("cloud_id", "v1", "bx"), ["cloud_id", "v1"])


@query("s12_tile_report", sql("voxels images", "SELECT image_id, arbitrary(pixel_size) AS pixel_size, count(*) AS tiles, count(*) FILTER (value > 50000) AS saved, min(value) AS low, max(value) AS high, 100.0 * count(*) FILTER (value > 50000) / count(*) AS saved_pct FROM voxels JOIN images USING (image_id) GROUP BY image_id", "image_id, tiles, saved", "pixel_size low high saved_pct"))
def _(s, d):
    from spatialseg.sources.tables import tile_report

    v, i = both(s, d)
    return tile_report(v, i, 50000.0)


@query("s13_prediction_stats", sql("points", "SELECT cloud_id, sum(n)::BIGINT AS points, count(*) AS instances, string_agg(n::VARCHAR, ',' ORDER BY n) AS sizes, bool_or(n > 1000) AS any_1000, bool_or(n > 15) AS any_large FROM (SELECT cloud_id, seg_id, count(*) AS n FROM points GROUP BY ALL) GROUP BY 1", "cloud_id, points, instances, sizes, any_1000, any_large"))
def _(s, d):
    from spatialseg.sources.tables import prediction_stats

    return prediction_stats(A.points(s, d), 1000, 15).withColumn("sizes", F.array_join(F.transform("sizes", lambda n: n.cast("string")), ","))


@query("s15_resume_pending", "SELECT doc_id AS image_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(s, d):
    from spatialseg.sources.tables import resume_pending

    ids = lambda t: table(s, d, t).select(F.col("doc_id").alias("image_id"))
    return resume_pending(ids("documents"), ids("labels"))


# 2.2 projections ---------------------------------------------------------------------------


@query("p1_to_physical", sql("points", "SELECT point_id, cloud_id, x * px + 10 AS x, y * px + 20 AS y, z * px + 30 AS z FROM points JOIN imgs USING (cloud_id)", "cloud_id, point_id", XYZ, SCALE))
def _(s, d):
    return P.to_physical(A.points(s, d), scale_images(s, d)).select("cloud_id", "point_id", "x", "y", "z")


@query("p1_to_pixel", sql("points", "SELECT point_id, cloud_id, (x - 10) / (px / 10) AS x, (y - 20) / (px / 10) AS y, (z - 30) / (px / 10) AS z FROM points JOIN imgs USING (cloud_id)", "cloud_id, point_id", XYZ, SCALE))
def _(s, d):
    return P.to_pixel(A.points(s, d), scale_images(s, d), unit="nm").select("cloud_id", "point_id", "x", "y", "z")


@query("p2_rescale_plan", sql("voxels images", "SELECT image_id, pixel_size / 4 AS scale, trunc(nz * pixel_size / 4)::INT AS new_nz, trunc(ny * pixel_size / 4)::INT AS new_ny, trunc(nx * pixel_size / 4)::INT AS new_nx FROM images", "image_id, new_nz, new_ny, new_nx", "scale"))
def _(s, d):
    return P.rescale_plan(A.images(s, d), 4.0)


@query("p3_threshold", sql("voxels", "SELECT image_id, z, y, x, (value >= 50000)::INT AS value FROM voxels", f"{CELL}, value"))
def _(s, d):
    return binary(s, d)


@query("p3_threshold_half_max", sql("voxels", "SELECT image_id, z, y, x, (value > max(value) OVER (PARTITION BY image_id) / 2)::INT AS value FROM voxels", f"{CELL}, value"))
def _(s, d):
    return P.threshold_half_max(A.voxels(s, d))


@query("p4_drop_singletons", sql("points", "SELECT * FROM points QUALIFY count(*) OVER (PARTITION BY cloud_id, seg_id) > 1", "cloud_id, seg_id, point_id"))
def _(s, d):
    return P.drop_singletons(A.points(s, d)).select("cloud_id", "seg_id", "point_id")


@query("p5_ensure_3d", sql("points", "SELECT point_id, x, y, 0.0 AS z FROM points", "point_id", XYZ))
def _(s, d):
    return P.ensure_3d(A.points(s, d).drop("z")).select("point_id", "x", "y", "z")


@query("p6_clear_border", sql("voxels images", "SELECT image_id, z, y, x, CASE WHEN y >= 1 AND y < ny - 1 AND x >= 1 AND x < nx - 1 THEN value ELSE 0 END AS value FROM voxels JOIN images USING (image_id)", CELL, "value"))
def _(s, d):
    return P.clear_border(*both(s, d))


@query("p7_trim_to_points", sql("voxels", "SELECT image_id, z - zl AS z, y - yl AS y, x - xl AS x, value FROM voxels JOIN box USING (image_id) WHERE z >= zl AND z < zh AND y >= yl AND y < yh AND x >= xl AND x < xh", CELL, "value", "box AS (SELECT image_id, min(z) AS zl, max(z) AS zh, min(y) AS yl, max(y) AS yh, min(x) AS xl, max(x) AS xh FROM voxels WHERE value > 90000 GROUP BY 1)"))
def _(s, d):
    v = A.voxels(s, d)
    return P.trim_to_points(v, v.where("value > 90000"))


@query("p8_center_crop", sql("voxels", "SELECT image_id, z - 1 AS z, y - 9 AS y, x - 16 AS x, value FROM voxels WHERE z BETWEEN 1 AND 4 AND y BETWEEN 9 AND 40 AND x BETWEEN 16 AND 47", CELL, "value"))
def _(s, d):
    return P.center_crop(*both(s, d), (4, 32, 32))


@query("p9_align_common_extent", sql("voxels", "SELECT v.* FROM voxels v JOIN e ON v.image_id = e.image_id AND v.z < e.z AND v.y < e.y AND v.x < e.x", CELL, "value", "e AS (SELECT a.image_id, least(a.z, b.z) + 1 AS z, least(a.y, b.y) + 1 AS y, least(a.x, b.x) + 1 AS x FROM (SELECT image_id, max(z) AS z, max(y) AS y, max(x) AS x FROM voxels GROUP BY 1) a JOIN (SELECT image_id, max(z) AS z, max(y) AS y, max(x) AS x FROM voxels WHERE value < 20000 AND z < 5 GROUP BY 1) b USING (image_id))"))
def _(s, d):
    v = A.voxels(s, d)
    return P.align_common_extent(v, v.where("value < 20000 and z < 5"))[0]


@query("p10_binary_check", sql("voxels", "SELECT image_id, min(value) AS low, max(value) AS high, CASE WHEN count(DISTINCT value) = 1 THEN 'single' WHEN count(DISTINCT value) = 2 THEN 'binary' ELSE 'error' END AS state FROM (SELECT image_id, CASE WHEN image_id < 3 THEN (value >= 50000)::INT WHEN image_id = 3 THEN 1 ELSE value END AS value FROM voxels) GROUP BY 1", "image_id, state", "low high"))
def _(s, d):
    v = A.voxels(s, d)
    return P.binary_check(v.withColumn("value", F.when(F.col("image_id") < 3, (F.col("value") >= 50000).cast("double")).when(F.col("image_id") == 3, 1.0).otherwise(F.col("value"))))


@query("p11_mask_from_label", sql("voxels", "SELECT image_id, z, y, x, ((value / 10000)::INT IN (2, 5))::INT AS value FROM (SELECT * REPLACE (floor(value / 10000) * 10000 AS value) FROM voxels)", f"{CELL}, value"))
def _(s, d):
    v = A.voxels(s, d)
    return P.mask_from_label(v.withColumn("value", F.floor(F.col("value") / 10000)), [2, 5])


@query("p12_flip", sql("voxels", "SELECT image_id, z, 50 - y AS y, x, value FROM voxels", CELL, "value"))
def _(s, d):
    return P.flip(*both(s, d), "y")


def digest_sql(*parts: str) -> str:
    """The number that operators draw by."""
    return f"('0x' || substr(md5({" || ':' || ".join(f"({p})::VARCHAR" for p in parts)}), 1, 15))::BIGINT"


@query("p12_random_flip", sql("voxels images", "SELECT image_id, CASE WHEN s <= 3 THEN nz - 1 - z ELSE z END AS z, CASE WHEN s BETWEEN 4 AND 6 THEN ny - 1 - y ELSE y END AS y, CASE WHEN s >= 7 THEN nx - 1 - x ELSE x END AS x, value FROM (SELECT *, " + digest_sql("image_id", "0") + " % 10 AS s FROM voxels JOIN images USING (image_id))", CELL, "value"))
def _(s, d):
    return P.random_flip(*both(s, d))


@query("p13_rot90", sql("voxels", "SELECT image_id, z, 63 - x AS y, y AS x, value FROM voxels", CELL, "value"))
def _(s, d):
    return P.rot90(*both(s, d), 1)


def draw_sql(i: object, what: str, below: int) -> str:
    return f"(('0x' || substr(md5(image_id::VARCHAR || ':7:{i}:{what}'), 1, 8))::BIGINT % {below})"


def moved_sql(i: int) -> str:
    """One drawn transform after the other, on the coordinates that the ones before it gave."""
    quarter = f"CASE WHEN {draw_sql(i, 'turns', 9)} <= 3 THEN 0 WHEN {draw_sql(i, 'turns', 9)} <= 6 THEN CASE WHEN {draw_sql(i, 'way', 10)} > 3 THEN 3 ELSE 1 END ELSE 2 END"
    flip = f"CASE WHEN {draw_sql(i, 'flip', 10)} <= 3 THEN 'z' WHEN {draw_sql(i, 'flip', 10)} <= 6 THEN 'y' ELSE 'x' END"
    op = f"CASE WHEN {draw_sql(0, 'draws', 3)} + 1 < {i} THEN '0' WHEN {draw_sql(i, 'which', 2)} = 0 THEN {flip} ELSE ({quarter})::VARCHAR END"
    y = "CASE op WHEN 'y' THEN ny - 1 - y WHEN '1' THEN nx - 1 - x WHEN '2' THEN ny - 1 - y WHEN '3' THEN x ELSE y END"
    x = "CASE op WHEN 'x' THEN nx - 1 - x WHEN '1' THEN y WHEN '2' THEN nx - 1 - x WHEN '3' THEN ny - 1 - y ELSE x END"
    side = lambda a, b: f"CASE WHEN op IN ('1', '3') THEN {b} ELSE {a} END"
    return f"s{i} AS (SELECT image_id, CASE WHEN op = 'z' THEN nz - 1 - z ELSE z END AS z, {y} AS y, {x} AS x, value, mask, nz, {side('ny', 'nx')} AS ny, {side('nx', 'ny')} AS nx FROM (SELECT *, {op} AS op FROM s{i - 1}))"


#: Image and mask of all voxels, as the steps move them.
DRAWN = "s0 AS (SELECT image_id, z, y, x, value, (value >= 50000)::INT AS mask, nz, ny, nx FROM voxels JOIN images USING (image_id)), " + ", ".join(map(moved_sql, (1, 2, 3)))


@query("p13_drawn_transforms", sql("voxels images", "SELECT * FROM s3", f"{CELL}, mask", "value", DRAWN))
def _(s, d):
    v, i = both(s, d)
    return P.apply_transforms(v.withColumn("mask", (F.col("value") >= 50000).cast("int")), P.transform_plan(i, 7))


@query("p14_rotation_average", sql("voxels", "SELECT * FROM voxels", CELL, "value"))
def _(s, d):
    v, i = both(s, d)
    turned = [P.rot90(v, i, k).withColumn("k", F.lit(k)) for k in range(4)]
    return P.rotation_average(turned[0].union(turned[1]).union(turned[2]).union(turned[3]), i)


@query("p15_sigmoid", sql("voxels", "SELECT image_id, z, y, x, 1 / (1 + exp(-(value / 50000 - 1))) AS value FROM voxels", CELL, "value"))
def _(s, d):
    return P.sigmoid(A.voxels(s, d).withColumn("value", F.col("value") / 50000 - 1))


@query("p16_crop_around_points", sql("voxels images", "SELECT p.image_id, p.point_id, v.z - p.z0 AS dz, v.y - p.y0 AS dy, v.x - p.x0 AS dx, v.value FROM p JOIN voxels v ON v.image_id = p.image_id AND v.z >= p.z0 AND v.z < p.z0 + 4 AND v.y >= p.y0 AND v.y < p.y0 + 4 AND v.x >= p.x0 AND v.x < p.x0 + 4", "image_id, point_id, dz, dy, dx", "value", f"{TRACKS}, p AS (SELECT cloud_id AS image_id, point_id, greatest(least(z::INT - 2, 3), 0) AS z0, greatest(least(y::INT - 2, 47), 0) AS y0, greatest(least(x::INT - 2, 60), 0) AS x0 FROM tracks)"))
def _(s, d):
    v, i = both(s, d)
    return P.crop_around_points(v, tracks(s, d).withColumnRenamed("cloud_id", "image_id"), i, 4)


@query("p17_prepare_tile", sql("voxels", "SELECT image_id, z, y - 23 AS y, x - 30 AS x, value, (value >= 50000)::INT AS mask, channel FROM voxels, (VALUES (0), (1)) c(channel) WHERE z BETWEEN 1 AND 4 AND y BETWEEN 23 AND 26 AND x BETWEEN 30 AND 33", "image_id, z - 1 AS z, y, x, mask, channel", "value"))
def _(s, d):
    v, i = both(s, d)
    return P.prepare_tile(v, binary(s, d), i, 4, channels=2)


# 2.3 normalisation -------------------------------------------------------------------------


@query("n1_norm_dtype", sql("voxels images", "SELECT image_id, z, y, x, CASE dtype WHEN 'uint8' THEN value / 255 WHEN 'int8' THEN (value + 128) / 255 WHEN 'uint16' THEN value / 65535 ELSE value END AS value FROM voxels JOIN images USING (image_id)", CELL, "value"))
def _(s, d):
    return N.norm_dtype(*both(s, d))


@query("n2_norm_minmax", sql("voxels", "SELECT image_id, z, y, x, (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) AS value FROM voxels WINDOW w AS (PARTITION BY image_id)", CELL, "value"))
def _(s, d):
    return N.norm_minmax(A.voxels(s, d))


@query("n3_norm_meanstd", sql("voxels", "SELECT image_id, z, y, x, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS value FROM voxels WINDOW w AS (PARTITION BY image_id)", CELL, "value"))
def _(s, d):
    return N.norm_meanstd(A.voxels(s, d))


@query("n4_norm_percentile", sql("voxels", "SELECT image_id, z, y, x, (greatest(least(value, hi), lo) - lo) / (hi - lo) AS value FROM voxels JOIN (SELECT image_id, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM voxels GROUP BY 1) USING (image_id)", CELL, "value"))
def _(s, d):
    return N.norm_percentile(cut(A.voxels(s, d), "voxels"))


@query("n4_norm_percentile_dtype", sql("voxels images", "SELECT image_id, z, y, x, CASE WHEN dtype = 'float32' THEN scaled ELSE trunc(scaled) END AS value FROM (SELECT *, CASE WHEN lo = hi THEN greatest(least(value, most), 0) ELSE (greatest(least(value, hi), lo) - lo) / (hi - lo) * most END AS scaled FROM (SELECT *, CASE dtype WHEN 'uint8' THEN 255 WHEN 'int8' THEN 127 WHEN 'uint16' THEN 65535 ELSE 1 END AS most FROM whole) JOIN (SELECT image_id, CASE WHEN any_value(dtype) = 'uint8' AND quantile_cont(value, 0.01) <= 5 THEN 0.0 ELSE quantile_cont(value, 0.01) END AS lo, CASE WHEN any_value(dtype) = 'uint8' AND quantile_cont(value, 0.99) >= 250 THEN 256.0 ELSE quantile_cont(value, 0.99) END AS hi FROM whole GROUP BY 1) USING (image_id))", CELL, "value", "whole AS (SELECT image_id, z, y, x, floor(value / 400) AS value, dtype FROM voxels JOIN images USING (image_id))"))
def _(s, d):
    v = cut(A.voxels(s, d).withColumn("value", F.floor(F.col("value") / 400).cast("double")), "voxels")
    return N.norm_percentile(v, images=A.images(s, d))


@query("n5_normalize_image", sql("voxels", "SELECT image_id, z, y, x, 2 * (greatest(least(value, hi), lo) - lo) / (hi - lo) - 1 AS value FROM m JOIN (SELECT image_id, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM m GROUP BY 1) USING (image_id)", CELL, "value", "m AS (SELECT image_id, z, y, x, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS value FROM voxels WINDOW w AS (PARTITION BY image_id))"))
def _(s, d):
    return N.normalize_image(A.voxels(s, d))


@query("n6_adaptive_threshold", sql("voxels", "SELECT image_id, z, y, x, (value * 1e-4 >= avg(value) OVER w / stddev_pop(value) OVER w)::INT AS value FROM voxels WINDOW w AS (PARTITION BY image_id, z)", f"{CELL}, value"))
def _(s, d):
    return N.adaptive_threshold(A.voxels(s, d).withColumn("value", F.col("value") * 1e-4))


@query("n7_rank_channels_by_snr", sql("voxels", "SELECT image_id, z, snr, row_number() OVER (PARTITION BY image_id ORDER BY snr DESC, z) AS rank FROM (SELECT image_id, z, avg(value) / stddev_pop(value) AS snr FROM voxels GROUP BY ALL)", "image_id, z, rank", "snr"))
def _(s, d):
    return N.rank_channels_by_snr(A.voxels(s, d))


@query("n8_image_stats", sql("voxels", "SELECT image_id, min(value) AS low, max(value) AS high, avg(value) AS mean, stddev_pop(value) AS std, count(*) FILTER (value > 0) AS foreground FROM voxels GROUP BY 1", "image_id, foreground", "low high mean std"))
def _(s, d):
    return N.image_stats(A.voxels(s, d))


@query("n9_z_projection", sql("voxels", "SELECT image_id, y, x, sum(value) AS value FROM voxels GROUP BY ALL", "image_id, y, x", "value"))
def _(s, d):
    return N.z_projection(A.voxels(s, d))


@query("n9_busiest_slice", sql("voxels", "SELECT image_id, z, n FROM (SELECT image_id, z, count(*) FILTER (value > 50000) AS n FROM voxels GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, z) = 1", "image_id, z, n"))
def _(s, d):
    return N.busiest_slice(*both(s, d), 50000)


# 2.4 tiles ---------------------------------------------------------------------------------

PLAN = "plan AS (SELECT image_id, tz::INT AS tz, ty::INT AS ty, tx::INT AS tx, tz * 4 AS z0, ty * 12 AS y0, tx * 12 AS x0 FROM images, range(2) a(tz), range(4) b(ty), range(5) c(tx))"
TV = PLAN + ", tv AS (SELECT p.image_id, tz, ty, tx, z, y, x, z - z0 AS lz, y - y0 AS ly, x - x0 AS lx, value FROM voxels v JOIN plan p ON v.image_id = p.image_id AND z >= z0 AND z < z0 + 4 AND y >= y0 AND y < y0 + 16 AND x >= x0 AND x < x0 + 16)"
TILE = "image_id, tz, ty, tx"


def tiled(s: SparkSession, d: str) -> DataFrame:
    return T.assign_tiles(*both(s, d), 16, 4, 4)


@query("t1_tile_plan", sql("voxels images", "SELECT * FROM plan", f"{TILE}, z0, y0, x0", "", PLAN))
def _(s, d):
    return T.tile_plan(A.images(s, d), 16, 4, 4)


@query("t2_assign_tiles", sql("voxels images", "SELECT * FROM tv", f"{TILE}, z, y, x, lz, ly, lx", "value", TV))
def _(s, d):
    return tiled(s, d)


@query("t3_drop_empty_tiles", sql("voxels images", f"SELECT * FROM tv QUALIFY sum((value >= 90000)::INT) OVER (PARTITION BY {TILE}) > 2", f"{TILE}, z, y, x", "value", TV))
def _(s, d):
    t = tiled(s, d)
    return T.drop_empty_tiles(t, P.threshold(t, 90000.0), 2).drop("lz", "ly", "lx")


@query("t4_tile_counts", sql("voxels images", f"SELECT image_id, count(*) AS total, count(*) FILTER (s > 2) AS kept FROM (SELECT {TILE}, sum((value >= 90000)::INT) AS s FROM tv GROUP BY ALL) GROUP BY 1", "image_id, total, kept", "", TV))
def _(s, d):
    return T.tile_counts(P.threshold(tiled(s, d), 90000.0), 2)


@query("t5_stitch_mean", sql("voxels", "SELECT * FROM voxels", CELL, "value"))
def _(s, d):
    return T.stitch_mean(tiled(s, d))


@query("t6_stitch_mask", sql("voxels", "SELECT image_id, z, y, x, (value >= 50000)::INT AS value FROM voxels", f"{CELL}, value"))
def _(s, d):
    return T.stitch_mask(P.threshold(tiled(s, d), 50000.0))


@query("t7_stack_by_image", sql("voxels images", "SELECT image_id, tz, count(*) AS n, avg(value) AS mean FROM tv GROUP BY ALL", "image_id, tz, n", "mean", TV))
def _(s, d):
    return tiled(s, d).groupBy("image_id", "tz").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


@query("t8_resample_nearest", sql("voxels images", "SELECT g.image_id, g.z, g.y, g.x, v.value FROM (SELECT image_id, z::INT AS z, y::INT AS y, x::INT AS x FROM images, range(4) a(z), range(30) b(y), range(100) c(x)) g JOIN voxels v ON v.image_id = g.image_id AND v.z = g.z * 7 // 4 AND v.y = g.y * 51 // 30 AND v.x = g.x * 64 // 100", CELL, "value"))
def _(s, d):
    return T.resample_nearest(*both(s, d), (4, 30, 100))


@query("t9_resample_area", sql("voxels images", "SELECT g.image_id, g.z, g.y, g.x, avg(v.value) AS value FROM (SELECT image_id, z::INT AS z, y::INT AS y, x::INT AS x FROM images, range(3) a(z), range(20) b(y), range(24) c(x)) g JOIN voxels v ON v.image_id = g.image_id AND v.z >= g.z * 7 // 3 AND v.z < ceil((g.z + 1) * 7 / 3) AND v.y >= g.y * 51 // 20 AND v.y < ceil((g.y + 1) * 51 / 20) AND v.x >= g.x * 64 // 24 AND v.x < ceil((g.x + 1) * 64 / 24) GROUP BY ALL", CELL, "value"))
def _(s, d):
    return T.resample_area(*both(s, d), (3, 20, 24))


@query("t10_resample_linear", sql("voxels images", "SELECT image_id, z, y, x, sum(wz * wy * wx * value) AS value FROM (SELECT DISTINCT image_id FROM voxels) i, az, ay, ax JOIN voxels v ON v.image_id = i.image_id AND v.z = iz AND v.y = iy AND v.x = ix GROUP BY ALL".replace("FROM (SELECT DISTINCT image_id FROM voxels) i, az, ay, ax JOIN voxels v ON v.image_id = i.image_id AND v.z = iz AND v.y = iy AND v.x = ix", "FROM (SELECT image_id AS im, z AS sz, y AS sy, x AS sx, value FROM voxels) v JOIN az ON sz = iz JOIN ay ON sy = iy JOIN ax ON sx = ix").replace("SELECT image_id, z", "SELECT im AS image_id, z"), CELL, "value", ", ".join(f"a{c} AS (SELECT {c}, i{c}, sum(w{c}) AS w{c} FROM (SELECT {c}, unnest([least(floor(p), {n} - 1)::INT, least(floor(p) + 1, {n} - 1)::INT]) AS i{c}, unnest([1 - (p - floor(p)), p - floor(p)]) AS w{c} FROM (SELECT g::INT AS {c}, greatest((g + 0.5::DOUBLE) * {n} / {m} - 0.5::DOUBLE, 0) AS p FROM range({m}) r(g))) WHERE w{c} > 0 GROUP BY ALL)" for c, n, m in (("z", 7, 3), ("y", 51, 20), ("x", 64, 30)))))
def _(s, d):
    return T.resample_linear(*both(s, d), (3, 20, 30))


def stencil_sql(src: str, rule: str, agg: str) -> str:
    return f"SELECT a.image_id, a.z, a.y, a.x, {agg}(b.value) AS value FROM {src} a JOIN {src} b ON a.image_id = b.image_id AND {rule} GROUP BY ALL"


ERODE = stencil_sql("voxels", "abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) <= 1", "min")
DILATE = "SELECT image_id, z, y, x, max(value) AS value FROM (SELECT image_id, z + dz AS z, y + dy AS y, x + dx AS x, value FROM {0}, (VALUES (-1), (0), (1)) a(dz), (VALUES (-1), (0), (1)) b(dy), (VALUES (-1), (0), (1)) c(dx)) WHERE z BETWEEN 0 AND 6 AND y BETWEEN 0 AND 50 AND x BETWEEN 0 AND 63 GROUP BY ALL"


@query("t11_erode", sql("voxels", ERODE, CELL, "value"))
def _(s, d):
    return T.erode(*both(s, d))


@query("t11_dilate", sql("voxels", DILATE.format("voxels"), CELL, "value"))
def _(s, d):
    return T.dilate(*both(s, d))


@query("t11_opening", sql("voxels", DILATE.format("er"), CELL, "value", f"er AS ({ERODE})"))
def _(s, d):
    return T.opening(*both(s, d))


def eroded_sql(src: str) -> str:
    cross = "(VALUES (0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) o(dz, dy, dx)"
    return f"SELECT a.* FROM (SELECT image_id, z + dz AS z, y + dy AS y, x + dx AS x, min(value) AS value FROM {src}, {cross} GROUP BY ALL) a SEMI JOIN {src} b ON a.image_id = b.image_id AND a.z = b.z AND a.y = b.y AND a.x = b.x"


def skeleton_sql(src: str, iters: int, name: str) -> str:
    """CTEs of the images eroded once to ``iters`` times, what openings leave of them, and the skeleton so far."""
    out = []
    for i in range(iters + 1):
        x = src if i == 0 else f"{name}x{i}"
        if i:
            out.append(f"{x} AS ({eroded_sql(src if i == 1 else f'{name}x{i - 1}')})")
        out += [f"{name}e{i} AS ({eroded_sql(x)})", f"{name}o{i} AS ({DILATE.format(f'{name}e{i}')})"]
        out.append(f"{name}d{i} AS (SELECT x.image_id, x.z, x.y, x.x, greatest(x.value - coalesce(o.value, 0), 0.0) AS value FROM {x} x LEFT JOIN {name}o{i} o ON o.image_id = x.image_id AND o.z = x.z AND o.y = x.y AND o.x = x.x)")
        out.append(f"{name}s{i} AS (" + (f"SELECT * FROM {name}d0" if i == 0 else f"SELECT s.image_id, s.z, s.y, s.x, s.value + greatest(d.value - s.value * d.value, 0.0) AS value FROM {name}s{i - 1} s JOIN {name}d{i} d ON s.image_id = d.image_id AND s.z = d.z AND s.y = d.y AND s.x = d.x") + ")")
    return ", ".join(out)


@query("t12_soft_skeleton", sql("voxels", "SELECT * FROM ks2", CELL, "value", "im AS (SELECT image_id, z, y, x, value / 131072 AS value FROM voxels), " + skeleton_sql("im", 2, "k")))
def _(s, d):
    v, i = both(s, d)
    return T.soft_skeleton(v.withColumn("value", F.col("value") / 131072), i, 2)


# 2.5 raster --------------------------------------------------------------------------------


@query("r1_interpolate_polyline", sql("", "SELECT cloud_id, seg_id, ord, unnest(range(greatest(coalesce(greatest(abs(dx), abs(dy), abs(dz)), 1), 1))) AS k, * EXCLUDE (cloud_id, seg_id, ord) FROM w", "cloud_id, seg_id, ord, k::INT AS k, " + ", ".join(f"({c} + sign(coalesce(d{c}, 0)) * ((2 * k * abs(coalesce(d{c}, 0)) + n) // (2 * n)))::INT AS {c}" for c in "xyz"), "", TRACKS + ", w AS (SELECT *, greatest(coalesce(greatest(abs(dx), abs(dy), abs(dz)), 1), 1) AS n FROM (SELECT cloud_id, seg_id, ord, x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, lead(x::BIGINT) OVER v - x::BIGINT AS dx, lead(y::BIGINT) OVER v - y::BIGINT AS dy, lead(z::BIGINT) OVER v - z::BIGINT AS dz FROM tracks WINDOW v AS (PARTITION BY cloud_id, seg_id ORDER BY ord)))"))
def _(s, d):
    return R.interpolate_polyline(tracks(s, d))


BALL = "ball AS (SELECT z AS dz, y AS dy, x AS dx FROM range(-2, 3) a(z), range(-2, 3) b(y), range(-2, 3) c(x) WHERE z * z + y * y + x * x <= 4 AND abs(z) <= 1)"
FRAME = "z BETWEEN 0 AND 6 AND y BETWEEN 0 AND 50 AND x BETWEEN 0 AND 63"


@query("r2_ball_offsets", sql("", "SELECT cloud_id, z + dz AS z, y + dy AS y, x + dx AS x, count(*) AS n FROM tracks, ball WHERE z + dz >= 0 AND y + dy >= 0 AND x + dx >= 0 GROUP BY ALL", "cloud_id, z::INT AS z, y::INT AS y, x::INT AS x, n", "", f"{TRACKS}, {BALL}"))
def _(s, d):
    cells = tracks(s, d).select("cloud_id", *[F.col(c).cast("int").alias(c) for c in "zyx"])
    return R.stamp(cells, R.ball_offsets(s, 2), (1000, 1000, 1000)).groupBy("cloud_id", "z", "y", "x").agg(F.count(F.lit(1)).alias("n"))


@query("r3_draw_instances", f"WITH drawn AS ({SQL['r1_interpolate_polyline']}), {BALL} SELECT cloud_id, z + dz AS z, y + dy AS y, x + dx AS x, max(seg_id) + 1 AS value FROM drawn, ball WHERE z + dz BETWEEN 0 AND 6 AND y + dy BETWEEN 0 AND 50 AND x + dx BETWEEN 0 AND 63 GROUP BY ALL")
def _(s, d):
    return R.draw_instances(tracks(s, d), (7, 51, 64), 1.0, 4.0)


@query("r4_draw_points_mask", sql("", f"SELECT DISTINCT cloud_id, (z + dz)::INT AS z, (y + dy)::INT AS y, (x + dx)::INT AS x, 1 AS value FROM tracks, ball WHERE z + dz BETWEEN 0 AND 6 AND y + dy BETWEEN 0 AND 50 AND x + dx BETWEEN 0 AND 63", "cloud_id, z, y, x, value", "", f"{TRACKS}, {BALL}"))
def _(s, d):
    return R.draw_points_mask(tracks(s, d), (7, 51, 64), 1.0, 4.0)


@query("r5_draw_semantic", sql("", f"SELECT DISTINCT cloud_id, (z + dz)::INT AS z, (y + dy)::INT AS y, (x + dx)::INT AS x, 1 AS value FROM tracks, ball WHERE z + dz BETWEEN 0 AND 6 AND y + dy BETWEEN 0 AND 50 AND x + dx BETWEEN 0 AND 63", "cloud_id, z, y, x, value", "", f"{TRACKS}, {BALL}"))
def _(s, d):
    return R.draw_semantic(tracks(s, d), (7, 51, 64), 1.0, 4.0)


@query("r6_draw_instances_membrane", sql("", f"SELECT cloud_id, (z + dz)::INT AS z, (y + dy)::INT AS y, (x + dx)::INT AS x, arg_max(seg_id, point_id) AS value FROM tracks, ball WHERE z + dz BETWEEN 0 AND 6 AND y + dy BETWEEN 0 AND 50 AND x + dx BETWEEN 0 AND 63 GROUP BY ALL", "cloud_id, z, y, x, value", "", f"{TRACKS}, {BALL}"))
def _(s, d):
    return R.draw_instances_membrane(tracks(s, d), (7, 51, 64), 1.0, 4.0)


@query("r7_project_to_voxels", sql("points", "SELECT cloud_id, floor(z / 10)::INT AS z, floor(y / 10)::INT AS y, floor(x / 10)::INT AS x, max(seg_id) AS value FROM points GROUP BY ALL", "cloud_id, z, y, x, value"))
def _(s, d):
    return R.project_to_voxels(A.points(s, d), "seg_id", 10.0)


# 2.6 clouds --------------------------------------------------------------------------------

CENT = "cent AS (SELECT cloud_id, floor(x / 0.1) AS gx, floor(y / 0.1) AS gy, floor(z / 0.1) AS gz, avg(x) AS x, avg(y) AS y, avg(z) AS z, min(point_id) AS point_id FROM cloud3 GROUP BY cloud_id, gx, gy, gz)"


def near_sql(a: str, b: str, k: int, extra: str = "", cond: str = "") -> str:
    return f"near AS (SELECT * FROM (SELECT a.cloud_id, a.point_id AS src, b.point_id AS dst, b.seg_id AS t_seg_id, b.x AS t_x, b.y AS t_y, b.z AS t_z{extra}, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS dist FROM {a} a JOIN {b} b USING (cloud_id) {cond}) QUALIFY row_number() OVER (PARTITION BY cloud_id, src ORDER BY dist, dst) <= {k})"


@query("c1_foreground_points", sql("voxels", "SELECT image_id, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM voxels WHERE value >= 50000", "image_id", XYZ))
def _(s, d):
    return C.foreground_points(binary(s, d))


@query("c2_voxel_downsample", sql("points", "SELECT cloud_id, floor(x / 50)::BIGINT AS gx, floor(y / 50)::BIGINT AS gy, floor(z / 50)::BIGINT AS gz, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n, min(point_id) AS point_id FROM points GROUP BY cloud_id, gx, gy, gz", "cloud_id, gx, gy, gz, n, point_id", XYZ))
def _(s, d):
    return C.voxel_downsample(A.points(s, d), 50.0)


@query("c3_downsample_labels", sql("cloud3", "SELECT c.cloud_id, c.x, c.y, c.z, t_seg_id AS seg_id FROM cent c JOIN near n ON c.point_id = n.src", "cloud_id, seg_id", XYZ, f"{CENT}, {near_sql('cent', 'cloud3', 1)}"))
def _(s, d):
    return C.downsample_labels(A.cloud3(s, d), 0.1).drop("gx", "gy", "gz")


@query("c4_downsample_medoid", sql("cloud3", "SELECT cloud_id, dst AS point_id, t_seg_id AS seg_id, t_x AS x, t_y AS y, t_z AS z FROM near", "cloud_id, point_id, seg_id", XYZ, f"{CENT}, {near_sql('cent', 'cloud3', 1)}"))
def _(s, d):
    return C.downsample_medoid(A.cloud3(s, d), 0.1)


@query("c5_downsample_rgb", sql("cloud3", "SELECT c.cloud_id, c.x, c.y, c.z, n.dst % 251 AS r, n.dst % 7 AS g, n.dst % 3 AS b FROM cent c JOIN near n ON c.point_id = n.src", "cloud_id, r, g, b", XYZ, f"{CENT}, {near_sql('cent', 'cloud3', 1)}"))
def _(s, d):
    return C.downsample_rgb(A.cloud3(s, d).withColumns({c: F.col("point_id") % n for c, n in (("r", 251), ("g", 7), ("b", 3))}), 0.1)


@query("c6_random_downsample", sql("points", "SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY cloud_id ORDER BY " + digest_sql("point_id", "0") + ", point_id) <= floor(count(*) OVER (PARTITION BY cloud_id) * 0.3::DOUBLE)", "cloud_id, seg_id, point_id, ord", "x y z"))
def _(s, d):
    return C.random_downsample(A.points(s, d), 0.3)


@query("c7_downsample_each", sql("points", "SELECT cloud_id, seg_id, floor(x / 50)::BIGINT AS gx, floor(y / 50)::BIGINT AS gy, floor(z / 50)::BIGINT AS gz, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n, min(point_id) AS point_id FROM points GROUP BY cloud_id, seg_id, gx, gy, gz", "cloud_id, seg_id, gx, gy, gz, n, point_id", XYZ))
def _(s, d):
    return C.voxel_downsample(A.points(s, d), 50.0, ["cloud_id", "seg_id"])


BOX = "box AS (SELECT cloud_id, " + ", ".join(f"min({c}) - (max({c}) - min({c})) / 2 * 0.1 AS lo_{c}, max({c}) + (max({c}) - min({c})) / 2 * 0.1 AS hi_{c}" for c in "xyz") + " FROM points GROUP BY 1)"
NUM = BOX + ", num AS (SELECT *, greatest(ceil((hi_x - lo_x) / 100), 2)::INT AS n_x, greatest(ceil((hi_y - lo_y) / 100), 2)::INT AS n_y, greatest(floor(greatest(ceil((hi_z - lo_z) / 100), 2) / 2), 2)::INT AS n_z FROM box)"
GRIDS = NUM + ", grid AS (SELECT cloud_id, ((ix * n_y + iy) * n_z + iz)::INT AS patch_id, lo_x + ix * (hi_x - lo_x) / (n_x - 1) AS c_x, lo_y + iy * (hi_y - lo_y) / (n_y - 1) AS c_y, lo_z + iz * (hi_z - lo_z) / (n_z - 1) AS c_z, (hi_x - lo_x) / (n_x - 1) AS sx, (hi_y - lo_y) / (n_y - 1) AS sy, (hi_z - lo_z) / (n_z - 1) AS sz FROM num, range(100) a(ix), range(100) b(iy), range(100) c(iz) WHERE ix < n_x AND iy < n_y AND iz < n_z)"


@query("c8_bounding_box", sql("points", "SELECT * FROM box", "cloud_id", "lo_x lo_y lo_z hi_x hi_y hi_z", BOX))
def _(s, d):
    return C.bounding_box(A.points(s, d))


@query("c9_patch_grid", sql("points", "SELECT * FROM grid", "cloud_id, patch_id", "c_x c_y c_z", GRIDS))
def _(s, d):
    return C.patch_grid(C.bounding_box(A.points(s, d)), 100.0)


@query("c10_points_in_patches", sql("points", "SELECT g.cloud_id, g.patch_id, p.point_id FROM points p JOIN grid g ON p.cloud_id = g.cloud_id AND abs(p.x - c_x) <= sx * (0.575::DOUBLE + 1e-9) AND abs(p.y - c_y) <= sy * (0.575::DOUBLE + 1e-9) AND abs(p.z - c_z) <= sz * (0.575::DOUBLE + 1e-9)", "cloud_id, patch_id, point_id", "", GRIDS))
def _(s, d):
    p = A.points(s, d)
    return C.points_in_patches(p, C.bounding_box(p), 100.0, 0.15)


IN_PATCHES = "inp AS (SELECT g.cloud_id, g.patch_id, p.point_id FROM points p JOIN grid g ON p.cloud_id = g.cloud_id AND abs(p.x - c_x) <= sx * (0.575::DOUBLE + 1e-9) AND abs(p.y - c_y) <= sy * (0.575::DOUBLE + 1e-9) AND abs(p.z - c_z) <= sz * (0.575::DOUBLE + 1e-9))"
#: First-fit as a walk along the patches of a cloud: ``full`` is what the group of the patch has so far.
FIRST_FIT = "cnt AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY patch_id) AS i FROM (SELECT cloud_id, patch_id, count(*) AS n FROM inp GROUP BY ALL)), reach(cloud_id, i, grp, filled) AS (SELECT cloud_id, i, 0, n FROM cnt WHERE i = 1 UNION ALL SELECT c.cloud_id, c.i, CASE WHEN filled + n > 500 THEN grp + 1 ELSE grp END, CASE WHEN filled + n > 500 THEN n ELSE filled + n END FROM reach r JOIN cnt c ON c.cloud_id = r.cloud_id AND c.i = r.i + 1)"


@query("c12_merge_small_patches", sql("points", "SELECT DISTINCT i.cloud_id, r.grp AS patch_id, point_id FROM inp i JOIN cnt c USING (cloud_id, patch_id) JOIN reach r ON r.cloud_id = c.cloud_id AND r.i = c.i", "cloud_id, patch_id, point_id", "", f"{GRIDS}, {IN_PATCHES}, {FIRST_FIT}"))
def _(s, d):
    p = A.points(s, d)
    return C.merge_small_patches(C.points_in_patches(p, C.bounding_box(p), 100.0), 500)


@query("c13_random_patches")
def _(s, d):
    return C.random_patches(A.cloud3(s, d), 100)


@query("c21_load_labelled_dataset")
def _(s, d):
    return G.load_labelled_dataset(A.cloud3(s, d), "part", max_points=100)["edges"]


#: Clouds of up to 500 points are one patch; of the others first-fit groups of boxes.
BUILT = f"{GRIDS}, {IN_PATCHES}, {FIRST_FIT}, nn AS (SELECT cloud_id, count(*) AS n FROM points GROUP BY 1), bp AS (SELECT cloud_id, 0 AS patch_id, point_id FROM points JOIN nn USING (cloud_id) WHERE n <= 500 UNION SELECT i.cloud_id, r.grp, point_id FROM inp i JOIN cnt c USING (cloud_id, patch_id) JOIN reach r ON r.cloud_id = c.cloud_id AND r.i = c.i JOIN nn ON nn.cloud_id = i.cloud_id WHERE nn.n > 500)"


def boxes_sql(c: str, src: str) -> str:
    """Rows of ``src`` once for each box along an axis that holds the point."""
    return f"i{c} AS (SELECT *, unnest(generate_series(greatest(ceil(at_{c} - 0.575 - 1e-9), 0)::INT, least(floor(at_{c} + 0.575 + 1e-9), n_{c} - 1)::INT)) AS i_{c} FROM {src})"


#: The largest of a row of sizes at which no box has more than 500 points: a tenth of the x extent less a step until the step is reached, then a quarter of the last again and again; one of a 64th of the step or less is taken as it is.
SIZES = (
    BOX.replace("box AS", "bx AS")
    + ", s0 AS (SELECT max(hi_x - lo_x) / 10 AS start, greatest(max(hi_y - lo_y) / 100, 1e-6) AS step FROM bx)"
    + ", ev AS (SELECT start - i * step AS size, step FROM s0, unnest(generate_series(0, ceil(start / step)::BIGINT)) r(i) WHERE start - i * step > step)"
    + ", sz AS (SELECT size FROM ev UNION ALL SELECT size FROM (SELECT coalesce((SELECT min(size) FROM ev), start * 2) / power(4, j) AS size, step, j FROM s0, range(1, 40) r(j)) WHERE j = 1 OR size * 4 > step / 64)"
    + ", nb AS (SELECT *, greatest(ceil((hi_x - lo_x) / size), 2) AS n_x, greatest(ceil((hi_y - lo_y) / size), 2) AS n_y, greatest(floor(greatest(ceil((hi_z - lo_z) / size), 2) / 2), 2) AS n_z FROM bx, sz)"
    + ", pl AS (SELECT p.cloud_id, size, n_x, n_y, n_z, " + ", ".join(f"({c} - lo_{c}) / ((hi_{c} - lo_{c}) / (n_{c} - 1)) AS at_{c}" for c in "xyz") + " FROM points p JOIN nb USING (cloud_id))"
    + f", {boxes_sql('x', 'pl')}, {boxes_sql('y', 'ix')}, {boxes_sql('z', 'iy')}"
    + ", worst AS (SELECT size, max(n) AS w FROM (SELECT size, cloud_id, i_x, i_y, i_z, count(*) AS n FROM iz GROUP BY ALL) GROUP BY 1)"
)


@query("c11_choose_patch_size", sql("points", "SELECT max(size) AS size FROM worst, s0 WHERE w <= 500 OR size <= step / 64", "", "size", SIZES))
def _(s, d):
    p = A.points(s, d)
    return s.createDataFrame([(C.choose_patch_size(p, 500),)], "size double")


@query("c14_build_patches", sql("points", "SELECT cloud_id, patch_id, point_id, row_number() OVER (PARTITION BY cloud_id, patch_id ORDER BY point_id) - 1 AS local_idx FROM bp", "cloud_id, patch_id, point_id, local_idx", "", BUILT))
def _(s, d):
    return C.build_patches(A.points(s, d), 500, size=100.0)


@query("c15_normalize_ids", sql("points", "SELECT cloud_id, point_id, dense_rank() OVER (PARTITION BY cloud_id ORDER BY seg_id) - 1 AS seg_id FROM points", "cloud_id, point_id, seg_id"))
def _(s, d):
    return C.normalize_ids(A.points(s, d), ["cloud_id"]).select("cloud_id", "point_id", "seg_id")


@query("c16_upsample_labels", sql("cloud3", "SELECT cloud_id, src AS point_id, t_seg_id AS seg_id FROM near", "cloud_id, point_id, seg_id", "", "few AS (SELECT * FROM cloud3 WHERE abs(x) > 0.05), " + near_sql("cloud3", "few", 1)))
def _(s, d):
    c = A.cloud3(s, d)
    return C.upsample_labels(c, c.where("abs(x) > 0.05")).select("cloud_id", "point_id", "seg_id")


@query("c17_scale_cloud", sql("points", "SELECT point_id, x / 20 AS x, y / 20 AS y, z / 20 AS z FROM points", "point_id", XYZ))
def _(s, d):
    return C.scale_cloud(A.points(s, d), 10.0, 2.0).select("point_id", "x", "y", "z")


@query("c18_median_nn_distance", sql("cloud3", "SELECT cloud_id, median(dist) AS median_nn FROM near GROUP BY 1", "cloud_id", "median_nn", near_sql("cloud3", "cloud3", 1, cond="WHERE a.point_id <> b.point_id")))
def _(s, d):
    return C.median_nn_distance(A.cloud3(s, d))


@query("c19_labels_from_color", sql("", "SELECT p_partkey AS point_id, dense_rank() OVER (ORDER BY r, g, b) - 1 AS seg_id FROM (SELECT p_partkey, p_size % 4 AS r, p_partkey % 3 AS g, length(p_brand) AS b FROM part)", "point_id, seg_id"))
def _(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("point_id"), (F.col("p_size") % 4).alias("r"), (F.col("p_partkey") % 3).alias("g"), F.length("p_brand").alias("b"))
    return C.labels_from_color(p).select("point_id", "seg_id")


#: Under 1000 tiles: four tiles of one image in five.
SPLIT = TV + ", tl AS (SELECT DISTINCT image_id, tz, ty, tx FROM tv), sp AS (SELECT *, CASE WHEN " + digest_sql("image_id", "0") + " % 5 = 0 AND count(*) OVER (PARTITION BY image_id) > 10 AND row_number() OVER (PARTITION BY image_id ORDER BY " + digest_sql("tz", "ty", "tx", "0") + ", tz, ty, tx) <= 4 THEN 'test' ELSE 'train' END AS split FROM tl)"


@query("c20_named_holdout", sql("voxels images", "SELECT image_id, tz, ty, tx, CASE WHEN image_id IN (2, 5) THEN 'test' ELSE split END AS split FROM sp", f"{TILE}, split", "", SPLIT))
def _(s, d):
    return C.train_test_split(tiled(s, d).select("image_id", "tz", "ty", "tx").distinct(), holdout=("2", "5"))


@query("c20_train_test_split", sql("voxels images", "SELECT * FROM sp", f"{TILE}, split", "", SPLIT))
def _(s, d):
    return C.train_test_split(tiled(s, d).select("image_id", "tz", "ty", "tx").distinct())


@query("c22_one_hot_class", sql("cloud3", "SELECT point_id, seg_id AS hot, 1.0 AS total, array_to_string([CASE WHEN i = seg_id THEN 1 ELSE 0 END FOR i IN range(200)], '') AS bits FROM cloud3", "point_id, hot, bits", "total"))
def _(s, d):
    o = C.one_hot_class(A.cloud3(s, d))
    return o.select("point_id", (F.array_position("one_hot", 1.0) - 1).alias("hot"), F.aggregate("one_hot", F.lit(0.0), lambda a, b: a + b).alias("total"), F.array_join(F.transform("one_hot", lambda x: x.cast("int").cast("string")), "").alias("bits"))


# 2.7 graphs --------------------------------------------------------------------------------

KEPT = "med AS (SELECT cloud_id, src, dst, median(prob) AS prob FROM edges WHERE prob >= 0.7 AND src <> dst GROUP BY ALL), mut AS (SELECT m.* FROM med m SEMI JOIN med b ON m.src = b.dst AND m.dst = b.src), top AS (SELECT * FROM mut QUALIFY row_number() OVER (PARTITION BY cloud_id, src ORDER BY prob DESC, dst) <= 2), kept AS (SELECT t.* FROM top t SEMI JOIN top b ON t.src = b.dst AND t.dst = b.src)"
REACH = KEPT + ", reach(node, other) AS (SELECT DISTINCT src, src FROM kept UNION SELECT r.node, k.dst FROM reach r JOIN kept k ON r.other = k.src), comp AS (SELECT 'all' AS cloud_id, node, min(other) AS component FROM reach GROUP BY 1, 2)"
BIG = REACH + ", big AS (SELECT * FROM comp QUALIFY count(*) OVER (PARTITION BY component) >= 5), seg AS (SELECT cloud_id, node, dense_rank() OVER (ORDER BY component) - 1 AS seg_id FROM big)"
PAIR = "cloud_id, src, dst"


def near_edges(s: SparkSession, d: str) -> DataFrame:
    return G.knn_edges(A.cloud3(s, d), 6, same_label=False)


@query("g1_chain_edges", sql("points", "SELECT * FROM (SELECT cloud_id, src, dst FROM one UNION SELECT cloud_id, dst, src FROM one UNION SELECT cloud_id, point_id, point_id FROM points)", PAIR, "", "one AS (SELECT cloud_id, point_id AS src, lead(point_id) OVER (PARTITION BY cloud_id, seg_id ORDER BY ord) AS dst FROM points QUALIFY dst IS NOT NULL UNION ALL SELECT cloud_id, b.point_id, a.point_id FROM (SELECT cloud_id, seg_id, arg_min({'point_id': point_id, 'x': x, 'y': y, 'z': z}, ord) AS a, arg_max({'point_id': point_id, 'x': x, 'y': y, 'z': z}, ord) AS b, count(*) AS n FROM points GROUP BY ALL) WHERE n > 2 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) < 100)"))
def _(s, d):
    return G.chain_edges(A.points(s, d), 100.0)


@query("g2_knn_edges", sql("cloud3", "SELECT n.cloud_id, src, dst, dist FROM near n JOIN cloud3 c ON c.point_id = n.src AND c.seg_id = n.t_seg_id", PAIR, "dist", near_sql("cloud3", "cloud3", 6)))
def _(s, d):
    return G.knn_edges(A.cloud3(s, d), 6)


@query("g3_knn_edge_features", sql("cloud3", "SELECT cloud_id, src, dst, exp(-dist * dist / (2 * 0.01::DOUBLE)) AS f0, exp(-dist * dist / (2 * 0.25::DOUBLE)) AS f1 FROM near", PAIR, "f0 f1", near_sql("cloud3", "cloud3", 6)))
def _(s, d):
    return G.knn_edge_features(A.cloud3(s, d), 6, [0.1, 0.5]).select("cloud_id", "src", "dst", F.col("feat")[0].alias("f0"), F.col("feat")[1].alias("f1"))


@query("g4_pairwise_features", sql("cloud3", "SELECT a.cloud_id, (a.point_id // 64)::BIGINT AS patch_id, a.point_id AS src, b.point_id AS dst, CASE WHEN a.point_id = b.point_id THEN 1 ELSE exp(-((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) / (2 * 0.04::DOUBLE)) END AS prob FROM cloud3 a JOIN cloud3 b ON a.cloud_id = b.cloud_id AND a.point_id // 64 = b.point_id // 64", "cloud_id, patch_id, src, dst", "prob"))
def _(s, d):
    # patches of at most 64 points with ids that follow each other
    return G.pairwise_features(A.cloud3(s, d).withColumn("patch_id", F.expr("point_id div 64")), 0.2)


@query("s16_bucketed_patches", sql("cloud3", "SELECT a.cloud_id, (a.point_id // 64)::BIGINT AS patch_id, a.point_id AS src, b.point_id AS dst, CASE WHEN a.point_id = b.point_id THEN 1 ELSE exp(-((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) / (2 * 0.04::DOUBLE)) END AS prob FROM cloud3 a JOIN cloud3 b ON a.cloud_id = b.cloud_id AND a.point_id // 64 = b.point_id // 64", "cloud_id, patch_id, src, dst", "prob"))
def _(s, d):
    from spatialseg.sources.files import materialize_buckets

    patches = A.cloud3(s, d).withColumn("patch_id", F.expr("point_id div 64"))
    path = work_path(s, "buckets")
    return G.pairwise_features(materialize_buckets(patches, f"patches_{path[-12:]}", path), 0.2)


@query("g5_incoming_neighbours", sql("cloud3", "SELECT cloud_id, src, dst, dist, row_number() OVER (PARTITION BY cloud_id, dst ORDER BY dist, src) AS rank FROM near QUALIFY rank <= 3", f"{PAIR}, rank", "dist", near_sql("cloud3", "cloud3", 6)))
def _(s, d):
    return G.incoming_neighbours(near_edges(s, d), 3)


@query("g5_neighbour_slots", sql("cloud3", "SELECT cloud_id, src AS node, 'out' AS side, row_number() OVER (PARTITION BY cloud_id, src ORDER BY dist, dst) AS rank, src, dst, dist FROM near QUALIFY rank <= 3 UNION ALL SELECT cloud_id, dst, 'in', row_number() OVER (PARTITION BY cloud_id, dst ORDER BY dist, src) AS rank, src, dst, dist FROM near QUALIFY rank <= 3", f"{PAIR}, node, side, rank", "dist", near_sql("cloud3", "cloud3", 6)))
def _(s, d):
    return G.neighbour_slots(near_edges(s, d), 3)


@query("g6_stitch_edges_mean", sql("edges", "SELECT cloud_id, src, dst, avg(prob) AS prob FROM edges GROUP BY ALL", PAIR, "prob"))
def _(s, d):
    return G.stitch_edges_mean(A.edges(s, d))


@query("g7_merge_edges_median", sql("edges", "SELECT * FROM med", PAIR, "prob", KEPT))
def _(s, d):
    return G.merge_edges_median(A.edges(s, d), 0.7)


@query("g8_mutual_edges", sql("edges", "SELECT * FROM mut", PAIR, "prob", KEPT.replace("FROM edges WHERE", "FROM (SELECT * REPLACE (CASE WHEN src % 3 = 0 THEN dst + 1 ELSE dst END AS dst) FROM edges) WHERE")))
def _(s, d):
    return G.mutual_edges(G.merge_edges_median(A.edges(s, d).withColumn("dst", F.when(F.col("src") % 3 == 0, F.col("dst") + 1).otherwise(F.col("dst"))), 0.7))


@query("g9_top_k_edges", sql("edges", "SELECT * FROM kept", PAIR, "prob", KEPT))
def _(s, d):
    return G.kept_edges(A.edges(s, d), 0.7, 2)


@query("g10_segment_components", sql("edges", "SELECT * FROM comp", "cloud_id, node, component", "", REACH))
def _(s, d):
    return G.segment_components(G.kept_edges(A.edges(s, d), 0.7, 2))


@query("g11_prune_segments", sql("edges", "SELECT * FROM big", "cloud_id, node, component", "", BIG))
def _(s, d):
    return G.prune_segments(G.segment_components(G.kept_edges(A.edges(s, d), 0.7, 2)), 5)


@query("g12_number_segments", sql("edges", "SELECT cloud_id, node, dense_rank() OVER (ORDER BY component) - 1 AS seg_id FROM comp", "cloud_id, node, seg_id", "", REACH))
def _(s, d):
    return G.number_segments(G.segment_components(G.kept_edges(A.edges(s, d), 0.7, 2)))


@query("g13_segment_transitive", sql("edges", "SELECT 'all' AS cloud_id, node, min(other) AS component FROM reach GROUP BY 2", "cloud_id, node, component", "", "e AS (SELECT DISTINCT src, dst FROM edges WHERE prob >= 1), reach(node, other) AS (SELECT DISTINCT src, src FROM e UNION SELECT r.node, e.dst FROM reach r JOIN e ON r.other = e.src)"))
def _(s, d):
    return G.segment_transitive(A.edges(s, d), 1.0)


@query("g14_stitch_points", sql("edges", "SELECT cloud_id, src AS point_id, max(patch_id) AS patch FROM edges GROUP BY ALL", "cloud_id, point_id, patch"))
def _(s, d):
    e = A.edges(s, d).select("cloud_id", F.col("src").alias("point_id"), "patch_id", F.col("patch_id").alias("patch")).distinct()
    return G.stitch_points(e)


@query("g15_cut_graph", sql("edges", "SELECT * FROM seg", "cloud_id, node, seg_id", "", BIG))
def _(s, d):
    return G.cut_graph(A.edges(s, d), 0.7, 2, 5)


@query("g15_segment_lines", sql("edges", "SELECT s.cloud_id, seg_id, node AS point_id, row_number() OVER (PARTITION BY seg_id ORDER BY node) - 1 AS ord, p_partkey::DOUBLE AS x, (p_partkey * 31 % 64)::DOUBLE AS y, (p_partkey % 5)::DOUBLE AS z FROM seg s JOIN part ON p_partkey = node", "cloud_id, seg_id, point_id, ord", XYZ, BIG))
def _(s, d):
    p = F.col("p_partkey")
    points = table(s, d, "part").select(F.lit("all").alias("cloud_id"), p.alias("point_id"), p.cast("double").alias("x"), (p * 31 % 64).cast("double").alias("y"), (p % 5).cast("double").alias("z"))
    return L.segment_lines(A.edges(s, d), points, 0.7, 2, 5, sort=False)


@query("g16_polyline_edges", sql("points", "SELECT cloud_id, seg_id, point_id AS src, lead(point_id) OVER (PARTITION BY cloud_id, seg_id ORDER BY ord) AS dst FROM points QUALIFY dst IS NOT NULL", "cloud_id, seg_id, src, dst"))
def _(s, d):
    return G.polyline_edges(A.points(s, d))


@query("g17_knn_triangles", sql("cloud3", "SELECT DISTINCT p.cloud_id, p.t_seg_id AS seg_id, list_sort([p.src, p.dst, q.dst]) AS t FROM nb p JOIN nb q ON p.src = q.src AND p.dst < q.dst", "cloud_id, seg_id, t[1] AS a, t[2] AS b, t[3] AS c", "", near_sql("cloud3", "cloud3", 3, cond="WHERE a.point_id <> b.point_id AND a.seg_id = b.seg_id") + ", nb AS (SELECT * FROM near)"))
def _(s, d):
    return G.knn_triangles(A.cloud3(s, d), 4)


@query("g18_score_patches", sql("cloud3", "SELECT * FROM (SELECT cloud_id, (point_id // 300)::INT AS patch_id, point_id AS src, lead(point_id) OVER w AS dst, exp(-((x - lead(x) OVER w) * (x - lead(x) OVER w))) AS prob FROM cloud3 WINDOW w AS (PARTITION BY cloud_id, point_id // 300 ORDER BY point_id)) WHERE dst IS NOT NULL", "cloud_id, patch_id, src, dst", "prob"))
def _(s, d):
    import numpy as np
    import pandas as pd

    def load():
        def chain(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"src": pdf["point_id"][:-1].to_numpy(), "dst": pdf["point_id"][1:].to_numpy(), "prob": np.exp(-(np.diff(pdf["x"]) ** 2))})

        return chain

    pts = A.cloud3(s, d).withColumn("patch_id", F.expr("point_id div 300").cast("int"))
    return G.score_patches(pts.select("cloud_id", "patch_id", "point_id", "x", "y", "z"), load=load)


# 2.8 filaments -----------------------------------------------------------------------------

W = "WINDOW w AS (PARTITION BY cloud_id, seg_id ORDER BY ord)"
D3 = "sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w))"
LEN = f"st AS (SELECT *, coalesce({D3}, 0) AS step FROM points {W}), len AS (SELECT cloud_id, seg_id, sum(step) AS length FROM st GROUP BY ALL)"
ENDS = "ends AS (SELECT cloud_id, seg_id, " + ", ".join(f"arg_min({c}, ord) AS a_{c}, arg_max({c}, ord) AS b_{c}" for c in ("point_id", "x", "y", "z")) + " FROM points GROUP BY ALL)"
GAP = "sqrt((a_x - b_x) * (a_x - b_x) + (a_y - b_y) * (a_y - b_y) + (a_z - b_z) * (a_z - b_z))"
CURV = f"dv AS (SELECT cloud_id, seg_id, point_id, ord, {', '.join(f'(lead({c}) OVER w - lag({c}) OVER w) / 2 AS f{c}, lead({c}) OVER w - 2 * {c} + lag({c}) OVER w AS s{c}' for c in 'xyz')} FROM points {W}), cv AS (SELECT cloud_id, seg_id, point_id, ord, coalesce(sqrt((fy * sz - fz * sy) * (fy * sz - fz * sy) + (fz * sx - fx * sz) * (fz * sx - fx * sz) + (fx * sy - fy * sx) * (fx * sy - fy * sx)) / nullif(pow(sqrt(fx * fx + fy * fy + fz * fz), 3), 0), 0) AS curvature FROM dv)"


@query("f1_order_points")
def _(s, d):
    return L.order_points(A.points(s, d))


@query("f2_segment_length", sql("points", "SELECT * FROM len", SEG, "length", LEN))
def _(s, d):
    return L.segment_length(A.points(s, d))


@query("f3_segment_tortuosity", sql("points", f"SELECT cloud_id, seg_id, coalesce(length / nullif({GAP}, 0), 1) AS tortuosity FROM len JOIN ends USING (cloud_id, seg_id)", SEG, "tortuosity", f"{LEN}, {ENDS}"))
def _(s, d):
    return L.segment_tortuosity(A.points(s, d))


@query("f4_curvature", sql("points", "SELECT * FROM cv", f"{SEG}, point_id, ord", "curvature", CURV))
def _(s, d):
    return L.curvature(A.points(s, d))


@query("f4_curvature_by_segment", sql("points", "SELECT cloud_id, seg_id, avg(curvature) AS curvature FROM cv GROUP BY ALL", SEG, "curvature", CURV))
def _(s, d):
    return L.curvature(A.points(s, d), "segment")


ANGLE = "an AS (SELECT *, CASE WHEN cosine IS NOT NULL THEN degrees(acos(greatest(-1, least(1, cosine)))) END AS angle FROM (SELECT *, (ax * nx + ay * ny + az * nz) / nullif(sqrt(ax * ax + ay * ay + az * az) * sqrt(nx * nx + ny * ny + nz * nz), 0) AS cosine FROM (SELECT *, " + ", ".join(f"lag({c}) OVER w - {c} AS a{c}, lead({c}) OVER w - {c} AS n{c}" for c in "xyz") + f" FROM points {W})))"


@query("f5_angle_between", sql("points", "SELECT * FROM an", f"{SEG}, point_id", "angle", ANGLE))
def _(s, d):
    return L.bend_angles(A.points(s, d)).select("cloud_id", "seg_id", "point_id", "angle")


#: Of a run of sharp bends every second one cuts, the first among them.
BENT = ANGLE + ", sh AS (SELECT p.*, coalesce((angle < 150)::INT, 0) AS sharp FROM points p JOIN an USING (cloud_id, seg_id, point_id)), cl AS (SELECT *, sum(1 - sharp) OVER (PARTITION BY cloud_id, seg_id ORDER BY ord) AS calm FROM sh), ct AS (SELECT *, CASE WHEN sharp = 1 AND row_number() OVER (PARTITION BY cloud_id, seg_id, calm, sharp ORDER BY ord) % 2 = 1 THEN 1 ELSE 0 END AS cut_ FROM cl), pa AS (SELECT *, coalesce(sum(cut_) OVER (PARTITION BY cloud_id, seg_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM ct)"


@query("f6_cut_sharp_bends", sql("points", "SELECT cloud_id, dense_rank() OVER (PARTITION BY cloud_id ORDER BY seg_id, part) - 1 AS seg_id, point_id, ord FROM pa", "cloud_id, seg_id, point_id, ord", "", BENT))
def _(s, d):
    return L.cut_sharp_bends(A.points(s, d)).select("cloud_id", "seg_id", "point_id", "ord")


SPACED = "al AS (SELECT *, sum(step) OVER w AS pos FROM st WINDOW w AS (PARTITION BY cloud_id, seg_id ORDER BY ord)), nx AS (SELECT *, lead(pos) OVER w AS npos, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM al WINDOW w AS (PARTITION BY cloud_id, seg_id ORDER BY ord)), ks AS (SELECT *, unnest(CASE WHEN npos IS NULL AND pos = 0 THEN [0] WHEN npos IS NOT NULL THEN generate_series(ceil(pos / 100)::BIGINT, (ceil(npos / 100) - 1)::BIGINT) ELSE [] END) AS k FROM nx), pt AS (SELECT *, coalesce((k * 100 - pos) / nullif(npos - pos, 0), 0) AS part FROM ks)"


@query("f7_resample", sql("points", "SELECT cloud_id, seg_id, k::INT AS ord, " + ", ".join(f"coalesce({c} + part * (n{c} - {c}), {c}) AS {c}" for c in "xyz") + " FROM pt", "cloud_id, seg_id, ord", XYZ, f"{LEN}, {SPACED}"))
def _(s, d):
    return L.resample(A.points(s, d), 100.0)


@query("f8_smooth", sql("points", f"SELECT cloud_id, seg_id, point_id, {', '.join(f'CASE WHEN count(*) OVER (PARTITION BY cloud_id, seg_id) > 4 THEN avg({c}) OVER (PARTITION BY cloud_id, seg_id ORDER BY ord ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) ELSE {c} END AS {c}' for c in 'xyz')} FROM points", f"{SEG}, point_id", XYZ))
def _(s, d):
    return L.smooth(A.points(s, d)).select("cloud_id", "seg_id", "point_id", "x", "y", "z")


@query("f9_renumber", sql("points", "SELECT cloud_id, point_id, dense_rank() OVER (PARTITION BY cloud_id ORDER BY seg_id) + 2 AS seg_id FROM points", "cloud_id, point_id, seg_id"))
def _(s, d):
    return L.renumber(A.points(s, d), 3).select("cloud_id", "point_id", "seg_id")


@query("f10_sort_by_length", sql("points", "SELECT cloud_id, point_id, new AS seg_id FROM points JOIN (SELECT cloud_id, seg_id, row_number() OVER (PARTITION BY cloud_id ORDER BY length, seg_id) - 1 AS new FROM len) USING (cloud_id, seg_id)", "cloud_id, point_id, seg_id", "", LEN))
def _(s, d):
    return L.sort_by_length(A.points(s, d)).select("cloud_id", "point_id", "seg_id")


@query("f11_filter_short", sql("points", "SELECT cloud_id, seg_id, point_id FROM points JOIN len USING (cloud_id, seg_id) WHERE length >= 3000", f"{SEG}, point_id", "", LEN))
def _(s, d):
    return L.filter_short(A.points(s, d), 3000.0).select("cloud_id", "seg_id", "point_id")


TOWARD, FACE = [f"(b.{c} - a.{c})" for c in "xyz"], " + ".join(f"(a.v{c} * b.v{c})" for c in "xyz")
AXIAL = " + ".join(f"{g} * a.v{c}" for g, c in zip(TOWARD, "xyz", strict=True))
APART = "sqrt(" + " + ".join(f"{g} * {g}" for g in TOWARD) + ")"
#: Ends with the way out of them, the pairs that face each other best, and the states of a walk along them.
FACING = f"""nth AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, seg_id ORDER BY ord, point_id) - 1 AS r, count(*) OVER (PARTITION BY cloud_id, seg_id) AS n,
  {", ".join(f"{c} - lead({c}) OVER w AS o{c}, {c} - lag({c}) OVER w AS i{c}" for c in "xyz")} FROM points WINDOW w AS (PARTITION BY cloud_id, seg_id ORDER BY ord)),
two AS (SELECT cloud_id, seg_id, 0 AS e, x, y, z, ox AS vx, oy AS vy, oz AS vz FROM nth WHERE n > 1 AND r = 0 UNION ALL SELECT cloud_id, seg_id, 1, x, y, z, ix, iy, iz FROM nth WHERE n > 1 AND r = n - 1),
en AS (SELECT cloud_id, seg_id, e, x, y, z, {", ".join(f"v{c} / nullif(sqrt(vx * vx + vy * vy + vz * vz), 0.0) AS v{c}" for c in "xyz")} FROM two),
good AS (SELECT a.cloud_id, a.seg_id AS s, a.e, b.seg_id AS t, b.e AS f, {APART} AS dist, {AXIAL} AS axial FROM en a JOIN en b ON a.cloud_id = b.cloud_id AND a.seg_id <> b.seg_id AND {APART} <= 60 WHERE {FACE} < 0),
best AS (SELECT * FROM good WHERE axial >= 0 AND sqrt(greatest(dist * dist - axial * axial, 0.0)) <= 30 QUALIFY row_number() OVER (PARTITION BY cloud_id, s, e ORDER BY dist, t, f) = 1),
lnk AS (SELECT a.cloud_id, a.s, a.e, a.t, a.f FROM best a JOIN best b ON a.cloud_id = b.cloud_id AND a.t = b.s AND a.f = b.e AND b.t = a.s AND b.f = a.e),
num AS (SELECT DISTINCT cloud_id, seg_id, n FROM nth),
reach(cloud_id, s0, e0, s, e, k, passed, ring) AS (SELECT cloud_id, seg_id, e, seg_id, e, 0, n, false FROM num, (VALUES (0), (1)) v(e)
  UNION ALL SELECT r.cloud_id, s0, e0, t, f, k + 1, passed + n, t = s0 FROM reach r JOIN lnk l ON l.cloud_id = r.cloud_id AND l.s = r.s AND l.e = 1 - r.e JOIN num m ON m.cloud_id = l.cloud_id AND m.seg_id = l.t WHERE NOT ring),
rings AS (SELECT DISTINCT cloud_id, least(s0, min(s)) AS s FROM reach GROUP BY cloud_id, s0, e0 HAVING bool_or(ring)),
lnk2 AS (SELECT l.* FROM lnk l WHERE NOT EXISTS (FROM rings g WHERE g.cloud_id = l.cloud_id AND (g.s = l.s AND l.e = 0 OR g.s = l.t AND l.f = 0))),
wlk(cloud_id, s0, e0, s, e, k, passed) AS (SELECT cloud_id, seg_id, e, seg_id, e, 0, n FROM num, (VALUES (0), (1)) v(e)
  UNION ALL SELECT r.cloud_id, s0, e0, t, f, k + 1, passed + n FROM wlk r JOIN lnk2 l ON l.cloud_id = r.cloud_id AND l.s = r.s AND l.e = 1 - r.e JOIN num m ON m.cloud_id = l.cloud_id AND m.seg_id = l.t),
fin AS (SELECT cloud_id, s0, e0, max(passed) AS passed, arg_max(s, k) AS ls, arg_max(e, k) AS le, min(s) AS low FROM wlk GROUP BY ALL),
way AS (SELECT cloud_id, s0 AS seg_id, min(low) AS chain, arg_max(e0, ls * 2 + le) AS turn, sum(passed) - arg_max(passed, ls * 2 + le) AS other FROM fin GROUP BY cloud_id, s0)"""
CHAINED = "SELECT p.cloud_id, dense_rank() OVER (PARTITION BY p.cloud_id ORDER BY chain) - 1 AS seg_id, point_id, CASE WHEN other = n AND chain = p.seg_id AND NOT EXISTS (FROM lnk l WHERE l.cloud_id = p.cloud_id AND l.s = p.seg_id) THEN ord ELSE other - n + CASE WHEN turn = 1 THEN n - 1 - r ELSE r END END AS ord FROM nth p JOIN way USING (cloud_id, seg_id)"


@query("f12_connect_ends", sql("points", CHAINED, "cloud_id, seg_id, point_id, ord", "", FACING))
def _(s, d):
    return L.connect_ends(A.points(s, d), 60.0, 30.0).select("cloud_id", "seg_id", "point_id", "ord")


@query("f13_connect_near_segments", sql("points", CHAINED, "cloud_id, seg_id, point_id, ord", "", FACING.replace("<= 60", "<= 40").replace("<= 30", "<= 20")))
def _(s, d):
    return L.connect_near_segments(A.points(s, d), 40.0, 20.0).select("cloud_id", "seg_id", "point_id", "ord")


@query("f14_confidence", sql("edges", "SELECT s.cloud_id, seg_id, avg(prob) AS confidence FROM kept k JOIN seg s ON k.src = s.node GROUP BY ALL", "cloud_id, seg_id", "confidence", BIG))
def _(s, d):
    kept = cut(G.kept_edges(A.edges(s, d), 0.7, 2), "kept")
    return L.kept_confidence(kept, G.cut_kept(kept, 5))


HIT = "a AS (SELECT * FROM points WHERE point_id % 2 = 0), b AS (SELECT * FROM points WHERE point_id % 2 = 1), hit AS (SELECT DISTINCT a.cloud_id, a.seg_id, b.seg_id AS b_seg_id, a.point_id FROM a JOIN b ON a.cloud_id = b.cloud_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 10)"


def halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two segmentations: points of even and of odd id."""
    p = A.points(s, d)
    return p.where("point_id % 2 = 0"), p.where("point_id % 2 = 1")


@query("f15_overlap_probability", sql("points", "SELECT a.cloud_id, a.seg_id, count(DISTINCT h.point_id) / count(DISTINCT a.point_id) AS overlap FROM a LEFT JOIN hit h USING (cloud_id, seg_id, point_id) GROUP BY 1, 2", SEG, "overlap", HIT))
def _(s, d):
    return L.overlap_probability(*halves(s, d), 10.0)


@query("f16_compare_segmentations", sql("points", " UNION ALL ".join(f"SELECT {p}.cloud_id, {p}.seg_id, CASE WHEN coalesce(max(k), 0) / any_value(n) >= 0.15 THEN '{p}_matched' ELSE '{p}_noise' END AS class FROM (SELECT cloud_id, seg_id, count(*) AS n FROM {p} GROUP BY ALL) {p} LEFT JOIN (SELECT {p}.cloud_id, {p}.seg_id, o.seg_id AS other, count(DISTINCT {p}.point_id) AS k FROM {p} JOIN {o} o ON {p}.cloud_id = o.cloud_id AND sqrt(({p}.x - o.x) * ({p}.x - o.x) + ({p}.y - o.y) * ({p}.y - o.y) + ({p}.z - o.z) * ({p}.z - o.z)) <= 10 GROUP BY ALL) m USING (cloud_id, seg_id) GROUP BY 1, 2" for p, o in (("a", "b"), ("b", "a"))), f"{SEG}, class", "", HIT))
def _(s, d):
    return L.compare_segmentations(*halves(s, d), 10.0, 0.15)


@query("f17_endpoints", sql("points", "SELECT * FROM ends", f"{SEG}, a_point_id, b_point_id", "a_x a_y a_z b_x b_y b_z", ENDS))
def _(s, d):
    return L.endpoints(A.points(s, d))


@query("f18_thin_order_smooth")
def _(s, d):
    return L.thin_order_smooth(A.points(s, d), 20.0)


ROUTE = TRACKS + ", wk AS (SELECT *, greatest(coalesce(greatest(abs(dx), abs(dy), abs(dz)), 1), 1) AS n FROM (SELECT cloud_id, seg_id, ord, x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, lead(x::BIGINT) OVER v - x::BIGINT AS dx, lead(y::BIGINT) OVER v - y::BIGINT AS dy, lead(z::BIGINT) OVER v - z::BIGINT AS dz FROM tracks WINDOW v AS (PARTITION BY cloud_id, seg_id ORDER BY ord))), rt AS (SELECT DISTINCT cloud_id, seg_id, " + ", ".join(f"({c} + sign(coalesce(d{c}, 0)) * ((2 * k * abs(coalesce(d{c}, 0)) + n) // (2 * n)))::INT AS {c}" for c in "zyx") + " FROM (SELECT *, unnest(range(n)) AS k FROM wk)), tl AS (SELECT cloud_id, seg_id, sum(s) AS length FROM (SELECT cloud_id, seg_id, coalesce(sqrt((x - lag(x) OVER v) * (x - lag(x) OVER v) + (y - lag(y) OVER v) * (y - lag(y) OVER v) + (z - lag(z) OVER v) * (z - lag(z) OVER v)), 0) AS s FROM tracks WINDOW v AS (PARTITION BY cloud_id, seg_id ORDER BY ord)) GROUP BY ALL)"


@query("f19_intensity_along", sql("voxels", "SELECT cloud_id, seg_id, avg(value) AS mean_intensity, sum(value) AS sum_intensity, avg(value) / nullif(any_value(length), 0) AS mean_intensity_per_length, sum(value) / nullif(any_value(length), 0) AS sum_intensity_per_length FROM rt JOIN voxels v ON v.image_id = rt.cloud_id AND v.z = rt.z AND v.y = rt.y AND v.x = rt.x JOIN tl USING (cloud_id, seg_id) GROUP BY cloud_id, seg_id", SEG, "mean_intensity sum_intensity mean_intensity_per_length sum_intensity_per_length", ROUTE))
def _(s, d):
    return L.intensity_along(tracks(s, d), A.voxels(s, d))


@query("f20_filament_report", sql("points", f"SELECT cloud_id, seg_id, n_points, length, coalesce(length / nullif({GAP}, 0), 1) AS tortuosity, curvature FROM len JOIN ends USING (cloud_id, seg_id) JOIN (SELECT cloud_id, seg_id, count(*) AS n_points, avg(curvature) AS curvature FROM cv GROUP BY ALL) USING (cloud_id, seg_id)", f"{SEG}, n_points", "length tortuosity curvature", f"{LEN}, {ENDS}, {CURV}"))
def _(s, d):
    return L.filament_report(A.points(s, d))


@query("f21_offset_union", sql("points", "SELECT cloud_id, point_id, dense_rank() OVER (PARTITION BY cloud_id ORDER BY p, seg_id) - 1 AS seg_id FROM (SELECT *, point_id % 2 AS p FROM points)", "cloud_id, point_id, seg_id"))
def _(s, d):
    return L.offset_union(list(halves(s, d))).select("cloud_id", "point_id", "seg_id")


# 2.9 classification ------------------------------------------------------------------------


def poles(s: SparkSession, d: str) -> DataFrame:
    """Two poles for each cloud: the ends of its diagonal."""
    b = A.points(s, d).groupBy("cloud_id").agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    row = lambda i, n: F.struct(F.lit(i).alias("pole_id"), *[F.col(f"{n}_{c}").alias(c) for c in "xyz"])
    return b.select("cloud_id", F.explode(F.array(row(0, "lo"), row(1, "hi"))).alias("p")).select("cloud_id", "p.*")


def mesh(s: SparkSession, d: str) -> DataFrame:
    return A.points(s, d).where("x > 60 and y between 100 and 400")


POLES = "poles AS (SELECT cloud_id, 0 AS pole_id, min(x) AS x, min(y) AS y, min(z) AS z FROM points GROUP BY 1 UNION ALL SELECT cloud_id, 1, max(x), max(y), max(z) FROM points GROUP BY 1), mesh AS (SELECT * FROM points WHERE x > 60 AND y BETWEEN 100 AND 400)"


def pole_dist(p: str) -> str:
    return f"sqrt(({p}x - o.x) * ({p}x - o.x) + ({p}y - o.y) * ({p}y - o.y) + ({p}z - o.z) * ({p}z - o.z))"


@query("m1_count_true_runs", "SELECT user_id, sum(CASE WHEN f AND NOT coalesce(p, false) THEN 1 ELSE 0 END)::BIGINT AS runs FROM (SELECT user_id, value > 50 AS f, lag(value > 50) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) GROUP BY 1")
def _(s, d):
    return M.count_true_runs(table(s, d, "events").withColumn("flag", F.col("value") > 50), ["user_id"], "event_id", "flag")


@query("m2_consecutive_runs", "SELECT l_suppkey, min(n) AS first, max(n) AS last, count(*) AS size FROM (SELECT l_suppkey, n, n - row_number() OVER (PARTITION BY l_suppkey ORDER BY n) AS i FROM (SELECT DISTINCT l_suppkey, l_partkey AS n FROM lineitem)) GROUP BY l_suppkey, i")
def _(s, d):
    return M.consecutive_runs(table(s, d, "lineitem").select("l_suppkey", "l_partkey"), ["l_suppkey"], "l_partkey")


@query("m3_fill_gaps", "SELECT l_suppkey, unnest(CASE WHEN nx - n <= 5 THEN range(n, nx) ELSE [n] END) AS l_partkey FROM (SELECT l_suppkey, n, lead(n) OVER (PARTITION BY l_suppkey ORDER BY n) AS nx FROM (SELECT DISTINCT l_suppkey, l_partkey AS n FROM lineitem))")
def _(s, d):
    return M.fill_gaps(table(s, d, "lineitem").select("l_suppkey", "l_partkey"), ["l_suppkey"], "l_partkey", 5)


@query("m4_distance_to_pole", sql("points", f"SELECT p.cloud_id, point_id, pole_id, {pole_dist('p.')} AS dist FROM points p JOIN poles o USING (cloud_id)", "cloud_id, point_id, pole_id", "dist", POLES))
def _(s, d):
    return M.distance_to_pole(A.points(s, d), poles(s, d))


@query("m5_end_distances", sql("points", f"SELECT e.cloud_id, e.point_id, min({pole_dist('e.')}) AS to_surface, any_value(q.pd) AS to_pole FROM e JOIN mesh o ON e.cloud_id = o.cloud_id JOIN (SELECT e.cloud_id, e.point_id, min({pole_dist('e.')}) AS pd FROM e JOIN poles o ON e.cloud_id = o.cloud_id GROUP BY 1, 2) q ON q.cloud_id = e.cloud_id AND q.point_id = e.point_id GROUP BY 1, 2", "cloud_id, point_id", "to_surface to_pole", f"{POLES}, e AS (SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY cloud_id, seg_id ORDER BY ord) = 1)"))
def _(s, d):
    e = L.endpoints(A.points(s, d)).select("cloud_id", F.col("a_point_id").alias("point_id"), *[F.col(f"a_{c}").alias(c) for c in "xyz"])
    return M.end_distances(mesh(s, d), poles(s, d), e)


@query("m6_order_poles", sql("points", f"SELECT o.cloud_id, pole_id, row_number() OVER (PARTITION BY o.cloud_id ORDER BY {pole_dist('m.')}, pole_id) AS pole_order FROM poles o JOIN (SELECT cloud_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM mesh GROUP BY 1) m USING (cloud_id)", "cloud_id, pole_id, pole_order", "", POLES))
def _(s, d):
    return M.order_poles(poles(s, d), mesh(s, d))


@query("m7_nearest_vertex", sql("points", "SELECT cloud_id, src AS point_id, dst AS vertex_id, dist, dist <= 20 AS within FROM near", "cloud_id, point_id, vertex_id, within", "dist", f"{POLES}, {near_sql('points', 'mesh', 1)}"))
def _(s, d):
    return M.nearest_vertex(A.points(s, d), mesh(s, d), 20.0)


@query("m8_segments_in_box", sql("points", "SELECT e.cloud_id, e.seg_id FROM ends e JOIN (SELECT cloud_id, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM mesh GROUP BY 1) USING (cloud_id) WHERE " + " AND ".join(f"{p}_{c} BETWEEN l{c} AND h{c}" for p in "ab" for c in "xyz"), SEG, "", f"{POLES}, {ENDS}"))
def _(s, d):
    return M.segments_in_box(mesh(s, d), A.points(s, d))


@query("m9_assign_to_pole", sql("points", "SELECT cloud_id, seg_id, pole_id, least(da, db) AS dist, da < db AS turn FROM j QUALIFY row_number() OVER (PARTITION BY cloud_id, seg_id ORDER BY least(da, db), overall, pole_id) = 1", f"{SEG}, pole_id, turn", "dist", f"{POLES}, {ENDS}, h AS (SELECT cloud_id, seg_id, pole_id, {pole_dist('e.a_')} AS da, {pole_dist('e.b_')} AS db FROM ends e JOIN poles o USING (cloud_id)), j AS (SELECT *, min(least(da, db)) OVER (PARTITION BY cloud_id, pole_id) AS overall FROM h)"))
def _(s, d):
    return M.assign_to_pole(A.points(s, d), poles(s, d))


#: Ends with their distance to the surface and to the nearest pole, and whether a segment lies in the surface's box.
SIDES = POLES + ", " + ENDS + ", sf AS (SELECT e.cloud_id, e.seg_id, " + ", ".join(f"min({pole_dist(f'e.{p}_')}) AS {p}_s" for p in "ab") + " FROM ends e JOIN mesh o USING (cloud_id) GROUP BY ALL), pd AS (SELECT e.cloud_id, e.seg_id, " + ", ".join(f"min({pole_dist(f'e.{p}_')}) AS {p}d, arg_min(pole_id, ({pole_dist(f'e.{p}_')}, pole_id)) AS {p}p" for p in "ab") + " FROM ends e JOIN poles o USING (cloud_id) GROUP BY ALL), bx AS (SELECT cloud_id, " + ", ".join(f"min({c}) AS l{c}, max({c}) AS h{c}" for c in "xyz") + " FROM mesh GROUP BY 1), ib AS (SELECT cloud_id, seg_id, " + " AND ".join(f"{p}_{c} BETWEEN l{c} AND h{c}" for p in "ab" for c in "xyz") + " AS inside FROM ends JOIN bx USING (cloud_id))"


@query("m10_classify_filaments", sql("points", """SELECT cloud_id, seg_id, CASE WHEN a_s <= 10 OR b_s <= 10 THEN 'attached_' || CASE WHEN ad <= bd THEN ap ELSE bp END || CASE WHEN inside THEN '_inside' ELSE '_outside' END
  WHEN least(a_s, b_s) <= 60 THEN 'mid' WHEN ap <> bp AND greatest(ad, bd) <= 60 THEN 'bridging' WHEN ap <> bp THEN 'interdigitating' ELSE 'remaining' END AS "group"
  FROM (SELECT cloud_id, seg_id, a_s, b_s, ad, bd, ap, bp, inside FROM sf JOIN pd USING (cloud_id, seg_id) JOIN ib USING (cloud_id, seg_id))""", 'cloud_id, seg_id, "group"', "", SIDES))
def _(s, d):
    return M.classify_filaments(A.points(s, d), mesh(s, d), poles(s, d), 10.0, 60.0)


# 2.10 metrics ------------------------------------------------------------------------------

CONF = "conf AS (SELECT group_id, count(*) FILTER (score >= 0.05 AND target = 1) AS tp, count(*) FILTER (score >= 0.05 AND target = 0) AS fp, count(*) FILTER (score < 0.05 AND target = 0) AS tn, count(*) FILTER (score < 0.05 AND target = 1) AS fn FROM scored GROUP BY 1)"
PRF = CONF + ", prf AS (SELECT *, (tp + tn) / (tp + fp + tn + fn + 1e-16) AS accuracy, p AS precision, r AS recall, 2 * p * r / (p + r + 1e-16) AS f1 FROM (SELECT *, tp / (tp + fp + 1e-16) AS p, tp / (tp + fn + 1e-16) AS r FROM conf))"
SWEEP = "sw AS (SELECT group_id, i, count(*) FILTER (b > i AND target = 1) AS tp, count(*) FILTER (b > i AND target <> 1) AS fp, count(*) FILTER (b <= i AND target = 1) AS fn FROM (SELECT *, ceil(score::DECIMAL(18, 6) * {0})::INT AS b FROM scored), range({0}) r(i) GROUP BY ALL)"
RANK = "rk AS (SELECT group_id, score, p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER g AS ps, sum(q) OVER g AS qs FROM (SELECT group_id, score, count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS q FROM scored GROUP BY ALL) WINDOW w AS (PARTITION BY group_id ORDER BY score DESC), g AS (PARTITION BY group_id))"
AP = "SELECT group_id, coalesce(sum(p / nullif(ps, 0) * tp / (tp + fp)), 0) AS ap FROM rk GROUP BY 1"
AUC = "SELECT group_id, sum(q * (tp - p / 2)) / nullif(max(ps) * max(qs), 0) AS auc FROM rk GROUP BY 1"
CE = "-(target * CASE WHEN score > 0 THEN greatest(ln(score), -100) ELSE -100 END + (1 - target) * CASE WHEN score < 1 THEN greatest(ln(1 - score), -100) ELSE -100 END)"


@query("e1_confusion", sql("scored", "SELECT * FROM conf", "group_id, tp, fp, tn, fn", "", CONF))
def _(s, d):
    return E.confusion(A.scored(s, d), 0.05)


@query("e2_binarize", sql("scored", "SELECT group_id, item_id, (score - 0.05 > 0)::INT AS score, target FROM scored", "group_id, item_id, score, target"))
def _(s, d):
    return E.binarize(A.scored(s, d).withColumn("score", F.col("score") - 0.05))


@query("e3_prf", sql("scored", "SELECT * FROM prf", "group_id", "accuracy precision recall f1", PRF))
def _(s, d):
    return E.prf(A.scored(s, d), 0.05).select("group_id", "accuracy", "precision", "recall", "f1")


@query("e4_best_f1", sql("scored", "SELECT f.group_id, f.m / 100 AS threshold, round(p, 2) AS precision, round(r, 2) AS recall, f1 FROM f JOIN (SELECT group_id, floor(avg(i) + 0.5)::INT AS i, avg(i) AS m FROM f WHERE f1 = best GROUP BY 1) a USING (group_id, i)".replace("f.m", "a.m"), "group_id", "threshold precision recall f1", SWEEP.format(100) + ", f AS (SELECT *, round(2 * p * r / (p + r + 1e-16), 2) AS f1, max(round(2 * p * r / (p + r + 1e-16), 2)) OVER (PARTITION BY group_id) AS best FROM (SELECT *, tp / (tp + fp + 1e-16) AS p, tp / (tp + fn + 1e-16) AS r FROM sw))"))
def _(s, d):
    return E.best_f1(A.scored(s, d))


def scored_edges(s: SparkSession, d: str) -> DataFrame:
    e = A.edges(s, d)
    return e.select(F.col("patch_id").alias("group_id"), "src", "dst", F.col("prob").alias("score"), ((F.col("src") + F.col("dst")) % 3 == 0).cast("int").alias("target")).union(e.select("patch_id", "src", F.col("src").alias("dst"), F.lit(0.6), F.lit(1)).distinct())


SE = "se AS (SELECT patch_id AS group_id, src, dst, prob AS score, ((src + dst) % 3 = 0)::INT AS target FROM edges UNION ALL SELECT DISTINCT patch_id, src, src, 0.6, 1 FROM edges)"


@query("e5_graph_f1", sql("edges", "SELECT group_id, (2 * tp1 / (2 * tp1 + fp1 + fn1 + 1e-16) + 2 * tp0 / (2 * tp0 + fp0 + fn0 + 1e-16)) / 2 AS f1 FROM (SELECT group_id, count(*) FILTER (score >= 0.8 AND target = 1 AND src <> dst) AS tp1, count(*) FILTER (score >= 0.8 AND target = 0 AND src <> dst) AS fp1, count(*) FILTER (score < 0.8 AND target = 1 AND src <> dst) AS fn1, count(*) FILTER (score < 0.8 AND target = 0) AS tp0, count(*) FILTER (score < 0.8 AND target = 1) AS fp0, count(*) FILTER (score >= 0.8 AND target = 0) AS fn0 FROM se GROUP BY 1)", "group_id", "f1", SE))
def _(s, d):
    return E.graph_f1(scored_edges(s, d), 0.8)


@query("e6_soft_prf", sql("scored", "SELECT group_id, 1 - (2 * tp / (2 * tp + fn + fp + 1e-16) + 2 * tn / (2 * tn + fn + fp + 1e-16)) / 2 AS loss FROM (SELECT group_id, sum(score * target) AS tp, sum(score * (1 - target)) AS fp, sum((1 - score) * target) AS fn, sum((1 - score) * (1 - target)) AS tn FROM scored GROUP BY 1)", "group_id", "loss"))
def _(s, d):
    return E.soft_prf(A.scored(s, d))


@query("e7_average_precision", sql("scored", AP, "group_id", "ap", RANK))
def _(s, d):
    return E.average_precision(A.scored(s, d))


@query("e8_roc_auc", sql("scored", AUC, "group_id", "auc", RANK))
def _(s, d):
    return E.roc_auc(A.scored(s, d))


@query("e9_iou", sql("scored", "SELECT group_id, tp / (tp + fp + fn + 1e-16) AS iou FROM conf", "group_id", "iou", CONF))
def _(s, d):
    return E.iou(A.scored(s, d), 0.05)


def moved(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A predicted and a true segmentation of equal points."""
    p = A.points(s, d)
    return p.where("point_id % 5 <> 0").withColumn("seg_id", F.col("seg_id") % 40), p


PT = "p AS (SELECT DISTINCT cloud_id, x, y, z, seg_id % 40 AS ps FROM points WHERE point_id % 5 <> 0), t AS (SELECT DISTINCT cloud_id, x, y, z, seg_id AS ts FROM points), i AS (SELECT cloud_id, ps, ts, count(*) AS n FROM p JOIN t USING (cloud_id, x, y, z) GROUP BY ALL), pn AS (SELECT cloud_id, ps, count(*) AS pn FROM p GROUP BY ALL), tn AS (SELECT cloud_id, ts, count(*) AS tn FROM t GROUP BY ALL)"


@query("e10_instance_precision", sql("points", "SELECT cloud_id, avg(coalesce(m / tn, 0)) AS precision FROM tn LEFT JOIN (SELECT cloud_id, ts, max(n) AS m FROM i GROUP BY ALL) USING (cloud_id, ts) GROUP BY 1", "cloud_id", "precision", PT))
def _(s, d):
    return E.instance_precision(*moved(s, d))


@query("e11_mean_coverage", sql("points", "SELECT cloud_id, avg(coalesce(b, 0)) AS mcov, sum(coalesce(b, 0) * tn) / sum(tn) AS mwcov FROM tn LEFT JOIN (SELECT cloud_id, ts, max(n / (pn + tn - n)) AS b FROM i JOIN pn USING (cloud_id, ps) JOIN tn USING (cloud_id, ts) GROUP BY ALL) USING (cloud_id, ts) GROUP BY 1", "cloud_id", "mcov mwcov", PT))
def _(s, d):
    return E.mean_coverage(*moved(s, d))


CURVE = SWEEP.format(100) + ", cu AS (SELECT group_id, i, last_value(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END IGNORE NULLS) OVER (PARTITION BY group_id ORDER BY i) AS precision, tp / (tp + fn + 1e-16) AS recall FROM sw)"
PAR = "lh AS (SELECT group_id, max(CASE WHEN recall <= 0.5 THEN {'r': recall, 'p': precision} END) AS lo, min(CASE WHEN recall >= 0.5 THEN {'r': recall, 'p': precision} END) AS hi FROM cu GROUP BY 1), par AS (SELECT group_id, coalesce(lo.p + (hi.p - lo.p) * (0.5 - lo.r) / nullif(hi.r - lo.r, 0), hi.p, lo.p) AS precision_at_recall FROM lh)"


@query("e12_pr_curve", sql("scored", "SELECT * FROM cu", "group_id, i::INT AS i", "precision recall", CURVE))
def _(s, d):
    return E.pr_curve(A.scored(s, d), 100)


@query("e13_precision_at_recall", sql("scored", "SELECT * FROM par", "group_id", "precision_at_recall", f"{CURVE}, {PAR}"))
def _(s, d):
    return E.precision_at_recall(E.pr_curve(A.scored(s, d), 100), 0.5)


HALF = PRF.replace("0.05", "0.5")


@query("e14_batch_benchmark", sql("scored", "SELECT group_id, precision, recall, f1, mean_precision, precision_at_recall FROM prf JOIN (SELECT group_id, avg(precision) AS mean_precision FROM cu GROUP BY 1) USING (group_id) JOIN par USING (group_id)", "group_id", "precision recall f1 mean_precision precision_at_recall", f"{HALF}, {SWEEP.format(1000)}{CURVE[CURVE.index(', cu AS') :]}, {PAR.replace('0.5', '0.9')}"))
def _(s, d):
    return E.batch_benchmark(A.scored(s, d))


@query("e15_image_benchmark", sql("scored", f"SELECT avg(accuracy) AS accuracy, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, avg(tp / (tp + fp + fn + 1e-16)) AS iou, avg(ap) AS ap, avg(auc) AS auc FROM prf JOIN ({AP}) USING (group_id) JOIN ({AUC}) USING (group_id)", "", "accuracy precision recall f1 iou ap auc", f"{HALF}, {RANK}"))
def _(s, d):
    return E.image_benchmark(A.scored(s, d))


COVER = "SELECT cloud_id, avg(coalesce(b, 0)) AS mcov, sum(coalesce(b, 0) * tn) / sum(tn) AS mwcov FROM tn LEFT JOIN (SELECT cloud_id, ts, max(n / (pn + tn - n)) AS b FROM i JOIN pn USING (cloud_id, ps) JOIN tn USING (cloud_id, ts) GROUP BY ALL) USING (cloud_id, ts) GROUP BY 1"


@query("e16_graph_benchmark", sql("scored points", f"SELECT * FROM (SELECT avg(tp / (tp + fp + fn + 1e-16)) AS iou, avg(auc) AS auc FROM conf JOIN ({AUC}) USING (group_id)), (SELECT avg(mcov) AS mcov, avg(mwcov) AS mwcov FROM ({COVER}))", "", "iou auc mcov mwcov", f"{CONF}, {RANK}, {PT}"))
def _(s, d):
    return E.graph_benchmark(A.scored(s, d), *moved(s, d), 0.05)


#: The graph cut at each threshold, which is part of every key, and the coverage of the true segments.
BY_THRESHOLD = """th(t) AS (VALUES (0.6), (0.7), (0.9)), med AS (SELECT t, src, dst, median(prob) AS prob FROM edges, th WHERE prob >= t AND src <> dst GROUP BY ALL),
mut AS (SELECT m.* FROM med m SEMI JOIN med b ON m.t = b.t AND m.src = b.dst AND m.dst = b.src), top AS (SELECT * FROM mut QUALIFY row_number() OVER (PARTITION BY t, src ORDER BY prob DESC, dst) <= 2),
kept AS (SELECT a.* FROM top a SEMI JOIN top b ON a.t = b.t AND a.src = b.dst AND a.dst = b.src),
reach(t, node, other) AS (SELECT DISTINCT t, src, src FROM kept UNION SELECT r.t, r.node, k.dst FROM reach r JOIN kept k ON r.t = k.t AND r.other = k.src),
comp AS (SELECT t, node, min(other) AS p FROM reach GROUP BY 1, 2), big AS (SELECT * FROM comp QUALIFY count(*) OVER (PARTITION BY t, p) >= 5),
tru AS (SELECT t, p_partkey AS node, p_partkey // 7 AS s FROM part, th), pr AS (SELECT b.t, b.node, p FROM big b JOIN tru USING (t, node)),
pn AS (SELECT t, p, count(*) AS pn FROM pr GROUP BY 1, 2), tn AS (SELECT t, s, count(*) AS tn FROM tru GROUP BY 1, 2), it AS (SELECT t, p, s, count(*) AS n FROM pr JOIN tru USING (t, node) GROUP BY ALL),
bst AS (SELECT t, s, max(n / (pn + tn - n)) AS b FROM it JOIN pn USING (t, p) JOIN tn USING (t, s) GROUP BY ALL)"""


@query("e17_coverage_by_threshold", sql("edges", "SELECT 'all' AS cloud_id, t::DOUBLE AS threshold, avg(coalesce(b, 0)) AS mcov, sum(coalesce(b, 0) * tn) / sum(tn) AS mwcov FROM tn LEFT JOIN bst USING (t, s) GROUP BY t", "cloud_id", "threshold mcov mwcov", BY_THRESHOLD))
def _(s, d):
    p = F.col("p_partkey")
    truth = table(s, d, "part").select(F.lit("all").alias("cloud_id"), p.alias("point_id"), F.floor(p / 7).alias("seg_id"), p.cast("double").alias("x"), (p * 31 % 64).cast("double").alias("y"), (p % 5).cast("double").alias("z"))
    return E.coverage_by_threshold(A.edges(s, d), truth, (0.6, 0.7, 0.9))


@query("e18_region_metrics", sql("scored", "SELECT group_id, tp, fp, fn, precision, recall, f1, tp / (tp + fp + fn + 1e-16) AS iou, 2 * tp / (2 * tp + fp + fn + 1e-16) AS dice FROM prf", "group_id, tp, fp, fn", "precision recall f1 iou dice", PRF.replace("FROM scored", "FROM scored WHERE item_id % 3 <> 0")))
def _(s, d):
    return E.region_metrics(A.scored(s, d), F.col("item_id") % 3 != 0, 0.05)


@query("e19_propagate_nearest", sql("cloud3", "SELECT cloud_id, src AS point_id, t_seg_id AS seg_id FROM near", "cloud_id, point_id, seg_id", "", "far AS (SELECT * FROM cloud3 WHERE y > 0.1), " + near_sql("cloud3", "far", 1)))
def _(s, d):
    c = A.cloud3(s, d)
    return C.upsample_labels(c, c.where("y > 0.1")).select("cloud_id", "point_id", "seg_id")


BINS = "ed AS (SELECT group_id, quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS e, quantile_cont(score, 0.99) AS t FROM scored WHERE score > 0 GROUP BY 1), bn AS (SELECT group_id, item_id, score, len(list_filter(e, lambda v: v <= score))::VARCHAR AS bin FROM scored JOIN ed USING (group_id) WHERE score > 0 UNION ALL SELECT group_id, item_id, score, 'top' FROM scored JOIN ed USING (group_id) WHERE score > 0 AND score >= t)"


@query("e20_quantile_bins", sql("scored", "SELECT * FROM bn", "group_id, item_id, bin", "", BINS))
def _(s, d):
    return E.quantile_bins(A.scored(s, d).withColumnRenamed("score", "value")).select("group_id", "item_id", "bin")


@query("e21_metrics_by_bin", sql("scored", "SELECT group_id, bin, count(*) FILTER (score >= 0.05 AND target = 1) AS tp, count(*) FILTER (score >= 0.05 AND target = 0) AS fp, count(*) FILTER (score < 0.05 AND target = 0) AS tn, count(*) FILTER (score < 0.05 AND target = 1) AS fn FROM (SELECT group_id, 'global' AS bin, score, target FROM scored UNION ALL SELECT b.group_id, CASE WHEN k = 0 THEN 'binned' ELSE b.bin END, s.score, s.target FROM bn b JOIN scored s USING (group_id, item_id), range(2) r(k) WHERE k = 1 OR b.bin <> 'top') GROUP BY ALL", "group_id, bin, tp, fp, tn, fn", "", BINS))
def _(s, d):
    sc = A.scored(s, d)
    return E.metrics_by_bin(sc, E.quantile_bins(sc.withColumnRenamed("score", "value")), 0.05).select("group_id", "bin", "tp", "fp", "tn", "fn")


#: Rows of all regions, and their counts by region and data set.
REGIONS = BINS + ", rg AS (SELECT group_id, 'global' AS bin, score, target FROM scored UNION ALL SELECT b.group_id, CASE WHEN k = 0 THEN 'binned' ELSE b.bin END, s.score, s.target FROM bn b JOIN scored s ON s.group_id = b.group_id AND s.item_id = b.item_id, (VALUES (0), (1)) v(k) WHERE k = 1 OR b.bin <> 'top')"
COUNTED = "count(*) FILTER (score >= 0.05 AND target = 1) AS tp, count(*) FILTER (score >= 0.05 AND target = 0) AS fp, count(*) FILTER (score < 0.05 AND target = 0) AS tn, count(*) FILTER (score < 0.05 AND target = 1) AS fn"
RATED = "2 * (tp / (tp + fp + 1e-16)) * (tp / (tp + fn + 1e-16)) / (tp / (tp + fp + 1e-16) + tp / (tp + fn + 1e-16) + 1e-16) AS f1"


@query("e21_region_rollup", sql("scored", f"SELECT *, {RATED}, tp / (tp + fp + fn + 1e-16) AS iou FROM (SELECT bin, group_id, grouping(bin) * 2 + grouping(group_id) AS level, {COUNTED} FROM rg GROUP BY GROUPING SETS ((bin, group_id), (bin)) UNION ALL SELECT NULL, NULL, 3, {COUNTED} FROM scored)", "bin, group_id, level::INT AS level, tp, fp, tn, fn", "f1 iou", REGIONS))
def _(s, d):
    sc = A.scored(s, d)
    return E.region_rollup(sc, E.quantile_bins(sc.withColumnRenamed("score", "value")), 0.05).select("bin", "group_id", "level", "tp", "fp", "tn", "fn", "f1", "iou")


@query("e21_region_pivot", sql("scored", f"SELECT bin, avg(f1) AS mean, " + ", ".join(f"max(f1) FILTER (group_id = '{g}') AS {g}" for g in ("de", "en", "es", "fr")) + f" FROM (SELECT *, {RATED} FROM (SELECT bin, group_id, {COUNTED} FROM rg GROUP BY ALL)) WHERE group_id IN ('de', 'en', 'es', 'fr') GROUP BY bin", "bin", "mean de en es fr", REGIONS))
def _(s, d):
    sc = A.scored(s, d)
    return E.region_pivot(sc, E.quantile_bins(sc.withColumnRenamed("score", "value")), 0.05, datasets=["de", "en", "es", "fr"])


def runs(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    return o.select(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("dataset"), F.col("o_orderkey").alias("ts"), F.create_map(F.lit("a"), F.col("o_totalprice"), F.lit("b"), F.col("o_totalprice") % 1000).alias("metrics"))


@query("e22_compare_runs", "WITH r AS (SELECT o_orderpriority AS model, o_orderstatus AS dataset, o_orderkey AS ts, (o_totalprice + o_totalprice % 1000) / 2 AS m FROM orders), o AS (SELECT model, dataset, arg_min(m, ts) AS old_mean, arg_max(m, ts) AS new_mean FROM r GROUP BY ALL) SELECT model, dataset, round(old_mean, 6) AS old_mean, round(new_mean, 6) AS new_mean, new_mean > old_mean AS better FROM o")
def _(s, d):
    r = runs(s, d)
    return E.compare_runs(r.groupBy("model", "dataset").agg(F.min_by("metrics", "ts").alias("metrics")), E.latest_best(r))


@query("e23_latest_best", "SELECT o_orderpriority AS model, o_orderstatus AS dataset, max(o_orderkey) AS ts, arg_max(o_totalprice, o_orderkey) AS a FROM orders GROUP BY ALL")
def _(s, d):
    return E.latest_best(runs(s, d)).select("model", "dataset", "ts", F.col("metrics")["a"].alias("a"))


@query("e24_early_stop", sql("history", "SELECT epoch, loss, counter, counter >= 10 AS stop FROM (SELECT epoch, loss, sum(worse) OVER (PARTITION BY run ORDER BY epoch)::BIGINT AS counter FROM (SELECT *, sum(up) OVER (ORDER BY epoch) AS run FROM (SELECT *, (best IS NULL OR loss < best)::INT AS up, coalesce((loss > best)::INT, 0) AS worse FROM (SELECT *, min(loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM history))))", "epoch, counter, stop", "loss"))
def _(s, d):
    return E.early_stop(A.history(s, d).withColumn("run", F.lit("r"))).drop("run")


#: A run's losses folded in order; a loss must beat the best one by more than a thousandth of the largest.
STOPPING = "hs AS (SELECT *, row_number() OVER (ORDER BY epoch) AS i FROM history), reach(i, epoch, loss, best, counter) AS (SELECT i, epoch, loss, loss, 0::BIGINT FROM hs WHERE i = 1 UNION ALL SELECT h.i, h.epoch, h.loss, CASE WHEN best - h.loss > 500 THEN h.loss ELSE best END, CASE WHEN best - h.loss > 500 THEN 0 WHEN best - h.loss < 500 THEN counter + 1 ELSE counter END FROM reach r JOIN hs h ON h.i = r.i + 1)"


@query("e24_early_stop_delta", sql("history", "SELECT epoch, loss, counter, counter >= 10 AS stop FROM reach", "epoch, counter, stop", "loss", STOPPING))
def _(s, d):
    return E.early_stop(A.history(s, d).withColumn("run", F.lit("r")), min_delta=500.0).drop("run")


@query("e24_early_stop_score", sql("history", "SELECT epoch, loss, counter, counter >= 10 AS stop FROM reach", "epoch, counter, stop", "loss", STOPPING.replace("best - h.loss > 500", "h.loss > best").replace("best - h.loss < 500", "h.loss < best")))
def _(s, d):
    return E.early_stop(A.history(s, d).withColumn("run", F.lit("r")), higher=True).drop("run")


@query("e27_cross_entropy", "WITH l AS (SELECT label AS group_id, [e::DOUBLE FOR e IN embedding[1:4]] AS g, vec_id % 4 AS t FROM embeddings), q AS (SELECT group_id, avg(ln(list_sum([exp(e) FOR e IN g])) - g[t + 1]) AS cross_entropy FROM l GROUP BY 1) SELECT group_id, round(cross_entropy, 6) + 0.0 AS cross_entropy FROM q")
def _(s, d):
    return E.cross_entropy(table(s, d, "embeddings").select(F.col("label").alias("group_id"), F.transform(F.slice("embedding", 1, 4), lambda e: e.cast("double")).alias("logits"), (F.col("vec_id") % 4).alias("target")))


@query("e25_bce", sql("scored", f"SELECT group_id, avg({CE}) AS bce, coalesce(avg({CE}) FILTER (target = 1), 0) + coalesce(avg({CE}) FILTER (target = 0), 0) AS bce_by_class FROM scored GROUP BY 1", "group_id", "bce bce_by_class"))
def _(s, d):
    return E.bce(A.scored(s, d))


@query("e26_dice", sql("scored", "SELECT group_id, 1 - (2 * sum(score * target) + 1e-16) / (sum(score * score) + sum(target * target) + 1e-16) AS dice, 1 - (2 * sum(a * target) + 1e-16) / (sum(a * a) + sum(target * target) + 1e-16) AS adaptive_dice FROM (SELECT *, score * pow(1 - score, 0.1) AS a FROM scored) GROUP BY 1", "group_id", "dice adaptive_dice"))
def _(s, d):
    return E.dice(A.scored(s, d))


@query("e27_losses", sql("scored", f"SELECT group_id, avg({CE}) + 1 - (2 * sum(score * target) + 1e-16) / (sum(score * score) + sum(target * target) + 1e-16) AS bce_dice, avg({CE} * CASE WHEN target = 1 THEN 1 ELSE 0.1 END) AS wbce, avg(pow(1 - CASE WHEN target = 1 THEN score ELSE 1 - score END, 0.25) * {CE}) AS focal FROM scored GROUP BY 1", "group_id", "bce_dice wbce focal"))
def _(s, d):
    return E.losses(A.scored(s, d))


@query("e27_bce_mse", sql("voxels", f"SELECT image_id, avg({CE}) + 0.1 * (coalesce(avg(pow(score - up, 2)), 0) + coalesce(avg(pow(score - down, 2)), 0)) AS bce_mse FROM (SELECT *, lead(score) OVER w AS up, lag(score) OVER w AS down FROM (SELECT image_id, z, y, x, value / 120000 AS score, (value >= 50000)::INT AS target FROM voxels) WINDOW w AS (PARTITION BY image_id, y, x ORDER BY z)) GROUP BY 1", "image_id", "bce_mse"))
def _(s, d):
    return E.bce_mse(A.voxels(s, d).withColumns({"score": F.col("value") / 120000, "target": (F.col("value") >= 50000).cast("int")}))


#: How much of each one's skeleton lies in the other.
LYING = "SELECT s.image_id, (sum(s.value * m.value) + 1) / (sum(s.value) + 1) AS {0} FROM {1} s JOIN {2} m ON s.image_id = m.image_id AND s.z = m.z AND s.y = m.y AND s.x = m.x GROUP BY 1"


@query("e28_centreline_dice", sql("voxels", f"SELECT image_id, 1 - 2 * p * s / (p + s) AS cldice FROM ({LYING.format('p', 'ps1', 'tr')}) JOIN ({LYING.format('s', 'ts1', 'pd')}) USING (image_id)", "image_id", "cldice", "pd AS (SELECT image_id, z, y, x, value / 120000 AS value FROM voxels), tr AS (SELECT image_id, z, y, x, (value >= 50000)::DOUBLE AS value FROM voxels), " + skeleton_sql("pd", 1, "p") + ", " + skeleton_sql("tr", 1, "t")))
def _(s, d):
    v, i = both(s, d)
    v = cut(v, "voxels")
    return E.centreline_dice(v.withColumn("value", F.col("value") / 120000), v.withColumn("value", (F.col("value") >= 50000).cast("double")), i, 1)


@query("e29_mask_diagonal", sql("edges", "SELECT 'drop' AS mode, group_id, src, dst, score, target FROM se WHERE src <> dst UNION ALL SELECT 'force', group_id, src, dst, CASE WHEN src = dst THEN 1 ELSE score END, CASE WHEN src = dst THEN 1 ELSE target END FROM se", "mode, group_id, src, dst, target", "score", SE))
def _(s, d):
    e = scored_edges(s, d)
    return E.mask_diagonal(e).withColumn("mode", F.lit("drop")).unionByName(E.mask_diagonal(e, "force").withColumn("mode", F.lit("force")))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

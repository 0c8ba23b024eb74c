"""The driver's tables as spatial tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatialseg.runtime import table


def points(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select(F.col("event_type").alias("cloud_id"), F.col("user_id").alias("seg_id"), e.alias("point_id"), e.alias("ord"), F.col("value").alias("x"), (e * 7919 % 500).cast("double").alias("y"), (e * 104729 % 50).cast("double").alias("z"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select(F.lit("all").alias("cloud_id"), F.col("l_linenumber").alias("patch_id"), F.col("l_partkey").alias("a"), (F.col("l_partkey") + 1 + F.col("l_suppkey") % 3).alias("b"), F.round(1 - 5 * F.col("l_discount"), 2).alias("prob"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return l.select("cloud_id", "patch_id", ends.alias("e"), "prob").select("cloud_id", "patch_id", "e.src", "e.dst", "prob")


def voxels(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    keys = [(F.col("l_suppkey") % 8).alias("image_id"), (F.col("l_linenumber") - 1).alias("z"), F.col("l_quantity").cast("int").alias("y"), (F.col("l_partkey") % 64).cast("int").alias("x")]
    return l.groupBy(*keys).agg(F.max("l_extendedprice").alias("value"))


def images(spark: SparkSession, d: str) -> DataFrame:
    """Sizes, type and pixel size of the images that ``voxels`` has."""
    return voxels(spark, d).select("image_id").distinct().select("image_id", F.lit(7).alias("nz"), F.lit(51).alias("ny"), F.lit(64).alias("nx"), F.element_at(F.array(*map(F.lit, ("uint8", "int8", "uint16", "float32"))), (F.col("image_id") % 4 + 1).cast("int")).alias("dtype"), (F.col("image_id") + 2).cast("double").alias("pixel_size"), F.lit(10.0).alias("off_x"), F.lit(20.0).alias("off_y"), F.lit(30.0).alias("off_z"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("lang").alias("group_id"), F.col("doc_id").alias("item_id"), F.least(F.col("n_chars") / 40000.0, F.lit(1.0)).alias("score"), F.col("quality").alias("target"))


def cloud3(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, d, "embeddings").select(F.lit("all").alias("cloud_id"), F.col("vec_id").alias("point_id"), F.col("label").cast("long").alias("seg_id"), *[F.element_at(v, i + 1).cast("double").alias(c) for i, c in enumerate("xyz")])


def history(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.to_date("o_orderdate").cast("string").alias("epoch")).agg(F.max("o_totalprice").alias("loss"))


VIEWS = {
    "points": "points AS (SELECT event_type AS cloud_id, user_id AS seg_id, event_id AS point_id, event_id AS ord, value AS x, ((event_id * 7919) % 500)::DOUBLE AS y, ((event_id * 104729) % 50)::DOUBLE AS z FROM events)",
    "edges": "pairs AS (SELECT 'all' AS cloud_id, l_linenumber AS patch_id, l_partkey AS a, l_partkey + 1 + l_suppkey % 3 AS b, round(1 - 5 * l_discount, 2) AS prob FROM lineitem), edges AS (SELECT cloud_id, patch_id, a AS src, b AS dst, prob FROM pairs UNION ALL SELECT cloud_id, patch_id, b, a, prob FROM pairs)",
    "voxels": "voxels AS (SELECT l_suppkey % 8 AS image_id, l_linenumber - 1 AS z, l_quantity::INT AS y, (l_partkey % 64)::INT AS x, max(l_extendedprice) AS value FROM lineitem GROUP BY ALL)",
    "images": "images AS (SELECT DISTINCT image_id, 7 AS nz, 51 AS ny, 64 AS nx, ['uint8', 'int8', 'uint16', 'float32'][(image_id % 4 + 1)::INT] AS dtype, (image_id + 2)::DOUBLE AS pixel_size, 10.0::DOUBLE AS off_x, 20.0::DOUBLE AS off_y, 30.0::DOUBLE AS off_z FROM voxels)",
    "scored": "scored AS (SELECT lang AS group_id, doc_id AS item_id, least(n_chars / 40000.0::DOUBLE, 1.0::DOUBLE) AS score, quality AS target FROM labels JOIN documents USING (doc_id))",
    "cloud3": "cloud3 AS (SELECT 'all' AS cloud_id, vec_id AS point_id, label::BIGINT AS seg_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)",
    "history": "history AS (SELECT o_orderdate::DATE::VARCHAR AS epoch, max(o_totalprice) AS loss FROM orders GROUP BY 1)",
}

"""Tables that come from sources or go to sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spatialseg.functions.geometry import AXES, SEGMENT
from spatialseg.operators.project import dense_ids


def pair_images_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Each image with the mask of its stem that is first by priority; unpaired ones are marked."""
    first = Window.partitionBy("stem").orderBy("priority", "mask")
    best = masks.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("stem", "mask")
    return images.join(best, "stem", "left").withColumn("paired", F.col("mask").isNotNull())


def check_layout(pairs: DataFrame) -> DataFrame:
    """Whether a split has as many masks as images, and any."""
    return pairs.groupBy("split").agg(F.count("stem").alias("images"), F.count("mask").alias("masks")).withColumn("valid", (F.col("images") == F.col("masks")) & (F.col("images") > 0))


def to_spatial_graph_tables(points: DataFrame, labels: dict[str, DataFrame] | None = None, scores: DataFrame | None = None) -> dict[str, DataFrame]:
    """Vertex, edge, point and label tables: edge i leads from vertex 2i to 2i + 1, the first and last point of segment i. Points of no segment are in none of them."""
    p = F.struct(*AXES)
    seg = points.groupBy(*SEGMENT).agg(F.min_by(p, "ord").alias("a"), F.max_by(p, "ord").alias("b"), F.count(F.lit(1)).alias("n_points"))
    seg = dense_ids(seg.where("seg_id is not null").withColumn("edge_id", F.col("seg_id")), ["cloud_id"], "edge_id")
    edge = seg.select("cloud_id", "edge_id", (F.col("edge_id") * 2).alias("v0"), (F.col("edge_id") * 2 + 1).alias("v1"), "n_points")
    if scores is not None:
        edge = edge.join(seg.select(*SEGMENT, "edge_id").join(scores, SEGMENT).drop("seg_id"), ["cloud_id", "edge_id"], "left")
    vertex = seg.select("cloud_id", "edge_id", F.posexplode(F.array("a", "b")).alias("k", "v")).select("cloud_id", (F.col("edge_id") * 2 + F.col("k")).alias("v_id"), "v.*")
    ordered = Window.partitionBy(*SEGMENT).orderBy("ord")
    point = points.withColumn("ord", F.row_number().over(ordered) - 1).join(seg.select(*SEGMENT, "edge_id"), SEGMENT).select("cloud_id", "edge_id", "ord", *AXES)
    label = None
    for i, (name, members) in enumerate(sorted((labels or {}).items())):
        part = seg.join(members.select(*SEGMENT).distinct().withColumn("_in", F.lit(i + 1)), SEGMENT, "left").select("cloud_id", "edge_id", F.lit(name).alias("label"), F.coalesce("_in", F.lit(0)).alias("value"))
        label = part if label is None else label.unionByName(part)
    out = {"sg_vertex": vertex, "sg_edge": edge, "sg_point": point}
    return out | ({"sg_label": label} if label is not None else {})


def tile_report(tiles: DataFrame, images: DataFrame, keep_if: float) -> DataFrame:
    r = tiles.groupBy("image_id").agg(F.count(F.lit(1)).alias("tiles"), F.count_if(F.col("value") > keep_if).alias("saved"), F.min("value").alias("low"), F.max("value").alias("high"))
    return r.join(images.select("image_id", "pixel_size"), "image_id").withColumn("saved_pct", 100.0 * F.col("saved") / F.col("tiles"))


def prediction_stats(points: DataFrame, large: int = 1000, medium: int = 250) -> DataFrame:
    """Points and instances of each cloud, the sizes of its instances (one number each) and whether any is large."""
    n = points.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("cloud_id").agg(F.sum("n").alias("points"), F.count(F.lit(1)).alias("instances"), F.array_sort(F.collect_list("n")).alias("sizes"), F.bool_or(F.col("n") > large).alias(f"any_{large}"), F.bool_or(F.col("n") > medium).alias("any_large"))


def resume_pending(files: DataFrame, done: DataFrame) -> DataFrame:
    return files.join(done, "image_id", "left_anti")

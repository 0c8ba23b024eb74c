"""Labelled sets from their files: a reader, a scale and a kind of graph for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatialseg.functions.geometry import AXES
from spatialseg.operators.cloud import downsample_medoid, scale_cloud
from spatialseg.operators.graph import load_labelled_dataset
from spatialseg.runtime import cut
from spatialseg.sources.files import ingest_spatial_graphs, read_ply_points, read_points_csv, read_scene_txt

#: The cell that clouds of a kind are thinned by, which then becomes their unit.
CELLS: dict[str, float | None] = {"filament": None, "part": 0.05, "indoor": 0.05, "room": None}


def read_labelled(spark: SparkSession, kind: str, path: str, palette: DataFrame | None = None) -> DataFrame:
    """(cloud_id, seg_id, point_id, ord, x, y, z) of the files of a kind.

    Filaments are CSV files or spatial graphs (``.am``) of ordered points in physical
    units; a number before the first underscore of a file's name is its pixel size, and
    coordinates become pixels. Parts and indoor scans are PLY files whose colours are
    classes, rooms are folders of one text file for each instance. Points get numbers
    that hold for the tables that are made from this one read.
    """
    if kind == "filament":
        if path.rstrip("/").lower().endswith(".am"):
            p = ingest_spatial_graphs(spark, path)["sg_point"].select("cloud_id", F.col("edge_id").cast("long").alias("seg_id"), "ord", *AXES)
            p = p.withColumn("point_id", F.monotonically_increasing_id())
        else:
            p = read_points_csv(spark, path)
        px = F.regexp_extract("cloud_id", r"([^/]+)$", 1)
        px = F.coalesce(F.nullif(F.regexp_extract(px, r"^([0-9]+(?:\.[0-9]+)?)_", 1).try_cast("double"), F.lit(0.0)), F.lit(1.0))
        p = p.withColumn("_px", px)
        return cut(p.select("cloud_id", "seg_id", "point_id", F.col("ord").cast("int").alias("ord"), *[(F.col(c) / F.col("_px")).alias(c) for c in AXES]), "labelled")
    if kind not in CELLS:
        raise ValueError(f"no labelled set of kind {kind}: {', '.join(CELLS)}")
    p = read_scene_txt(spark, path) if kind == "room" else read_ply_points(spark, path, palette)
    p = p.withColumn("point_id", F.monotonically_increasing_id()).withColumn("ord", F.lit(0))
    return cut(p.select("cloud_id", "seg_id", "point_id", "ord", *AXES), "labelled")


def load_labelled_files(spark: SparkSession, kind: str, path: str, cell: float | None = None, max_points: int = 500, palette: DataFrame | None = None) -> dict[str, DataFrame]:
    """``load_labelled_dataset`` of the files of a kind, thinned by ``cell`` or the kind's own."""
    points = read_labelled(spark, kind, path, palette)
    size = cell or CELLS[kind]
    if size and kind != "filament":
        thin = downsample_medoid(points.where("seg_id is not null"), size).withColumn("ord", F.lit(0))
        points = scale_cloud(cut(thin.select(points.columns), "thin"), size)
    elif size:
        points = scale_cloud(points, size)
    return load_labelled_dataset(points, kind, max_points=max_points)

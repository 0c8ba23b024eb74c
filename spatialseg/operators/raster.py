"""Points and polylines to voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatialseg.functions.geometry import along

CELL = ["cloud_id", "z", "y", "x"]


def interpolate_polyline(points: DataFrame) -> DataFrame:
    """Lattice walk along the dominant axis between consecutive points, the last point included. All axes move; halves round up."""
    w = along()
    p = points.withColumns({c: F.round(c).cast("long") for c in "xyz"})
    p = p.withColumns({f"_d{c}": F.lead(c).over(w) - F.col(c) for c in "xyz"})
    p = p.withColumn("_n", F.coalesce(F.greatest(*[F.abs(F.col(f"_d{c}")) for c in "xyz"]), F.lit(1)))
    p = p.withColumn("_k", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_n"), F.lit(1)) - 1)))
    moved = {c: (F.col(c) + F.when(F.coalesce(F.col(f"_d{c}"), F.lit(0)) == 0, 0).otherwise(F.signum(f"_d{c}") * F.floor((2 * F.col("_k") * F.abs(F.col(f"_d{c}")) + F.col("_n")) / (2 * F.col("_n"))))).cast("int") for c in "xyz"}
    return p.select("cloud_id", "seg_id", "ord", F.col("_k").cast("int").alias("k"), *[e.alias(c) for c, e in moved.items()])


def ball_offsets(spark: SparkSession, r: int) -> DataFrame:
    """Lattice offsets within ``r``, without the outer round(2r/6) layers in z."""
    trim = round(2 * r / 6)
    rows = [(z, y, x) for z in range(-r, r + 1) for y in range(-r, r + 1) for x in range(-r, r + 1) if z * z + y * y + x * x <= r * r and abs(z) <= r - trim]
    return spark.createDataFrame(rows, "dz int, dy int, dx int")


def disk_offsets(spark: SparkSession, r: int) -> DataFrame:
    """Offsets in a plane strictly within ``r``."""
    rows = [(0, y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if y * y + x * x < r * r]
    return spark.createDataFrame(rows, "dz int, dy int, dx int")


def stamp(cells: DataFrame, offsets: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Each cell at all offsets, a small constant list, inside the frame."""
    rows = [tuple(r) for r in offsets.collect()]  # the offsets of one radius
    near = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dz", "dy", "dx"), r, strict=True)]) for r in rows])).alias("_o")
    s = cells.select("*", near).withColumns({c: F.col(c) + F.col(f"_o.d{c}") for c in "zyx"}).drop("_o")
    return s.where(" and ".join(f"{c} >= 0 and {c} < {n}" for c, n in zip("zyx", dims, strict=True)))


def stamps(spark: SparkSession, r: int, flat: bool) -> DataFrame:
    return disk_offsets(spark, r) if flat else ball_offsets(spark, r)


def draw_instances(points: DataFrame, dims: tuple[int, int, int], px: float, diameter: float) -> DataFrame:
    """Filaments drawn with round cross-section; value is the id + 1, the later id on top."""
    r = int((diameter // 2) // px)
    drawn = stamp(interpolate_polyline(points), stamps(points.sparkSession, r, dims[0] == 1), dims)
    return drawn.groupBy(*CELL).agg((F.max("seg_id") + 1).alias("value"))


def draw_points_mask(points: DataFrame, dims: tuple[int, int, int], px: float, diameter: float) -> DataFrame:
    r = int((diameter // 2) // px)
    cells = points.select("cloud_id", *[F.round(c).cast("int").alias(c) for c in "zyx"]).distinct()
    return stamp(cells, stamps(points.sparkSession, r, dims[0] == 1), dims).select(*CELL).distinct().withColumn("value", F.lit(1))


def draw_semantic(points: DataFrame, dims: tuple[int, int, int], px: float, thickness: float) -> DataFrame:
    cells = points.select("cloud_id", *[F.round(c).cast("int").alias(c) for c in "zyx"]).distinct()
    return stamp(cells, stamps(points.sparkSession, round(thickness / 2 / px), dims[0] == 1), dims).select(*CELL).distinct().withColumn("value", F.lit(1))


def draw_instances_membrane(points: DataFrame, dims: tuple[int, int, int], px: float, thickness: float) -> DataFrame:
    """As draw_semantic, with the id of the last point on top."""
    cells = points.select("cloud_id", "seg_id", "point_id", *[F.round(c).cast("int").alias(c) for c in "zyx"])
    return stamp(cells, stamps(points.sparkSession, round(thickness / 2 / px), dims[0] == 1), dims).groupBy(*CELL).agg(F.max_by("seg_id", "point_id").alias("value"))


def project_to_voxels(points: DataFrame, attr: str, px: float) -> DataFrame:
    cells = points.select("cloud_id", *[F.floor(F.col(c) / px).cast("int").alias(c) for c in "zyx"], attr)
    return cells.groupBy(*CELL).agg(F.max(attr).alias("value"))

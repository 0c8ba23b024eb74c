"""Filaments against surfaces and poles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spatialseg.functions.geometry import AXES, SEGMENT, distance, norm
from spatialseg.operators.filament import endpoints
from spatialseg.operators.knn import knn


def count_true_runs(rows: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """Number of maximal runs of true."""
    w = Window.partitionBy(*keys).orderBy(order)
    starts = F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))
    return rows.withColumn("_s", starts.cast("int")).groupBy(*keys).agg(F.sum("_s").alias("runs"))


def consecutive_runs(rows: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Runs of integers with step 1: first, last and size of each."""
    w = Window.partitionBy(*keys).orderBy(n)
    # equal numbers have equal ranks, so they need not be made distinct; a run's size follows from its ends
    island = rows.select(*keys, n).withColumn("_i", F.col(n) - F.dense_rank().over(w))
    size = F.coalesce(F.col("last") - F.col("first") + 1, F.lit(1)).cast("long")  # a null is a run of its own
    return island.groupBy(*keys, "_i").agg(F.min(n).alias("first"), F.max(n).alias("last")).select(*keys, "first", "last", size.alias("size"))


def fill_gaps(rows: DataFrame, keys: list[str], n: str, most: int) -> DataFrame:
    """Missing integers inserted where the step is at most ``most``."""
    w = Window.partitionBy(*keys).orderBy(n)
    nxt = F.lead(n).over(w)
    p = rows.select(*keys, n).distinct().withColumn("_next", nxt)
    upto = F.when((F.col("_next") - F.col(n)) <= most, F.col("_next") - 1).otherwise(F.col(n))
    return p.select(*keys, F.explode(F.sequence(F.col(n), upto)).alias(n))


def distance_to_pole(points: DataFrame, poles: DataFrame) -> DataFrame:
    """Points against the few poles of their cloud."""
    p = poles.select("cloud_id", "pole_id", *[F.col(c).alias(f"p_{c}") for c in AXES])
    q = points.withColumns({f"q_{c}": F.col(c) for c in AXES})
    return q.join(p, "cloud_id").select("cloud_id", "point_id", "pole_id", distance("q_", "p_").alias("dist"))


def nearest_vertex(points: DataFrame, mesh: DataFrame, t: float) -> DataFrame:
    """Distance of each point to the nearest vertex, and whether it is within ``t``."""
    near = knn(points, mesh, 1)
    return near.select("cloud_id", F.col("src").alias("point_id"), F.col("dst").alias("vertex_id"), "dist", (F.col("dist") <= t).alias("within"))


def end_distances(mesh: DataFrame, poles: DataFrame, ends: DataFrame) -> DataFrame:
    surface = knn(ends, mesh, 1).select("cloud_id", F.col("src").alias("point_id"), F.col("dist").alias("to_surface"))
    pole = distance_to_pole(ends, poles).groupBy("cloud_id", "point_id").agg(F.min("dist").alias("to_pole"))
    return surface.join(pole, ["cloud_id", "point_id"])


def order_poles(poles: DataFrame, mesh: DataFrame) -> DataFrame:
    """The pole nearer to the centroid of the surface is first."""
    c = mesh.groupBy("cloud_id").agg(*[F.avg(x).alias(f"m_{x}") for x in AXES])
    d = norm([F.col(x) - F.col(f"m_{x}") for x in AXES])
    return poles.join(c, "cloud_id").withColumn("_d", d).withColumn("pole_order", F.row_number().over(Window.partitionBy("cloud_id").orderBy("_d", "pole_id"))).select("cloud_id", "pole_id", "pole_order")


def segments_in_box(mesh: DataFrame, points: DataFrame) -> DataFrame:
    """Segments both of whose ends lie in the bounding box of the mesh."""
    box = mesh.groupBy("cloud_id").agg(*[f(c).alias(f"{n}_{c}") for c in AXES for n, f in (("lo", F.min), ("hi", F.max))])
    j = endpoints(points).join(box, "cloud_id")
    for s in "ab":
        for c in AXES:
            j = j.where((F.col(f"{s}_{c}") >= F.col(f"lo_{c}")) & (F.col(f"{s}_{c}") <= F.col(f"hi_{c}")))
    return j.select(*SEGMENT)


def assign_to_pole(points: DataFrame, poles: DataFrame) -> DataFrame:
    """The pole that an end of a segment comes nearest to, ties to the pole that is nearest to any end of the cloud and then to the smaller id; whether the order must be turned for the pole end to be last."""
    e = endpoints(points)
    p = poles.select("cloud_id", "pole_id", *[F.col(c).alias(f"p_{c}") for c in AXES])
    j = e.join(p, "cloud_id").select(*SEGMENT, "pole_id", distance("a_", "p_").alias("_a"), distance("b_", "p_").alias("_b"))
    overall = j.groupBy("cloud_id", "pole_id").agg(F.min(F.least("_a", "_b")).alias("_o"))
    best = j.join(overall, ["cloud_id", "pole_id"]).groupBy(*SEGMENT).agg(F.min(F.struct(F.least("_a", "_b").alias("dist"), F.col("_o"), F.col("pole_id"), (F.col("_a") < F.col("_b")).alias("turn"))).alias("_m"))
    return best.select(*SEGMENT, "_m.pole_id", "_m.dist", "_m.turn")


def classify_filaments(points: DataFrame, mesh: DataFrame, poles: DataFrame, gap: float = 100.0, surf_dist: float = 1000.0) -> DataFrame:
    """(cloud_id, seg_id, group) by the ends' distances: attached (an end within ``gap`` of the surface; inside if both ends are in its box), mid (an end within ``surf_dist`` of the surface), bridging (near both poles), interdigitating (ends nearer to different poles), remaining."""
    e = endpoints(points)
    ends = e.select("cloud_id", F.col("a_point_id").alias("point_id"), *[F.col(f"a_{c}").alias(c) for c in AXES]).unionByName(e.select("cloud_id", F.col("b_point_id").alias("point_id"), *[F.col(f"b_{c}").alias(c) for c in AXES]))
    surface = knn(ends.dropDuplicates(["cloud_id", "point_id"]), mesh, 1).select("cloud_id", F.col("src").alias("_p"), F.col("dist").alias("_s"))
    by_pole = distance_to_pole(ends.dropDuplicates(["cloud_id", "point_id"]), poles).groupBy("cloud_id", F.col("point_id").alias("_p")).agg(F.min(F.struct("dist", "pole_id")).alias("_m")).select("cloud_id", "_p", "_m.dist", "_m.pole_id")
    sides = {}
    for s in "ab":
        part = surface.join(by_pole, ["cloud_id", "_p"]).select("cloud_id", F.col("_p").alias(f"{s}_point_id"), F.col("_s").alias(f"{s}_s"), F.col("dist").alias(f"{s}_d"), F.col("pole_id").alias(f"{s}_pole"))
        sides[s] = part
    j = e.join(sides["a"], ["cloud_id", "a_point_id"]).join(sides["b"], ["cloud_id", "b_point_id"])
    j = j.join(segments_in_box(mesh, points).withColumn("_in", F.lit(True)), SEGMENT, "left")
    near_a, near_b = F.col("a_s") <= gap, F.col("b_s") <= gap
    pole = F.when(F.col("a_d") <= F.col("b_d"), F.col("a_pole")).otherwise(F.col("b_pole"))
    group = (
        F.when(near_a | near_b, F.concat(F.lit("attached_"), pole.cast("string"), F.when(F.col("_in"), "_inside").otherwise("_outside")))
        .when(F.least("a_s", "b_s") <= surf_dist, "mid")
        .when((F.col("a_pole") != F.col("b_pole")) & (F.greatest("a_d", "b_d") <= surf_dist), "bridging")
        .when(F.col("a_pole") != F.col("b_pole"), "interdigitating")
        .otherwise("remaining")
    )
    return j.select(*SEGMENT, group.alias("group"))

"""Point clouds: down-sampling, patches, labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatialseg import runtime
from spatialseg.functions.geometry import AXES
from spatialseg.operators.knn import knn
from spatialseg.operators.project import dense_ids, digest, prefix_sums
from spatialseg.operators.quantiles import group_quantiles


def foreground_points(voxels: DataFrame) -> DataFrame:
    return voxels.where(F.col("value") > 0).select("image_id", *[F.col(c).cast("double").alias(c) for c in AXES])


def centroids(points: DataFrame, cell: float, keys: list[str]) -> DataFrame:
    """Mean of the points of each occupied cell."""
    g = [F.floor(F.col(c) / cell).alias(f"g{c}") for c in AXES]
    return points.groupBy(*keys, *g).agg(*[F.avg(c).alias(c) for c in AXES], F.count(F.lit(1)).alias("n"), F.min("point_id").alias("point_id"))


def voxel_downsample(points: DataFrame, cell: float, keys: list[str] | None = None) -> DataFrame:
    return centroids(points, cell, keys or ["cloud_id"])


def nearest_original(points: DataFrame, cell: float, carry: list[str]) -> DataFrame:
    """Centroids and, as t_ columns, what their nearest original point has."""
    c = centroids(points, cell, ["cloud_id"])
    near = knn(c, points, 1, carry=carry)
    return c.join(near.withColumnRenamed("src", "point_id").drop("rank"), ["cloud_id", "point_id"])


def downsample_labels(points: DataFrame, cell: float) -> DataFrame:
    return nearest_original(points, cell, ["seg_id"]).select("cloud_id", "gx", "gy", "gz", *AXES, F.col("t_seg_id").alias("seg_id"))


def downsample_medoid(points: DataFrame, cell: float) -> DataFrame:
    return nearest_original(points, cell, ["seg_id"]).select("cloud_id", F.col("dst").alias("point_id"), F.col("t_seg_id").alias("seg_id"), *[F.col(f"t_{c}").alias(c) for c in AXES])


def downsample_rgb(points: DataFrame, cell: float) -> DataFrame:
    """Centroids with the colour of their nearest original point."""
    return nearest_original(points, cell, ["r", "g", "b"]).select("cloud_id", *AXES, *[F.col(f"t_{c}").alias(c) for c in "rgb"])


def random_downsample(points: DataFrame, frac: float, seed: int = 0) -> DataFrame:
    """Keeps int(n * frac) points of each cloud, by the order of a hash: the bound comes from counts by hash bucket, and only the bucket at the bound is ranked."""
    buckets = 4096
    p = points.withColumn("_h", digest("point_id", F.lit(seed))).withColumn("_b", F.floor(F.col("_h") / ((1 << 60) // buckets)))
    sizes = p.groupBy("cloud_id", "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("cloud_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(upto), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy("cloud_id"))})
    ranked = p.join(sizes, ["cloud_id", "_b"]).withColumn("_r", F.row_number().over(Window.partitionBy("cloud_id", "_b").orderBy("_h", "point_id")))
    return ranked.where(F.col("_before") + F.col("_r") <= F.floor(F.col("_all") * frac)).select(points.columns)


def bounding_box(points: DataFrame, expand: float = 0.1) -> DataFrame:
    """Ends of each axis, pushed out by a share of the half extent."""
    b = points.groupBy("cloud_id").agg(*[f(c).alias(f"{n}_{c}") for c in AXES for n, f in (("lo", F.min), ("hi", F.max))])
    more = {c: (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / 2 * expand for c in AXES}
    return b.select("cloud_id", *[(F.col(f"lo_{c}") - more[c]).alias(f"lo_{c}") for c in AXES], *[(F.col(f"hi_{c}") + more[c]).alias(f"hi_{c}") for c in AXES])


def patch_counts(bbox: DataFrame, size: float | Column) -> DataFrame:
    """Centres along each axis, two at least; half as many in z."""
    n = {c: F.greatest(F.ceil((F.col(f"hi_{c}") - F.col(f"lo_{c}")) / size), F.lit(2)).cast("int") for c in AXES}
    n["z"] = F.greatest(F.floor(n["z"] / 2), F.lit(2)).cast("int")
    return bbox.select("*", *[n[c].alias(f"n_{c}") for c in AXES])


def patch_grid(bbox: DataFrame, size: float) -> DataFrame:
    """Evenly spaced patch centres from end to end."""
    g = patch_counts(bbox, size)
    for c in AXES:
        g = g.withColumn(f"i_{c}", F.explode(F.sequence(F.lit(0), F.col(f"n_{c}") - 1)))
    pid = (F.col("i_x") * F.col("n_y") + F.col("i_y")) * F.col("n_z") + F.col("i_z")
    return g.select("cloud_id", pid.alias("patch_id"), *[(F.col(f"lo_{c}") + F.col(f"i_{c}") * (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / (F.col(f"n_{c}") - 1)).alias(f"c_{c}") for c in AXES])


def points_in_patches(points: DataFrame, bbox: DataFrame, size: float | Column, overlap: float = 0.15) -> DataFrame:
    """(cloud_id, patch_id, point_id): every patch whose box holds the point. Boxes reach half the distance of centres, and the overlap, so none of the space is left out; candidates come from index arithmetic."""
    return boxes_of(points, patch_counts(bbox, size), overlap).select("cloud_id", F.col("patch_id").cast("int").alias("patch_id"), "point_id")


def boxes_of(points: DataFrame, grid: DataFrame, overlap: float) -> DataFrame:
    """Points with the rows of their cloud's ``grid``, once for each patch that holds them, patch_id added."""
    j = points.join(grid, "cloud_id")
    for c in AXES:
        step = (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / (F.col(f"n_{c}") - 1)
        at = F.when(step > 0, (F.col(c) - F.col(f"lo_{c}")) / step).otherwise(0.0)
        reach = 0.5 * (1 + overlap)
        first, last = F.greatest(F.ceil(at - reach - 1e-9), F.lit(0)).cast("int"), F.least(F.floor(at + reach + 1e-9).cast("int"), F.col(f"n_{c}") - 1)
        j = j.withColumn(f"i_{c}", F.explode(F.sequence(first, last)))
    # small boxes are more than an int counts
    return j.withColumn("patch_id", (F.col("i_x").cast("long") * F.col("n_y") + F.col("i_y")) * F.col("n_z") + F.col("i_z"))


def choose_patch_size(points: DataFrame, max_points: int, overlap: float = 0.15, batch: int = 8) -> float:
    """A tenth of the x extent, less a fixed step until no patch has more points; from the step on a quarter of the last size again and again, down to a 64th of the step, which is taken as it is. A batch of sizes is counted by one job."""
    boxes = runtime.cut(bounding_box(points), "boxes")
    b = boxes.agg(F.max(F.col("hi_x") - F.col("lo_x")), F.max(F.col("hi_y") - F.col("lo_y"))).first()
    size, step = float(b[0]) / 10, max(float(b[1]) / 100, 1e-6)
    while True:
        tried = [s for s in (size - i * step for i in range(batch)) if s > step] or [size / 2]
        grids = patch_counts(boxes.withColumn("_size", F.explode(F.array(*map(F.lit, tried)))), F.col("_size"))
        counted = boxes_of(points, grids, overlap).groupBy("_size", "cloud_id", "patch_id").count().groupBy("_size").agg(F.max("count").alias("worst"))
        worst = {r["_size"]: r["worst"] for r in counted.collect()}  # one row a size
        for s in tried:
            if worst[s] <= max_points or s <= step / 64:
                return s
        size = tried[-1] - step if tried[-1] - step > step else tried[-1] / 2


#: Most centres of random patches that are broadcast.
CENTRES = 100_000


def random_patches(points: DataFrame, max_points: int = 500, n: int = 10, seed: int = 0, ratio: float = 1.01) -> DataFrame:
    """(cloud_id, patch_id, half, point_id): cubes around ``n`` points of each cloud, drawn by a hash. A cube is the largest of a geometric row of sizes that holds at most ``max_points``, found from counts by size, so that no cube's points are sorted or gathered."""
    drawn = F.row_number().over(Window.partitionBy("cloud_id").orderBy("_h", "point_id"))
    # the n smallest hashes of each part of a cloud hold those of the cloud
    parts = Window.partitionBy("cloud_id", "_p").orderBy("_h", "point_id")
    p = points.withColumn("_h", F.xxhash64("point_id", F.lit(seed))).withColumn("_p", F.pmod(F.xxhash64("point_id"), F.lit(runtime.shuffle_width(points.sparkSession))))
    centres = p.withColumn("_k", F.row_number().over(parts)).where(F.col("_k") <= n).withColumn("patch_id", drawn - 1).where(F.col("patch_id") < n)
    centres = runtime.cut(centres.select("cloud_id", "patch_id", *[F.col(c).alias(f"c_{c}") for c in AXES]), "centres")
    if centres.count() <= CENTRES:  # a few a cloud: then no point is shuffled to meet them
        centres = F.broadcast(centres)
    far = F.greatest(*[F.abs(F.col(c) - F.col(f"c_{c}")) for c in AXES])
    bin_ = F.when(far > 0, F.ceil(F.ln(far) / math.log(ratio))).otherwise(-(1 << 20)).cast("int")
    near = points.join(centres, "cloud_id").withColumn("_bin", bin_)
    upto = Window.partitionBy("cloud_id", "patch_id").orderBy("_bin")
    sizes = near.groupBy("cloud_id", "patch_id", "_bin").agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.sum("_n").over(upto))
    best = sizes.where((F.col("_upto") <= max_points) | (F.col("_upto") == F.col("_n"))).groupBy("cloud_id", "patch_id").agg(F.max("_bin").alias("_most"))
    return near.join(best, ["cloud_id", "patch_id"]).where(F.col("_bin") <= F.col("_most")).select("cloud_id", "patch_id", F.pow(F.lit(ratio), F.col("_most")).alias("half"), "point_id")


def next_starts(patches: DataFrame, max_points: int) -> DataFrame:
    """(cloud_id, _i, _j): where the group that starts with patch ``_i`` ends and the next one starts, from prefix sums of the patches' counts ``n``.

    The next start is the patch in whose span of the sums the limit falls, or the one
    after ``_i`` where that patch alone is above it. Spans and limits meet in cells of
    ``max_points``, which hold no more than that many of each.
    """
    first, last = F.col("_sum") - F.col("n"), F.col("_sum") - 1
    spans = patches.select("cloud_id", F.explode(F.sequence(F.floor(first / max_points), F.floor(last / max_points))).alias("_cell"), first.alias("_at"), F.lit(0).alias("_asks"), "_i", "_sum")
    limits = patches.select("cloud_id", F.floor((first + max_points) / max_points).alias("_cell"), (first + max_points).alias("_at"), F.lit(1).alias("_asks"), "_i", "_sum")
    upto = Window.partitionBy("cloud_id", "_cell").orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = spans.unionByName(limits).withColumn("_span", F.last(F.when(F.col("_asks") == 0, F.struct("_i", "_sum")), ignorenulls=True).over(upto))
    inside = F.when(F.col("_span._sum") > F.col("_at"), F.col("_span._i"))
    return met.where("_asks = 1").select("cloud_id", "_i", F.greatest(inside, F.when(inside.isNotNull(), F.col("_i") + 1)).alias("_j")).where("_j is not null")


def starts_of_groups(steps: DataFrame) -> DataFrame:
    """(cloud_id, _i) of all patches that the chain of next starts from patch 0 comes by. Pointers reach four times as far in each round."""
    reached = runtime.cut(steps.select("cloud_id", F.lit(0).cast("long").alias("_i")).distinct(), "starts")
    jump = steps
    while True:
        over = lambda left, by, to: left.join(jump.select("cloud_id", F.col("_i").alias(by), F.col("_j").alias(to)), ["cloud_id", by], "left")  # noqa: B023, E731
        far = over(over(over(jump.select("cloud_id", "_i", F.col("_j").alias("_1")), "_1", "_2"), "_2", "_3"), "_3", "_4")
        far = runtime.cut(far.select("cloud_id", "_i", "_1", "_2", "_3", "_4"), "jumps")
        new = reached.join(far, ["cloud_id", "_i"]).select("cloud_id", F.explode(F.array("_1", "_2", "_3")).alias("_i")).where("_i is not null")
        before, reached = reached, runtime.cut(reached.unionByName(new), "starts")
        if reached.count() == before.count():
            return reached
        jump = far.where("_4 is not null").select("cloud_id", "_i", F.col("_4").alias("_j"))


def merge_small_patches(members: DataFrame, max_points: int) -> DataFrame:
    """Neighbouring patches joined first-fit in patch order while they fit; a patch that is too large stays alone."""
    sizes = members.groupBy("cloud_id", "patch_id").agg(F.count(F.lit(1)).alias("n"))
    patches = runtime.cut(prefix_sums(sizes, ["cloud_id"], "patch_id", "n"), "patches")
    steps = runtime.cut(next_starts(patches, max_points), "next")
    alone = patches.where("_i = 0").select("cloud_id", "_i")  # of clouds that are one group
    starts = starts_of_groups(steps).unionByName(alone).distinct().withColumn("_starts", F.lit(1))
    marked = patches.join(starts, ["cloud_id", "_i"], "left").select("cloud_id", "patch_id", F.coalesce("_starts", F.lit(0)).alias("_starts"))
    merged = prefix_sums(marked, ["cloud_id"], "patch_id", "_starts").select("cloud_id", "patch_id", (F.col("_sum") - 1).cast("int").alias("merged_id"))
    return members.join(merged, ["cloud_id", "patch_id"]).select("cloud_id", F.col("merged_id").alias("patch_id"), "point_id").distinct()


def build_patches(points: DataFrame, max_points: int = 500, overlap: float = 0.15, size: float | None = None) -> DataFrame:
    """(cloud_id, patch_id, local_idx, point_id): small clouds are one patch, others overlapping boxes of at most ``max_points`` points."""
    count = points.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("_n"))
    small = points.join(count.where(F.col("_n") <= max_points), "cloud_id", "left_semi").select("cloud_id", F.lit(0).alias("patch_id"), "point_id")
    large = points.join(count.where(F.col("_n") > max_points), "cloud_id", "left_semi")
    if not large.isEmpty():
        size = size or choose_patch_size(large, max_points, overlap)
        small = small.unionByName(merge_small_patches(boxes_of(large, patch_counts(bounding_box(large), size), overlap).select("cloud_id", "patch_id", "point_id"), max_points))
    return small.withColumn("local_idx", F.row_number().over(Window.partitionBy("cloud_id", "patch_id").orderBy("point_id")) - 1)


def normalize_ids(points: DataFrame, by: list[str]) -> DataFrame:
    return dense_ids(points, by, "seg_id")


def upsample_labels(full: DataFrame, sampled: DataFrame) -> DataFrame:
    """Every point takes the label of its nearest sampled point."""
    near = knn(full, sampled, 1, carry=["seg_id"])
    return full.drop("seg_id").join(near.select("cloud_id", F.col("src").alias("point_id"), F.col("t_seg_id").alias("seg_id")), ["cloud_id", "point_id"])


def scale_cloud(points: DataFrame, px: float, factor: float = 1.0) -> DataFrame:
    return points.withColumns({c: F.col(c) / (px * factor) for c in AXES})


def median_nn_distance(points: DataFrame) -> DataFrame:
    near = knn(points, points, 1, exclude_self=True)
    return group_quantiles(near, ["cloud_id"], "dist", [0.5], "_q").select("cloud_id", F.col("_q")[0].alias("median_nn"))


def labels_from_color(points: DataFrame) -> DataFrame:
    """Distinct colours as dense labels, in order of colour; a colour with a null has no label."""
    known = F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull()
    return dense_ids(points.drop("seg_id").withColumn("seg_id", F.when(known, F.struct("r", "g", "b"))), [], "seg_id")


def train_test_split(tiles: DataFrame, seed: int = 0, holdout: tuple[str, ...] = ()) -> DataFrame:
    """``tiles`` with split: images that ``holdout`` names are test, whole. Of the others, under 1000 tiles one image in five gives four tiles, where it has more than ten; else a 25th of the tiles, 1000 above 62 500."""
    named = F.coalesce(F.col("image_id").cast("string").isin(*holdout), F.lit(False)) if holdout else F.lit(False)
    rest = tiles.where(~named)
    n = rest.count()
    if n < 1000:
        w = Window.partitionBy("image_id").orderBy(digest("tz", "ty", "tx", F.lit(seed)), "tz", "ty", "tx")
        chosen = digest("image_id", F.lit(seed)) % 5 == 0
        test = chosen & (F.count(F.lit(1)).over(Window.partitionBy("image_id")) > 10) & (F.row_number().over(w) <= 4)
    else:
        share = 1000 / n if n > 62_500 else 1 / 25
        test = digest("image_id", "tz", "ty", "tx", F.lit(seed)) < int(share * (1 << 60))
    split = rest.withColumn("split", F.when(test, "test").otherwise("train"))
    return split.unionByName(tiles.where(named).withColumn("split", F.lit("test"))) if holdout else split


def one_hot_class(points: DataFrame, n: int = 200) -> DataFrame:
    return points.withColumn("one_hot", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == F.col("seg_id")).cast("double")))

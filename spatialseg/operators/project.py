"""Projections, filters and predicates on points and voxels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatialseg import runtime


def to_physical(points: DataFrame, images: DataFrame, key: str = "cloud_id") -> DataFrame:
    """Pixel coordinates to ångström: coordinate times pixel size plus offset."""
    j = points.join(images.select(key, "pixel_size", "off_x", "off_y", "off_z"), key)
    return j.withColumns({c: F.col(c) * F.col("pixel_size") + F.col(f"off_{c}") for c in "xyz"}).select(points.columns)


def to_pixel(points: DataFrame, images: DataFrame, key: str = "cloud_id", unit: str = "A") -> DataFrame:
    """The inverse; coordinates in nm are divided by a tenth of the pixel size."""
    scale = F.col("pixel_size") / (10.0 if unit == "nm" else 1.0)
    j = points.join(images.select(key, "pixel_size", "off_x", "off_y", "off_z"), key)
    return j.withColumns({c: (F.col(c) - F.col(f"off_{c}")) / scale for c in "xyz"}).select(points.columns)


def rescale_plan(images: DataFrame, target_px: float | None) -> DataFrame:
    scale = F.lit(1.0) if target_px is None else F.col("pixel_size") / F.lit(float(target_px))
    return images.withColumn("scale", scale).select("image_id", "scale", *[(F.col(f"n{c}") * F.col("scale")).cast("int").alias(f"new_n{c}") for c in "zyx"])


def threshold(voxels: DataFrame, t: float) -> DataFrame:
    """1 from ``t`` up, else 0; ``t`` = 0 keeps the values."""
    return voxels if t == 0 else voxels.withColumn("value", F.when(F.col("value") >= t, 1).otherwise(0))


def per_image(voxels: DataFrame, **stats) -> DataFrame:
    """Voxels with aggregates of their image; a join of the few aggregates, not a window over an image."""
    return voxels.join(voxels.groupBy("image_id").agg(*[e.alias(n) for n, e in stats.items()]), "image_id")


def threshold_half_max(voxels: DataFrame) -> DataFrame:
    return per_image(voxels, _top=F.max("value")).withColumn("value", (F.col("value") > F.col("_top") / 2).cast("int")).drop("_top")


def drop_singletons(points: DataFrame) -> DataFrame:
    many = points.groupBy("cloud_id", "seg_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return points.join(many, ["cloud_id", "seg_id"], "left_semi")


def ensure_3d(points: DataFrame) -> DataFrame:
    return points.withColumn("z", F.coalesce(F.col("z").cast("double"), F.lit(0.0)) if "z" in points.columns else F.lit(0.0))


def clear_border(voxels: DataFrame, images: DataFrame, voxel: int | None = None) -> DataFrame:
    """Zero a frame in y and x of 1 % of the dimension, 1 to 5 voxels (or ``voxel``)."""
    j = voxels.join(images.select("image_id", "ny", "nx"), "image_id")
    wide = {c: F.lit(voxel) if voxel else F.greatest(F.lit(1), F.least(F.lit(5), F.round(F.col(f"n{c}") * 0.01).cast("int"))) for c in "yx"}
    inside = (F.col("y") >= wide["y"]) & (F.col("y") < F.col("ny") - wide["y"]) & (F.col("x") >= wide["x"]) & (F.col("x") < F.col("nx") - wide["x"])
    return j.withColumn("value", F.when(inside, F.col("value")).otherwise(0.0)).select(voxels.columns)


def trim_to_points(voxels: DataFrame, points: DataFrame) -> DataFrame:
    """Voxels in the bounding box of an image's points, half-open, and moved to its corner."""
    box = points.groupBy("image_id").agg(*[F.greatest(F.min(c).cast("int"), F.lit(0)).alias(f"_lo_{c}") for c in "zyx"], *[F.max(c).cast("int").alias(f"_hi_{c}") for c in "zyx"])
    j = voxels.join(box, "image_id")
    for c in "zyx":
        j = j.where((F.col(c) >= F.col(f"_lo_{c}")) & (F.col(c) < F.col(f"_hi_{c}"))).withColumn(c, F.col(c) - F.col(f"_lo_{c}"))
    return j.select(voxels.columns)


def center_crop(voxels: DataFrame, images: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    j = voxels.join(images.select("image_id", "nz", "ny", "nx"), "image_id")
    for c, s in zip("zyx", size, strict=True):
        low = F.greatest(F.floor(F.col(f"n{c}") / 2).cast("int") - s // 2, F.lit(0))
        j = j.where((F.col(c) >= low) & (F.col(c) < low + s)).withColumn(c, (F.col(c) - low).cast("int"))
    return j.select(voxels.columns)


def align_common_extent(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both volumes cut to their common extent from the origin."""
    ext = lambda v, p: v.groupBy("image_id").agg(*[(F.max(c) + 1).alias(f"{p}{c}") for c in "zyx"])
    common = ext(a, "_a").join(ext(b, "_b"), "image_id").select("image_id", *[F.least(f"_a{c}", f"_b{c}").alias(f"_n{c}") for c in "zyx"])

    def cut_to(v: DataFrame) -> DataFrame:
        return v.join(common, "image_id").where(" and ".join(f"{c} < _n{c}" for c in "zyx")).select(v.columns)

    return cut_to(a), cut_to(b)


def binary_check(voxels: DataFrame) -> DataFrame:
    """Per image: distinct values, capped by what can be told from minimum, maximum and the values strictly between."""
    j = per_image(voxels, _lo=F.min("value"), _hi=F.max("value"))
    between = F.count_if((F.col("value") > F.col("_lo")) & (F.col("value") < F.col("_hi")))
    out = j.groupBy("image_id", "_lo", "_hi").agg(between.alias("_between"))
    state = F.when(F.col("_lo") == F.col("_hi"), "single").when(F.col("_between") == 0, "binary").otherwise("error")
    return out.select("image_id", F.col("_lo").alias("low"), F.col("_hi").alias("high"), state.alias("state"))


def mask_from_label(voxels: DataFrame, labels: list) -> DataFrame:
    return voxels.withColumn("value", F.col("value").isin(labels).cast("int"))


def flip(voxels: DataFrame, images: DataFrame, axis: str) -> DataFrame:
    return voxels.join(images.select("image_id", f"n{axis}"), "image_id").withColumn(axis, F.col(f"n{axis}") - 1 - F.col(axis)).select(voxels.columns)


def rot90(voxels: DataFrame, images: DataFrame, k: int) -> DataFrame:
    """Quarter turns in the plane of y and x, counter-clockwise."""
    j = voxels.join(images.select("image_id", "ny", "nx"), "image_id")
    y, x, ny, nx = (F.col(c) for c in ("y", "x", "ny", "nx"))
    turned = [(y, x), (nx - 1 - x, y), (ny - 1 - y, nx - 1 - x), (x, ny - 1 - y)][k % 4]
    return j.withColumns({"y": turned[0], "x": turned[1]}).select(voxels.columns)


def digest(*parts: str | Column) -> Column:
    """A reproducible number in [0, 2^60) from columns and parameters."""
    text = F.concat_ws(":", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def random_flip(voxels: DataFrame, images: DataFrame, seed: int = 0) -> DataFrame:
    """One axis for each image: of ten states, 0 to 3 flip z, 4 to 6 y, 7 to 9 x."""
    state = digest("image_id", F.lit(seed)) % 10
    j = voxels.join(images.select("image_id", "nz", "ny", "nx"), "image_id").withColumn("_s", state)
    new = {c: F.when((F.col("_s") >= lo) & (F.col("_s") <= hi), F.col(f"n{c}") - 1 - F.col(c)).otherwise(F.col(c)) for c, lo, hi in (("z", 0, 3), ("y", 4, 6), ("x", 7, 9))}
    return j.withColumns(new).select(voxels.columns)


#: Codes of drawn transforms: flips of z, y and x, one to three quarter turns, none.
FLIPS, TURNS, NOTHING = {"z": 0, "y": 1, "x": 2}, {1: 3, 2: 4, 3: 5}, 6
MOST_DRAWS = 3


def drawn(key: str, seed: int, draw: Column, what: str, below: int) -> Column:
    """A reproducible number from 0 on for a draw of an image."""
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(str(seed)), draw.cast("string"), F.lit(what)))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % below).cast("int")


def transform_plan(images: DataFrame, seed: int = 0) -> DataFrame:
    """A row an image: ``ops``, one to three drawn transforms, and what they come to, one integer map. New coordinate c is ``c.sign`` * (old coordinate ``c.axis``) + ``c.off``; nz, ny and nx are the new sides.

    A draw is a flip or a turn, equally often. A flip is of z in four of ten cases, of
    y and x in three each; a turn is none in four of nine, a quarter in three, a half in
    two, in one direction in four of ten and in the other else.
    """

    def op(i: Column) -> Column:
        state, turns = drawn("image_id", seed, i, "flip", 10), drawn("image_id", seed, i, "turns", 9)
        quarters = F.when(turns <= 3, 0).when(turns <= 6, 1).otherwise(2)
        back = drawn("image_id", seed, i, "way", 10) > 3
        turn = F.when(quarters == 0, NOTHING).when(quarters == 2, TURNS[2]).when(back, TURNS[3]).otherwise(TURNS[1])
        flip_ = F.when(state <= 3, FLIPS["z"]).when(state <= 6, FLIPS["y"]).otherwise(FLIPS["x"])
        return F.when(drawn("image_id", seed, i, "which", 2) == 0, flip_).otherwise(turn)

    n = 1 + drawn("image_id", seed, F.lit(0), "draws", MOST_DRAWS)
    planned = images.select("image_id", *[F.col(f"n{c}").cast("int").alias(f"n{c}") for c in "zyx"], F.transform(F.sequence(F.lit(1), n), op).alias("ops"))
    start = F.struct(*[F.struct(F.lit(i).alias("axis"), F.lit(1).alias("sign"), F.lit(0).alias("off")).alias(c) for i, c in enumerate("zyx")], *[F.col(f"n{c}") for c in "zyx"])

    def then(s: Column, o: Column) -> Column:
        turned = lambda c: F.struct(s[c]["axis"].alias("axis"), (-s[c]["sign"]).alias("sign"), (s[f"n{c}"] - 1 - s[c]["off"]).alias("off"))
        same = {c: F.struct(*[s[c][f].alias(f) for f in ("axis", "sign", "off")]) for c in "zyx"}
        z = F.when(o == FLIPS["z"], turned("z")).otherwise(same["z"])
        y = F.when((o == FLIPS["y"]) | (o == TURNS[2]), turned("y")).when(o == TURNS[1], turned("x")).when(o == TURNS[3], same["x"]).otherwise(same["y"])
        x = F.when((o == FLIPS["x"]) | (o == TURNS[2]), turned("x")).when(o == TURNS[1], same["y"]).when(o == TURNS[3], turned("y")).otherwise(same["x"])
        swap = o.isin(TURNS[1], TURNS[3])
        return F.struct(z.alias("z"), y.alias("y"), x.alias("x"), s["nz"].alias("nz"), F.when(swap, s["nx"]).otherwise(s["ny"]).alias("ny"), F.when(swap, s["ny"]).otherwise(s["nx"]).alias("nx"))

    return planned.select("image_id", "ops", F.aggregate("ops", start, then).alias("_s")).select("image_id", "ops", "_s.*")


def apply_transforms(voxels: DataFrame, plan: DataFrame) -> DataFrame:
    """Voxels, with whatever columns they have, moved by the map of their image in one projection; images without a plan stay."""
    j = voxels.join(plan.select("image_id", *[F.col(c).alias(f"_m{c}") for c in "zyx"]), "image_id", "left")
    new = {}
    for c in "zyx":
        m = F.col(f"_m{c}")
        old = F.when(m["axis"] == 0, F.col("z")).when(m["axis"] == 1, F.col("y")).otherwise(F.col("x"))
        new[c] = F.coalesce(m["sign"] * old + m["off"], F.col(c)).cast(voxels.schema[c].dataType)
    return j.withColumns(new).select(voxels.columns)


def rotation_average(scored: DataFrame, images: DataFrame) -> DataFrame:
    """Mean of the scores of four rotated copies (column ``k``) at the voxel they stem from. Image sides must be even among rotations: ny and nx are those of the unrotated image."""
    j = scored.join(images.select("image_id", "ny", "nx"), "image_id")
    y, x, ny, nx, k = (F.col(c) for c in ("y", "x", "ny", "nx", "k"))
    back_y = F.when(k == 0, y).when(k == 1, x).when(k == 2, ny - 1 - y).otherwise(ny - 1 - x)
    back_x = F.when(k == 0, x).when(k == 1, nx - 1 - y).when(k == 2, nx - 1 - x).otherwise(y)
    return j.select("image_id", "z", back_y.alias("y"), back_x.alias("x"), "value").groupBy("image_id", "z", "y", "x").agg(F.avg("value").alias("value"))


def sigmoid(voxels: DataFrame) -> DataFrame:
    return voxels.withColumn("value", 1 / (1 + F.exp(-F.col("value"))))


def crop_around_points(voxels: DataFrame, points: DataFrame, images: DataFrame, size: int) -> DataFrame:
    """(point_id, dz, dy, dx, value) of the voxels in a window around each point, moved so that it stays inside. Points and voxels meet by blocks of the window's size."""
    j = points.join(images.select("image_id", "nz", "ny", "nx"), "image_id")
    low = {c: F.greatest(F.least(F.floor(c).cast("int") - size // 2, F.col(f"n{c}") - size), F.lit(0)) for c in "zyx"}
    w = j.select("image_id", "point_id", *[low[c].alias(f"_{c}") for c in "zyx"])
    for c in "zyx":
        w = w.withColumn(f"_b{c}", F.explode(F.sequence(F.floor(F.col(f"_{c}") / size), F.floor((F.col(f"_{c}") + size - 1) / size))))
    v = voxels.withColumns({f"_b{c}": F.floor(F.col(c) / size) for c in "zyx"})
    met = v.join(w, ["image_id", "_bz", "_by", "_bx"])
    for c in "zyx":
        met = met.where((F.col(c) >= F.col(f"_{c}")) & (F.col(c) < F.col(f"_{c}") + size))
    return met.select("image_id", "point_id", *[(F.col(c) - F.col(f"_{c}")).alias(f"d{c}") for c in "zyx"], "value")


def prepare_tile(voxels: DataFrame, mask: DataFrame, images: DataFrame, size: int, seed: int | None = None, channels: int = 1) -> DataFrame:
    """Image and mask cut to a cube, moved alike by drawn transforms, the mask repeated for each channel."""
    cubes = [center_crop(v, images, (size,) * 3) for v in (voxels, mask)]
    both = cubes[0].join(cubes[1].withColumnRenamed("value", "mask"), ["image_id", "z", "y", "x"], "left").fillna(0, ["mask"])
    if seed is not None:
        dims = images.select("image_id", *[F.lit(size).alias(f"n{c}") for c in "zyx"])
        both = apply_transforms(both, transform_plan(dims, seed))
    return both.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """The condition that ``left``'s keys equal those of ``right``, which have _k_ before their names; nulls equal each other."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"_k_{c}"]) for c in keys], F.lit(True))


def dense_ids(df: DataFrame, keys: list[str], column: str, start: int = 0) -> DataFrame:
    """``column`` renumbered from ``start`` within ``keys``, by a rank over its distinct values. The values are dealt out by range and ranked within each range, which starts where the ranges before it end: a key may have any number of them. A null stays null and takes no number; a null key is a key."""
    spark = df.sparkSession
    names = df.where(F.col(column).isNotNull()).select(*keys, column).distinct().repartitionByRange(runtime.shuffle_width(spark), *keys, column).withColumn("_range", F.spark_partition_id())
    names = runtime.cut(names, "ids")  # ranges stay as they were dealt
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = names.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n")).select(*[F.col(c).alias(f"_k_{c}") for c in [*keys, "_range"]], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(column)) - 1
    ranked = names.withColumn("_inside", inside)
    ranked = ranked.join(starts, null_safe(ranked, starts, [*keys, "_range"])).select(*[F.col(c).alias(f"_k_{c}") for c in [*keys, column]], (F.col("_start") + F.col("_inside") + start).alias("_id"))
    return df.join(ranked, null_safe(df, ranked, [*keys, column]), "left").withColumn(column, F.col("_id").cast("long")).select(df.columns)


def prefix_sums(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, order, value, _i, _sum): the place of each row in its key by ``order``, whose values differ, from 0, and the sum of ``value`` up to it. Rows are dealt out by range, as in ``dense_ids``, so a key may have any number of them."""
    dealt = df.select(*keys, order, value).repartitionByRange(runtime.shuffle_width(df.sparkSession), *keys, order).withColumn("_range", F.spark_partition_id())
    dealt = runtime.cut(dealt, "sums")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    ranges = ranges.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    upto = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = dealt.withColumns({"_r": F.row_number().over(upto) - 1, "_t": F.sum(value).over(upto)})
    return inside.join(ranges, [*keys, "_range"]).select(*keys, order, value, (F.col("_n0") + F.col("_r")).cast("long").alias("_i"), (F.col("_s0") + F.col("_t")).alias("_sum"))

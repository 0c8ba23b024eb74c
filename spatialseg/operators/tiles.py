"""Tiles, stitching, resampling, morphology. Target cells are computed by arithmetic and exploded; no cross joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatialseg.operators.blocks import CELL, dilated, eroded, on_blocks
from spatialseg.runtime import cut

TILE = ["image_id", "tz", "ty", "tx"]


def tiles_along(dim: Column, size: int, overlap: int) -> Column:
    """Fewest tiles that cover a dimension."""
    return F.greatest(F.ceil(dim / size), F.ceil((dim - overlap) / (size - overlap)), F.lit(1)).cast("int")


def tile_counts_plan(images: DataFrame, size_xy: int, size_z: int, overlap: int) -> DataFrame:
    n = {c: tiles_along(F.col(f"n{c}"), size_z if c == "z" else size_xy, overlap if c != "z" or size_z > overlap else 0) for c in "zyx"}
    return images.select("image_id", "nz", "ny", "nx", *[n[c].alias(f"tiles_{c}") for c in "zyx"])


def tile_plan(images: DataFrame, size_xy: int, size_z: int, overlap: int) -> DataFrame:
    """A row for each tile: grid index, corner and padding at the far end of the axes."""
    p = tile_counts_plan(images, size_xy, size_z, overlap)
    for c in "zyx":
        p = p.withColumn(f"t{c}", F.explode(F.sequence(F.lit(0), F.col(f"tiles_{c}") - 1)))
    step = {c: (size_z if c == "z" else size_xy) - (overlap if c != "z" or size_z > overlap else 0) for c in "zyx"}
    return p.select(*TILE, *[(F.col(f"t{c}") * step[c]).alias(f"{c}0") for c in "zyx"])


def assign_tiles(voxels: DataFrame, images: DataFrame, size_xy: int, size_z: int, overlap: int) -> DataFrame:
    """Every voxel in each tile that covers it, with its place in the tile."""
    j = voxels.join(tile_counts_plan(images, size_xy, size_z, overlap).select("image_id", *[f"tiles_{c}" for c in "zyx"]), "image_id")
    for c in "zyx":
        size, lap = (size_z, overlap if size_z > overlap else 0) if c == "z" else (size_xy, overlap)
        step = size - lap
        first = F.greatest(F.floor((F.col(c) - size) / step) + 1, F.lit(0)).cast("int")
        last = F.least(F.floor(F.col(c) / step).cast("int"), F.col(f"tiles_{c}") - 1)
        j = j.withColumn(f"t{c}", F.explode(F.sequence(first, last))).withColumn(f"l{c}", F.col(c) - F.col(f"t{c}") * step)
    return j.select(*TILE, "z", "y", "x", "lz", "ly", "lx", "value")


def drop_empty_tiles(tile_voxels: DataFrame, mask: DataFrame, keep_if: float = 0.01) -> DataFrame:
    full = mask.groupBy(*TILE).agg(F.sum("value").alias("_s")).where(F.col("_s") > keep_if)
    return tile_voxels.join(full, TILE, "left_semi")


def tile_counts(tile_voxels: DataFrame, keep_if: float = 0.01) -> DataFrame:
    by_tile = tile_voxels.groupBy(*TILE).agg(F.sum("value").alias("_s"))
    return by_tile.groupBy("image_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("_s") > keep_if).alias("kept"))


def stitch_mean(tile_voxels: DataFrame) -> DataFrame:
    return tile_voxels.groupBy(*CELL).agg(F.avg("value").alias("value"))


def stitch_mask(tile_voxels: DataFrame) -> DataFrame:
    return tile_voxels.groupBy(*CELL).agg(F.max((F.col("value") > 0).cast("int")).alias("value"))


def with_target(images: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    return images.select("image_id", *[F.col(f"n{c}").alias(f"_s{c}") for c in "zyx"], *[F.lit(n).alias(f"_d{c}") for c, n in zip("zyx", dims, strict=True)])


def grid(images: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    g = with_target(images, dims)
    for c in "zyx":
        g = g.withColumn(c, F.explode(F.sequence(F.lit(0), F.col(f"_d{c}") - 1)))
    return g


def resample_nearest(voxels: DataFrame, images: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Each target cell takes the source cell at floor(i * source / target)."""
    g = grid(images, dims).withColumns({f"_i{c}": F.floor(F.col(c) * F.col(f"_s{c}") / F.col(f"_d{c}")).cast("int") for c in "zyx"})
    v = voxels.select("image_id", *[F.col(c).alias(f"_i{c}") for c in "zyx"], "value")
    return g.join(v, ["image_id", "_iz", "_iy", "_ix"]).select(*CELL, "value")


def resample_area(voxels: DataFrame, images: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Each target cell is the mean of the source cells floor(i s / d) to ceil((i + 1) s / d)."""
    j = voxels.join(with_target(images, dims), "image_id")
    for c in "zyx":
        s, d = F.col(f"_s{c}"), F.col(f"_d{c}")
        first, last = F.floor(F.col(c) * d / s).cast("int"), F.least(F.ceil((F.col(c) + 1) * d / s).cast("int"), d) - 1
        j = j.withColumn(f"_t{c}", F.explode(F.sequence(first, last)))
    return j.groupBy("image_id", *[F.col(f"_t{c}").alias(c) for c in "zyx"]).agg(F.avg("value").alias("value"))


def resample_linear(voxels: DataFrame, images: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Trilinear with half-pixel centres; absent source cells are 0."""
    g = grid(images, dims).withColumn("_w", F.lit(1.0))
    for c in "zyx":
        s, d = F.col(f"_s{c}"), F.col(f"_d{c}")
        at = F.greatest((F.col(c) + 0.5) * s / d - 0.5, F.lit(0.0))
        low = F.least(F.floor(at).cast("int"), s - 1)
        part = at - low
        ends = F.array(F.struct(low.alias("i"), (1 - part).alias("w")), F.struct(F.least(low + 1, s - 1).alias("i"), part.alias("w")))
        g = g.withColumn("_e", F.explode(ends)).withColumn(f"_i{c}", F.col("_e.i")).withColumn("_w", F.col("_w") * F.col("_e.w")).drop("_e")
    v = voxels.select("image_id", *[F.col(c).alias(f"_i{c}") for c in "zyx"], "value")
    return g.where("_w > 0").join(v, ["image_id", "_iz", "_iy", "_ix"]).groupBy(*CELL).agg(F.sum(F.col("_w") * F.col("value")).alias("value"))


#: Steps of the skeleton between two exchanges of halos, and the side of its blocks.
STEPS, SKELETON_SIDE = 8, 64


def same_type(out: DataFrame, voxels: DataFrame) -> DataFrame:
    return out.withColumn("value", F.col("value").cast(voxels.schema["value"].dataType))


def erode(voxels: DataFrame, images: DataFrame) -> DataFrame:
    """Each cell's minimum over itself and its six neighbours that are there; NaN and null count as absent."""
    return same_type(on_blocks(voxels, images, lambda a, _: {"value": eroded(a["value"])}, ["value"], ["value"], 1), voxels)


def dilate(voxels: DataFrame, images: DataFrame) -> DataFrame:
    """The maximum over the 27 cells around, of each cell of the frame that has one there."""
    return same_type(on_blocks(voxels, images, lambda a, frame: {"value": dilated(a["value"], frame)}, ["value"], ["value"], 1), voxels)


def opening(voxels: DataFrame, images: DataFrame) -> DataFrame:
    return same_type(on_blocks(voxels, images, lambda a, frame: {"value": dilated(eroded(a["value"]), frame)}, ["value"], ["value"], 2), voxels)


def soft_skeleton(voxels: DataFrame, images: DataFrame, iters: int, side: int = SKELETON_SIDE, steps: int = STEPS) -> DataFrame:
    """Sum of what openings of ever more eroded images leave: s + relu(d - s d) with d = relu(x - open(x)). ``steps`` iterations run inside a block; between such runs the image and the skeleton are written and dealt out anew."""

    def rest(x: np.ndarray, frame: np.ndarray) -> np.ndarray:
        return np.maximum(x - np.nan_to_num(dilated(eroded(x), frame)), 0.0)

    def run(n: int, first: bool):
        def compute(a: dict[str, np.ndarray], frame: np.ndarray) -> dict[str, np.ndarray]:
            x = a["value"]
            s = rest(x, frame) if first else a["skeleton"]
            for _ in range(n):
                x = eroded(x)
                d = rest(x, frame)
                s = s + np.maximum(d - s * d, 0.0)
            return {"value": x, "skeleton": s}

        return compute

    state, left, first = voxels.select(*CELL, "value"), iters, True
    while first or left:
        n = min(steps, left)
        given = ["value"] if first else ["value", "skeleton"]
        state = cut(on_blocks(state, images, run(n, first), given, ["value", "skeleton"], n + 2, side), "skeleton")
        left, first = left - n, False
    return state.select(*CELL, F.col("skeleton").alias("value"))

"""Volumes as blocks of dense arrays with halos, for operators that look at neighbours step after step.

A voxel goes to its own block and to those whose halo it lies in. With a halo as deep
as a run of steps reaches, the steps of the run need no further exchange: what is
shuffled for one is the volume of the blocks, once, and their faces times the depth.
Absent voxels are NaN inside a block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 32
CELL = ["image_id", "z", "y", "x"]


def in_blocks(voxels: DataFrame, images: DataFrame, side: int, halo: int) -> DataFrame:
    """Rows with _block, the number of a block of their image, and _at, the place in its array of (side + 2 halo) cubed; one row for each block that holds the voxel or has it in its halo."""
    j = voxels.join(images.select("image_id", *[F.col(f"n{c}").cast("long").alias(f"_n{c}") for c in "zyx"]), "image_id")
    block, at, edge = F.lit(0).cast("long"), F.lit(0), side + 2 * halo
    for c in "zyx":
        j = j.where((F.col(c) >= 0) & (F.col(c) < F.col(f"_n{c}")))
        last = F.floor((F.col(f"_n{c}") - 1) / side)
        first, end = F.greatest(F.floor((F.col(c) - halo) / side), F.lit(0)), F.least(F.floor((F.col(c) + halo) / side), last)
        j = j.withColumn(f"_b{c}", F.explode(F.sequence(first, end)))
        block = block * (last + 1) + F.col(f"_b{c}")
        at = at * edge + (F.col(c) - F.col(f"_b{c}") * side + halo).cast("int")
    return j.withColumns({"_block": block, "_at": at}).drop("_bz", "_by", "_bx")


def on_blocks(voxels: DataFrame, images: DataFrame, compute: Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]], inputs: list[str], outputs: list[str], halo: int, side: int = SIDE) -> DataFrame:
    """(image_id, z, y, x, outputs): ``compute`` gets arrays of the inputs over a block with its halo, and which of its cells lie in the frame; of its arrays the block's own cells are returned where the first is there. A block is a bounded group."""
    edge = side + 2 * halo
    image = voxels.schema["image_id"].dataType.simpleString()

    def run(key: tuple, t: pa.Table) -> pa.Table:
        image_id, nz, ny, nx, block = (k.as_py() for k in key)
        per = [-(-n // side) for n in (nz, ny, nx)]
        corner = np.array([block // (per[1] * per[2]), block // per[2] % per[1], block % per[2]]) * side
        at = t.column("_at").to_numpy()
        arrays = {}
        for name in inputs:
            a = np.full(edge**3, np.nan)
            a[at] = t.column(name).to_numpy(zero_copy_only=False).astype(float)
            arrays[name] = a.reshape(edge, edge, edge)
        inside = [(np.arange(edge) + c - halo >= 0) & (np.arange(edge) + c - halo < n) for c, n in zip(corner, (nz, ny, nx), strict=True)]
        frame = inside[0][:, None, None] & inside[1][None, :, None] & inside[2][None, None, :]
        done = compute(arrays, frame)
        core = (slice(halo, halo + side),) * 3
        own = [done[name][core] for name in outputs]
        places = np.nonzero(~np.isnan(own[0]) & frame[core])
        columns = [pa.array([image_id] * len(places[0]), t.schema.field("image_id").type), *[pa.array((p + c).astype(np.int32)) for p, c in zip(places, corner, strict=True)], *[pa.array(a[places]) for a in own]]
        return pa.Table.from_arrays(columns, names=[*CELL, *outputs])

    rows = in_blocks(voxels, images, side, halo).select("image_id", "_nz", "_ny", "_nx", "_block", "_at", *inputs)
    found = rows.groupBy("image_id", "_nz", "_ny", "_nx", "_block").applyInArrow(run, f"image_id {image}, z int, y int, x int, " + ", ".join(f"{n} double" for n in outputs))
    return found.select("image_id", *[F.col(c).cast(voxels.schema[c].dataType) for c in "zyx"], *outputs)


def eroded(a: np.ndarray) -> np.ndarray:
    """Minimum over a cell and its six neighbours that are there."""
    out = a.copy()
    for axis in range(3):
        o, x = np.moveaxis(out, axis, 0), np.moveaxis(a, axis, 0)
        np.fmin(o[1:], x[:-1], out=o[1:])
        np.fmin(o[:-1], x[1:], out=o[:-1])
    out[np.isnan(a)] = np.nan
    return out


def dilated(a: np.ndarray, frame: np.ndarray) -> np.ndarray:
    """Maximum over the 27 cells around, one axis after the other; cells outside the frame stay absent."""
    for axis in range(3):
        x = np.moveaxis(a, axis, 0)
        out = x.copy()
        np.fmax(out[1:], x[:-1], out=out[1:])
        np.fmax(out[:-1], x[1:], out=out[:-1])
        a = np.moveaxis(out, 0, axis)
    return np.where(frame, a, np.nan)

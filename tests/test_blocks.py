"""Volumes in blocks, quantile brackets in rounds, types' ranges and drawn transforms against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialseg.operators import blocks, metrics, norm, project, quantiles, tiles
from tests.test_operators import image_rows, shifted, soft_skeleton_of

VOXEL = "image_id string, z int, y int, x int, value double"


def frame_of(spark, shape, name="i"):
    return spark.createDataFrame([(name, *shape)], "image_id string, nz int, ny int, nx int")


def dense(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        assert np.isnan(out[r["z"], r["y"], r["x"]])
        out[r["z"], r["y"], r["x"]] = r["value"]
    return out


BOX = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
CROSS = [o for o in BOX if sum(map(abs, o)) <= 1]


@pytest.mark.parametrize("side", [4, 7, 64])
def test_steps_across_blocks(spark, monkeypatch, side):
    rng = np.random.default_rng(3)
    a = rng.random((9, 14, 17))
    a[rng.random(a.shape) < 0.5] = np.nan
    rows = [r for r in image_rows(a) if not np.isnan(r[4])]
    v, frame = spark.createDataFrame(rows, VOXEL), frame_of(spark, a.shape)
    with np.errstate(all="ignore"):
        wide = shifted(a, BOX, np.nan, lambda p: np.fmax.reduce(p))
        thin = np.where(np.isnan(a), np.nan, shifted(a, CROSS, np.nan, lambda p: np.fmin.reduce(p)))
        opened = shifted(thin, BOX, np.nan, lambda p: np.fmax.reduce(p))
    on = lambda f, halo: dense(blocks.on_blocks(v, frame, f, ["value"], ["value"], halo, side), a.shape)
    assert np.array_equal(on(lambda x, f: {"value": blocks.dilated(x["value"], f)}, 1), wide, equal_nan=True)
    assert np.array_equal(on(lambda x, f: {"value": blocks.eroded(x["value"])}, 1), thin, equal_nan=True)
    assert np.array_equal(on(lambda x, f: {"value": blocks.dilated(blocks.eroded(x["value"]), f)}, 2), opened, equal_nan=True)
    assert np.array_equal(dense(tiles.dilate(v, frame), a.shape), wide, equal_nan=True)
    assert tiles.erode(v.withColumn("value", F.lit(3)), frame).schema["value"].dataType.simpleString() == "int"
    assert tiles.dilate(v.limit(0), frame).count() == 0


def test_skeleton_of_ten_iterations(spark):
    rng = np.random.default_rng(4)
    a = rng.random((10, 25, 31))
    v, frame = spark.createDataFrame(image_rows(a), VOXEL), frame_of(spark, a.shape)
    want = soft_skeleton_of(a, 10)
    for side, steps in ((64, 10), (8, 3), (16, 4)):
        assert np.allclose(dense(tiles.soft_skeleton(v, frame, 10, side, steps), a.shape), want)


def test_rows_that_are_dealt_out(spark):
    shape = (32, 64, 64)
    v = spark.range(32 * 64 * 64).select(F.lit("i").alias("image_id"), *[F.expr(e).cast("int").alias(c) for c, e in (("z", "id div 4096"), ("y", "id div 64 % 64"), ("x", "id % 64"))], F.lit(1.0).alias("value"))
    for side, halo in ((16, 1), (32, 2)):
        per = [sum(min(n, b + side + halo) - max(0, b - halo) for b in range(0, n, side)) for n in shape]
        got = blocks.in_blocks(v, frame_of(spark, shape), side, halo)
        # the volume once, and the faces between blocks as deep as the halo
        assert got.count() == np.prod(per) and got.groupBy("_block", "_at").count().where("count > 1").isEmpty()
    assert blocks.in_blocks(v, frame_of(spark, shape), 32, 1).count() < 1.2 * v.count()


def test_brackets_are_refined(spark, monkeypatch):
    rng = np.random.default_rng(9)
    groups = {"a": rng.normal(size=6000), "b": np.r_[np.zeros(3000), rng.exponential(size=3000)], "c": np.round(rng.normal(size=5000), 1), "d": np.exp(rng.normal(0, 30, 4000)), "e": np.arange(7.0)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    at = [0.0, 0.003, 0.1, 0.5, 0.77, 0.999, 1.0]
    rounds, plain = [], quantiles.narrowed

    def counting(steps, keys, accuracy):
        out = plain(steps, keys, accuracy)
        rounds.append((steps.groupBy(*keys, "_i").count().agg(F.max("count")).first()[0], out.groupBy(*keys, "_i").count().agg(F.max("count")).first()[0]))
        return out

    monkeypatch.setattr(quantiles, "narrowed", counting)
    for accuracy in (20, 60):
        got = {r["g"]: r["q"] for r in quantiles.group_quantiles(df, ["g"], "v", at, "q", accuracy).collect()}
        for g, vs in groups.items():
            assert np.allclose(got[g], np.quantile(vs, at), rtol=1e-9, atol=1e-12), (g, accuracy)
    assert all(before > 20 and after <= accuracy + 1 for (before, after), accuracy in zip(rounds, (20, 60), strict=True))


def test_stretch_to_a_type(spark):
    rng = np.random.default_rng(1)
    kinds = {"uint8": rng.integers(0, 256, 400), "low8": rng.integers(20, 200, 400), "int8": rng.integers(-128, 128, 400), "uint16": rng.integers(0, 60000, 400), "int16": rng.integers(-900, 900, 400), "float32": rng.normal(size=400), "flat": np.full(50, 7.0), "unknown": rng.random(300) + 3}
    dtype = {"low8": "uint8", "flat": "float32"}
    rows = [(k, 0, 0, i, float(v)) for k, vs in kinds.items() for i, v in enumerate(vs)]
    v = spark.createDataFrame(rows, VOXEL)
    images = spark.createDataFrame([(k, dtype.get(k, k)) for k in kinds if k != "unknown"], "image_id string, dtype string")
    got = {}
    for r in norm.norm_percentile(v, 2, 98, images=images).collect():
        got.setdefault(r["image_id"], {})[r["x"]] = r["value"]
    for k, vs in kinds.items():
        lo, hi = np.percentile(vs, (2, 98))
        name = dtype.get(k, k)
        if name == "uint8":
            lo, hi = (0 if lo <= 5 else lo), (256 if hi >= 250 else hi)
        least, most = norm.RANGES.get(name, (-1, 1))
        least = max(least, 0) if lo >= 0 else least
        want = np.clip(vs, least, most) if lo == hi else (np.clip(vs, lo, hi) - lo) / (hi - lo) * (most - least) + least
        want = np.trunc(want) if name in norm.RANGES else want
        assert np.allclose([got[k][i] for i in range(len(vs))], want), k


def test_drawn_transforms_are_one_map(spark):
    a = np.arange(2 * 3 * 4, dtype=float).reshape(2, 3, 4)
    names = [f"i{n}" for n in range(120)]
    v = spark.createDataFrame([(n, *r[1:], int(r[4]) % 2) for n in names for r in image_rows(a)], f"{VOXEL}, mask int")
    frame = spark.createDataFrame([(n, *a.shape) for n in names], "image_id string, nz int, ny int, nx int")
    plan = project.transform_plan(frame, 3)
    plans = {r["image_id"]: r for r in plan.collect()}
    moved = {n: {} for n in names}
    for r in project.apply_transforms(v, plan).collect():
        moved[r["image_id"]][r["z"], r["y"], r["x"]] = (r["value"], r["mask"])
    step = {0: lambda x: np.flip(x, 0), 1: lambda x: np.flip(x, 1), 2: lambda x: np.flip(x, 2), 3: lambda x: np.rot90(x, 1, (1, 2)), 4: lambda x: np.rot90(x, 2, (1, 2)), 5: lambda x: np.rot90(x, 1, (2, 1)), 6: lambda x: x}
    for n in names:
        p, want = plans[n], a
        for op in p["ops"]:
            want = step[op](want)
        assert want.shape == (p["nz"], p["ny"], p["nx"])
        assert moved[n] == {at: (x, int(x) % 2) for at, x in np.ndenumerate(want)}
    assert {len(p["ops"]) for p in plans.values()} == {1, 2, 3} and {o for p in plans.values() for o in p["ops"]} == set(range(7))
    assert sorted(plans.items()) == sorted((r["image_id"], r) for r in project.transform_plan(frame, 3).collect())


def test_prepared_tiles_move_image_and_mask_alike(spark):
    a = np.random.default_rng(2).random((6, 6, 6))
    v, frame = spark.createDataFrame(image_rows(a), VOXEL), frame_of(spark, a.shape)
    got = project.prepare_tile(v, v.withColumn("value", F.col("value") * 2), frame, 4, seed=5, channels=2)
    assert got.count() == 2 * 64 and got.where("abs(mask - 2 * value) > 1e-12").isEmpty()
    assert sorted(r["value"] for r in got.where("channel = 0").collect()) == sorted(a[1:5, 1:5, 1:5].ravel())


def stop_by_hand(values, min_delta, higher):
    best, counter, out = None, 0, []
    for v in values:
        if best is None:
            best = v
        elif (best - v < min_delta) if higher else (best - v > min_delta):
            best, counter = v, 0
        elif (best - v > min_delta) if higher else (best - v < min_delta):
            counter += 1
        out.append(counter)
    return out


def test_early_stop(spark):
    rng = random.Random(3)
    runs = {f"r{i}": [rng.choice([1.0, 0.9, 0.8, 0.75, 0.5]) for _ in range(40)] for i in range(4)}
    h = spark.createDataFrame([(r, e, v) for r, vs in runs.items() for e, v in enumerate(vs)], "run string, epoch int, loss double").repartition(5)
    for min_delta in (0.0, 0.125, 0.25):
        for higher in (False, True):
            got = {}
            for r in metrics.early_stop(h, 5, min_delta=min_delta, higher=higher).orderBy("run", "epoch").collect():
                got.setdefault(r["run"], []).append(r["counter"])
                assert r["stop"] == (r["counter"] >= 5)
            assert got == {r: stop_by_hand(vs, min_delta, higher) for r, vs in runs.items()}, (min_delta, higher)


def test_cross_entropy(spark):
    logits = [[1.0, 2.0, 0.5], [1000.0, 0.0, -1000.0], [0.0, 0.0, 0.0]]
    df = spark.createDataFrame([("g", x, t) for x, t in zip(logits, (1, 1, 2), strict=True)] + [("g", [1.0], None)], "group_id string, logits array<double>, target int")
    want = np.mean([np.log(np.exp(np.array(x) - max(x)).sum()) + max(x) - x[t] for x, t in zip(logits, (1, 1, 2), strict=True)])
    assert abs(metrics.cross_entropy(df).first()["cross_entropy"] - want) < 1e-9

"""Ordered points, joined lines and merged patches against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialseg.operators import cloud, filament

POINTS = "cloud_id string, seg_id long, point_id long, ord int, x double, y double, z double"


def plain_walk(x):
    at, left = int(np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1).round(9))), np.ones(len(x), bool)
    way = [at]
    for _ in range(len(x) - 1):
        left[at] = False
        some = np.flatnonzero(left)
        at = int(some[np.argmin(((x[some] - x[at]) ** 2).sum(axis=1))])
        way.append(at)
    return way


@pytest.mark.parametrize("n", [1, 2, 3, 127, 129, 1000, 10_000])
def test_walk_equals_the_plain_one(n):
    rng = np.random.default_rng(n)
    for x in (rng.random((n, 3)), rng.integers(0, 2 + int(n**0.4), (n, 3)).astype(float), np.vstack([rng.normal(size=(n - 1, 3)) * 1e-6, [[1e6, 0, 0]]]), np.zeros((n, 3))):
        assert filament.nearest_walk(x) == plain_walk(x)


def lines(spark, segments, cloud_id="c"):
    """Segments as lists of (x, y, z)."""
    rows, n = [], 0
    for s, places in segments.items():
        for i, p in enumerate(places):
            rows.append((cloud_id, s, n, i, *map(float, p)))
            n += 1
    return spark.createDataFrame(rows, POINTS), rows


def joined(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["seg_id"], []).append((r["ord"], r["point_id"]))
    assert all(sorted(o for o, _ in v) == list(range(len(v))) for v in found.values())
    return {s: [p for _, p in sorted(v)] for s, v in found.items()}


def test_joined_lines_keep_their_order(spark):
    # three pieces of a line, the middle one backwards, then a piece that lies apart
    df, rows = lines(spark, {4: [(0, 0, 0), (1, 0, 0), (2, 0, 0)], 2: [(5, 0, 0), (4, 0, 0), (3, 0, 0)], 9: [(6, 0, 0), (7, 0, 0)], 7: [(0, 90, 0), (1, 90, 0)]})
    got = joined(filament.connect_ends(df, 1.5, 0.5))
    assert got[0] in ([0, 1, 2, 5, 4, 3, 6, 7], [7, 6, 3, 4, 5, 2, 1, 0]) and got[1] == [8, 9] and len(got) == 2


def test_hairpins_and_crossings(spark):
    # the way back of a hairpin runs a tenth beside the way out: the nearest point is on the other arm
    out, back = [(i, 0.0, 0) for i in range(30)], [(29 - i, 0.1, 0) for i in range(29)]
    tail = [(-1 - 0.9 * i, 0.1, 0) for i in range(20)]
    crossing = [(-4, y - 10.05, 0) for y in range(20)]
    df, _ = lines(spark, {1: out + back, 2: tail, 3: crossing})
    got = joined(filament.connect_ends(df, 2.2, 0.05))
    one = list(range(59)) + list(range(59, 79))
    assert got[0] in (one, one[::-1]) and got[1] == list(range(79, 99))


def test_rings_and_long_chains(spark):
    angle = np.linspace(0, 2 * np.pi, 61)[:-1]
    ring = np.c_[np.cos(angle), np.sin(angle), 0 * angle] * 50
    df, rows = lines(spark, {5: ring[:20].tolist(), 3: ring[20:40][::-1].tolist(), 8: ring[40:].tolist()})
    got = joined(filament.connect_ends(df, 7, 3))
    assert len(got) == 1
    place = {r[2]: i for i, r in enumerate(rows)}
    at = np.array([list(rows[place[p]][4:]) for p in got[0]])
    assert (np.linalg.norm(np.diff(at, axis=0), axis=1) < 6).all()  # it runs round without a jump
    rng = random.Random(2)
    pieces, x, want = {}, 0, []
    ids = rng.sample(range(1000), 70)
    for s in ids:
        n = rng.randrange(2, 6)
        part = [(x + i, 0, 0) for i in range(n)]
        pieces[s] = part if rng.random() < 0.5 else part[::-1]
        x += n
    df, rows = lines(spark, pieces)
    want = [r[2] for r in sorted(rows, key=lambda r: r[4])]
    got = joined(filament.connect_ends(df, 1.5, 0.5))
    assert len(got) == 1 and got[0] in (want, want[::-1])
    assert filament.connect_ends(df.limit(0), 1.5, 0.5).count() == 0
    apart, _ = lines(spark, {1: [(0, 0, 0), (1, 0, 0)], 6: [(50, 0, 0)]})
    assert joined(filament.connect_ends(apart, 1.5, 0.5)) == {0: [0, 1], 1: [2]}


def first_fit(counts, most):
    new, full, group = [], 0, -1
    for n in counts:
        if group < 0 or full + n > most:
            group, full = group + 1, 0
        full += n
        new.append(group)
    return new


def test_merged_patches_equal_the_loop(spark):
    rng = random.Random(5)
    counts = {f"c{i}": {p: rng.choice([1, 1, 2, 5, 9, 30]) for p in sorted(rng.sample(range(5000), n))} for i, n in enumerate((1, 2, 37, 400))}
    rows, n = [], 0
    for c, patches in counts.items():
        for p, k in patches.items():
            rows += [(c, p, n + i) for i in range(k)]
            n += k
    df = spark.createDataFrame(rows, "cloud_id string, patch_id int, point_id long")
    for most in (1, 7, 20, 10_000):
        want = {(c, p): g for c, patches in counts.items() for p, g in zip(patches, first_fit(patches.values(), most), strict=True)}
        got = {(r["cloud_id"], r["point_id"], r["patch_id"]) for r in cloud.merge_small_patches(df, most).collect()}
        assert got == {(c, i, want[c, p]) for c, p, i in rows}
    assert cloud.merge_small_patches(df.limit(0), 5).count() == 0
    assert "Pandas" not in cloud.merge_small_patches(df.where(F.col("cloud_id") == "c2"), 20)._jdf.queryExecution().executedPlan().toString()

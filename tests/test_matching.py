"""Segments that match: counts against brute force, over many groups, and no rows for pairs of points."""

import numpy as np
import pytest

from spatialseg.operators import filament
from spatialseg.operators import matching as M

ROW = "cloud_id string, seg_id long, point_id long, x double, y double, z double"


def frame(spark, rows):
    return spark.createDataFrame([(c, s, p, *map(float, x)) for c, s, p, x in rows], ROW)


def most(a, b, dist):
    out = {}
    for c, s, _, _ in a:
        met = {}
        for ca, sa, p, x in a:
            if (ca, sa) != (c, s) or c is None or s is None or p is None:
                continue
            for cb, sb, _, y in b:
                d = np.subtract(x, y)
                if cb == c and np.sqrt((d * d).sum()) <= dist:
                    met.setdefault(sb, set()).add(p)
        out[c, s] = (sum(r[:2] == (c, s) for r in a), max(map(len, met.values()), default=0))
    return out


def cloud(rng, n, segments, first):
    rows = [("c" if i % 3 else "d", int(s), first + i, x.tolist()) for i, (s, x) in enumerate(zip(rng.integers(0, segments, n), rng.integers(0, 12, (n, 3)), strict=True))]
    rows += [("c", 99, first + n + i, x.tolist()) for i, x in enumerate(rng.integers(0, 12, (70, 3)))]  # one longer than a group
    rows += [("c", 3, first + 1, [0.0, 0.0, 0.0]), ("c", 3, first + 1, [11.0, 11.0, 11.0]), ("c", None, first + 2, [5.0, 5.0, 5.0]), (None, 4, first + 3, [5.0, 5.0, 5.0])]
    return [*rows, ("c", 4, None, [5.0, 5.0, 5.0]), ("c", 4, first + 5, [5.0, float("nan"), 5.0]), ("only", first, first + 6, [5.0, 5.0, 5.0])]


@pytest.mark.parametrize("group", [30, 100_000])
def test_most_points_near_one_segment(spark, monkeypatch, group):
    monkeypatch.setattr(M, "GROUP", group)
    monkeypatch.setattr(M, "PAIRS", 50)
    rng = np.random.default_rng(6)
    a, b = cloud(rng, 160, 23, 0), cloud(rng, 140, 31, 1000)
    want = most(a, b, 2.5)
    assert max(k for _, k in want.values()) > 3
    got = {(r["cloud_id"], r["seg_id"]): (r["_n"], r["_k"]) for r in M.most_met(frame(spark, a), frame(spark, b), 2.5, 9.0).collect()}
    assert got == want  # no share is ever enough
    back = most(b, a, 2.5)
    for share in (0.0, 0.34) if group == 30 else ():
        found = {(r["class"][0], r["cloud_id"], r["seg_id"]): r["class"] for r in filament.compare_segmentations(frame(spark, a), frame(spark, b), 2.5, share).collect()}
        assert found == {(p, *s): f"{p}_matched" if k / n >= share else f"{p}_noise" for p, w in (("a", want), ("b", back)) for s, (n, k) in w.items()}
    none = frame(spark, [])
    assert {r["class"] for r in filament.compare_segmentations(frame(spark, a), none, 2.5, 0.1).collect()} == {"a_noise"}


def test_pairs_are_no_rows(spark):
    """Each of 1500 points is near 1500 segments: they went to the shuffle as 2 250 000 rows a direction."""
    rng = np.random.default_rng(7)
    a, b = ([("c", i, 2 * i + odd, x) for i, x in enumerate(rng.uniform(0, 1, (1500, 3)).tolist())] for odd in (0, 1))
    shuffled = lambda: spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    a, b = frame(spark, a), frame(spark, b)
    before = shuffled()
    assert {r["class"] for r in filament.compare_segmentations(a, b, 2.0, 2.0).collect()} == {"a_noise", "b_noise"}
    assert 0 < shuffled() - before < 3_000_000

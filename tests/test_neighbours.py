"""Neighbour searches over several blocks, against brute force."""

import numpy as np
import pytest

from spatialseg.operators import filament, metrics
from spatialseg.operators import knn as K
from spatialseg.operators.boxtree import Block

ROW = "cloud_id string, point_id long, name string, x double, y double, z double"


def table(spark, x, cloud="c", first=0):
    return spark.createDataFrame([(cloud, first + i, f"p{first + i}", *map(float, v)) for i, v in enumerate(x)], ROW)


def nearest(q, t, k, skip=None, far=np.inf):
    d = np.sqrt((q[0] - t[:, 0]) ** 2 + (q[1] - t[:, 1]) ** 2 + (q[2] - t[:, 2]) ** 2)
    return [int(j) for j in np.lexsort((np.arange(len(t)), d)) if j != skip and d[j] <= far][:k]


def test_block_of_many_kinds():
    rng = np.random.default_rng(1)
    t = np.concatenate([rng.normal(size=(900, 3)), rng.integers(0, 4, (700, 3)), np.ones((300, 3)), [[1e6, 0, 0]]])
    q = np.concatenate([t[::7], rng.normal(size=(60, 3)) * 50, [[-1e7, 3, 3]]])
    for k in (1, 5, 40):
        got = [[] for _ in q]
        for i, j, _ in zip(*Block(t).nearest(q, k, np.full(len(q), np.inf)), strict=True):
            got[i].append(int(j))
        assert got == [nearest(v, t, k) for v in q]
    far = Block(t).nearest(q, 3, np.full(len(q), 0.5))
    assert (far[2] <= 0.5).all() and len(far[0]) == sum(len(nearest(v, t, 3, far=0.5)) for v in q)


@pytest.mark.parametrize("self_too", [True, False])
def test_knn_over_blocks(spark, monkeypatch, self_too):
    """Blocks of about 40 targets, queries of a block dealt to tasks: a lattice full of ties, a pile, and a cloud of one block."""
    monkeypatch.setattr(K, "BLOCK", 40)
    monkeypatch.setattr(K, "QUERIES", 30)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(0, 9, (400, 3)), rng.normal(2, 1, (250, 3)), np.full((60, 3), 4.0), [[900.0, 0, 0]]])
    p = table(spark, x).unionByName(table(spark, x[:12], "small"))
    got = {}
    for r in K.knn(p, p, 4, carry=["name"], exclude_self=not self_too).orderBy("src", "rank").collect():
        assert r["t_name"] == f"p{r['dst']}"
        got.setdefault((r["cloud_id"], r["src"]), []).append(r["dst"])
    want = {("c", i): nearest(v, x, 4, None if self_too else i) for i, v in enumerate(x)} | {("small", i): nearest(v, x[:12], 4, None if self_too else i) for i, v in enumerate(x[:12])}
    assert got == want


def test_queries_far_from_all_targets(spark, monkeypatch):
    """They meet few blocks: the targets that they are searched in are not all of them."""
    monkeypatch.setattr(K, "BLOCK", 50)
    rng = np.random.default_rng(3)
    t, q = rng.uniform(0, 100, (3000, 3)) + [300, 0, 0], rng.uniform(0, 100, (200, 3))
    got = {r["src"]: r["dst"] for r in K.knn(table(spark, q), table(spark, t), 1).collect()}
    assert got == {i: nearest(v, t, 1)[0] for i, v in enumerate(q)}
    tree = K.BoxTree(t, 60)
    leaf = tree.leaf_of(t)
    some = np.unique(leaf)
    tree.set_boxes(some, np.array([t[leaf == i].min(axis=0) for i in some]), np.array([t[leaf == i].max(axis=0) for i in some]))
    asked = tree.within(q, np.array([np.sqrt(((t - v) ** 2).sum(axis=1)).min() for v in q]))[0]
    assert len(asked) < 4 * len(q)
    assert {r["src"]: r["dst"] for r in K.knn(table(spark, q), table(spark, t), 1, within=250.0).collect()} == {i: n[0] for i, v in enumerate(q) if (n := nearest(v, t, 1, far=250.0))}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_repeated_rows_are_not_broadcast(spark):
    """Cells around points, walked cells and repeated truth look small to the planner."""
    p = table(spark, np.random.default_rng(4).uniform(0, 9, (50, 3))).selectExpr("*", "point_id % 5 as seg_id", "point_id as ord")
    v = spark.range(50).selectExpr("'c' as image_id", "cast(id % 7 as int) z", "cast(id % 6 as int) y", "cast(id % 5 as int) x", "double(id) value")
    for df in (K.band_pairs(p, p, 1.0, ["cloud_id"], ["point_id"], ["point_id"]), filament.intensity_along(p, v), metrics.mean_coverage(p, p)):
        assert "SortMergeJoin" in plan_of(df) and "BroadcastHashJoin" not in plan_of(df)


def test_facing_ends_in_one_place(spark):
    """Many ends at one place that lead the same way: each meets the nearest facing end of another segment."""
    rows = []
    for s in range(40):
        back = s % 2
        rows += [("c", s, 2 * s, 0, 10.0 * back, 0.0, 0.0), ("c", s, 2 * s + 1, 1, 4.0 + 2 * back, 0.0, 0.0)]
    p = spark.createDataFrame(rows, "cloud_id string, seg_id long, point_id long, ord int, x double, y double, z double")
    got = [(r["a_seg_id"], r["a_end"], r["b_seg_id"], r["b_end"]) for r in filament.end_links(p, 5.0, 1.0).collect()]
    assert sorted(got) == [(0, 1, 1, 1), (1, 1, 0, 1)]

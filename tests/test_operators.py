"""Literal cases, properties, file formats and streams; and every query with SQL against DuckDB."""

import math
import os
import struct

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spatialseg.components import connected_components
from spatialseg.operators import classify, cloud, filament, graph, metrics, raster, tiles
from spatialseg.operators.knn import knn
from spatialseg.sources import files, tables
from spatialseg.streaming import streams

SF = "/root/testdata/sf0.001"
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op")}


def line(spark, rows):
    """[seg, x, y, z] rows in order."""
    return spark.createDataFrame([("c", i, int(r[0]), i, *map(float, r[1:])) for i, r in enumerate(rows)], "cloud_id string, point_id long, seg_id long, ord int, x double, y double, z double")


def plain(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple("null" if v is None or v is pd.NaT or isinstance(v, float) and v != v else f"{float(v):.4f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v) for v in r))
    return sorted(out)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_line_walk(spark):
    got = raster.interpolate_polyline(line(spark, [(0, 1, 2, 3), (0, 4, 2, 3)])).orderBy("ord", "k").select("x", "y", "z").collect()
    assert [tuple(r) for r in got] == [(1, 2, 3), (2, 2, 3), (3, 2, 3), (4, 2, 3)]


def test_tile_plan(spark):
    images = spark.createDataFrame([("a", 150, 150, 150), ("b", 1, 150, 150)], "image_id string, nz int, ny int, nx int")
    assert {r["image_id"]: r["count"] for r in tiles.tile_plan(images, 64, 64, 0).groupBy("image_id").count().collect()} == {"a": 27, "b": 9}


def test_lengths(spark):
    p = line(spark, [(0, 1, 2, 3), (0, 4, 5, 6), (0, 7, 8, 9), (0, 10, 11, 12), (1, 1, 1, 1), (2, 1, 2, 1), (2, 2, 5, 3), (2, 4, 6, 6), (2, 8, 9, 6)])
    length = {r["seg_id"]: r["length"] for r in filament.segment_length(p).collect()}
    bend = {r["seg_id"]: r["tortuosity"] for r in filament.segment_tortuosity(p).collect()}
    assert math.isclose(length[0], 3 * math.sqrt(27)) and length[1] == 0 and bend[0] == pytest.approx(1) and bend[1] == 1 and bend[2] == pytest.approx(math.sqrt(1.268), abs=1e-3)


def test_order_and_cut(spark):
    got = filament.order_points(line(spark, [(0, 1, 2, 3), (0, 4, 5, 6), (0, 2, 3, 4), (0, 3, 4, 5)])).orderBy("ord").collect()
    assert [r["x"] for r in got] in ([1, 2, 3, 4], [4, 3, 2, 1])
    stairs = filament.cut_sharp_bends(line(spark, [(0, 0, 0, 0), (0, 1, 0, 0), (0, 1, 1, 0), (0, 2, 1, 0)]), 150).orderBy("ord").collect()
    assert [r["seg_id"] for r in stairs] == [0, 0, 1, 1]


def test_overlap(spark):
    a = line(spark, [(0, 0, 0, 0), (0, 10, 0, 0), (0, 20, 0, 0)])
    share = lambda rows, d: filament.overlap_probability(a, line(spark, rows), d).first()["overlap"]
    assert share([(0, 0, 0, 0), (0, 10, 0, 0)], 1) == pytest.approx(2 / 3) and share([(0, 99, 0, 0)], 1) == 0 and share([(0, 10, 0, 0)], 10) == 1
    assert filament.overlap_probability(a, a.limit(0), 1).first()["overlap"] == 0


def test_connect_and_sort(spark):
    p = line(spark, [(0, 0, 0, 0), (0, 10, 0, 0), (1, 20, 0, 0), (1, 30, 0, 0), (2, 0, 500, 0), (2, 0, 600, 0)])
    assert filament.connect_ends(p, 15, 5).select("seg_id").distinct().count() == 2
    assert [r["seg_id"] for r in filament.sort_by_length(line(spark, [(0, 0, 0, 0), (0, 10, 0, 0), (1, 0, 0, 0), (1, 5, 0, 0), (2, 0, 0, 0), (2, 25, 0, 0)])).orderBy("point_id").collect()] == [1, 1, 0, 0, 2, 2]


def test_runs(spark):
    flags = spark.createDataFrame([(0, i, f) for i, f in enumerate([True, False, True, True, False, True])], "k int, i int, f boolean")
    assert classify.count_true_runs(flags, ["k"], "i", "f").first()["runs"] == 3
    ints = lambda v: spark.createDataFrame([(0, x) for x in v], "k int, n int")
    assert classify.consecutive_runs(ints([1, 2, 3, 5, 6, 10]), ["k"], "n").count() == 3
    assert sorted(r["n"] for r in classify.fill_gaps(ints([1, 3, 7, 8]), ["k"], "n", 3).collect()) == [1, 2, 3, 7, 8]
    assert sorted(r["n"] for r in classify.fill_gaps(ints([1, 10]), ["k"], "n", 9).collect()) == list(range(1, 11))


def test_components_against_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: root(i) for a, b in edges if a != b for i in (a, b)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(150, 3)), rng.normal(size=(30, 3)) * 0.01 + 5, [[100, 0, 0]] * 3])
    p = spark.createDataFrame([("c", i, *map(float, v)) for i, v in enumerate(x)], "cloud_id string, point_id long, x double, y double, z double")
    got = {}
    for r in knn(p, p, 4).orderBy("src", "rank").collect():
        got.setdefault(r["src"], []).append(r["dst"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert got == {i: [int(j) for j in np.lexsort((np.arange(len(x)), d[i]))[:4]] for i in range(len(x))}




@pytest.mark.parametrize("kind", ["line", "cloud", "ties", "jumps", "one place"])
def test_nearest_walk(kind):
    rng = np.random.default_rng(2)
    t = rng.permutation(np.linspace(0, 20, 700))
    x = {
        "line": np.c_[np.cos(t), np.sin(t), t / 3] + rng.normal(size=(700, 3)) * 0.01,
        "cloud": rng.normal(size=(500, 3)),
        "ties": rng.integers(0, 6, (400, 3)).astype(float),
        "jumps": np.repeat(rng.normal(size=(5, 3)) * 100, 60, axis=0) + rng.normal(size=(300, 3)) * 0.01,
        "one place": np.ones((50, 3)),
    }[kind]
    at = int(np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1).round(9)))
    left, want = np.ones(len(x), bool), []
    for _ in range(len(x)):
        want.append(at)
        left[at] = False
        at = int(np.argmin(np.where(left, ((x - x[at]) ** 2).sum(axis=1), np.inf)))
    assert filament.nearest_walk(x) == want


@pytest.mark.parametrize("self_too", [True, False])
def test_knn_of_uneven_clouds(spark, self_too):
    """A dense line, a far outlier, a pile of points at one place and a null coordinate; cells are split and no answer changes."""
    rng = np.random.default_rng(5)
    at = np.concatenate([np.c_[np.linspace(0, 1, 400), np.zeros((400, 2))], rng.normal(3, 1e-4, (300, 3)), np.full((150, 3), 2.0), [[1e6, 1e6, 1e6], [-5e5, 0, 0]]])
    rows = [("c", i, 0, *map(float, p)) for i, p in enumerate(at)]
    p = spark.createDataFrame([*rows, ("c", 9999, 0, None, 0.0, 0.0), ("one", 0, 0, 1.0, 1.0, 1.0)], "cloud_id string, point_id long, seg_id long, x double, y double, z double")
    got = {}
    for r in knn(p, p, 4, exclude_self=not self_too).orderBy("src", "rank").where("cloud_id = 'c'").collect():
        got.setdefault(r["src"], []).append(r["dst"])
    for i in range(len(at)):
        d = np.sqrt(((at - at[i]) ** 2).sum(axis=1))
        want = [j for j in np.lexsort((np.arange(len(at)), d)) if self_too or j != i][:4]
        assert np.allclose(d[got[i]], d[want], rtol=1e-12, atol=0) and len(got[i]) == 4
        if 700 <= i < 850:
            assert got[i] == want


def test_patches(spark):
    p = entry.catalogue.A.points(spark, SF)
    b = cloud.build_patches(p, 60)
    assert b.select("cloud_id", "point_id").distinct().count() == p.count() and b.groupBy("cloud_id", "patch_id").count().agg(F.max("count")).first()[0] <= 60
    assert cloud.random_downsample(p, 0.25).count() == sum(int(r["count"] * 0.25) for r in p.groupBy("cloud_id").count().collect())


def test_coverage_and_auc(spark):
    s = spark.createDataFrame([("g", i, v, t) for i, (v, t) in enumerate([(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.1, 0)])], "group_id string, item_id long, score double, target int")
    assert metrics.roc_auc(s).first()["auc"] == pytest.approx(5 / 6) and metrics.average_precision(s).first()["ap"] == pytest.approx((1 + 1 + 0.75) / 3)
    p = line(spark, [(0, i, 0, 0) for i in range(4)] + [(1, i, 1, 0) for i in range(4)])
    assert metrics.mean_coverage(p, p).first()["mcov"] == 1


def test_files(spark, tmp_path):
    root = f"file://{tmp_path}"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("ID,X,Y,Z\n0,1,2,3\n0,4,5,6\n1,7,8,9\n")
    (tmp_path / "in/b.csv").write_text("3,1,2\n3,4,5\n")
    p = files.read_points_csv(spark, f"{root}/in")
    assert p.count() == 5 and [r["x"] for r in p.where("seg_id = 0").orderBy("ord").collect()] == [1, 4] and p.where("seg_id = 3").agg(F.sum("z")).first()[0] == 0
    files.convert_points(spark, f"{root}/in", f"{root}/out")
    assert spark.read.option("header", True).csv(f"{root}/out").count() == 5
    (tmp_path / "scene").mkdir()
    for n in "ab":
        (tmp_path / f"scene/{n}.txt").write_text("1 2 3 255 0 0\nbad line\n4 5 6 0 255 0\n")
    scene = files.read_scene_txt(spark, f"{root}/scene")
    assert scene.count() == 4 and {r["seg_id"] for r in scene.collect()} == {0, 1} and scene.agg(F.max("r")).first()[0] == 1
    (tmp_path / "m.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nend_header\n0 0 0 255 0 0\n1 1 1 0 0 255\n3 0 1 2\n")
    assert sorted(r["seg_id"] for r in files.read_ply_points(spark, f"{root}/m.ply").collect()) == [0, 1]
    (tmp_path / "g.am").write_text("# AmiraMesh 3D ASCII 2.0\ndefine VERTEX 2\nVERTEX { float[3] VertexCoordinates } @1\nEDGE { int[2] EdgeConnectivity } @2\nEDGE { int NumEdgePoints } @3\nPOINT { float[3] EdgePointCoordinates } @4\n\n@1\n0 0 0\n2 0 0\n\n@2\n0 1\n1 0\n\n@3\n3\n2\n\n@4\n0 0 0\n1 0 0\n2 0 0\n2 0 0\n0 0 0\n")
    g = files.ingest_spatial_graphs(spark, f"{root}/g.am")
    assert g["sg_vertex"].count() == 2 and [tuple(r) for r in g["sg_point"].groupBy("edge_id").count().orderBy("edge_id").collect()] == [(0, 3), (1, 2)]
    head = "# AmiraMesh BINARY-LITTLE-ENDIAN 3.0\n\ndefine VERTEX 2\ndefine EDGE 2\ndefine POINT 5\n\nVERTEX { float[3] VertexCoordinates } @1\nEDGE { int[2] EdgeConnectivity } @2\nEDGE { int NumEdgePoints } @3\nPOINT { float[3] EdgePointCoordinates } @4\nEDGE { int Pole } @5\n\n# Data section follows\n"
    at = [0, 0, 0, 1, 0, 0, 2, 0, 0, struct.unpack("<f", b"\n@2\n")[0], 0, 0, 0, 0, 0]
    blocks = [struct.pack("<6f", 0, 0, 0, 2, 0, 0), struct.pack("<4i", 0, 1, 1, 0), struct.pack("<2i", 3, 2), struct.pack("<15f", *at), struct.pack("<2i", 7, 9)]
    whole = head.encode() + b"".join(b"@%d\n%s\n" % (i + 1, b) for i, b in enumerate(blocks))
    (tmp_path / "binary").mkdir()
    (tmp_path / "binary/g.am").write_bytes(whole)
    b = files.ingest_spatial_graphs(spark, f"{root}/binary")
    assert [tuple(r) for r in b["sg_vertex"].select("v_id", "x", "y", "z").orderBy("v_id").collect()] == [(0, 0, 0, 0), (1, 2, 0, 0)]
    assert [(r["v0"], r["v1"], r["n_points"]) for r in b["sg_edge"].orderBy("edge_id").collect()] == [(0, 1, 3), (1, 0, 2)]
    assert [(r["edge_id"], r["ord"], r["x"]) for r in b["sg_point"].orderBy("edge_id", "ord").collect()] == [(e, o, x) for (e, o), x in zip([(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)], at[::3], strict=True)]
    assert [(r["label"], r["value"]) for r in b["sg_label"].orderBy("edge_id").collect()] == [("Pole", 7), ("Pole", 9)]
    for end in (whole.index(b"@4"), whole.rindex(b"@4") + 20):
        with pytest.raises(ValueError):
            list(files.binary_graph_rows(whole[:end]))
    (tmp_path / "v.mrc").write_bytes(struct.pack("<4i", 4, 3, 2, 0) + bytes(24) + struct.pack("<f", 40.0) + bytes(1024 - 44) + bytes(range(24)))
    h = files.scan_volume_headers(spark, f"{root}/v.mrc").first()
    v = files.scan_volume_slabs(spark, f"{root}/v.mrc", 1)
    assert (h["nz"], h["ny"], h["nx"], h["dtype"], h["pixel_size"]) == (2, 3, 4, "uint8", 10.0) and v.count() == 24 and v.where("z = 1 and y = 2 and x = 3").first()["value"] == 23
    assert files.catalog_files(spark, f"{root}").select("stem").collect() and {r["stem"] for r in files.catalog_files(spark, root).collect()} == {"g", "v"}
    m = files.materialize(p.withColumn("cloud_id", F.lit("c")), f"{root}/kept")
    assert m.count() == 5 and set(m.columns) == set(p.columns)
    (tmp_path / "s.surf").write_text("# surface\nVertices 4\n0 0 0\n1 0 0\n0 1 0\n0 0 1\nPatches 1\nInnerRegion A\nTriangles 2\n1 2 3\n1 3 4\n")
    vertex, tri = files.ingest_surfaces(spark, f"{root}/s.surf")
    assert vertex.count() == 4 and {(r["a"], r["b"], r["c"]) for r in tri.collect()} == {(0, 1, 2), (0, 2, 3)}


def test_spatial_graph_tables(spark):
    t = tables.to_spatial_graph_tables(line(spark, [(5, 0, 0, 0), (5, 1, 0, 0), (9, 2, 0, 0), (9, 3, 0, 0)]))
    assert [(r["v_id"], r["x"]) for r in t["sg_vertex"].orderBy("v_id").collect()] == [(0, 0), (1, 1), (2, 2), (3, 3)] and t["sg_point"].count() == 4


def test_streams(spark, tmp_path):
    src, out = f"file://{tmp_path}/src", f"file://{tmp_path}/out"
    for k in range(2):
        line(spark, [(k, 0, 0, 0), (k, 3, 4, 0)]).select("cloud_id", "point_id", "seg_id", "ord", "x", "y", "z").write.mode("append").parquet(src)
        streams.watch_points(spark, src, out, f"file://{tmp_path}/ck").awaitTermination()
        assert spark.read.parquet(out).count() == k + 1
    spark.createDataFrame([("m", "d", 1, 0.5), ("m", "d", 2, 0.4)], "model string, dataset string, ts long, score double").write.parquet(f"file://{tmp_path}/runs")
    streams.watch_metrics(spark, f"file://{tmp_path}/runs", f"file://{tmp_path}/best", f"file://{tmp_path}/ck2").awaitTermination()
    assert tuple(streams.registry(spark, f"file://{tmp_path}/best").first()) == ("m", "d", 0.5, 1, 2)


def test_graph_of_rings(spark):
    ring = line(spark, [(0, 0, 0, 0), (0, 3, 0, 0), (0, 3, 3, 0), (0, 0, 3, 0), (1, 50, 0, 0)])
    e = {(r["src"], r["dst"]) for r in graph.chain_edges(ring).collect()}
    assert (3, 0) in e and (0, 3) in e and (4, 4) in e and not any(4 in p and p != (4, 4) for p in e)


def test_random_patches(spark):
    rng = np.random.default_rng(3)
    rows = [("a", i, *map(float, rng.normal(size=3))) for i in range(600)] + [("b", i, float(i), 0.0, 0.0) for i in range(30)]
    points = spark.createDataFrame(rows, "cloud_id string, point_id long, x double, y double, z double")
    got = cloud.random_patches(points, 50, 4).toPandas()
    sizes = got.groupby(["cloud_id", "patch_id"]).size()
    assert len(sizes) == 8 and sizes.loc["a"].between(25, 50).all() and (sizes.loc["b"] == 30).all()


def test_labelled_sets(spark):
    pts = line(spark, [(i // 10, i % 10, 50 * (i // 10), 0) for i in range(40)])
    sets = {k: graph.load_labelled_dataset(pts, k, max_points=500) for k in graph.KINDS}
    assert sets["filament"]["edges"].count() == 4 * (10 + 18) and sets["filament"]["patches"].select("patch_id").distinct().count() == 1
    assert sets["part"]["edges"].groupBy("src").count().agg(F.max("count"), F.min("count")).first()[:] == (6, 6)


def test_coverage_by_threshold(spark):
    truth = line(spark, [(i // 8, i % 8, 9 * (i // 8), 0) for i in range(16)])
    edges = [("c", 0, a, b, p) for i in range(15) if i != 7 for p in [0.95 if i < 7 else 0.6] for a, b in ((i, i + 1), (i + 1, i))]
    got = metrics.coverage_by_threshold(spark.createDataFrame(edges, "cloud_id string, patch_id int, src long, dst long, prob double"), truth, (0.5, 0.9, 0.99)).collect()
    assert {(r["threshold"], r["mcov"]) for r in got} == {(0.5, 1.0), (0.9, 0.5), (0.99, 0.0)}


def test_numbers_over_ranges(spark):
    from spatialseg.operators.project import dense_ids

    rng = np.random.default_rng(4)
    rows = [(int(k), int(v)) for k, v in zip(rng.integers(0, 3, 5000), rng.integers(0, 2000, 5000))]
    got = dense_ids(spark.createDataFrame([(k, v, v) for k, v in rows], "cloud_id int, was long, seg_id long"), ["cloud_id"], "seg_id").distinct().collect()
    want = {k: {v: i for i, v in enumerate(sorted({y for x, y in rows if x == k}))} for k in range(3)}
    assert all(r["seg_id"] == want[r["cloud_id"]][r["was"]] for r in got) and len(got) == sum(map(len, want.values()))


def test_group_quantiles(spark):
    from spatialseg.operators.quantiles import group_quantiles

    rng = np.random.default_rng(5)
    at = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    groups = {"normal": rng.normal(size=3000), "ties": np.r_[np.zeros(2000), rng.exponential(size=500), -np.ones(3)], "skew": np.exp(rng.normal(0, 20, 2000)), "constant": np.full(900, 0.1), "few": np.array([3.0, 1.0, 2.0]), "one": np.array([7.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("few", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    for accuracy in (50, 400, 10_000):
        got = {r["g"]: r["q"] for r in group_quantiles(df, ["g"], "v", at, "q", accuracy).collect()}
        assert set(got) == set(groups)
        for g, vs in groups.items():
            assert np.allclose(got[g], np.quantile(vs, at), rtol=1e-9, atol=1e-12), (g, accuracy)
    assert group_quantiles(df.limit(0), ["g"], "v", at, "q").count() == 0


def test_ranked_metrics_of_skewed_scores(spark):
    rng = np.random.default_rng(6)
    score = np.r_[rng.random(2000) ** 9, np.full(700, 0.5), 1e6]
    target = (rng.random(len(score)) < 0.4).astype(int)
    scored = spark.createDataFrame([("a", i, float(s), int(t)) for i, (s, t) in enumerate(zip(score, target))], "group_id string, item_id long, score double, target int")
    tp = np.array([target[score >= s].sum() for s in score])
    n = np.array([(score >= s).sum() for s in score])
    assert math.isclose(metrics.average_precision(scored).first()["ap"], (target * tp / n).sum() / target.sum(), rel_tol=1e-9)
    up, down = score[target == 1], score[target == 0]
    auc = ((up[:, None] > down).mean() + (up[:, None] == down).mean() / 2).item()
    assert math.isclose(metrics.roc_auc(scored).first()["auc"], auc, rel_tol=1e-9)


def test_resample_by_arc_length(spark):
    pts = line(spark, [(1, 0, 0, 0), (1, 1, 0, 0), (1, 2, 0, 0), (2, 0, 0, 0), (2, 3, 0, 0), (2, 3, 4, 0), (3, 9, 9, 9)])
    got = {}
    for r in filament.resample(pts, 0.5).orderBy("seg_id", "ord").collect():
        got.setdefault(r["seg_id"], []).append((r["x"], r["y"], r["z"]))
    assert np.allclose(got[1], [(k / 2, 0, 0) for k in range(len(got[1]))]) and len(got[1]) > 3
    bent = np.array(got[2])
    assert np.allclose(bent[:6], [(k / 2, 0, 0) for k in range(6)]) and np.allclose(bent[6:], [(3, k / 2, 0) for k in range(len(bent) - 6)]) and len(bent) >= 14
    assert got[3] == [(9.0, 9.0, 9.0)]


def image_rows(a):
    return [("i", *map(int, at), float(v)) for at, v in np.ndenumerate(a)]


def shifted(a, offsets, worst, best):
    padded = np.pad(a, 1, constant_values=worst)
    z, y, x = a.shape
    return best([padded[1 + o[0] : 1 + o[0] + z, 1 + o[1] : 1 + o[1] + y, 1 + o[2] : 1 + o[2] + x] for o in offsets])


def soft_skeleton_of(a, iters):
    cross = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    box = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    erode = lambda x: shifted(x, cross, np.inf, lambda p: np.min(p, axis=0))
    rest = lambda x: np.maximum(x - shifted(erode(x), box, -np.inf, lambda p: np.max(p, axis=0)), 0)
    s = rest(a)
    for _ in range(iters):
        a = erode(a)
        d = rest(a)
        s = s + np.maximum(d - s * d, 0)
    return s


def test_soft_skeleton_and_centreline_dice(spark):
    rng = np.random.default_rng(7)
    a, b = rng.random((3, 6, 7)), (rng.random((3, 6, 7)) > 0.4).astype(float)
    frame = spark.createDataFrame([("i", 3, 6, 7)], "image_id string, nz int, ny int, nx int")
    va, vb = (spark.createDataFrame(image_rows(m), "image_id string, z int, y int, x int, value double") for m in (a, b))
    got = np.zeros(a.shape)
    for r in tiles.soft_skeleton(va, frame, 2).collect():
        got[r["z"], r["y"], r["x"]] = r["value"]
    sa, sb = soft_skeleton_of(a, 2), soft_skeleton_of(b, 2)
    assert np.allclose(got, sa)
    p, s = ((sa * b).sum() + 1) / (sa.sum() + 1), ((sb * a).sum() + 1) / (sb.sum() + 1)
    assert math.isclose(metrics.centreline_dice(va, vb, frame, 2).first()["cldice"], 1 - 2 * p * s / (p + s), rel_tol=1e-9)


def test_intensity_along_a_line(spark):
    a = np.arange(2 * 5 * 6, dtype=float).reshape(2, 5, 6)
    v = spark.createDataFrame(image_rows(a), "image_id string, z int, y int, x int, value double").withColumn("image_id", F.lit("c"))
    r = filament.intensity_along(line(spark, [(1, 0, 2, 1), (1, 4, 2, 1)]), v).first()
    under = a[1, 2, :5]
    assert (r["mean_intensity"], r["sum_intensity"]) == (under.mean(), under.sum())
    assert (r["mean_intensity_per_length"], r["sum_intensity_per_length"]) == (under.mean() / 4, under.sum() / 4)


def test_thin_order_smooth(spark):
    rng = np.random.default_rng(8)
    along = rng.permutation(60)
    pts = line(spark, [(1, x, 0, 0) for x in along] + [(2, 500 + i / 10, 0, 0) for i in range(5)])
    got = filament.thin_order_smooth(pts, 5.0).orderBy("ord").collect()
    assert {r["seg_id"] for r in got} == {1} and len(got) == 12  # one medoid a cell; segment 2 has one and goes
    x = np.array([r["x"] for r in got])
    assert (np.diff(x) > 0).all() or (np.diff(x) < 0).all()


def test_near_segments_become_one(spark):
    pts = line(spark, [(1, x, 0, 0) for x in range(0, 50, 5)] + [(2, x, 0, 0) for x in range(60, 110, 5)] + [(3, x, 900, 0) for x in range(0, 50, 5)])
    got = {(r["seg_id"], tuple(sorted({p["x"] < 55 for p in r["p"]})), len(r["p"])) for r in filament.connect_near_segments(pts, 40.0, 20.0).groupBy("seg_id").agg(F.collect_list(F.struct("x", "y")).alias("p")).collect()}
    assert sorted((sides, n) for _, sides, n in got) == [((False, True), 20), ((True,), 10)]


def test_scored_patches(spark):
    pts = spark.createDataFrame([("a", p, i, float(i), 0.0, 0.0) for p in (0, 1) for i in range(4)], "cloud_id string, patch_id int, point_id long, x double, y double, z double")
    chain = lambda pdf: pd.DataFrame({"src": pdf["point_id"], "dst": np.roll(pdf["point_id"], 1), "prob": 0.25})
    got = graph.score_patches(pts, chain).collect()
    assert len(got) == 8 and {r["prob"] for r in got} == {0.25} and {r["patch_id"] for r in got} == {0, 1}
    kernel = {(r["src"], r["dst"]): r["prob"] for r in graph.score_patches(pts.where("patch_id = 0"), sigma=2.0).collect()}
    assert len(kernel) == 16 and all(math.isclose(p, math.exp(-((a - b) ** 2) / 8)) for (a, b), p in kernel.items())


def test_split_of_tiles(spark):
    many = spark.range(5000).select(F.lit("i").alias("image_id"), *[F.expr(e).cast("int").alias(c) for c, e in (("tz", "id div 100"), ("ty", "id % 10"), ("tx", "(id div 10) % 10"))])
    got = cloud.train_test_split(many)
    share = got.where("split = 'test'").count() / 5000
    assert got.count() == 5000 and 0.02 < share < 0.06
    few = many.where("tz < 9").withColumn("image_id", F.concat(F.lit("i"), F.col("tz")))
    by = {r["image_id"]: r["n"] for r in cloud.train_test_split(few).groupBy("image_id").agg(F.count_if(F.col("split") == "test").alias("n")).collect()}
    assert len(by) == 9 and set(by.values()) <= {0, 4}


def test_random_flip_turns_one_axis(spark):
    from spatialseg.operators import project

    a = np.arange(2 * 3 * 4, dtype=float).reshape(2, 3, 4)
    names = [f"i{n}" for n in range(30)]
    v = spark.createDataFrame([(n, *r[1:]) for n in names for r in image_rows(a)], "image_id string, z int, y int, x int, value double")
    frame = spark.createDataFrame([(n, *a.shape) for n in names], "image_id string, nz int, ny int, nx int")
    flips = {axis: np.flip(a, axis) for axis in range(3)}
    got, again = ({n: np.zeros(a.shape) for n in names} for _ in range(2))
    for out in (got, again):
        for r in project.random_flip(v, frame).collect():
            out[r["image_id"]][r["z"], r["y"], r["x"]] = r["value"]
    axes = [next(k for k, f in flips.items() if (got[n] == f).all()) for n in names]
    assert set(axes) == {0, 1, 2} and all((got[n] == again[n]).all() for n in names)


def test_filament_classes(spark):
    # a box-shaped surface near pole 0; pole 1 lies far along x
    mesh = spark.createDataFrame([("c", i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate((x, y, z) for x in (0, 20) for y in (0, 20) for z in (0, 20))], "cloud_id string, point_id long, x double, y double, z double")
    poles = spark.createDataFrame([("c", 0, 10.0, 10.0, 10.0), ("c", 1, 1000.0, 10.0, 10.0)], "cloud_id string, pole_id int, x double, y double, z double")
    ends = {1: ((1, 1, 1), (19, 19, 19)), 2: ((-2, 0, 0), (-300, 0, 0)), 3: ((-40, 0, 0), (-300, 0, 0)), 4: ((300, 0, 0), (900, 0, 0)), 5: ((600, 0, 0), (900, 0, 0)), 6: ((10, 10, 75), (1000, 10, 60))}
    pts = line(spark, [(k, *p) for k, two in ends.items() for p in two])
    got = {r["seg_id"]: r["group"] for r in classify.classify_filaments(pts, mesh, poles, 5.0, 60.0).collect()}
    want = {1: "attached_0_inside", 2: "attached_0_outside", 3: "mid", 4: "interdigitating", 5: "remaining", 6: "mid"}
    assert got == want
    near = spark.createDataFrame([("c", 0, 290.0, 0.0, 0.0), ("c", 1, 910.0, 0.0, 0.0)], poles.schema)
    assert classify.classify_filaments(pts.where("seg_id = 4"), mesh, near, 5.0, 60.0).first()["group"] == "bridging"

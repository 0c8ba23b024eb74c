"""What later passes reuse: bucketed tables, loaded scorers, a registry of runs, recipes of labelled sets."""

import shutil
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spatialseg.operators import cloud, filament, graph, metrics
from spatialseg.sources import files, labelled
from spatialseg.streaming import streams


def test_buckets_need_no_exchange(spark, tmp_path):
    pts = spark.range(400).select(F.concat(F.lit("c"), F.col("id") % 40).alias("cloud_id"), (F.col("id") % 3).cast("int").alias("patch_id"), F.col("id").alias("point_id"), *[F.rand(i).alias(c) for i, c in enumerate("xyz")])
    t = files.materialize_buckets(pts, "kept_patches", f"file://{tmp_path}/b", buckets=4)
    plan = graph.pairwise_features(t, 0.5)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = graph.pairwise_features(t, 0.5)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and pairs.count() == sum(n * n for n in [r["count"] for r in t.groupBy("cloud_id", "patch_id").count().collect()])
        spark.sql("DROP TABLE kept_patches")
        again = files.attach_buckets(spark, "kept_again", f"file://{tmp_path}/b", buckets=4)
        counts = again.groupBy("cloud_id", "patch_id").count()
        assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString() and counts.agg(F.sum("count")).first()[0] == 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS kept_again")
    assert len(list(Path(f"{tmp_path}/b").glob("*.parquet"))) == 4  # of 40 clouds


def test_a_scorer_is_loaded_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        Path(folder, f"{os.getpid()}-{uuid.uuid4().hex}").touch()
        return lambda pdf: pd.DataFrame({"src": pdf["point_id"][:-1].to_numpy(), "dst": pdf["point_id"][1:].to_numpy(), "prob": 0.5})

    pts = spark.range(3000).select((F.col("id") % 7).cast("string").alias("cloud_id"), (F.col("id") % 50).cast("int").alias("patch_id"), F.col("id").alias("point_id"))
    scored = graph.score_patches(pts, load=load)
    assert scored.count() == 3000 - 350 and scored.count() == 3000 - 350
    pids = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(pids) == len(set(pids)) < 350
    sizes = scored.groupBy("cloud_id", "patch_id").agg(F.min("src").alias("a"), F.max("dst").alias("b"))
    assert sizes.count() == 350 and scored.where("(dst - src) % 350 <> 0").isEmpty()
    with pytest.raises(Exception, match=r"patch \d+ of cloud \d has more than 5 points"):
        graph.score_patches(pts, load=load, most=5).count()
    assert graph.score_patches(pts.limit(0), load=load).count() == 0


def test_registry_survives_a_restart(spark, tmp_path):
    runs, table, check = f"file://{tmp_path}/runs", f"file://{tmp_path}/table", f"file://{tmp_path}/check"
    rng = np.random.default_rng(1)
    rows, now = [], []
    add = lambda some: spark.createDataFrame(some, streams.RUNS).coalesce(1).write.mode("append").parquet(runs)

    def best():
        by = {}
        for m, d, ts, score in rows:
            b = by.get((m, d), (-1.0, 0, 0))
            b = max(b[:2], (score, ts)) + (max(b[2], ts),)
            by[m, d] = b
        return sorted((m, d, *b) for (m, d), b in by.items())

    assert streams.registry(spark, table).count() == 0
    for k in range(3):
        some = [(f"m{rng.integers(3)}", "d", int(100 * k + i), float(rng.integers(5)) / 4) for i in range(10)]
        rows += some
        add(some)
        streams.watch_metrics(spark, runs, table, check).awaitTermination()
        now = sorted(map(tuple, streams.registry(spark, table).collect()))
        assert now == best()
    assert len(streams.versions(spark, table)) == 2
    # killed after the batch wrote its version and before the stream noted it: the batch comes again
    shutil.rmtree(tmp_path / "check/commits")
    (tmp_path / "check/commits").mkdir()
    (tmp_path / "table/version=7").mkdir()  # begun and not finished
    last = streams.versions(spark, table)[-1]
    streams.watch_metrics(spark, runs, table, check).awaitTermination()
    assert streams.versions(spark, table)[-1] == last and sorted(map(tuple, streams.registry(spark, table).collect())) == now


def test_slots_and_lines(spark):
    e = spark.createDataFrame([("c", 1, 2, 0.5), ("c", 1, 3, 0.5), ("c", 2, 3, 0.1), ("c", 4, 3, 0.2)], "cloud_id string, src long, dst long, dist double")
    got = {(r["node"], r["side"]): [] for r in graph.neighbour_slots(e, 2).collect()}
    for r in graph.neighbour_slots(e, 2).orderBy("rank").collect():
        got[r["node"], r["side"]].append((r["src"], r["dst"]))
    assert got == {(1, "out"): [(1, 2), (1, 3)], (2, "out"): [(2, 3)], (4, "out"): [(4, 3)], (2, "in"): [(1, 2)], (3, "in"): [(2, 3), (4, 3)]}
    n = 30
    way = [(i * 7) % n for i in range(n)]  # ids are not in order along the line
    edges = [("c", 0, a, b, 0.9) for a, b in zip(way, way[1:], strict=False)]
    edges += [(c, p, b, a, w) for c, p, a, b, w in edges]
    edges = spark.createDataFrame(edges, "cloud_id string, patch_id int, src long, dst long, prob double")
    pts = spark.createDataFrame([("c", p, float(i * 3), 0.0, 0.0) for i, p in enumerate(way)], "cloud_id string, point_id long, x double, y double, z double")
    lines = filament.segment_lines(edges, pts).orderBy("ord").collect()
    ids = [r["point_id"] for r in lines]
    assert ids in (way, way[::-1]) and [r["ord"] for r in lines] == list(range(n))
    assert [r["point_id"] for r in filament.segment_lines(edges, pts, sort=False).orderBy("ord").collect()] == list(range(n))
    smooth = filament.segment_lines(edges, pts, smooth_lines=True).orderBy("ord").collect()
    assert 4 < len(smooth) < n and (np.abs(np.diff([r["x"] for r in smooth])) > 0).all()


def test_region_tables(spark):
    rng = np.random.default_rng(6)
    rows = [(g, i, float(rng.random()), int(rng.random() < 0.5)) for g in ("a", "b") for i in range(200)]
    scored = spark.createDataFrame(rows, "group_id string, item_id long, score double, target int")
    bins = metrics.quantile_bins(scored.withColumnRenamed("score", "value"))
    by = {(r["bin"], r["group_id"], r["level"]): r for r in metrics.region_rollup(scored, bins).collect()}
    whole = by[None, None, 3]
    assert whole["tp"] + whole["fp"] + whole["tn"] + whole["fn"] == 400
    for b in ("global", "binned", "0", "top"):
        assert sum(by[b, g, 0]["tp"] for g in "ab") == by[b, None, 1]["tp"]
    pivot = {r["bin"]: r for r in metrics.region_pivot(scored, bins).collect()}
    assert set(pivot) == {b for b, _, _ in by if b} and abs(pivot["0"]["mean"] - (by["0", "a", 0]["f1"] + by["0", "b", 0]["f1"]) / 2) < 1e-12
    assert metrics.region_pivot(scored, bins, datasets=["a"]).columns == ["bin", "a", "mean"]


def test_named_holdout(spark):
    t = spark.range(600).select(F.concat(F.lit("i"), F.col("id") % 6).alias("image_id"), *[(F.col("id") % k).cast("int").alias(c) for c, k in (("tz", 5), ("ty", 7), ("tx", 11))])
    got = {(r["image_id"], r["split"]): r["count"] for r in cloud.train_test_split(t, holdout=("i2", "none")).groupBy("image_id", "split").count().collect()}
    assert got["i2", "test"] == 100 and ("i2", "train") not in got and sum(got.values()) == 600
    assert all(n == 4 for (i, s), n in got.items() if s == "test" and i != "i2")




def test_labelled_sets_of_each_kind(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv/2.5_line.csv").write_text("ID,X,Y,Z\n0,0,0,0\n0,25,0,0\n0,50,0,0\n1,0,100,0\n1,0,125,0\n")
    got = labelled.load_labelled_files(spark, "filament", f"file://{tmp_path}/csv")
    assert sorted((r["seg_id"], r["x"], r["y"]) for r in got["points"].collect()) == [(0, 0, 0), (0, 10, 0), (0, 20, 0), (1, 0, 40), (1, 0, 50)]
    assert sorted((r["src"], r["dst"]) for r in got["edges"].where("src < dst").collect()) == [(0, 1), (1, 2), (3, 4)]
    (tmp_path / "g.am").write_text("# AmiraMesh 3D ASCII 2.0\ndefine VERTEX 2\nVERTEX { float[3] VertexCoordinates } @1\nEDGE { int[2] EdgeConnectivity } @2\nEDGE { int NumEdgePoints } @3\nPOINT { float[3] EdgePointCoordinates } @4\n\n@1\n0 0 0\n2 0 0\n\n@2\n0 1\n\n@3\n3\n\n@4\n0 0 0\n10 0 0\n20 0 0\n")
    graph_ = labelled.load_labelled_files(spark, "filament", f"file://{tmp_path}/g.am")
    assert graph_["points"].count() == 3 and graph_["edges"].where("src < dst").count() == 2 and graph_["patches"].count() == 3
    rows = [(0.05 * i + 0.01, 0.01, 0.01, c) for i in range(20) for c in ["255 0 0" if i < 10 else "0 0 255"]]
    (tmp_path / "m.ply").write_text("ply\nend_header\n" + "".join(f"{x} {y} {z} {c}\n" * 2 for x, y, z, c in rows))
    for kind in ("part", "indoor"):
        got = labelled.load_labelled_files(spark, kind, f"file://{tmp_path}/m.ply")
        xs = sorted((r["x"], r["seg_id"]) for r in got["points"].collect())
        assert len(xs) == 20 and np.allclose([x for x, _ in xs], np.arange(20) + 0.2) and [s for _, s in xs] == [1] * 10 + [0] * 10
        seg = {r["point_id"]: r["seg_id"] for r in got["points"].collect()}
        assert all(seg[r["src"]] == seg[r["dst"]] for r in got["edges"].collect()) and got["patches"].count() == 20
    for i in range(2):
        (tmp_path / f"rooms/office/{i}.txt").parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f"rooms/office/{i}.txt").write_text("".join(f"{j} {i} 0 9 9 9\n" for j in range(12)))
    got = labelled.load_labelled_files(spark, "room", f"file://{tmp_path}/rooms")
    assert got["points"].count() == 24 and {r["cloud_id"] for r in got["points"].collect()} == {"office"}
    assert got["edges"].groupBy("src").count().agg(F.max("count")).first()[0] <= 8
    with pytest.raises(ValueError, match="no labelled set of kind"):
        labelled.read_labelled(spark, "moon", f"file://{tmp_path}")

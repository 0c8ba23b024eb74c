"""Rows whose ids, keys or colours are null stay, and a plain local session works."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from spatialseg.operators import cloud, filament, graph, project
from spatialseg.sources import files

POINTS = "cloud_id string, seg_id long, point_id long, ord int, x double, y double, z double"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def points(spark):
    return spark.createDataFrame([("c", 5, 0, 0, 0.0, 0.0, 0.0), ("c", 5, 1, 1, 3.0, 0.0, 0.0), ("c", None, 2, 0, 1.0, 1.0, 1.0), ("c", 9, 3, 0, 0.0, 0.0, 0.0), ("c", 9, 4, 1, 1.0, 0.0, 0.0), (None, 7, 5, 0, 0.0, 0.0, 0.0), (None, None, 6, 0, 0.0, 0.0, 0.0)], POINTS)


def test_dense_ids(spark):
    p = points(spark)
    want = [(0, 0), (1, 0), (2, None), (3, 1), (4, 1), (5, 0), (6, None)]
    assert rows(project.dense_ids(p, ["cloud_id"], "seg_id"), "point_id", "seg_id") == want
    assert rows(filament.renumber(p), "point_id", "seg_id") == want
    assert rows(cloud.normalize_ids(p, ["cloud_id"]), "point_id", "seg_id") == want
    assert rows(project.dense_ids(p, [], "seg_id", 3), "point_id", "seg_id") == [(0, 3), (1, 3), (2, None), (3, 5), (4, 5), (5, 4), (6, None)]
    assert project.dense_ids(p.limit(0), ["cloud_id"], "seg_id").count() == 0


def test_order_union_and_bends(spark):
    p = points(spark)
    assert rows(filament.sort_by_length(p), "point_id", "seg_id") == [(0, 1), (1, 1), (2, None), (3, 0), (4, 0), (5, 0), (6, None)]
    union = rows(filament.offset_union([p, p]), "point_id", "seg_id")
    assert len(union) == 14 and [s for i, s in union if i in (0, 3)] == [0, 2, 1, 3] and [s for i, s in union if i in (2, 6)] == [None] * 4
    assert rows(filament.cut_sharp_bends(p), "point_id", "seg_id") == [(0, 0), (1, 0), (2, None), (3, 1), (4, 1), (5, 0), (6, None)]


def test_numbered_segments(spark):
    c = spark.createDataFrame([("c", 1, 1), ("c", 2, 1), ("c", 5, 5), (None, 8, 8), ("c", 6, None)], "cloud_id string, node long, component long")
    assert rows(graph.number_segments(c), "node", "seg_id") == [(1, 0), (2, 0), (5, 1), (6, None), (8, 0)]


def test_colours(spark, tmp_path):
    p = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, 0.0, 9.0, 9.0), (2, None, 2.0, 3.0), (3, 1.0, 2.0, 3.0)], "point_id long, r double, g double, b double")
    assert rows(cloud.labels_from_color(p), "point_id", "seg_id") == [(0, 1), (1, 0), (2, None), (3, 1)]
    (tmp_path / "m.ply").write_text("ply\nend_header\n0 0 0 255 0 0\n1 1 1 0 0 255\n2 1 1 0 0 255\n")
    palette = spark.createDataFrame([(255, 0, 0, 4)], "r int, g int, b int, seg_id long")
    assert rows(files.read_ply_points(spark, f"file://{tmp_path}/m.ply", palette), "x", "seg_id") == [(0.0, 4), (1.0, None), (2.0, None)]
    assert rows(files.read_ply_points(spark, f"file://{tmp_path}/m.ply"), "x", "seg_id") == [(0.0, 1), (1.0, 0), (2.0, 0)]


def test_plain_local_session(tmp_path):
    """Without any setting of a shared folder, in a session of its own."""
    run = (
        "from pyspark.sql import SparkSession; import __spark_entry__ as e\n"
        "s = SparkSession.builder.master('local[4]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '4').getOrCreate()\n"
        "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
        "names = [n for n in ('g15_cut_graph', 'op9_jaccard_join') if n in e.queries()]\n"
        "print('ROWS', *[e.queries()[n](s, '/root/testdata/sf0.001').count() for n in names])"
    )
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.getcwd()}
    done = subprocess.run([sys.executable, "-c", run], env=env, capture_output=True, text=True, timeout=600)
    found = done.stdout.rpartition("ROWS")[2].split()
    assert found and all(int(n) > 0 for n in found), done.stderr[-2000:]

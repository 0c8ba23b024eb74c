"""What the driver is spared: threads, code and native memory of each job and exchange stay with it for the rest of a session or a part of it."""

import random

import numpy as np

from spatialseg import runtime
from spatialseg.components import connected_components
from spatialseg.llm import langid, mixing


def jobs_of(spark, f):
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    f()
    return len(set(tracker.getJobIdsForGroup(None)) - before)


def test_calibration_takes_few_jobs(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(x, rng.gauss(k, 1.0)) for k, x in enumerate(("a", "b", "c")) for _ in range(101 + k)]
    judged = runtime.cut(spark.createDataFrame(rows, "lang string, own double"), "judged")
    found, sizes = [], {"a": 101, "b": 102, "c": 103}
    assert 0 < jobs_of(spark, lambda: found.append(langid.bounds(judged, ["a", "b", "c", "d"], sizes))) <= 6
    monkeypatch.setattr(langid, "COUNTED_VALUES", 10)  # the way for languages of many rows
    found.append(langid.bounds(judged, ["a", "b", "c", "d"], sizes))
    for i, x in enumerate("abc"):
        own = np.array([v for k, v in rows if k == x])
        want = np.median(own) + max(langid.REJECT_SD * 1.4826 * np.median(abs(own - np.median(own))), langid.REJECT_NATS)
        assert all(abs(f[i] - want) < 1e-9 and np.isinf(f[3]) for f in found)


def test_contracted_components_take_no_rounds(spark, monkeypatch):
    made, write = [], runtime.Scratch.cut
    monkeypatch.setattr(runtime.Scratch, "cut", lambda self, df, name="step": (made.append(name), write(self, df, name))[1])
    rng = random.Random(4)
    ends = [(i, i + 1) for i in range(12_000)] + [(20_000 + i, 20_000 + rng.randrange(40)) for i in range(40)]
    frame = spark.createDataFrame(ends, "src long, dst long").coalesce(1)
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # one task, and more rows than a batch has
    try:
        got = {r["node"]: r["component"] for r in connected_components(frame).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    assert made.count("stars") == 0
    low = {n: n for e in ends if e[0] != e[1] for n in e}
    for _ in range(45):
        for a, b in ends[12_000:]:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    assert got == {n: 0 if n <= 12_000 else low[n] for n in low}


def test_mix_goes_in_short_plans(spark, monkeypatch):
    docs = runtime.cut(spark.createDataFrame([(i, "a b " * (i % 7), "s" if i % 3 else None) for i in range(300)], "doc_id long, text string, source string"), "docs")
    plans, write = {}, mixing.cut
    monkeypatch.setattr(mixing, "cut", lambda df, name: (plans.update({name: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")}), write(df, name))[1])
    got = {r["doc_id"]: r["count"] for r in mixing.mix(docs).groupBy("doc_id").count().collect()}
    assert max(plans.values()) <= 6, plans
    assert got == {r["doc_id"]: r["_copies"] for r in mixing.mix_plan(docs).where("_copies > 0").collect()}

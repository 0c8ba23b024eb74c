"""Components of long chains take few rounds, and graphs of several clouds stay apart."""

import random

from spatialseg import runtime
from spatialseg.components import connected_components
from spatialseg.operators import filament, graph

EDGES = "cloud_id string, src long, dst long, prob double"


def rounds_of(monkeypatch):
    made, write = [], runtime.Scratch.cut
    monkeypatch.setattr(runtime.Scratch, "cut", lambda self, df, name="step": (made.append(name), write(self, df, name))[1])
    return made


def test_rounds_of_a_chain(spark, monkeypatch):
    made = rounds_of(monkeypatch)
    ends = [(i, i + 1) for i in range(3000)] + [(i + 1, i) for i in range(5000, 8000)]
    random.Random(1).shuffle(ends)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(ends, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(3001)} | {i: 5000 for i in range(5000, 8001)}
    assert made.count("stars") <= 5


def test_clouds_stay_apart(spark):
    rng = random.Random(2)
    rows = [(c, rng.randrange(90), rng.randrange(90), 1.0) for c in ("a", "b", "-", "+", None) for _ in range(60)] + [("a", None, 3, 1.0), ("empty", 4, 4, 1.0)]
    want = {}
    for c in {r[0] for r in rows}:
        low = {n: n for r in rows if r[0] == c and None not in r[1:3] and r[1] != r[2] for n in r[1:3]}
        for _ in low:
            for r in rows:
                if r[0] == c and r[1] in low and r[2] in low:
                    low[r[1]] = low[r[2]] = min(low[r[1]], low[r[2]])
        want |= {(c, n): x for n, x in low.items()}
    found = graph.segment_components(spark.createDataFrame(rows, EDGES)).collect()
    assert {(r["cloud_id"], r["node"]): r["component"] for r in found} == want and len(found) == len(want)


def test_confidence_of_kept_edges(spark):
    rng = random.Random(3)
    one = [("a", n, n + 1 + rng.randrange(3), 0.5 + rng.randrange(50) / 100) for n in rng.choices(range(60), k=200)]
    e = spark.createDataFrame(one + [(c, b, a, p) for c, a, b, p in one], EDGES)
    kept = runtime.cut(graph.kept_edges(e, 0.7, 2), "kept")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(filament.kept_confidence(kept, graph.cut_kept(kept, 3))) == rows(filament.confidence(e, graph.cut_graph(e, 0.7, 2, 3), 0.7, 2))

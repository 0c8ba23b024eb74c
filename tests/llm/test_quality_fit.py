"""The fit that op8 runs: its prior, its word counts and its bounds."""

import ast
import pathlib
import random
from collections import Counter

import numpy as np

from spatialseg.llm import quality

GOOD, BAD = "The river runs, slowly and quietly, past the old mill.", "BUY!!! $$$ 99% OFF >>> CLICK 111 222 <<< HERE ###"


def corpus(spark, share, n=3000, seed=1):
    rng = random.Random(seed)

    def text(good):
        words = (GOOD if good else BAD).split()
        return " ".join(rng.choice(words) for _ in range(rng.randrange(20, 60)))

    return spark.createDataFrame([(i, text(rng.random() < share if i >= 600 else i < 500)) for i in range(n)], "doc_id long, text string")


def test_nothing_is_defined_twice():
    for path in pathlib.Path("spatialseg").rglob("*.py"):
        names = Counter(n.name for n in ast.parse(path.read_text()).body if isinstance(n, ast.FunctionDef | ast.ClassDef) and n.name != "_")
        assert max(names.values(), default=1) == 1, (path, names.most_common(1))


def test_prior_is_the_share_among_unlabelled_rows(spark):
    for share in (0.3, 0.7):
        docs = corpus(spark, share)
        # labels are of the good alone but for a few: their share says nothing of the corpus
        labels = spark.createDataFrame([(i, 1 if i < 500 else 0) for i in range(600)], "doc_id long, quality int")
        model = quality.fit(docs, labels)
        rows = docs.collect()
        truth = np.mean(["river" in r["text"] or "mill" in r["text"] or "slowly" in r["text"] for r in rows])
        assert abs(model.prior - truth) < 0.07
        s = {r["doc_id"]: r["score"] for r in quality.score(docs, model, ["doc_id"]).collect()}
        good = {r["doc_id"] for r in rows if "$$$" not in r["text"] and "###" not in r["text"]}
        assert np.mean([(s[i] >= 0.5) == (i in good) for i in s]) > 0.97


def test_words_are_counted_over_all_documents(spark, monkeypatch):
    monkeypatch.setattr(quality, "UNLABELLED", 50)
    docs = corpus(spark, 0.5)
    counts = Counter()
    for r in docs.collect():
        counts.update(set(r["text"].lower().split()))
    most = 8
    monkeypatch.setattr(quality, "FREQUENT_WORDS", most)
    labels = spark.createDataFrame([(i, 1 if i < 500 else 0) for i in range(600)], "doc_id long, quality int")
    want = {w.encode() for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]}
    assert quality.fit(docs, labels).frequent == want


def test_conflicting_and_repeated_ids(spark, monkeypatch):
    docs = corpus(spark, 0.5, 1200)
    labels = [(i, 1 if i < 500 else 0) for i in range(600)]
    fetched = []
    plain = quality.feature_rows

    def counting(df, keep, frequent):
        fetched.append((df.count(), {r["y"] for r in df.select("y").distinct().collect()}))
        return plain(df, keep, frequent)

    monkeypatch.setattr(quality, "feature_rows", counting)
    both = spark.createDataFrame(labels + [(i, 1 - y) for i, y in labels if i % 2], "doc_id long, quality int")
    quality.fit(docs, both)
    assert fetched[0][0] == 300  # ids labelled both ways are unlabelled
    fetched.clear()
    monkeypatch.setattr(quality, "POSITIVES", 100)
    monkeypatch.setattr(quality, "CALIBRATION", 100)
    monkeypatch.setattr(quality, "UNLABELLED", 200)
    many = docs.union(spark.range(10_000).selectExpr("0L", "concat('The mill ', id, '.')")).union(spark.range(10_000).selectExpr("500L", "concat('BUY ', id, '!')"))
    quality.fit(many, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert all(n <= 2 * 2 * 200 for n, _ in fetched)

"""Every stage of the pipeline against a plain version."""

import math
import random
from collections import Counter

import pytest

import corpus_pipeline
from spatialseg.llm import pii
from spatialseg.runtime import cut
from tests.llm.test_brute_force import components, words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(90_000, None, "en", "s", 0), (90_001, "12 34", "en", None, 5), (90_002, "a@b.cc and the of that it is", None, None, 1)], docs.schema)
    docs = cut(docs.union(odd), "in")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = cut(stage(spark, docs, SF), name)
        rows = docs.collect()
        seen[name] = (before, rows)
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    before, after = seen["language_id"]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {90_000, 90_001}
    before, after = seen["near_duplicates"]
    comp = components({r["doc_id"]: words(r["text"], 5) for r in before}, 80, 100)
    assert sorted(r["doc_id"] for r in after) == sorted({i for i, c in comp.items() if i == c})
    twice = spark.createDataFrame([(5, "one two three four five six", "a", "s", 1)] * 3 + [(5, "quite another text than that one", "a", "s", 1), (None, None, None, None, None), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicate_stage(spark, twice, SF).collect()
    assert sorted(str(r["text"]) for r in kept) == ["None", "None", "one two three four five six", "quite another text than that one"]
    before, after = seen["personal_data"]
    text = {r["doc_id"]: r["text"] for r in before}
    assert len(after) == len(before)
    for r in after:
        found = [s for s in pii.spans(text[r["doc_id"]]) if s[0] != "url"]
        assert (r["text"] == text[r["doc_id"]]) == (not found) and r["n_chars"] == len(r["text"])
        assert not [s for s in pii.spans(r["text"]) if s[0] in ("email", "ip", "card", "phone")]
    before, after = seen["source_mix"]
    times = Counter(r["doc_id"] for r in after)
    assert set(times) <= {r["doc_id"] for r in before} and max(times.values()) <= math.ceil(2)
    before, after = seen["packing"]
    assert Counter(r["doc_id"] for r in after if r["piece"] == 0) == Counter(r["doc_id"] for r in before)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, seen[name][0] and spark.createDataFrame(seen[name][0][:1]).limit(0).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "cast(lang as string) lang", "cast(source as string) source", "cast(n_chars as long) n_chars"), SF).count() == 0


@pytest.mark.parametrize("percent", [1, 5, 20])
def test_planted_noise_goes(spark, percent):
    """Noise that is marked as English is trained on with the rest, and goes; no text of the table goes with it."""
    rng = random.Random(percent)
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*corpus_pipeline.COLUMNS)
    n = round(real.where("lang = 'en'").count() * percent / (100 - percent))
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(rng.randint(20, 200))) for _ in range(n)]
    docs = cut(real.union(spark.createDataFrame([(1_000_000 + i, t, "en", "s", len(t)) for i, t in enumerate(noise)], real.schema)), "noisy")
    kept = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, SF).select("doc_id").collect()}
    assert not [i for i in kept if i >= 1_000_000]
    assert kept == {r["doc_id"] for r in real.where("text rlike '\\\\p{L}'").collect()}

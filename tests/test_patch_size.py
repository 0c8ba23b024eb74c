"""Patch sizes below the step, against the query's SQL; runs of repeated and missing numbers."""

import duckdb
import pytest

import __spark_entry__ as entry
from spatialseg.operators import classify, cloud


@pytest.mark.parametrize("spread", [0.0, 8.0])
def test_crowded_places(spark, tmp_path, spread):
    """More points than a patch may have at one place, or near it: no size above the step will do."""
    rows = [(500 * i, f"{500 * i}", 7.0 + spread * i / 700) for i in range(700)] + [(i, f"{i}", float(i % 97)) for i in range(1, 400)]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO events VALUES (?, 0, 'a', ?)", [(i, v) for i, _, v in rows])
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = con.execute(entry.oracle_sql()["c11_choose_patch_size"]).fetchall()[0][0]
    got = cloud.choose_patch_size(entry.catalogue.A.points(spark, str(tmp_path)), 500)
    assert want is not None and got == pytest.approx(want, abs=1e-6)


def test_runs_of_repeated_and_missing_numbers(spark):
    rows = spark.createDataFrame([("a", n) for n in (1, 1, 2, 3, 3, 7, None, None)] + [("b", 5), ("b", 5)], "k string, n long")
    got = sorted(((r["k"], r["first"], r["last"], r["size"]) for r in classify.consecutive_runs(rows, ["k"], "n").collect()), key=str)
    assert got == sorted([("a", 1, 3, 3), ("a", 7, 7, 1), ("a", None, None, 1), ("b", 5, 5, 1)], key=str)
    plan = classify.consecutive_runs(rows, ["k"], "n")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # the numbers are not made distinct in a table of their own

"""Percentile stretch of images whose two bounds are equal, against the query's SQL."""

import duckdb

import __spark_entry__ as entry


def test_equal_bounds(spark, tmp_path):
    con = duckdb.connect()
    # images 0 to 3 have one value, the others many
    con.execute("CREATE TABLE lineitem AS SELECT (i % 8)::BIGINT AS l_suppkey, (i // 8 % 64)::BIGINT AS l_partkey, (i // 512 % 7 + 1)::INT AS l_linenumber, (i // 3584 + 1)::DOUBLE AS l_quantity, CASE WHEN i % 8 < 4 THEN 60000.0 + 20000 * (i % 2) ELSE (i * 7919 % 100000)::DOUBLE END AS l_extendedprice FROM range(8000) r(i)")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    cells = lambda rows: {tuple(r[:4]): r[4] for r in rows}
    want = cells(con.execute(f"SELECT image_id, z, y, x, value FROM ({entry.oracle_sql()['n4_norm_percentile_dtype']})").fetchall())
    got = cells(entry.queries()["n4_norm_percentile_dtype"](spark, str(tmp_path)).select("image_id", "z", "y", "x", "value").collect())
    assert got == want
    assert {v for k, v in got.items() if k[0] == 0} == {150.0} and {v for k, v in got.items() if k[0] == 3} == {1.0}

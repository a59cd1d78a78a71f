"""matches_term over parts with repeated and null names: rows with names as in SQL, null hits for those without, the pairs of names dealt over tasks."""

import duckdb

from leadloom.plans import catalog


def test_matches_term(spark, tmp_path):
    names = ["Green anodized bolt", "green bolt", "bolted x", "ab", None, ""]
    rows = [(k, names[k % 6], k % 3 if k % 20 else None) for k in range(120)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = catalog.QUERIES["matches_term"](spark, str(tmp_path))
    have, want = list(map(tuple, got.collect())), set(con.execute(catalog.ORACLE["matches_term"]).fetchall())
    named = lambda found: {x for x in found if x[0] % 6 != 4 and x[1] is not None}
    assert named(have) == named(want) and {x[:2] for x in have} == {x[:2] for x in want} and len(set(have)) == len(have)
    assert all(x[2] is None for x in have if x[0] % 6 == 4 and x[1] not in ("ab", ""))
    assert f", {catalog.PARTS})" in got._jdf.queryExecution().executedPlan().toString()

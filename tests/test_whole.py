"""Queries read all of their rows: larger tables than the SQL of the catalog looks at, and rows that the test tables do not have."""

import duckdb
import pytest

from leadloom.plans import catalog
from tests.test_queries import TABLES, plain

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["analysis_requests", "matches_term", "score_explanation", "fact_support", "normalized_hash", "normalize_items", "check_report", "validate_responses", "audit_constraints", "dedup_assignments_near"])
def test_larger_tables(spark, duck, name):
    assert plain(catalog.QUERIES[name](spark, SF).toPandas()) == plain(duck.sql(catalog.ORACLE[name]).df())


def test_run_pipeline_profiles(spark, monkeypatch):
    seen = []
    monkeypatch.setattr("leadloom.plans.pipeline.run_pipeline", lambda spark, out, sources, raw, people, rules: seen.append(people.select("id", "revision").collect()) or {})
    catalog.QUERIES["run_pipeline"](spark, "/root/testdata/sf0.001")
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").collect()
    assert all(sorted(x) == sorted((c["c_custkey"], 1) for c in customers) for x in seen) and len(customers) > 20


def test_pairs_of_repeated_rows(spark):
    from leadloom.operators.scoring import eligible_pairs

    kinds = ["CONSTRUCTION", "HORECA", "OTHER"]
    analyses = [(i // 2, kinds[i // 2 % 3], "SUCCEEDED" if i % 5 else "FAILED") for i in range(200)]
    profiles = [(p, [kinds[p % 3], kinds[p % 2], kinds[p % 3]]) for p in range(12)]
    got = eligible_pairs(spark.createDataFrame(analyses, "id long, vertical string, status string"), spark.createDataFrame(profiles, "profile_id long, verticals array<string>"))
    assert got.columns == ["vertical", "id", "status", "profile_id", "verticals"]
    wanted = sorted((i, p) for i, v, s in analyses for p, vs in profiles if s == "SUCCEEDED" and v in vs and v != "OTHER")
    assert sorted((r["id"], r["profile_id"]) for r in got.collect()) == wanted


def test_normalized_hash(spark, tmp_path):
    import hashlib

    opening = "The same opening of more than sixty letters stands before what tells these texts apart, "
    texts = {1: (opening + "one", opening + "one"), 2: (opening + "two", opening + "two"), 3: (f"<p>{opening}A &amp; B</p>", opening + "A & B")}
    spark.createDataFrame([(i, t, "s1") for i, (t, _) in texts.items()], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["raw_item_id"]: r["normalized_hash"] for r in catalog.QUERIES["normalized_hash"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, (_, t) in texts.items()}


def test_decode_entities(spark, tmp_path):
    import hashlib

    spark.createDataFrame([(1, "a &#65; &#x42; &amp;"), (2, "b &lt;")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["digest"] for r in catalog.QUERIES["decode_entities"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.md5(t.encode()).hexdigest() for i, t in ((1, "a A B &"), (2, "b <"))}


def test_delivery_conflicts(spark, duck):
    wanted = duck.sql("SELECT event_id AS id, 'FAILED' AS status FROM events WHERE event_id % 4000 = 1 AND event_id > 4000").df()
    assert len(wanted) and plain(catalog.QUERIES["delivery_conflicts"](spark, SF).toPandas()) == plain(wanted)

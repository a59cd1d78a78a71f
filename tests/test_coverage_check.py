"""Ids that are due for a missing and for a repeated assignment are reported as both."""

from leadloom.plans import catalog


def test_missing_and_repeated(spark, tmp_path):
    spark.createDataFrame([(i, "text", "src1") for i in (4, 5, 90, 92, 8099, 8100)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["check_dedup_coverage"](spark, str(tmp_path)).collect())
    assert got == [
        ("MISSING_ASSIGNMENT", 90), ("MISSING_ASSIGNMENT", 8100), ("OUTSIDE_REFERENCE", -1), ("REPEATED_ASSIGNMENT", 92), ("REPEATED_ASSIGNMENT", 8100), ("UNKNOWN_ITEM", 92), ("UNKNOWN_ITEM", 8100),
    ]

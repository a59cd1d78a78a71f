"""Prefix sums by range parts and pages of a stored order."""

import datetime
import random
from bisect import bisect_left

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from leadloom.operators import dedup, serving

START = datetime.datetime(2026, 1, 1)


def test_pairs_in_window(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), START + datetime.timedelta(minutes=r.choice([r.randint(0, 9000), r.randint(0, 30)]))) for _ in range(400)] + [("c", START), ("a", None)]
    got = {x["vertical"]: x["pairs"] for x in dedup.pairs_in_window(spark.createDataFrame(rows, "vertical string, observed_at timestamp"), 24).collect()}
    rows = [x for x in rows if x[1] is not None]
    want = {v: sum(a[0] == b[0] == v and abs(a[1] - b[1]) <= datetime.timedelta(hours=24) for i, a in enumerate(rows) for b in rows[:i]) for v in ("a", "b", "c", None)}
    assert got == want and dedup.pairs_in_window(spark.createDataFrame([], "vertical string, observed_at timestamp")).count() == 0


def test_a_million_items_in_an_hour(spark):
    """Within the window of a second; the tasks of one vertical are alike."""
    at = F.timestamp_millis(F.lit(1767225600000) + F.pmod(F.xxhash64("id"), F.lit(3_600_000)))
    items = spark.range(1_000_000).select(F.lit("v").alias("vertical"), at.alias("observed_at"))
    seen = []
    kept = dedup.cut
    dedup.cut = lambda df: (seen.append(kept(df)), seen[-1])[1]
    try:
        got = dedup.pairs_in_window(items, 1).first()["pairs"]
    finally:
        dedup.cut = kept
    assert got == 1_000_000 * 999_999 // 2  # all are within the hour
    sizes = sorted(x["count"] for x in seen[0].groupBy("part").count().collect())
    assert len(sizes) == 4 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    millis = sorted(x["t"] for x in items.sample(0.02, 3).select(F.unix_millis("observed_at").alias("t")).collect())
    some = spark.createDataFrame([("v", t) for t in millis], "vertical string, t long").select("vertical", F.timestamp_millis("t").alias("observed_at"))
    few = some.withColumn("observed_at", F.timestamp_millis(F.unix_millis("observed_at") * 100))  # so that an hour is 36 seconds of these
    want = sum(i - bisect_left(millis, t - 36_000) for i, t in enumerate(millis))
    assert dedup.pairs_in_window(few, 1).first()["pairs"] == want


def test_pages_of_a_stored_order(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, float(r.randint(0, 20)), START + datetime.timedelta(days=r.randint(0, 3)), f"x{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, total_score double, created_at timestamp, note string")
    path = str(tmp_path / "ranked")
    serving.write_ranked(df, path, 100)
    order = sorted(rows, key=lambda x: (-x[1], -x[2].timestamp(), x[0]))
    got, cursor = [], None
    while True:
        found = serving.ranked_page(spark, path, 60, cursor).collect()
        if not found:
            break
        got += [tuple(x) for x in found]
        cursor = {"total_score": found[-1]["total_score"], "created_at": found[-1]["created_at"], "id": found[-1]["id"]}
    assert got == order
    one = serving.ranked_page(spark, path, 5, {"total_score": 10.0, "created_at": START, "id": -1})
    files = spark.read.parquet(f"{path}/rows").filter(F.col("part").isin(*{x["part"] for x in spark.read.parquet(f"{path}/rows").join(one.select("id"), "id").collect()}))
    assert one.count() == 5 and files.select("part").distinct().count() <= 2
    assert serving.ranked_page(spark, path, 5).count() == 5
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan


def test_ranges_without_sorting(spark, tmp_path):
    """First and last keys come from an aggregation, nulls and NaN in their places; no task holds or sorts the rows of a file."""
    at = lambda d: None if d is None else START + datetime.timedelta(days=d)
    rows = [(i, x, at(d)) for i, (x, d) in enumerate([(x, d) for x in (None, float("nan"), -0.5, 0.0, 7.25) for d in (None, 0, 3)] * 2)]
    df = spark.createDataFrame(rows, "id long, total_score double, created_at timestamp")
    assert [x["id"] for x in df.orderBy(F.desc(serving._place())).collect()] == [x["id"] for x in df.orderBy(*serving._order()).collect()]
    plans, write = [], DataFrameWriter.parquet
    DataFrameWriter.parquet = lambda self, path, *args, **named: (plans.append((path, self._df._jdf.queryExecution().executedPlan().toString())), write(self, path, *args, **named))[1]
    try:
        serving.write_ranked(df, str(tmp_path / "ranked"), 4)
    finally:
        DataFrameWriter.parquet = write
    plan = next(p for path, p in plans if path.endswith("/ranges"))
    assert "Window" not in plan
    ranges = {x["part"]: x for x in spark.read.parquet(str(tmp_path / "ranked/ranges")).collect()}
    for part, x in ranges.items():
        ids = [y["id"] for y in spark.read.parquet(str(tmp_path / "ranked/rows")).filter(F.col("part") == part).orderBy(*serving._order()).collect()]
        assert (x["first"]["id"], x["last"]["id"], x["n"]) == (ids[0], ids[-1], len(ids))

"""Profiles and the reads that serve opportunities and sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = (("total_score", True), ("created_at", True), ("id", False))


def _order() -> list[Column]:
    return [F.desc(c) if down else F.asc(c) for c, down in ORDER]


def _place() -> Column:
    """A value that descends in the order of the sort key, nulls and NaN in their places."""
    return F.struct("total_score", "created_at", F.col("id").isNull(), F.bitwise_not("id"))


def latest_profiles(profiles: DataFrame) -> DataFrame:
    """Per user the newest revision; of equal revisions the smallest id."""
    order = Window.partitionBy("user_id").orderBy(F.desc("revision"), F.asc("id"))
    return profiles.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def apply_profile_patches(profiles: DataFrame, patches: DataFrame, users: DataFrame, fields: list[str]) -> DataFrame:
    """New revisions: patches (user_id, seq, nullable fields) in order, each carrying over what it leaves out.

    Patches of users that are not ACTIVE are refused. A null field is not specified.
    """
    base = latest_profiles(profiles).select("user_id", "id", F.col("revision").alias("_base"), *[F.col(f).alias(f"_{f}") for f in fields])
    active = patches.join(users.filter("status = 'ACTIVE'").select("user_id"), "user_id", "left_semi").join(base, "user_id")
    so_far = Window.partitionBy("user_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {f: F.coalesce(F.last(f, ignorenulls=True).over(so_far), F.col(f"_{f}")) for f in fields}
    revision = F.col("_base") + F.row_number().over(Window.partitionBy("user_id").orderBy("seq"))
    return active.withColumns({**{f"n_{f}": c for f, c in out.items()}, "revision": revision}).select("id", "revision", "user_id", *[F.col(f"n_{f}").alias(f) for f in fields])


def profile_conflicts(profiles: DataFrame) -> DataFrame:
    """(id, revision, problem) of profiles that contradict themselves or break the bounds."""
    low = lambda c: F.transform(c, lambda x: F.lower(F.trim(x)))
    overlap = lambda a, b: F.arrays_overlap(low(F.col(a)), low(F.col(b)))
    lists = ("verticals", "regions", "keywords", "excluded_keywords", "interested_event_types", "ignored_event_types")
    size = lambda c, least: (F.size(c) < least) | (F.size(c) > 100) | (F.size(F.array_distinct(low(F.col(c)))) < F.size(c))
    checks = {
        "KEYWORDS_EXCLUDED": overlap("keywords", "excluded_keywords"), "EVENTS_IGNORED": overlap("interested_event_types", "ignored_event_types"),
        "VALUE_RANGE": (F.col("project_value_minimum") > F.col("project_value_maximum")) | (F.col("project_value_minimum") < 0),
        "CURRENCY": (F.coalesce("project_value_minimum", "project_value_maximum").isNotNull() & F.col("currency").isNull()) | ~F.coalesce(F.col("currency").rlike("^[A-Z]{3}$"), F.lit(True)),
        **{f"ITEMS_{c.upper()}": size(c, 1 if c == "verticals" else 0) for c in lists if c in profiles.columns},
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return profiles.select("id", "revision", F.explode(found).alias("problem"))


def list_opportunities(
    recommendations: DataFrame, n: int, minimum_score=None, category=None, vertical=None, status=None, created_from=None, created_to=None, user_id=None
) -> DataFrame:
    """First n of each user (n + 1 shows whether there are more): score, then newest, then id. Both time ends inclusive."""
    df = recommendations
    for column, value in (("category", category), ("vertical", vertical), ("status", status), ("user_id", user_id)):
        df = df if value is None else df.filter(F.col(column) == value)
    df = df if minimum_score is None else df.filter(F.col("total_score") >= minimum_score)
    df = df if created_from is None else df.filter(F.col("created_at") >= F.lit(created_from).cast("timestamp"))
    df = df if created_to is None else df.filter(F.col("created_at") <= F.lit(created_to).cast("timestamp"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(*_order()))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def page_after(rows: DataFrame, cursor: dict, n: int) -> DataFrame:
    """The next n rows after a cursor with the values of the sort key, of any rows; see ranked_page for a stored order."""
    return rows.filter(_after(F.col, cursor)).orderBy(*_order()).limit(n)


def write_ranked(rows: DataFrame, path: str, files: int) -> None:
    """Rows as files in the order of the sort key, and beside them the table of their ranges: file, first and last key, number of rows.

    Rows with equal keys stand in one file. Ranges are one row a file, from one pass over what was written.
    """
    spark = rows.sparkSession
    rows.repartitionByRange(files, *_order()).sortWithinPartitions(*_order()).withColumn("part", F.spark_partition_id()).write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    kept = spark.read.parquet(f"{path}/rows").select("part", F.struct(*[c for c, _ in ORDER]).alias("key"), _place().alias("place"))
    ends = kept.groupBy("part").agg(F.max_by("key", "place").alias("first"), F.min_by("key", "place").alias("last"), F.count("*").alias("n"))
    ends.coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")


def _after(value, cursor: dict):
    """Whether a key stands after a cursor; value names the columns of the key."""
    after, equal = F.lit(False), F.lit(True)
    for c, down in ORDER:
        given = F.lit(cursor[c])
        after = after | (equal & (value(c) < given if down else value(c) > given))
        equal = equal & (value(c) == given)
    return after


def ranked_page(spark: SparkSession, path: str, n: int, cursor: dict | None = None) -> DataFrame:
    """The first n rows of a table of write_ranked, or the next n after a cursor, in order.

    The ranges name the files whose rows come next; only as many are read as hold n rows beside the one that the cursor is in.
    """
    ranges = spark.read.parquet(f"{path}/ranges")
    if cursor is not None:
        ranges = ranges.filter(_after(lambda c: F.col(f"last.{c}"), cursor))
    wanted, have = [], 0
    for r in ranges.orderBy("part").limit(n + 1).select("part", "n").collect():  # each file has a row at least
        wanted.append(r["part"])
        have += r["n"] if cursor is None or len(wanted) > 1 else 0  # of the first file some rows may stand before the cursor
        if have >= n:
            break
    rows = spark.read.parquet(f"{path}/rows").filter(F.col("part").isin(wanted)).drop("part")
    rows = rows if cursor is None else rows.filter(_after(F.col, cursor))
    return rows.orderBy(*_order()).limit(n)


def find_opportunity(recommendations: DataFrame, user_id, signal_id) -> DataFrame:
    newest = Window.partitionBy("user_id", "signal_id").orderBy(F.desc("profile_revision"), F.desc("created_at"), F.asc("id"))
    own = recommendations.filter((F.col("user_id") == user_id) & (F.col("signal_id") == signal_id))
    return own.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")


def saved_opportunities(recommendations: DataFrame, feedback: DataFrame, n: int) -> DataFrame:
    """What each user saved, of any revision, in the same order."""
    saved = feedback.filter("action = 'SAVED'").select("user_id", F.col("recommendation_id").alias("id")).distinct()
    return list_opportunities(recommendations.join(saved, ["user_id", "id"], "left_semi"), n)


def opportunity_sources(links: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """Nested source links of each recommendation. links: recommendation_id, item_id; items: item_id, source_id, url, published_at."""
    joined = links.join(items, "item_id").join(sources.select("source_id", "name"), "source_id")
    return joined.groupBy("recommendation_id").agg(F.sort_array(F.collect_list(F.struct("item_id", "url", "published_at", "source_id", "name"))).alias("links"))


def list_sources(sources: DataFrame, enabled=None, rights=None, ai_allowed=None, vertical=None) -> DataFrame:
    tests = [F.col(c) == v for c, v in (("enabled", enabled), ("rights", rights), ("ai_allowed", ai_allowed)) if v is not None]
    if vertical is not None:
        tests.append(F.array_contains("verticals", vertical))
    return (sources.filter(reduce(lambda a, b: a & b, tests)) if tests else sources).orderBy("source_id")

"""Daily and weekly digests of all users and periods in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 5
DIGEST_IDENTITY = ["user_id", "kind", "period_start", "period_end", "version"]
DIGEST_VERSION = "digest-v1"
HIGH = ("HIGH", "CRITICAL")


def digest_periods(instant: Column, kind: str) -> tuple[Column, Column, Column]:
    """(start, end, start of the period before): a UTC day, or a week from Monday."""
    days = 1 if kind == "DAILY" else 7
    start = F.date_trunc("day" if kind == "DAILY" else "week", instant)
    step = F.make_dt_interval(F.lit(days))
    return start, start + step, start - step


def digest_candidates(recommendations: DataFrame, signals: DataFrame, analyses: DataFrame, profiles: DataFrame, kind: str) -> DataFrame:
    """Recommendations of the latest profile with a live signal and a succeeded analysis, with the signal's period."""
    live = signals.filter(F.col("status").isin("ACTIVE", "CANDIDATE")).select("signal_id", "category", F.col("created_at").alias("signal_at"))
    good = analyses.filter("status = 'SUCCEEDED'").select("analysis_id").distinct()
    latest = profiles.select(F.col("id").alias("profile_id"), F.col("revision").alias("profile_revision"))
    start, end, _ = digest_periods(F.col("signal_at"), kind)
    rows = recommendations.join(latest, ["profile_id", "profile_revision"], "left_semi").join(good, "analysis_id", "left_semi").join(live, "signal_id")
    return rows.withColumns({"kind": F.lit(kind), "period_start": start, "period_end": end})


def _best() -> list[Column]:
    return [F.desc("total_score"), F.desc("created_at"), F.asc("id")]


def unique_by_signal(candidates: DataFrame) -> DataFrame:
    by = Window.partitionBy("user_id", "period_start", "signal_id").orderBy(*_best())
    return candidates.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r")


def digest_top5(unique: DataFrame, n: int = TOP) -> DataFrame:
    by = Window.partitionBy("user_id", "period_start").orderBy(*_best())
    return unique.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)


def weekly_funnel(raw: DataFrame, assignments: DataFrame, signals: DataFrame) -> DataFrame:
    """By week of each stage's own time: processed, unique, relevant. Global, not by user."""
    week = lambda df, c, name: df.groupBy(F.date_trunc("week", c).alias("period_start")).agg(F.count("*").alias(name))
    heads = assignments.filter("match_kind = 'REPRESENTATIVE'")
    out = week(raw, "received_at", "processed").join(week(heads, "created_at", "unique_items"), "period_start", "full").join(week(signals, "created_at", "relevant"), "period_start", "full")
    return out.fillna(0, ["processed", "unique_items", "relevant"])


def category_trends(unique: DataFrame, days: int = 7, n: int = TOP) -> DataFrame:
    """Categories that grew against the period before: delta, then current, then name; the first n of each."""
    now = unique.groupBy("user_id", "period_start", "category").agg(F.count("*").alias("current"))
    before = now.select("user_id", (F.col("period_start") + F.make_dt_interval(F.lit(days))).alias("period_start"), "category", F.col("current").alias("previous"))
    both = now.join(before, ["user_id", "period_start", "category"], "left").fillna(0, ["previous"]).withColumn("delta", F.col("current") - F.col("previous")).filter("delta > 0")
    by = Window.partitionBy("user_id", "period_start").orderBy(F.desc("delta"), F.desc("current"), F.asc("category"))
    return both.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)


def build_digests(candidates: DataFrame, stored: DataFrame | None = None, users: DataFrame | None = None) -> dict[str, DataFrame]:
    """digests, items, trends of candidates of one kind; stored identities are left out.

    A day without candidates makes no digest; a week does, for each of users (user_id, period_start, period_end).
    """
    unique = unique_by_signal(candidates)
    digests = unique.groupBy("user_id", "kind", "period_start", "period_end").agg(F.count("*").alias("opportunities"), F.count_if(F.col("band").isin(*HIGH)).alias("high_priority"))
    if users is not None:
        empty = users.select("user_id", F.lit("WEEKLY").alias("kind"), "period_start", "period_end").join(digests, ["user_id", "kind", "period_start", "period_end"], "left_anti")
        digests = digests.unionByName(empty.withColumns({"opportunities": F.lit(0).cast("long"), "high_priority": F.lit(0).cast("long")}))
    digests = digests.withColumn("version", F.lit(DIGEST_VERSION))
    if stored is not None:
        digests = digests.join(stored.select(*DIGEST_IDENTITY), DIGEST_IDENTITY, "left_anti")
    own = digests.select("user_id", "period_start")
    return {"digests": digests, "items": digest_top5(unique).join(own, ["user_id", "period_start"], "left_semi"), "trends": category_trends(unique).join(own, ["user_id", "period_start"], "left_semi")}


def check_digests(digests: DataFrame, items: DataFrame, trends: DataFrame) -> DataFrame:
    """Violations (problem, user_id, period_start)."""
    ranks = items.groupBy("user_id", "period_start").agg(F.count("*").alias("n"), F.max("rank").alias("top"), F.min("rank").alias("low"), F.count_distinct("id").alias("ids"))
    days = F.when(F.col("kind") == "DAILY", 1).otherwise(7)
    aligned = (F.col("period_start") == F.date_trunc("day", "period_start")) & (F.datediff("period_end", "period_start") == days) & ((F.col("kind") == "DAILY") | (F.dayofweek("period_start") == 2))
    parts = {
        "RANKS": ranks.filter("n > 5 or top <> n or low <> 1"), "REPEATED_RECOMMENDATION": ranks.filter("ids < n"), "PERIOD": digests.filter(~aligned),
        "HIGH_PRIORITY": digests.filter("high_priority > opportunities"), "TREND_DELTA": trends.filter("delta <> current - previous or delta <= 0"),
    }
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("problem"), "user_id", "period_start")
        out = rows if out is None else out.unionByName(rows)
    return out


def digest_view(items: DataFrame) -> DataFrame:
    return items.groupBy("user_id", "kind", "period_start").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "signal_id", "total_score", "category"))).alias("items"))


def digest_counts(digests: DataFrame, deliveries: DataFrame) -> DataFrame:
    by = lambda df, c, what: df.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "name", "n")
    return by(digests, "kind", "digests").unionByName(by(deliveries, "status", "deliveries"))

"""Feedback and deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.expr import half_up

ACTIONS = ("USEFUL", "NOT_USEFUL", "ALREADY_KNOWN", "SAVED", "ACTED")
SENTIMENT = ("USEFUL", "NOT_USEFUL")


def record_feedback(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feedback, conflicts): the first of each (user, recommendation, action); the first sentiment wins."""
    order = ["created_at", "id"]
    first = Window.partitionBy("user_id", "recommendation_id", "action").orderBy(*order)
    kept = events.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    mood = F.col("action").isin(*SENTIMENT)
    by = Window.partitionBy("user_id", "recommendation_id", mood).orderBy(*order)
    ranked = kept.withColumns({"_mood": mood, "_k": F.row_number().over(by)})
    opposite = F.col("_mood") & (F.col("_k") > 1)
    return ranked.filter(~opposite).drop("_mood", "_k"), ranked.filter(opposite).drop("_mood", "_k")


def feedback_target(signal_feedback: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Feedback on a signal -> the user's recommendation: newest revision, newest, smallest id."""
    by = Window.partitionBy("feedback_id").orderBy(F.desc("profile_revision"), F.desc("created_at"), F.asc("id"))
    joined = signal_feedback.join(recommendations.select("id", "user_id", "signal_id", "profile_revision", "created_at"), ["user_id", "signal_id"])
    return joined.withColumn("_r", F.row_number().over(by)).filter("_r = 1").select("feedback_id", "user_id", "signal_id", F.col("id").alias("recommendation_id"))


def action_counts(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("user_id").pivot("action", list(ACTIONS)).count().fillna(0)


def feedback_attribution(feedback: DataFrame) -> DataFrame:
    direct = F.col("delivery_id").isNull()
    return feedback.groupBy("user_id").agg(F.count_if(direct).alias("direct"), F.count_if(~direct).alias("telegram"))


def percent(part: Column, whole: Column) -> Column:
    """Percent to two digits: half up, without an epsilon."""
    return half_up(part.cast("double") / whole * 100, 2, epsilon=False)


def feedback_coverage(deliveries: DataFrame, feedback: DataFrame) -> DataFrame:
    """By user: distinct sent recommendations, those with any feedback of the user, percent (0 if none was sent)."""
    sent = deliveries.filter("status = 'SENT'").select("user_id", "recommendation_id").distinct()
    answered = feedback.select("user_id", "recommendation_id", F.lit(True).alias("_f")).distinct()
    out = sent.join(answered, ["user_id", "recommendation_id"], "left").groupBy("user_id").agg(F.count("*").alias("sent"), F.count("_f").alias("answered"))
    return out.withColumn("coverage", F.when(F.col("sent") > 0, percent(F.col("answered"), F.col("sent"))).otherwise(0.0))


def positive_sentiment(feedback: DataFrame) -> DataFrame:
    good, bad = (F.count_if(F.col("action") == a) for a in SENTIMENT)
    out = feedback.groupBy("user_id").agg(good.alias("useful"), bad.alias("not_useful"))
    total = F.col("useful") + F.col("not_useful")
    return out.withColumn("positive", F.when(total > 0, percent(F.col("useful"), total)))


def high_score_rejections(feedback: DataFrame, recommendations: DataFrame, n: int = 10) -> DataFrame:
    """High and critical recommendations found not useful: score, newest feedback, id; the first n of each user."""
    high = recommendations.filter(F.col("band").isin("HIGH", "CRITICAL")).select(F.col("id").alias("recommendation_id"), "total_score", "band")
    rows = feedback.filter("action = 'NOT_USEFUL'").select(F.col("id").alias("feedback_id"), "user_id", "recommendation_id", F.col("created_at").alias("feedback_at"))
    by = Window.partitionBy("user_id").orderBy(F.desc("total_score"), F.desc("feedback_at"), F.asc("feedback_id"))
    return rows.join(high, "recommendation_id").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)


def feedback_summary(feedback: DataFrame, deliveries: DataFrame) -> DataFrame:
    """All counts of each user, from one aggregation; consistent says whether attribution and actions add up.

    Feedback and sent deliveries meet by (user, recommendation) first, each pair with its counts, then by user.
    """
    action, direct = F.col("action"), F.col("delivery_id").isNull()
    given = feedback.select("user_id", "recommendation_id", F.lit(False).alias("sent"), "action", direct.alias("direct"))
    sent = deliveries.filter("status = 'SENT'").select("user_id", "recommendation_id", F.lit(True).alias("sent"), F.lit(None).cast("string").alias("action"), F.lit(None).cast("boolean").alias("direct"))
    counts = {a: F.count_if(action == a) for a in ACTIONS} | {"direct": F.count_if(F.col("direct")), "telegram": F.count_if(~F.col("direct"))}
    pairs = given.unionByName(sent).groupBy("user_id", "recommendation_id").agg(F.max("sent").alias("sent"), F.count("action").alias("any"), *[c.alias(n) for n, c in counts.items()])
    out = pairs.groupBy("user_id").agg(*[F.sum(n).alias(n) for n in counts], F.count_if("sent").alias("sent"), F.count_if(F.col("sent") & (F.col("any") > 0)).alias("answered"))
    useful, total = F.col("USEFUL"), sum((F.col(a) for a in ACTIONS[1:]), F.col(ACTIONS[0]))
    moods = useful + F.col("NOT_USEFUL")
    return out.withColumns({
        "positive": F.when(moods > 0, percent(useful, moods)), "coverage": F.when(F.col("sent") > 0, percent(F.col("answered"), F.col("sent"))).otherwise(0.0),
        "total": total, "consistent": (total == F.col("direct") + F.col("telegram")) & (F.col("answered") <= F.col("sent")),
    })


def feedback_context_audit(feedback: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Feedback whose delivery belongs to another user or recommendation."""
    held = deliveries.select(F.col("id").alias("delivery_id"), F.col("user_id").alias("_u"), F.col("recommendation_id").alias("_r"))
    return feedback.join(held, "delivery_id").filter("user_id <> _u or recommendation_id <> _r").drop("_u", "_r")


def delivery_outcomes(attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deliveries, conflicts): per (channel, key) the first terminal state, else the first pending; later other terminals conflict."""
    terminal = F.col("status").isin("SENT", "FAILED")
    by = Window.partitionBy("channel", "idempotency_key")
    order = by.orderBy(F.desc(terminal), "updated_at", "id")
    ranked = attempts.withColumns({"_k": F.row_number().over(order), "_first": F.first("status").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    clash = terminal & (F.col("_k") > 1) & (F.col("status") != F.col("_first"))
    return ranked.filter("_k = 1").drop("_k", "_first"), ranked.filter(clash).drop("_k", "_first")


def new_deliveries(opportunities: DataFrame, deliveries: DataFrame, kind: str = "NEW", n: int = 5) -> DataFrame:
    """The first n ranked opportunities of each user whose idempotency key was not delivered. opportunities: rank, user_id, id."""
    key = F.concat_ws(":", F.lit(kind), F.col("user_id").cast("string"), F.col("id").cast("string"))
    rows = opportunities.filter(F.col("rank") <= n).withColumn("idempotency_key", key)
    return rows.join(deliveries.select("idempotency_key").distinct(), "idempotency_key", "left_anti")


def delivery_status_counts(deliveries: DataFrame) -> DataFrame:
    return deliveries.groupBy("kind", "status", "reused").agg(F.count("*").alias("n"))

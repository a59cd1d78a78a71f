"""Evaluation of predictions against a gold set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.expr import half_up, ratio

RUN = ["provider", "model", "prompt_version", "split"]
IRRELEVANT_EVENT = "irrelevant_notice"


def squash(text: Column) -> Column:
    """Lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


#: Of each vertical of a gold set: items, relevant ones, calibration ones. Fixed values.
GOLD_BALANCE = {"items": 100, "relevant": 80, "calibration": 40}
GOLD_VERTICALS = ("CONSTRUCTION", "HORECA")


def validate_gold(gold: DataFrame, balance: dict[str, int] | None = None) -> DataFrame:
    """Violations (problem, id); of the whole set with a null id.

    gold: id, split, url, text, vertical, relevant, category, event_type, action, importance, facts (id, statement,
    evidenceQuote). balance: how many items, relevant and calibration items each vertical has, as in GOLD_BALANCE; not
    checked if None.
    """
    repeated = lambda name, key: gold.groupBy(key.alias("k")).agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n > 1").select(F.lit(name).alias("problem"), "id")
    facts = F.coalesce("facts", F.array().cast(gold.schema["facts"].dataType))
    relevant, vertical = F.col("relevant"), F.col("vertical")
    rules = {
        "FACT_COUNT": ~F.size(facts).between(1, 3), "FACT_IDS": F.size(F.array_distinct(F.transform(facts, lambda f: f["id"]))) < F.size(facts),
        "QUOTE_NOT_IN_TEXT": F.exists(facts, lambda f: ~F.contains(F.col("text"), f["evidenceQuote"])),
        "IRRELEVANT_ACTION": ~relevant & (F.col("action") != "IGNORE"), "RELEVANT_ACTION": relevant & (F.col("action") == "IGNORE"),
        "IRRELEVANT_LABELS": ~relevant & ((F.col("category") != "OTHER") | (F.col("event_type") != "IRRELEVANT_NOTICE")),
        "RELEVANT_CATEGORY": relevant & vertical.isin(*GOLD_VERTICALS) & ~F.startswith(F.col("category"), F.concat(vertical, F.lit("_"))),
        "IMPORTANCE": F.when(relevant, F.col("importance") < 40).otherwise(F.col("importance") >= 40),
        "VERTICAL": ~vertical.isin(*GOLD_VERTICALS), "SPLIT": ~F.col("split").isin("CALIBRATION", "HOLDOUT"),
    }
    found = gold.select("id", F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())).alias("problem")).select("problem", "id")
    for name, key in (("REPEATED_ID", F.col("id")), ("REPEATED_URL", F.col("url")), ("REPEATED_TEXT", F.sha2(squash(F.col("text")), 256))):
        found = found.unionByName(repeated(name, key))
    if balance is None:
        return found
    has = {"items": F.lit(True), "relevant": relevant, "calibration": F.col("split") == "CALIBRATION"}
    counts = gold.agg(*[F.count_if((vertical == v) & has[k]).alias(f"BALANCE_{v}_{k}".upper()) for v in GOLD_VERTICALS for k in balance])
    wrong = [F.when(F.col(f"BALANCE_{v}_{k}".upper()) != n, F.lit(f"BALANCE_{v}_{k}".upper())) for v in GOLD_VERTICALS for k, n in balance.items()]
    wrong = counts.select(F.explode(F.filter(F.array(*wrong), lambda x: x.isNotNull())).alias("problem"), F.lit(None).cast(gold.schema["id"].dataType).alias("id"))
    return found.unionByName(wrong)


def gold_summary(gold: DataFrame) -> DataFrame:
    n, v = F.size("facts"), lambda x: F.count_if(F.col("vertical") == x)
    return gold.agg(
        F.count("*").alias("items"), F.min(n).alias("facts_min"), F.max(n).alias("facts_max"), F.sum(n).alias("facts_total"), F.count_if("relevant").alias("relevant"), F.count_if(~F.col("relevant")).alias("irrelevant"),
        F.count_if(F.col("split") == "CALIBRATION").alias("calibration"), F.count_if(F.col("split") == "HOLDOUT").alias("holdout"), v("CONSTRUCTION").alias("construction"), v("HORECA").alias("horeca"),
    )


def select_split(gold: DataFrame, split: str) -> DataFrame:
    return gold if split == "ALL" else gold.filter(F.col("split") == split)


def eval_requests(gold: DataFrame) -> DataFrame:
    """Requests without any label: neutral category and scores."""
    return gold.select(
        "id", "text", "url", "source_id", F.lit("UNCLASSIFIED").alias("category"), F.lit(50).alias("relevance_score"), F.lit(50).alias("classification_confidence")
    )


def prediction_validity(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Gold items with their prediction and validity: SUCCEEDED, FAILED_ANALYSIS, INVALID_ANALYSIS, THROWN or MISSING.

    predictions: id, status, event_type, valid, failure_code, and, if facts are scored, facts (sourceIds, statement).
    """
    facts = [F.col("facts").alias("p_facts")] if "facts" in predictions.columns else []
    p = predictions.select("id", F.col("status").alias("p_status"), F.col("event_type").alias("p_event"), F.coalesce("valid", F.lit(False)).alias("p_valid"), F.col("failure_code").alias("p_code"), *facts)
    s = F.col("p_status")
    validity = F.when(s.isNull(), "MISSING").when(s == "THROWN", "THROWN").when(s == "FAILED", "FAILED_ANALYSIS").when(~F.col("p_valid"), "INVALID_ANALYSIS").otherwise("SUCCEEDED")
    return gold.join(p, "id", "left").withColumn("validity", validity)


def failure_code(validity: Column, code: Column) -> Column:
    """Null for a success. An invalid answer is AI_INVALID_RESPONSE; what failed without a code is AI_INTERNAL_ERROR."""
    return F.when(validity == "INVALID_ANALYSIS", "AI_INVALID_RESPONSE").when(validity != "SUCCEEDED", F.coalesce(code, F.lit("AI_INTERNAL_ERROR")))


def _validity_counts(judged: DataFrame) -> list[Column]:
    """items, valid, failures, invalid. judged: validity, p_code."""
    code = failure_code(F.col("validity"), F.col("p_code"))
    return [F.count("*").alias("items"), F.count_if(F.col("validity") == "SUCCEEDED").alias("valid"), F.count_if(code.isNotNull()).alias("failures"), F.count_if(code == "AI_INVALID_RESPONSE").alias("invalid")]


def _validity_rates() -> dict[str, Column]:
    """Coverage is the share of all items that succeeded, the valid rate that of the answers that were valid."""
    valid, invalid = F.col("valid"), F.col("invalid")
    return {"provider_failures": F.col("failures") - invalid, "coverage": ratio(valid, F.col("items"), 6), "valid_rate": ratio(valid, valid + invalid, 6)}


def validity_rates(judged: DataFrame) -> DataFrame:
    return judged.agg(*_validity_counts(judged)).withColumns(_validity_rates())


def event_type_accuracy(judged: DataFrame) -> DataFrame:
    good = judged.filter("validity = 'SUCCEEDED'")
    out = good.agg(F.count("*").alias("valid"), F.count_if(squash(F.col("p_event")) == squash(F.col("event_type"))).alias("correct"))
    return out.withColumn("accuracy", ratio(F.col("correct"), F.col("valid"), 6))


def relevance_confusion(judged: DataFrame) -> DataFrame:
    said, true = squash(F.col("p_event")) != IRRELEVANT_EVENT, F.col("relevant")
    c = judged.filter("validity = 'SUCCEEDED'").agg(
        F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & ~true).alias("tn"), F.count_if(~said & true).alias("fn")
    )
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select(
        "*", ratio(tp, tp + fp, 6).alias("precision"), ratio(tp, tp + fn, 6).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn, 6).alias("f1"), ratio(tp + tn, tp + fp + tn + fn, 6).alias("accuracy")
    )


def fact_support(generated: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, fact_id, supported): generated (id, fact_id, source_ids, statement) against evidence (id, source_id, text)."""
    facts = generated.withColumn("source_id", F.explode_outer("source_ids"))
    texts = evidence.select("id", "source_id", squash(F.col("text")).alias("_text"))
    return facts.join(texts, ["id", "source_id"], "left").groupBy("id", "fact_id").agg(
        F.coalesce(F.bool_or(F.contains("_text", squash(F.col("statement")))), F.lit(False)).alias("supported")
    )


def expected_fact_recall(gold_facts: DataFrame, generated: DataFrame) -> DataFrame:
    """(id, fact_id, matched): a quote that contains or is contained in any generated statement of its item."""
    own = generated.select("id", squash(F.col("statement")).alias("_s"))
    q = squash(F.col("evidenceQuote"))
    return gold_facts.join(own, "id", "left").groupBy("id", "fact_id").agg(F.coalesce(F.bool_or(F.contains("_s", q) | F.contains(q, F.col("_s"))), F.lit(False)).alias("matched"))


def latency_stats(runs: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """Least, mean, most and nearest-rank percentiles to three digits."""
    x = F.col("latency_ms").cast("double")
    pick = lambda p: F.expr(f"percentile_disc({p}) within group (order by cast(latency_ms as double))")
    r = lambda c: half_up(c, 3, epsilon=False)
    return runs.filter("latency_ms is not null").groupBy(*keys).agg(r(F.min(x)).alias("min"), r(F.avg(x)).alias("mean"), r(F.max(x)).alias("max"), r(pick(0.5)).alias("p50"), r(pick(0.95)).alias("p95"))


def token_throughput(runs: DataFrame, keys: list[str] = RUN) -> DataFrame:
    have = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    out = runs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(have).alias("with_usage"), F.sum(F.when(have, F.col("input_tokens"))).alias("input_tokens"), F.sum(F.when(have, F.col("output_tokens"))).alias("output_tokens"), F.sum(F.when(have, F.col("latency_ms"))).alias("ms"))
    state = F.when(F.col("with_usage") == 0, "UNAVAILABLE").when(F.col("with_usage") < F.col("n"), "PARTIAL").otherwise("COMPLETE")
    return out.withColumns({"usage": state, "tokens_per_second": ratio(F.col("output_tokens") * 1000, F.col("ms"), 3)}).drop("ms")


def failure_rows(judged: DataFrame) -> DataFrame:
    """(id, kind, code) of each item that did not succeed; an item without a prediction counts as THROWN."""
    kind = F.when(F.col("validity") == "MISSING", "THROWN").otherwise(F.col("validity"))
    return judged.filter("validity <> 'SUCCEEDED'").select("id", kind.alias("kind"), failure_code(F.col("validity"), F.col("p_code")).alias("code"))


def eval_failures(judged: DataFrame) -> DataFrame:
    """Failures by code, invalid answers (kind INVALID) apart from provider failures."""
    kind = F.when(F.col("code") == "AI_INVALID_RESPONSE", "INVALID").otherwise("PROVIDER")
    return failure_rows(judged).groupBy(kind.alias("kind"), "code").agg(F.count("*").alias("n"))


def _fact_counts(ok: Column) -> dict[str, Column]:
    """Of each item the expected facts, those of scored items, the matched ones, generated facts and supported ones."""
    text, expected, made = squash(F.col("text")), F.col("facts"), F.col("p_facts")
    statements = F.transform(made, lambda m: squash(m["statement"]))
    matched = F.filter(expected, lambda f: F.exists(statements, lambda m: F.contains(m, squash(f["evidenceQuote"])) | F.contains(squash(f["evidenceQuote"]), m)))
    supported = F.filter(made, lambda m: F.array_contains(m["sourceIds"], F.col("source_id")) & F.contains(text, squash(m["statement"])))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    each = {"evaluated_expected_facts": expected, "matched_expected_facts": matched, "generated_facts": made, "supported_generated_facts": supported}
    return {"expected_facts": F.sum(size(expected)), **{k: F.sum(F.when(ok, size(c)).otherwise(0)) for k, c in each.items()}}


def benchmark_report(judged: DataFrame, runs: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """One row per run: validity, confusion, event types, factuality, latency and tokens side by side.

    judged: keys, relevant, event_type, text, source_id, facts, and the columns of prediction_validity with p_facts.
    runs: keys, latency_ms, input_tokens, output_tokens of each attempted item. Failures themselves: failure_rows.
    """
    ok, true = F.col("validity") == "SUCCEEDED", F.col("relevant")
    said = squash(F.col("p_event")) != IRRELEVANT_EVENT
    out = judged.groupBy(*keys).agg(
        *_validity_counts(judged), F.count_if(ok & said & true).alias("tp"), F.count_if(ok & said & ~true).alias("fp"), F.count_if(ok & ~said & ~true).alias("tn"), F.count_if(ok & ~said & true).alias("fn"),
        F.count_if(ok & (squash(F.col("p_event")) == squash(F.col("event_type")))).alias("event_correct"), *[c.alias(n) for n, c in _fact_counts(ok).items()],
    )
    out = out.withColumns({**_validity_rates(), "event_evaluated": F.col("valid"), "event_unscored": F.col("items") - F.col("valid"), "relevance_evaluated": F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")})
    unsupported = F.col("generated_facts") - F.col("supported_generated_facts")
    out = out.withColumns({"relevance_unscored": F.col("items") - F.col("relevance_evaluated"), "unsupported_generated_facts": unsupported, "hallucination_count": unsupported})
    out = out.withColumns({name: ratio(part, whole, 6) for name, (part, whole) in _report_rates().items()})
    tokens = token_throughput(runs, keys).withColumnRenamed("n", "samples").withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    return out.join(latency_stats(runs, keys), keys, "left").join(tokens, keys, "left")


def _report_rates() -> dict[str, tuple[Column, Column]]:
    """Rate -> (part, whole), in columns of a report."""
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return {
        "coverage": (F.col("valid"), F.col("items")), "valid_rate": (F.col("valid"), F.col("valid") + F.col("invalid")), "event_accuracy": (F.col("event_correct"), F.col("event_evaluated")),
        "accuracy": (tp + tn, F.col("relevance_evaluated")), "precision": (tp, tp + fp), "recall": (tp, tp + fn), "f1": (2 * tp, 2 * tp + fp + fn),
        "expected_fact_recall": (F.col("matched_expected_facts"), F.col("evaluated_expected_facts")), "generated_fact_support_rate": (F.col("supported_generated_facts"), F.col("generated_facts")),
    }


def check_report(report: DataFrame) -> DataFrame:
    """The report's rows with each problem (problem) of counts, rates, latencies and tokens that do not reconcile."""
    c = F.col
    usage, totals = F.coalesce("with_usage", F.lit(0)), ("input_tokens", "output_tokens", "total_tokens")
    metrics = [c(x).isNotNull() for x in (*totals, "tokens_per_second")]
    rules = {
        "OUTCOME_SUM": c("valid") + c("failures") != c("items"), "FAILURE_CLASSES": c("invalid") + c("provider_failures") != c("failures"),
        "EVENT_COUNTS": (c("event_evaluated") != c("valid")) | (c("event_evaluated") + c("event_unscored") != c("items")), "EVENT_CORRECT": c("event_correct") > c("event_evaluated"),
        "CONFUSION_SUM": (c("tp") + c("fp") + c("tn") + c("fn") != c("relevance_evaluated")) | (c("relevance_evaluated") + c("relevance_unscored") != c("items")),
        "FACT_SUPPORT_SUM": c("supported_generated_facts") + c("unsupported_generated_facts") != c("generated_facts"), "HALLUCINATION_COUNT": c("hallucination_count") != c("unsupported_generated_facts"),
        "FACT_ORDER": (c("matched_expected_facts") > c("evaluated_expected_facts")) | (c("evaluated_expected_facts") > c("expected_facts")),
        "LATENCY_SAMPLES": ~c("samples").eqNullSafe(c("items")), "LATENCY_MISSING": c("min").isNull() | c("max").isNull() | c("mean").isNull() | c("p50").isNull() | c("p95").isNull(),
        "TOKENS_WITHOUT_SAMPLES": (usage == 0) & ((c("usage") != "UNAVAILABLE") | F.array_contains(F.array(*metrics), True)),
        "TOKEN_TOTALS": (usage > 0) & F.array_contains(F.array(*metrics[:3]), False), "TOKEN_SUM": (usage > 0) & (c("total_tokens") != c("input_tokens") + c("output_tokens")),
        "TOKEN_AVAILABILITY": (usage > 0) & (c("usage") != F.when(usage == c("items"), "COMPLETE").otherwise("PARTIAL")), "TOKEN_SAMPLES": usage > c("items"),
        **{f"RATE_{name.upper()}": ~c(name).eqNullSafe(ratio(part, whole, 6)) for name, (part, whole) in _report_rates().items()},
    }
    if "health_status" in report.columns:
        healthy = c("health_status") == "HEALTHY"
        rules["HEALTH"] = (healthy != c("health_failure_code").isNull()) | (healthy & c("health_retryable"))
    if "completed_at" in report.columns:
        rules["TIME_ORDER"] = c("completed_at") < c("started_at")
    found = F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]), lambda x: x.isNotNull())
    return report.withColumn("problem", F.explode(found))


def corpus_overlap(evaluation: DataFrame, corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """Evaluation rows whose text, spaces and case aside, is in the corpus."""
    key = F.sha2(squash(F.col(text_col)), 256)
    return evaluation.withColumn("_k", key).join(corpus.select(key.alias("_k")), "_k", "left_semi").drop("_k")

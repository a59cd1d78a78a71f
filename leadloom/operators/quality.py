"""Data-quality audits and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCORE = "{0} between 0 and 100"
_HASH = "{0} rlike '^[0-9a-f]{{64}}$'"
_TEXT = "trim({0}) <> ''"
_ORDER = "updated_at >= created_at"
_DELIVERED = (
    "(status = 'PENDING' and provider_message_id is null and failure_code is null) or (status = 'SENT' and provider_message_id is not null and failure_code is null)"
    " or (status = 'FAILED' and provider_message_id is null and failure_code is not null)"
)
_REASONED = "(status = 'FAILED') = (failure_reason is not null)"


def _each(check: str, *columns: str) -> dict[str, tuple[str, str]]:
    return {c: (c, check.format(c)) for c in columns}


def _all(columns: str, what: str) -> str:
    return " and ".join(f"{c} {what}" for c in columns.split())


_ANALYSIS = "headline summary why_important event_type facts inferences entities risks candidate_actions business_impact urgency confidence actionability"
_COUNTS = "processed_count unique_count relevant_count opportunity_count high_priority_count"

#: Table -> constraint -> columns and what holds for each row; unknown (null) holds, as in a database.
CONSTRAINTS: dict[str, dict[str, tuple[str, str]]] = {
    "sources": {
        **_each(_TEXT, "name"), "dimensions": ("regions verticals", "size(regions) > 0 and size(verticals) > 0"), "reliability": ("reliability", _SCORE.format("reliability")), "verticals": ("verticals", "size(verticals) > 0"),
        "time_order": ("created_at updated_at last_success_at last_error_at", f"{_ORDER} and coalesce(last_success_at >= created_at, true) and coalesce(last_error_at >= created_at, true)"),
        "poll_policy": ("poll_interval_minutes type", "case when poll_interval_minutes is null then type in ('FIXTURE', 'MANUAL') else poll_interval_minutes > 0 end"),
        "ai_permission": ("ai_allowed rights rights_basis", "not ai_allowed or (rights in ('OPEN_DATA', 'PUBLIC_API', 'PARTNER', 'CONSENT') and rights_basis is not null and trim(rights_basis) <> '')"),
        "ai_rights": ("ai_allowed rights", "not ai_allowed or rights in ('OPEN_DATA', 'PUBLIC_API', 'PARTNER', 'CONSENT')"), "telegram": ("type rights", "type <> 'PARTNER_TELEGRAM' or rights in ('PARTNER', 'CONSENT')"),
    },
    "raw_items": {**_each(_TEXT, "raw_text"), **_each(_HASH, "content_hash")},
    "normalized_items": {**_each(_TEXT, "text"), **_each(_HASH, "normalized_hash"), "title": ("title", "length(title) <= 1000")},
    "normalization_attempts": {
        "outcome": ("status rejection_code", "case status when 'SUCCEEDED' then rejection_code is null when 'REJECTED' then rejection_code is not null and trim(rejection_code) <> '' else false end"),
        "payload": ("status normalized_item_id rejection_detail", "case status when 'SUCCEEDED' then normalized_item_id is not null and rejection_detail is null when 'REJECTED' then normalized_item_id is null and rejection_detail is not null and trim(rejection_detail) <> '' else false end"),
    },
    "assignments": {
        "similarity": ("similarity", "similarity between 0 and 1"), "distance": ("time_distance_hours", "time_distance_hours >= 0"),
        "representative": ("id representative_id matched_to_id match_kind similarity time_distance_hours", "match_kind <> 'REPRESENTATIVE' or (id = representative_id and id = matched_to_id and similarity = 1 and time_distance_hours = 0)"),
    },
    "signals": {
        **_each(_SCORE, "relevance_score", "classification_confidence"), "time_order": ("created_at updated_at", _ORDER), "rule_ids": ("rule_ids", "size(rule_ids) > 0"),
        "supersession": ("status superseded_by id", "(status = 'SUPERSEDED') = (superseded_by is not null) and not (superseded_by <=> id)"),
    },
    "analyses": {
        "payload": (f"{_ANALYSIS} status failure_code failure_reason retryable deadline", f"case status when 'SUCCEEDED' then {_all(_ANALYSIS, 'is not null')} and {_all('failure_code failure_reason retryable', 'is null')}"
                    f" when 'FAILED' then {_all(_ANALYSIS, 'is null')} and deadline is null and {_all('failure_code failure_reason retryable', 'is not null')} else false end"),
        "lists": ("facts candidate_actions", "size(facts) > 0 and size(candidate_actions) <= 5"), **_each(_SCORE, "business_impact", "urgency", "actionability"), "confidence": ("confidence", "confidence between 0 and 1"),
    },
    "users": {"revision": ("revision", "revision > 0"), "time_order": ("created_at updated_at", _ORDER)},
    "profiles": {
        "revision": ("revision", "revision > 0"), "range": ("project_value_minimum project_value_maximum", "project_value_minimum <= project_value_maximum"), "dimensions": ("verticals regions", "size(verticals) > 0 and size(regions) > 0"),
        "services": ("services_and_products", "size(services_and_products) > 0"), **{c: (c, f"{c} >= 0") for c in ("project_value_minimum", "project_value_maximum")},
        "currency": ("project_value_minimum project_value_maximum currency", "case when project_value_minimum is null and project_value_maximum is null then currency is null else currency is not null and currency rlike '^[A-Z]{3}$' end"),
        "time_order": ("created_at updated_at", _ORDER),
    },
    "recommendations": {**_each(_SCORE, "business_impact", "company_fit", "urgency", "confidence", "actionability", "total_score"), "actions": ("recommended_actions", "size(recommended_actions) between 2 and 5")},
    "deliveries": {"outcome": ("status provider_message_id failure_code", _DELIVERED), "reason": ("status failure_reason", _REASONED), "key": ("idempotency_key", _TEXT.format("idempotency_key")), "time_order": ("created_at updated_at", _ORDER)},
    "digests": {
        "period": ("kind period_start period_end", "case kind when 'DAILY' then period_end = period_start + interval 1 day when 'WEEKLY' then period_end = period_start + interval 7 days else false end"),
        "alignment": ("kind period_start", "date_trunc('day', period_start) = period_start and (kind = 'DAILY' or weekday(period_start) = 0)"),
        "summary": (f"kind {_COUNTS}", f"case kind when 'DAILY' then {_all(_COUNTS, 'is null')} when 'WEEKLY' then {_all(_COUNTS, 'is not null')} else false end"),
        "counts": (f"kind {_COUNTS}", f"kind = 'DAILY' or ({_all(_COUNTS, '>= 0')} and high_priority_count <= opportunity_count)"),
    },
    "digest_items": {"rank": ("rank", "rank between 1 and 5")},
    "digest_trends": {"counts": ("current previous delta", "current >= 0 and previous >= 0 and delta = current - previous and delta > 0"), "rank": ("rank", "rank between 1 and 5")},
    "digest_deliveries": {"outcome": ("status provider_message_id failure_code", _DELIVERED), "reason": ("status failure_reason", _REASONED), "time_order": ("created_at updated_at", _ORDER)},
}


def audit_constraints(tables: dict[str, DataFrame], rules: dict[str, dict[str, tuple[str, str]]] | None = None) -> DataFrame:
    """(table_name, constraint_name, violations, missing): one pass over each table.

    A rule over columns that a table lacks is not checked: its violations are null and missing names the columns.
    """
    out = None
    for name, df in tables.items():
        own = (rules or CONSTRAINTS).get(name, {})
        if not own:
            continue
        lacks = {k: [c for c in columns.split() if c not in df.columns] for k, (columns, _) in own.items()}
        counted = df.agg(F.lit(None).cast("long").alias("_none"), *[F.count_if(~F.coalesce(F.expr(check), F.lit(True))).alias(k) for k, (_, check) in own.items() if not lacks[k]])
        pairs = F.array(*[F.struct(F.lit(k).alias("constraint_name"), F.col("_none" if lacks[k] else k).alias("violations"), F.lit(",".join(lacks[k]) or None).cast("string").alias("missing")) for k in own])
        rows = counted.select(F.lit(name).alias("table_name"), F.explode(pairs).alias("p")).select("table_name", "p.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def audit_uniqueness(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(table, keys, duplicates): identities that occur more than once; nulls are no identity."""
    out = None
    for name, (df, keys) in tables.items():
        known = df.filter(" and ".join(f"{k} is not null" for k in keys))
        rows = known.groupBy(*keys).count().filter("count > 1").agg(F.count("*").alias("duplicates")).select(F.lit(name).alias("table_name"), F.lit(",".join(keys)).alias("keys"), "duplicates")
        out = rows if out is None else out.unionByName(rows)
    return out


def audit_references(checks: dict[str, tuple[DataFrame, list[str], DataFrame, list[str]]]) -> DataFrame:
    """(reference, dangling): rows whose non-null keys are absent from the other table."""
    out = None
    for name, (df, keys, other, other_keys) in checks.items():
        target = other.select(*[F.col(b).alias(a) for a, b in zip(keys, other_keys)]).distinct()
        known = df.select(*keys).filter(" and ".join(f"{k} is not null" for k in keys))
        rows = known.join(target, keys, "left_anti").agg(F.count("*").alias("dangling")).select(F.lit(name).alias("reference"), "dangling")
        out = rows if out is None else out.unionByName(rows)
    return out


def audit_item_dataset(items: DataFrame) -> DataFrame:
    """(problem, key): items: fixture_id, source_id, external_id, content_hash, duplicate_group, duplicate_kind."""
    repeated = lambda name, *keys: items.filter(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).count().filter("count > 1").select(F.lit(name).alias("problem"), F.concat_ws("|", *keys).alias("key"))
    odd = items.filter(F.col("duplicate_group").isNull() != F.col("duplicate_kind").isNull()).select(F.lit("LABEL_PAIR").alias("problem"), F.col("fixture_id").cast("string").alias("key"))
    return repeated("FIXTURE_ID", "fixture_id").unionByName(repeated("EXTERNAL_ID", "source_id", "external_id")).unionByName(repeated("RAW_EVIDENCE", "source_id", "content_hash")).unionByName(odd)


def dedup_quality(assignments: DataFrame, labels: DataFrame) -> DataFrame:
    """Pair precision and recall of clusters against labelled groups, by counts: no pair is written.

    labels: id, duplicate_group (null: alone). Pairs of a cell of n are n (n - 1) / 2.
    """
    rows = assignments.select("id", "representative_id").join(labels.select("id", "duplicate_group"), "id")
    pairs = lambda df, *keys: df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")), F.lit(0)).alias("pairs"))
    own = rows.filter("duplicate_group is not null")
    parts = {"predicted": pairs(rows, "representative_id"), "labelled": pairs(own, "duplicate_group"), "both": pairs(own, "representative_id", "duplicate_group")}
    counts = None
    for name, df in parts.items():
        df = df.withColumn("name", F.lit(name))
        counts = df if counts is None else counts.unionByName(df)
    out = counts.agg(*[F.max(F.when(F.col("name") == name, F.col("pairs"))).alias(name) for name in parts])
    return out.select("*", F.when(F.col("predicted") > 0, F.col("both") / F.col("predicted")).alias("precision"), F.when(F.col("labelled") > 0, F.col("both") / F.col("labelled")).alias("recall"))


#: Gate -> (comparison, bound). Fixed values.
GATES = {
    "parse_success": (">", 98.0), "duplicates": ("<", 5.0), "positive_sentiment": (">", 60.0), "high_score_precision": (">", 70.0), "feedback_coverage": (">=", 20.0), "source_links": (">=", 100.0),
}


def quality_gates(values: DataFrame) -> DataFrame:
    """(gate, value, bound, passed) of (gate, value) in percent; a null value does not pass."""
    table = F.create_map(*[x for k, (op, b) in GATES.items() for x in (F.lit(k), F.struct(F.lit(op).alias("op"), F.lit(b).alias("bound")))])
    rule = table[F.col("gate")]
    ok = F.when(rule["op"] == ">", F.col("value") > rule["bound"]).when(rule["op"] == ">=", F.col("value") >= rule["bound"]).otherwise(F.col("value") < rule["bound"])
    return values.select("gate", "value", rule["bound"].alias("bound"), F.coalesce(ok, F.lit(False)).alias("passed"))


def stage_summary(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, input, created, existing, rejected) of tables with an outcome column."""
    out = None
    for name, df in stages.items():
        o = F.col("outcome")
        rows = df.agg(F.count("*").alias("input"), F.count_if(o == "CREATED").alias("created"), F.count_if(o.startswith("EXISTING")).alias("existing"), F.count_if(o.isin("REJECTED", "CONFLICT")).alias("rejected"))
        rows = rows.select(F.lit(name).alias("stage"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out

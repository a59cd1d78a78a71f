"""Classification of duplicate clusters by versioned rule tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.expr import json_strings, uuid_of
from leadloom.operators.dedup import DEDUPLICATOR_VERSION
from leadloom.operators.rules import RULES_V1, Rule

TAXONOMY_VERSION = "taxonomy-v1"
TENDER_IDS = ("opportunity.applications", "opportunity.contractor", "opportunity.procurement", "opportunity.tender")
PROCUREMENT_IDS = ("opportunity.procurement", "opportunity.supplier-selection", "opportunity.tender")


def cluster_evidence(assignments: DataFrame, items: DataFrame) -> DataFrame:
    """By representative the ids of its members, in order. Ids only: texts are joined for the selected member."""
    rows = assignments.select("id", "representative_id").join(items.select("id", "source_id"), "id")
    return rows.groupBy("representative_id").agg(F.sort_array(F.collect_list(F.struct("id", "source_id"))).alias("evidence"))


def select_evidence(members: DataFrame) -> DataFrame:
    """Of each cluster the permitted representative, else the earliest permitted member; null without any.

    members: representative_id, id, observed_at, ai (boolean).
    """
    order = Window.partitionBy("representative_id").orderBy(F.desc(F.col("id") == F.col("representative_id")), "observed_at", "id")
    chosen = members.filter("ai").withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    return members.select("representative_id").distinct().join(chosen.select("representative_id", F.col("id").alias("selected_id")), "representative_id", "left")


def folded(text: Column) -> Column:
    """Text in one case, by the letters that patterns without regard to case take for the same; upper leaves the rounded Cyrillic ones."""
    return F.translate(F.lower(F.upper(text)), "\u1c80\u1c81\u1c82\u1c83\u1c84\u1c85\u1c86", "вдосттъ")


def match_rules(text: Column, rules: list[Rule], low: Column | None = None) -> Column:
    """Ids of the rules that match, in order. low: folded(text), where a column has it; patterns then meet only texts with a word of theirs."""

    def matches(r: Rule) -> Column:
        found = text.rlike("(?iu)" + r.pattern)
        return found if low is None or not r.words else reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in r.words]) & found

    hits = [F.when(matches(r), F.lit(r.id)) for r in rules]
    return F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.array().cast("array<string>")


def _of(rules: list[Rule], group: str) -> list[Rule]:
    return [r for r in rules if r.group == group]


def vertical_scores(construction: Column, horeca: Column, verticals: Column) -> tuple[Column, Column]:
    """Twice the matched rules of each vertical, and one if the source declares it."""
    one = lambda v: F.when(F.array_contains(verticals, v), 1).otherwise(0)
    return F.size(construction) * 2 + one("CONSTRUCTION"), F.size(horeca) * 2 + one("HORECA")


def classified_vertical(construction: Column, horeca: Column) -> Column:
    return F.when(construction == horeca, "OTHER").when(construction > horeca, "CONSTRUCTION").otherwise("HORECA")


def classification_confidence(vertical: Column, construction: Column, horeca: Column, verticals: Column) -> Column:
    other = F.when((construction == 0) & (horeca == 0) & F.array_contains(verticals, "OTHER"), 95).otherwise(40)
    agrees = F.when(F.array_contains(verticals, vertical), 10).otherwise(0)
    return F.when(vertical == "OTHER", other).otherwise(F.least(F.lit(100), 60 + F.abs(construction - horeca) * 5 + agrees))


def signal_category(vertical: Column, opportunity: Column) -> Column:
    some = lambda ids: F.arrays_overlap(opportunity, F.array(*[F.lit(i) for i in ids]))
    return (
        F.when(vertical == "CONSTRUCTION", F.when(some(TENDER_IDS), "CONSTRUCTION_TENDER").otherwise("CONSTRUCTION_PROJECT"))
        .when(vertical == "HORECA", F.when(some(PROCUREMENT_IDS), "HORECA_PROCUREMENT").otherwise("HORECA_OPENING"))
        .otherwise("OTHER")
    )


def relevance_score(vertical_rules: Column, opportunity_rules: Column, agrees: Column) -> Column:
    return F.least(F.lit(100), 50 + F.least(F.lit(25), opportunity_rules * 10) + F.least(F.lit(15), vertical_rules * 5) + F.when(agrees, 10).otherwise(0))


def classify_clusters(clusters: DataFrame, rules: list[Rule] = RULES_V1) -> DataFrame:
    """One decision per cluster. clusters: representative_id, selected_id (null: no permitted evidence), title, text, verticals.

    Denied, then advertisement, then explicit irrelevance, then no single vertical, then no cue; else eligible.
    """
    clusters = clusters.withColumn("_text", F.concat_ws("\n", "title", "text"))
    low = folded(F.col("_text")) if any(r.words for r in rules) else F.lit("")
    clusters = clusters.withColumn("_low", low)
    found = {g: match_rules(F.col("_text"), _of(rules, g), F.col("_low")) for g in ("construction", "horeca", "opportunity", "advertisement", "irrelevance")}
    rows = clusters.withColumns({f"_{g}": c for g, c in found.items()})
    c, h = vertical_scores(F.col("_construction"), F.col("_horeca"), F.col("verticals"))
    rows = rows.withColumns({"_c": c, "_h": h}).withColumn("_v", classified_vertical(F.col("_c"), F.col("_h")))
    denied = F.col("selected_id").isNull()
    explicit = [r.id for r in _of(rules, "advertisement") if r.id.endswith(".explicit")]
    ad = (F.size("_advertisement") >= 2) | F.arrays_overlap("_advertisement", F.array(*[F.lit(i) for i in explicit]).cast("array<string>"))
    notice, none, quiet = F.size("_irrelevance") > 0, F.col("_v") == "OTHER", F.size("_opportunity") == 0
    chain = lambda d, a, n, o, q, e: F.when(denied, d).when(ad, a).when(notice, n).when(none, o).when(quiet, q).otherwise(e)
    base = F.concat(F.transform("verticals", lambda v: F.concat(F.lit("source.vertical."), F.lower(v))), "_construction", "_horeca")
    one = lambda x: F.array(F.lit(x))
    ids = chain(
        one("permission.no-ai-permitted-evidence"), F.concat(base, "_advertisement"), F.concat(base, "_irrelevance"),
        F.concat(base, one("vertical.unsupported-or-ambiguous")), F.concat(base, one("relevance.no-opportunity-cue")), F.concat(base, "_opportunity"),
    )
    vertical = F.when(denied, F.lit(None).cast("string")).when(~ad & notice, "OTHER").otherwise(F.col("_v"))
    own = classification_confidence(F.col("_v"), F.col("_c"), F.col("_h"), F.col("verticals"))
    confidence = F.when(denied, 100).when(~ad & notice & (F.col("_v") != "OTHER"), 95).otherwise(own)
    matched = F.when(F.col("_v") == "CONSTRUCTION", F.size("_construction")).otherwise(F.size("_horeca"))
    relevance = relevance_score(matched, F.size("_opportunity"), F.array_contains("verticals", F.col("_v")))
    zero = F.lit(0)
    return rows.select(
        "representative_id", "selected_id",
        chain(*[F.lit(x) for x in ("PERMISSION_DENIED", "IRRELEVANT", "IRRELEVANT", "IRRELEVANT", "IRRELEVANT", "AI_ELIGIBLE")]).alias("outcome"),
        chain(*[F.lit(x) for x in ("NO_AI_PERMITTED_EVIDENCE", "ADVERTISEMENT", "EXPLICITLY_IRRELEVANT", "UNSUPPORTED_OR_AMBIGUOUS_VERTICAL", "NO_OPPORTUNITY_CUE", "RELEVANT_OPPORTUNITY")]).alias("reason_code"),
        vertical.alias("vertical"), F.when(~denied, signal_category(vertical, F.col("_opportunity"))).alias("category"),
        confidence.alias("classification_confidence"), chain(zero, zero, zero, zero, zero, relevance).alias("relevance_score"), ids.alias("matched_rule_ids"),
        F.when(denied, zero).otherwise(F.col("_c")).alias("construction_score"), F.when(denied, zero).otherwise(F.col("_h")).alias("horeca_score"),
    )


def signal_id(representative: Column, classifier_version: str, deduplicator_version: str = DEDUPLICATOR_VERSION, taxonomy_version: str = TAXONOMY_VERSION) -> Column:
    return uuid_of(json_strings(representative, F.lit(deduplicator_version), F.lit(classifier_version), F.lit(taxonomy_version)))


def build_signals(decisions: DataFrame, members: DataFrame, classifier_version: str = "classifier-v1") -> tuple[DataFrame, DataFrame]:
    """Eligible decisions -> (signals, their permitted evidence). members: representative_id, id, source_id, ai."""
    signals = decisions.filter("outcome = 'AI_ELIGIBLE'").withColumn("signal_id", signal_id(F.col("representative_id"), classifier_version))
    evidence = signals.select("signal_id", "representative_id").join(members.filter("ai"), "representative_id").select("signal_id", "id", "source_id")
    return signals, evidence.distinct()


def classification_metrics(decisions: DataFrame) -> DataFrame:
    o, v = F.col("outcome"), F.col("vertical")
    return decisions.agg(
        F.count("*").alias("clusters"), F.count_if(o == "AI_ELIGIBLE").alias("eligible"), F.count_if(o == "IRRELEVANT").alias("irrelevant"), F.count_if(o == "PERMISSION_DENIED").alias("denied"),
        F.count_if(v == "CONSTRUCTION").alias("construction"), F.count_if(v == "HORECA").alias("horeca"), F.count_if(v == "OTHER").alias("other"),
    )


def check_decisions(decisions: DataFrame, evidence: DataFrame, members: DataFrame) -> DataFrame:
    """Violations (problem, key): repeated clusters, evidence not permitted or outside its cluster, rejected ones that leak."""
    joined = evidence.join(members.select("id", "representative_id", "ai"), "id", "left")
    outcome = decisions.select(F.col("representative_id").alias("key"), "outcome", "selected_id")
    leak = joined.join(outcome, joined["representative_id"] == outcome["key"]).filter("outcome <> 'AI_ELIGIBLE'")
    shown = joined.select(F.col("representative_id").alias("key"), F.col("id").alias("selected_id"))
    hidden = outcome.filter("outcome = 'AI_ELIGIBLE'").join(shown, ["key", "selected_id"], "left_anti")
    parts = {
        "REPEATED_CLUSTER": outcome.groupBy("key").count().filter("count > 1").select("key"), "NOT_PERMITTED": joined.filter("not coalesce(ai, false)").select(F.col("id").alias("key")),
        "LEAKED_EVIDENCE": leak.select("key"), "SELECTED_NOT_IN_EVIDENCE": hidden.select("key"),
        "REPEATED_EVIDENCE": evidence.groupBy("signal_id", "id").count().filter("count > 1").select(F.col("id").alias("key")),
    }
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("problem"), F.col("key").cast("string").alias("key"))
        out = rows if out is None else out.unionByName(rows)
    return out

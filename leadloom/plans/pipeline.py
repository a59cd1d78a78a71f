"""The whole item pipeline over tables, from the registry to recommendations; run again, it creates nothing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leadloom.functions.expr import deterministic_uuid, half_up
from leadloom.functions.text import NORMALIZER_VERSION, canonicalize_urls, normalize_items
from leadloom.operators import analyze, classify, dedup, ingest, scoring
from leadloom.operators.rules import RULES_V1
from leadloom.operators.terms import matched_lists, term_lists
from leadloom.plans.lineage import cut, emptied, new_table
from leadloom.plans.lineage import stored as parquet_cut
from leadloom.plans.stages import Stages
from leadloom.sources.sinks import new_rows

NAMESPACE = "leadloom-v1"
#: Who answers requests, by default the deterministic template.
PROVIDER = {"provider": "template", "model": "deterministic", "prompt_version": "prompt-v1", "schema_version": analyze.SCHEMA_VERSION, "analysis_version": "analysis-v1"}
#: Columns of an analysis that scoring reads.
ANALYSIS = ["analysis_id", "signal_id", "vertical", "status", "reason", "event_type", "confidence", "business_impact", "urgency", "actionability", "facts", "source_ids", "candidate_actions", "headline"]
RECOMMENDATION = ["id", "signal_id", "analysis_id", "profile_id", "profile_revision", "user_id", "actionability", "business_impact", "company_fit", "confidence", "urgency", "total_score", "band", "scoring_version", "recommended_actions", "source_ids", "criteria"]


def _versions(stages: Stages, name: str, rows: DataFrame, key: str) -> DataFrame:
    """Saves the rows that differ from the newest stored ones of their key; all newest rows, stored and new."""
    columns = rows.columns
    digest = F.sha2(F.to_json(F.struct(*[c for c in columns if c != key]), {"ignoreNullFields": "false"}), 256)
    ready = cut(rows.dropDuplicates([key]).withColumn("_digest", digest))
    stored = stages.read(name, ready.schema).groupBy(key).agg(F.max_by(F.struct(*[c for c in ready.columns if c != key]), "run").alias("x")).select(key, "x.*")
    stored = cut(stored.select(*ready.columns))
    same = stored.select(F.col(key).alias("_key"), F.col("_digest").alias("_same"))
    changed = ready.join(same, (ready[key] == same["_key"]) & (ready["_digest"] == same["_same"]), "left_anti")
    written = stages.write(name, changed)
    return stored.join(written.select(key), key, "left_anti").unionByName(written).drop("_digest")


def _ingested(stages: Stages, candidates: DataFrame, usable: DataFrame) -> None:
    raw = candidates.join(usable.select("source_id"), "source_id", "left_semi").withColumn("content_hash", ingest.content_hash(F.col("raw_text")))
    raw = raw.withColumn("raw_item_id", deterministic_uuid(NAMESPACE, "raw", F.col("source_id"), F.coalesce("external_id", "content_hash")))
    stored = stages.read("raw_items", raw.schema)
    fresh = cut(new_rows(raw.select("source_id", "content_hash"), stored, ["source_id", "content_hash"]))
    offered = raw.join(fresh, ["source_id", "content_hash"], "left_semi")
    names = offered.filter("external_id is not null").select("source_id", "external_id").distinct()
    path = new_table(stages.spark, "resolved")
    resolved = parquet_cut(ingest.resolve_raw_identity(offered, stored.join(names, ["source_id", "external_id"], "left_semi")), "resolved", path)
    refused = resolved.filter("outcome = 'CONFLICT'")
    stages.write("raw_items", resolved.filter("outcome = 'CREATED'").drop("outcome"), rejected=refused.count())
    stages.write("raw_conflicts", refused.select("source_id", "external_id", "content_hash", "url"))
    emptied(stages.spark, path)


def _normalized(stages: Stages) -> None:
    """One outcome for each new raw item, then numbered items of those that succeeded."""
    if stages.idle("normalization", "raw_items"):
        stages.record("items", 0)
        return
    cleaned = canonicalize_urls(normalize_items(stages.new("raw_items", "normalization")), "url", "canonical_url")
    keep = ["raw_item_id", "source_id", "external_id", "normalizer_version", "status", "rejection_code", "title", "text", "language", "normalized_hash", "canonical_url", "published_at", "received_at"]
    path = new_table(stages.spark, "cleaned")
    cleaned = parquet_cut(cleaned.select(*keep), "cleaned", path)
    stages.write("normalization", cleaned, rejected=cleaned.filter("status = 'REJECTED'").count(), input=cleaned.count())
    emptied(stages.spark, path)
    done = stages.new("normalization", "items").filter("status = 'SUCCEEDED'").withColumn("observed_at", dedup.observed_at(F.col("published_at"), F.col("received_at")))
    done = done.select("raw_item_id", "source_id", "external_id", "title", "text", "normalized_hash", "canonical_url", "observed_at")
    first = stages.read("items", done.withColumn("id", F.lit(0).cast("long")).schema).agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
    stages.write("items", done.withColumn("id", F.monotonically_increasing_id() + F.lit(first)))


def current_assignments(stages: Stages) -> DataFrame:
    """The newest assignment of each item."""
    rows = stages.read("assignments")
    return rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("id", "run")]), "run").alias("x")).select("id", "x.*")


def _assigned(stages: Stages, sources: DataFrame) -> None:
    """Assignments of new items, and of the stored ones whose clusters they change."""
    if stages.idle("assignments", "items"):
        return
    verticals = sources.select("source_id", "verticals")
    fresh = stages.new("items", "assignments").drop("run").join(verticals, "source_id")
    if "assignments" not in stages.last:
        rows = dedup.dedup_assignments(fresh)
        stages.write("assignments", rows)
        return
    new_ids = cut(fresh.select("id"))
    every = stages.read("items").drop("run").join(verticals, "source_id")
    known = current_assignments(stages)
    rows = cut(dedup.dedup_increment(fresh, every.join(new_ids, "id", "left_anti"), known))
    before = known.select("id", F.struct("representative_id", "matched_to_id", "match_kind", "similarity").alias("was"))
    rows = rows.join(before, "id", "left").filter(F.col("was").isNull() | (F.col("was") != F.struct("representative_id", "matched_to_id", "match_kind", "similarity"))).drop("was")
    stages.write("assignments", rows, created=new_ids.count())


def _decided(stages: Stages, sources: DataFrame, rules, version: str) -> None:
    """Decisions of the clusters that changed, by their representatives of now."""
    if stages.idle("decisions", "assignments"):
        stages.record("signals", 0)
        return
    changed = stages.new("assignments", "decisions").select("representative_id").distinct()
    ai = sources.select("source_id", ingest.ai_permitted(F.col("enabled"), F.col("ai_allowed"), F.col("rights")).alias("ai"))
    members = current_assignments(stages).select("id", "representative_id").join(changed, "representative_id", "left_semi")
    items = stages.read("items").join(sources.select("source_id", "verticals"), "source_id")
    members = cut(members.join(items.select("id", "observed_at", "source_id"), "id").join(ai, "source_id"))
    text = items.select(F.col("id").alias("selected_id"), "title", "text", "verticals")
    decided = classify.classify_clusters(classify.select_evidence(members).join(text, "selected_id", "left"), rules).withColumn("version", F.lit(version))
    decided = stages.write("decisions", decided)
    signals, evidence = classify.build_signals(decided, members, version)
    one = F.struct(F.col("id").cast("string").alias("id"), "source_id", "title", "text", F.array().cast("array<string>").alias("entities"))
    shown = evidence.join(items.select("id", "title", "text"), "id").groupBy("signal_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("id").alias("k"), one.alias("e")))), lambda x: x["e"]).alias("evidence"))
    stages.write("signals", signals.select("signal_id", "representative_id", "category", "vertical", "relevance_score", "classification_confidence").join(shown, "signal_id"))


def _responses(requests: DataFrame, model: Callable[[dict], str], provider: dict[str, str]) -> DataFrame:
    """A model's answers, checked; those that fail have their reason and no content. Identity, sources and bounds are the checks of validate_responses."""
    asked = requests.withColumns({"correlation_id": F.col("signal_id"), "allowed_source_ids": F.array_distinct("evidence.source_id"), **{k: F.lit(v) for k, v in provider.items()}})
    given = F.struct("analysis_id", "signal_id", "correlation_id", *provider, "category", "vertical", "relevance_score", "classification_confidence", "evidence")
    answered = cut(analyze.analyze_with(asked.select("analysis_id", F.to_json(given).alias("input")), model))
    checked = analyze.validate_responses(answered.select("analysis_id", "response"), asked.select("analysis_id", "signal_id", "correlation_id", "provider", "model", "allowed_source_ids"))
    r = F.from_json("response", analyze.RESPONSE)
    rows = answered.join(checked, "analysis_id").join(requests.select("analysis_id", "signal_id", "vertical"), "analysis_id").withColumn("r", F.when(F.col("status") == "SUCCEEDED", r))
    field = lambda name, into: F.col(f"r.{name}").alias(into)
    return rows.select(
        "analysis_id", "signal_id", "vertical", "status", F.coalesce("failure_code", "reason").alias("reason"), field("eventType", "event_type"), "r.confidence", field("businessImpact", "business_impact"), "r.urgency", "r.actionability",
        "r.facts", field("sourceIds", "source_ids"), field("candidateActions", "candidate_actions"), "r.headline",
    )


def _analyzed(stages: Stages, sources: DataFrame, model: Callable[[dict], str] | None, provider: dict[str, str]) -> None:
    """Requests of new signals, without those that are refused or stored, and their answers."""
    if stages.idle("analyses", "signals"):
        return
    identity = [F.lit(provider[k]) for k in ("provider", "model", "prompt_version", "schema_version", "analysis_version")]
    signals = stages.new("signals", "analyses").withColumn("analysis_id", deterministic_uuid(NAMESPACE, "analysis", F.col("signal_id"), *identity))
    signals = signals.dropDuplicates(["signal_id"])
    evidence = signals.select("signal_id", F.col("signal_id").alias("of_signal"), F.explode("evidence").alias("e")).select("signal_id", "of_signal", "e.id", "e.source_id")
    judged = analyze.analysis_requests(signals.select("signal_id", F.lit("CANDIDATE").alias("status"), F.col("evidence.id").alias("declared")), evidence, sources)
    judged = cut(judged.select("signal_id", "error"))
    wanted = signals.join(judged.filter("error is null"), "signal_id", "left_semi")
    if "analyses" in stages.last:
        wanted = wanted.join(stages.read("analyses").select("analysis_id"), "analysis_id", "left_anti")
    path = new_table(stages.spark, "wanted")
    wanted = parquet_cut(wanted, "wanted", path)
    if model is None:
        rows = analyze.template_analysis(wanted).withColumn("reason", F.lit(None).cast("string")).select(*ANALYSIS)
    else:
        rows = _responses(wanted, model, provider).select(*ANALYSIS)
    stages.write("analyses", rows, rejected=judged.filter("error is not null").count(), input=judged.count())
    emptied(stages.spark, path)


def _text_terms(evidence: str) -> Column:
    return F.flatten(F.transform(evidence, lambda e: F.filter(F.array(e["title"], e["text"]), lambda x: x.isNotNull())))


def score_pairs(pairs: DataFrame, analyses: DataFrame, profiles: DataFrame, shown: DataFrame, sources: DataFrame) -> DataFrame:
    """Pairs (analysis_id, profile_id, profile_revision) with criteria, exclusion and scores. shown: signal_id, evidence.

    Terms are normalised once for each signal and each distinct list of a profile, and matched as dictionaries; pairs
    look up what their two lists have in common. Pairs travel as ids; the columns of profiles and analyses come last.
    """
    pair = ["profile_id", "profile_revision"]
    pairs = cut(pairs.select("analysis_id", *pair))
    some = cut(analyses.join(pairs.select("analysis_id").distinct(), "analysis_id", "left_semi"))
    facts = some.select("analysis_id", F.explode("facts").alias("f")).select("analysis_id", F.col("f.id").alias("fact_id"), F.col("f.sourceIds").alias("source_ids"))
    reliable = scoring.evidence_reliability(facts, sources.select("source_id", "reliability")).filter("error is null").select("analysis_id", "reliability")
    regions = some.select("analysis_id", F.posexplode("source_ids").alias("place", "source_id")).join(sources.select("source_id", "regions"), "source_id").groupBy("analysis_id").agg(F.sort_array(F.collect_list(F.struct("place", "regions")))["regions"].alias("x"))
    regions = regions.select("analysis_id", F.array_distinct(F.flatten("x")).alias("signal_regions"))  # in the order of source_ids
    texts = cut(term_lists(shown.join(some.select("signal_id").distinct(), "signal_id", "left_semi"), "signal_id", _text_terms("evidence")))
    places = cut(term_lists(regions, "analysis_id", F.col("signal_regions")))
    profile = profiles.join(pairs.select(*pair).distinct(), pair, "left_semi").withColumn("_profile", F.to_json(F.struct(*pair)))
    wanted = {
        "offering": F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("services_and_products", "keywords", "target_clients")]), "excluded": F.col("excluded_keywords"), "region": F.col("regions"),
    }
    lists = cut(reduce(DataFrame.unionByName, [term_lists(profile, "_profile", terms).withColumn("kind", F.lit(kind)) for kind, terms in wanted.items()]))
    met = cut(matched_lists(texts.select("list_id", "terms").unionByName(places.select("list_id", "terms")), lists))
    met = met.select(F.col("list_id").alias("_own"), F.col("wanted_id").alias("_wanted"), "matched")
    by_profile = lists.groupBy("_profile").agg(*[F.max(F.when(F.col("kind") == kind, F.col("list_id"))).alias(f"_{kind}_list") for kind in wanted])
    whom = cut(profile.join(by_profile, "_profile").drop("_profile"))
    own = some.join(reliable, "analysis_id").join(texts.select("signal_id", F.col("list_id").alias("_text"), (F.size("terms") > 0).alias("_has_terms")), "signal_id")
    own = cut(own.join(places.select("analysis_id", F.col("list_id").alias("_place"), F.col("terms").alias("_regions")), "analysis_id", "left"))
    pairs = pairs.join(own.select("analysis_id", "_text", "_place"), "analysis_id").join(whom.select(*pair, *[f"_{kind}_list" for kind in wanted]), pair)
    none = F.array().cast("array<string>")

    def looked_up(rows: DataFrame, kind: str, matched: Column = F.col("matched")) -> DataFrame:
        found = met.select("_own", "_wanted", matched.alias(f"_{kind}"))
        rows = rows.join(found, (rows["_place" if kind == "region" else "_text"] == found["_own"]) & (rows[f"_{kind}_list"] == found["_wanted"]), "left").drop("_own", "_wanted")
        return rows.withColumn(f"_{kind}", F.coalesce(f"_{kind}", none))

    # matched terms may be whole texts: of excluded ones only their presence counts, and those of offerings come with the analysis, once for each list
    pairs = looked_up(pairs, "excluded", F.slice(F.transform("matched", lambda x: F.lit("x")), 1, 1)).drop("_excluded_list")
    pairs = looked_up(pairs, "region").drop("_region_list", "_text", "_place")
    last = ["analysis_id", "_offering_list"]
    offered = looked_up(pairs.select(*last).distinct().join(own, "analysis_id"), "offering").drop("_text", "_place")
    pairs = pairs.join(whom.drop(*[f"_{kind}_list" for kind in wanted]), pair).join(offered, last)
    has = F.when(F.col("_has_terms"), F.array(F.lit("x"))).otherwise(none)
    criteria = [
        scoring.fit_vertical(F.col("vertical"), F.col("verticals")), scoring.fit_region(F.col("_regions"), F.col("regions"), F.col("_region")), scoring.fit_event_type(F.col("event_type"), F.col("interested_event_types")),
        scoring.fit_offering(has, none, none, none, F.col("_offering")),
        scoring.fit_project_value(F.lit(None).cast("double"), F.lit(None).cast("string"), F.col("project_value_minimum"), F.col("project_value_maximum"), F.col("currency")),
    ]
    pairs = pairs.withColumn("exclusion", scoring.fit_exclusions(F.col("event_type"), F.col("ignored_event_types"), none, none, F.col("_excluded")))
    rows, fit = scoring.company_fit(criteria, F.col("exclusion"))
    pairs = pairs.withColumns({"criteria": rows, "company_fit": fit, "confidence": half_up(F.col("confidence") * 100, 2)})
    return scoring.with_opportunity_score_v2(pairs).drop(*[c for c in pairs.columns if c.startswith("_")])


def _recommended(stages: Stages, sources: DataFrame) -> None:
    """New analyses with all profiles, and stored ones with new profiles."""
    if stages.idle("recommendations", "analyses", "profiles"):
        return
    named = lambda df: df.withColumnRenamed("id", "profile_id").withColumnRenamed("revision", "profile_revision")
    fresh, people = stages.new("analyses", "recommendations"), named(stages.new("profiles", "recommendations"))
    every, profiles = stages.read("analyses"), named(stages.read("profiles").drop("run"))
    ids = lambda df: df.select("analysis_id", "vertical", "status")
    some = lambda df: df.select("profile_id", "profile_revision", "verticals")
    pairs = scoring.eligible_pairs(ids(fresh), some(profiles))
    if "recommendations" in stages.last:
        older = every.filter(F.col("run") <= stages.last["recommendations"])
        pairs = pairs.unionByName(scoring.eligible_pairs(ids(older), some(people)))
    scored = score_pairs(pairs, every.drop("run"), profiles, stages.read("signals").dropDuplicates(["signal_id"]), sources)
    seen = Observation()  # so that pairs are scored once, not for the counts and again for the table
    scored = scored.observe(seen, F.count("*").alias("input"), F.count_if(F.col("exclusion").isNotNull()).alias("rejected"))
    made = scoring.build_recommendations(scored, NAMESPACE)
    stages.write("recommendations", made.filter("error is null").select(*RECOMMENDATION), seen)


def run_pipeline(
    spark: SparkSession, out: str, sources: DataFrame, candidates: DataFrame, profiles: DataFrame, rules=RULES_V1, classifier_version: str = "classifier-v1", model: Callable[[dict], str] | None = None, provider: dict[str, str] | None = None,
) -> dict[str, dict[str, int]]:
    """Stage tables under out; counts of each stage in this run: input, created, existing, rejected. The table runs has those of all runs.

    sources: source_id, name, enabled, rights, type, ai_allowed, verticals, regions, reliability. candidates: source_id,
    external_id, url, published_at, received_at, position, raw_text, raw_payload. profiles: id, revision, user_id and
    their lists. model: answers requests (a dict with analysis_id and input, JSON) with a JSON response, which is
    checked; without it the deterministic template answers. provider names it in the identity of an analysis.

    Stages: sources and profiles (saved where they differ from what is stored), raw_items, normalization, items,
    assignments, decisions, signals, analyses, recommendations. Each reads the partitions that its predecessor has
    written since its own last recorded run, so a run that is broken off goes on where it ended, and a run without new
    rows does no work. A new item changes the assignments of the clusters that it touches; those are decided again. A
    signal that has an analysis of the same identity keeps it.
    """
    stages = Stages(spark, out)
    registry = cut(_versions(stages, "sources", sources, "source_id"))
    people = cut(profiles.dropDuplicates(["id", "revision"]))
    stages.write("profiles", new_rows(people, stages.read("profiles", people.schema), ["id", "revision"]))
    _ingested(stages, candidates, registry.filter(ingest.collection_permitted(F.col("enabled"), F.col("rights"), F.col("type"))))
    _normalized(stages)
    _assigned(stages, registry)
    _decided(stages, registry, rules, classifier_version)
    _analyzed(stages, registry, model, PROVIDER | (provider or {}))
    _recommended(stages, registry)
    rows = stages.records().filter(F.col("run") == stages.run).collect()  # one a stage
    return {r["stage"]: {k: r[k] for k in ("input", "created", "existing", "rejected")} for r in rows}


__all__ = ["NORMALIZER_VERSION", "run_pipeline"]

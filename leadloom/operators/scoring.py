"""Company fit and opportunity scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.expr import deterministic_uuid, fixed2, half_up

# Fixed values.
FIT_WEIGHTS = {"VERTICAL": 0.30, "REGION": 0.25, "EVENT_TYPE": 0.20, "OFFERING": 0.15, "PROJECT_VALUE": 0.10}
SCORE_WEIGHTS = {"actionability": 0.10, "business_impact": 0.35, "company_fit": 0.25, "confidence": 0.10, "urgency": 0.20}
BANDS = (("CRITICAL", 85), ("HIGH", 70), ("MEDIUM", 55), ("LOW", 40))
GUARDRAIL = ((40, "LOW", 54), (60, "MEDIUM", 69), (80, "HIGH", 84))
SCORING_VERSION = "opportunity-score-v2"
#: Pairs of a part of a vertical, and the most parts.
PART_PAIRS, MOST_PARTS = 2_000_000, 4096


def eligible_pairs(analyses: DataFrame, profiles: DataFrame) -> DataFrame:
    """Succeeded analyses with each profile that has their vertical. Spark broadcasts profiles if their size allows.

    There are few verticals: where one has more than PART_PAIRS pairs, its analyses are dealt to parts, and its profiles
    go to all of them; others are joined as they are. Both sides are counted by vertical first.
    """
    wanted = profiles.withColumn("vertical", F.explode(F.array_distinct("verticals"))).filter("vertical <> 'OTHER'")
    done = analyses.filter("status = 'SUCCEEDED'")
    sizes = done.groupBy("vertical").agg(F.count("*").alias("a")).join(wanted.groupBy("vertical").agg(F.count("*").alias("p")), "vertical")
    most = sizes.agg(F.max(F.col("a").cast("double") * F.col("p"))).first()[0] or 0
    parts = int(min(MOST_PARTS, -(-most // PART_PAIRS)))
    if parts <= 1:
        return done.join(wanted, "vertical")
    wanted = wanted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = done.withColumn("_part", F.pmod(F.xxhash64(*analyses.columns), F.lit(parts)).cast("int"))
    return dealt.join(wanted, ["vertical", "_part"]).drop("_part")


def normalize_term(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(value), "ё", "е"), r"[^\p{L}\p{N}]+", " "))


def normalize_terms(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, normalize_term), lambda x: x != ""))


def alike(a: Column, b: Column) -> Column:
    """Whether tokens begin alike: with the same five letters, or all of a shorter one of three or more."""
    n = F.least(F.lit(5), F.length(a), F.length(b))
    return (n >= 3) & (F.left(a, n) == F.left(b, n))


def matches_term(candidate: Column, wanted: Column) -> Column:
    """Equality of short terms; else one contains the other, or each wanted token begins like a candidate token."""
    short = (F.length(candidate) < 3) | (F.length(wanted) < 3)
    contains = F.contains(candidate, wanted) | F.contains(wanted, candidate)
    tokens = F.forall(F.split(wanted, " "), lambda w: F.exists(F.split(candidate, " "), lambda c: alike(c, w)))
    return F.when(short, candidate == wanted).otherwise(contains | tokens)


def intersecting(candidates: Column, wanted: Column) -> Column:
    """Normalised candidates that match a wanted term."""
    terms = normalize_terms(wanted)
    return F.filter(normalize_terms(candidates), lambda c: F.exists(terms, lambda w: matches_term(c, w)))


def _criterion(name: str, score: Column, reason: Column, matched: Column | None = None) -> Column:
    """One criterion; matched are the values that made the match, an empty array without one."""
    weight, none = FIT_WEIGHTS[name], F.array().cast("array<string>")
    score = score.cast("double")
    values = none if matched is None else F.when(F.endswith(reason, F.lit("_MATCH")), matched).otherwise(none)
    return F.struct(
        F.lit(name).alias("criterion"), score.alias("score"), F.lit(weight).alias("weight"), half_up(F.lit(weight) * score, 2).alias("contribution"), reason.alias("reason_code"), values.alias("matched_values")
    )


def _pick(unknown: Column, match: Column, miss: int, names: tuple[str, str, str]) -> tuple[Column, Column]:
    return F.when(unknown, 50).when(match, 100).otherwise(miss), F.when(unknown, names[0]).when(match, names[1]).otherwise(names[2])


def fit_vertical(vertical: Column, verticals: Column) -> Column:
    ok = (vertical != "OTHER") & F.array_contains(verticals, vertical)
    return _criterion("VERTICAL", F.when(ok, 100).otherwise(0), F.when(ok, "VERTICAL_MATCH").otherwise("VERTICAL_MISMATCH"), F.array(vertical))


def fit_region(regions: Column, wanted: Column, matched: Column | None = None) -> Column:
    """matched: the regions that match, where an index of terms has found them; without it they are found here, pair by pair."""
    matched = intersecting(regions, wanted) if matched is None else matched
    return _criterion("REGION", *_pick(F.coalesce(F.size(regions), F.lit(0)) <= 0, F.size(matched) > 0, 0, ("REGION_UNKNOWN", "REGION_MATCH", "REGION_MISMATCH")), matched)


def fit_event_type(event: Column, interested: Column) -> Column:
    own = normalize_term(F.coalesce(event, F.lit("")))
    unknown = (own == "") | (F.size(interested) <= 0)
    return _criterion("EVENT_TYPE", *_pick(unknown, F.array_contains(normalize_terms(interested), own), 25, ("EVENT_UNKNOWN", "EVENT_MATCH", "EVENT_MISMATCH")), F.array(own))


def fit_offering(terms: Column, services: Column, keywords: Column, clients: Column, matched: Column | None = None) -> Column:
    """matched: as in fit_region."""
    matched = intersecting(terms, F.concat(services, keywords, clients)) if matched is None else matched
    return _criterion("OFFERING", *_pick(F.coalesce(F.size(terms), F.lit(0)) <= 0, F.size(matched) > 0, 25, ("OFFERING_UNKNOWN", "OFFERING_MATCH", "OFFERING_MISMATCH")), matched)


def fit_project_value(amount: Column, currency: Column, low: Column, high: Column, wanted_currency: Column) -> Column:
    """Negative amounts and codes that are not three letters are invalid: null score, reason INVALID_PROJECT_VALUE."""
    code = F.upper(F.trim(currency))
    invalid = amount.isNotNull() & ((amount < 0) | F.isnan(amount) | ~F.coalesce(code.rlike("^[A-Z]{3}$"), F.lit(False)))
    unknown = amount.isNull() | wanted_currency.isNull()
    within = (F.coalesce(low, amount) <= amount) & (amount <= F.coalesce(high, amount))
    score = F.when(invalid, F.lit(None)).when(unknown, 50).when(code != wanted_currency, 0).when(within, 100).otherwise(0)
    reason = (
        F.when(invalid, "INVALID_PROJECT_VALUE").when(unknown, "PROJECT_VALUE_UNKNOWN").when(code != wanted_currency, "PROJECT_VALUE_CURRENCY_MISMATCH")
        .when(within, "PROJECT_VALUE_MATCH").otherwise("PROJECT_VALUE_OUTSIDE_RANGE")
    )
    return _criterion("PROJECT_VALUE", score, reason)


def fit_exclusions(event: Column, ignored: Column, terms: Column, excluded: Column, matched: Column | None = None) -> Column:
    """Reason of an exclusion or null: an ignored event first, then an excluded term. matched: as in fit_region."""
    own = normalize_term(F.coalesce(event, F.lit("")))
    matched = intersecting(terms, excluded) if matched is None else matched
    return F.when((own != "") & F.array_contains(normalize_terms(ignored), own), "EVENT_IGNORED").when(F.size(matched) > 0, "EXCLUDED_TERM_MATCH")


def company_fit(criteria: list[Column], exclusion: Column) -> tuple[Column, Column]:
    """(criteria rows, score): the rounded sum of the contributions, 0 if excluded."""
    rows = F.array(*criteria)
    total = F.aggregate(rows, F.lit(0.0), lambda a, x: a + x["contribution"])
    return rows, F.when(exclusion.isNull(), half_up(total, 2)).otherwise(0.0)


def score_contributions(**factors: Column) -> dict[str, Column]:
    return {name: half_up(factors[name].cast("double") * F.lit(weight), 4) for name, weight in SCORE_WEIGHTS.items()}


def opportunity_score_v1(actionability: Column, business_impact: Column, company_fit: Column, confidence: Column, urgency: Column) -> Column:
    parts = score_contributions(actionability=actionability, business_impact=business_impact, company_fit=company_fit, confidence=confidence, urgency=urgency)
    total = F.lit(0.0)
    for name in SCORE_WEIGHTS:
        total = total + parts[name]
    return half_up(total, 2)


def opportunity_band(score: Column) -> Column:
    out = F.when(score >= BANDS[0][1], BANDS[0][0])
    for name, least in BANDS[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("IGNORE")


def evidence_reliability(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """(analysis_id, reliability, error): the least, over facts, of the best source. facts: analysis_id, fact_id, source_ids."""
    known = sources.groupBy("source_id").agg(F.max("reliability").alias("reliability"), (F.min("reliability") != F.max("reliability")).alias("conflict"))
    each = facts.withColumn("source_id", F.explode("source_ids")).join(known, "source_id", "left")
    by_fact = each.groupBy("analysis_id", "fact_id").agg(F.max("reliability").alias("best"), F.bool_or(F.col("reliability").isNull()).alias("missing"), F.bool_or("conflict").alias("conflict"))
    out = by_fact.groupBy("analysis_id").agg(F.min("best").alias("reliability"), F.bool_or("missing").alias("missing"), F.bool_or("conflict").alias("conflict"))
    error = F.when(F.col("conflict"), "CONFLICTING_SCORING_SOURCE_RELIABILITY").when(F.col("missing"), "MISSING_SCORING_SOURCE_RELIABILITY")
    return out.select("analysis_id", F.when(error.isNull(), F.col("reliability")).alias("reliability"), error.alias("error"))


def confidence_guardrail_v2(confidence: Column, reliability: Column) -> tuple[Column, Column, Column]:
    """(effective confidence, highest band, highest score)."""
    effective = F.least(confidence, reliability)
    band, top = F.when(effective < GUARDRAIL[0][0], GUARDRAIL[0][1]), F.when(effective < GUARDRAIL[0][0], GUARDRAIL[0][2])
    for edge, name, most in GUARDRAIL[1:]:
        band, top = band.when(effective < edge, name), top.when(effective < edge, most)
    return effective, band.otherwise("CRITICAL"), top.otherwise(100)


def with_opportunity_score_v2(df: DataFrame) -> DataFrame:
    """Adds effective_confidence, raw_total, total_score, band, guardrail_band, guardrail_applied.

    df: actionability, business_impact, company_fit, confidence (0 to 100), reliability, urgency.
    """
    effective, band, top = confidence_guardrail_v2(F.col("confidence"), F.col("reliability"))
    df = df.withColumns({"effective_confidence": effective, "guardrail_band": band, "_top": top})
    raw = opportunity_score_v1(F.col("actionability"), F.col("business_impact"), F.col("company_fit"), F.col("effective_confidence"), F.col("urgency"))
    df = df.withColumn("raw_total", raw).withColumn("total_score", half_up(F.least("raw_total", F.col("_top").cast("double")), 2))
    return df.withColumns({"band": opportunity_band(F.col("total_score")), "guardrail_applied": F.col("total_score") < F.col("raw_total")}).drop("_top")


def score_explanation(df: DataFrame) -> Column:
    """Explanation of a row of with_opportunity_score_v2, which also has `confidence`."""
    parts = score_contributions(**{n: F.col("effective_confidence" if n == "confidence" else n) for n in SCORE_WEIGHTS})
    f = fixed2
    part = lambda n, label, percent: F.concat(F.lit(f"{label} "), f(F.col(n)), F.lit(f"×{percent}%="), f(parts[n]))
    return F.concat_ws(
        "; ", F.concat(F.lit("Opportunity Score "), f(F.col("total_score")), F.lit(" ("), F.col("band"), F.lit(")")), F.concat(F.lit("rawWeightedScore "), f(F.col("raw_total"))),
        part("business_impact", "businessImpact", 35), part("company_fit", "companyFit", 25), part("urgency", "urgency", 20),
        F.concat(F.lit("effectiveConfidence min(analysisConfidence "), f(F.col("confidence")), F.lit(", evidenceReliability "), f(F.col("reliability")), F.lit(")="), f(F.col("effective_confidence")), F.lit("×10%="), f(parts["confidence"])),
        part("actionability", "actionability", 10),
        F.when(F.col("guardrail_applied"), F.concat(F.lit("confidenceGuardrail capped priority at "), F.col("guardrail_band"), F.lit("/"), f(F.col("total_score")))).otherwise("confidenceGuardrail not applied"),
    )


def recommendation_id(namespace: str = "pipeline") -> Column:
    """From signal_id, analysis_id, profile_id and profile_revision."""
    identity = [F.col(c).cast("string") for c in ("signal_id", "analysis_id", "profile_id", "profile_revision")]
    return deterministic_uuid(namespace, "recommendation", *identity, F.lit(SCORING_VERSION))


def build_recommendations(scored: DataFrame, namespace: str = "pipeline") -> DataFrame:
    """Pairs that are not excluded -> recommendations with deterministic ids, recommended_actions and source_ids.

    scored: exclusion, the ids, candidate_actions (title, ...) and source_ids of the analysis. error is
    INVALID_RECOMMENDED_ACTION_COUNT unless there are 2 to 5 actions, DUPLICATE_RECOMMENDED_ACTION if two have one title,
    case aside, INVALID_SOURCE_IDS if sources are absent or repeated; else null.
    """
    titles = F.transform("candidate_actions", lambda a: F.lower(a["title"]))
    error = (
        F.when(~F.coalesce(F.size("candidate_actions"), F.lit(0)).between(2, 5), "INVALID_RECOMMENDED_ACTION_COUNT").when(F.size(F.array_distinct(titles)) < F.size(titles), "DUPLICATE_RECOMMENDED_ACTION")
        .when((F.coalesce(F.size("source_ids"), F.lit(0)) < 1) | (F.size(F.array_distinct("source_ids")) < F.size("source_ids")), "INVALID_SOURCE_IDS")
    )
    rows = scored.filter("exclusion is null").withColumns({"id": recommendation_id(namespace), "scoring_version": F.lit(SCORING_VERSION), "error": error})
    return rows.withColumnRenamed("candidate_actions", "recommended_actions")


def scoring_summary(scored: DataFrame, created: int | None = None) -> DataFrame:
    out = scored.agg(
        F.count("*").alias("eligible_pairs"), F.count_if(F.col("exclusion").isNull()).alias("scored"), F.count_if(F.col("exclusion").isNotNull()).alias("excluded"), F.count_distinct("profile_id").alias("profiles")
    )
    return out if created is None else out.withColumns({"created": F.lit(created), "existing": F.col("scored") - F.lit(created)})

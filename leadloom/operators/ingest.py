"""Ingestion: rights, identities of raw items, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AI_RIGHTS = ("OPEN_DATA", "PUBLIC_API", "PARTNER", "CONSENT")
UNREVIEWED_TYPES = ("FIXTURE", "MANUAL")


def collection_permitted(enabled: Column, rights: Column, source_type: Column) -> Column:
    """Enabled, not blocked, and reviewed unless the type needs no review."""
    return enabled & (rights != "BLOCKED") & ((rights != "REVIEW_REQUIRED") | source_type.isin(*UNREVIEWED_TYPES))


def ai_permitted(enabled: Column, allowed: Column, rights: Column) -> Column:
    return enabled & allowed & rights.isin(*AI_RIGHTS)


def content_hash(raw_text: Column) -> Column:
    return F.sha2(raw_text, 256)


def resolve_raw_identity(candidates: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Candidates (source_id, external_id, content_hash, received_at, position) with an outcome each.

    CREATED: first of its content in its source, and of its external id among those. EXISTING_CONTENT_HASH and
    EXISTING_EXTERNAL_ID: a stored or earlier row has it. CONFLICT: the external id is held by other content.
    """
    order = ["received_at", "position"]
    if stored is not None:
        held = stored.select("source_id", "external_id", "content_hash", F.lit(None).cast("timestamp").alias("received_at"), F.lit(-1).cast("long").alias("position"))
        every = candidates.withColumn("_old", F.lit(False)).unionByName(held.withColumn("_old", F.lit(True)), allowMissingColumns=True)
    else:
        every = candidates.withColumn("_old", F.lit(False))
    by_hash = Window.partitionBy("source_id", "content_hash").orderBy(F.desc("_old"), *order)
    marked = every.withColumn("_h", F.row_number().over(by_hash))
    leads = marked.filter("_h = 1 and external_id is not null")
    holder = leads.groupBy("source_id", "external_id").agg(F.min_by(F.struct("content_hash", "_old", *order), F.struct((~F.col("_old")).alias("o"), *order)).alias("holder"))
    out = marked.filter("not _old").join(holder, ["source_id", "external_id"], "left")
    mine = F.col("holder.content_hash") == F.col("content_hash")
    before = F.col("holder._old") | (F.struct(*[F.col(f"holder.{c}").alias(c) for c in order]) < F.struct(*order))
    first = (F.col("_h") == 1) & (F.col("holder").isNull() | (mine & (F.struct(*[F.col(f"holder.{c}").alias(c) for c in order]) == F.struct(*order))))
    outcome = (
        F.when(first, "CREATED").when(F.col("holder").isNotNull() & mine & before, "EXISTING_EXTERNAL_ID")
        .when(F.col("holder").isNotNull() & ~mine & before, "CONFLICT").otherwise("EXISTING_CONTENT_HASH")
    )
    return out.withColumn("outcome", outcome).drop("_old", "_h", "holder")


def raw_identity_conflicts(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates whose external id is stored with other content."""
    held = stored.filter("external_id is not null").select("source_id", "external_id", F.col("content_hash").alias("stored_hash"))
    return candidates.join(held, ["source_id", "external_id"]).filter("content_hash <> stored_hash")


def ingestion_summary(resolved: DataFrame, sources: DataFrame) -> DataFrame:
    """By source: candidates, created, existing, AI-permitted created."""
    known = sources.select("source_id", ai_permitted(F.col("enabled"), F.col("ai_allowed"), F.col("rights")).alias("ai"))
    created = F.col("outcome") == "CREATED"
    return resolved.join(known, "source_id", "left").groupBy("source_id").agg(
        F.count("*").alias("candidates"), F.count_if(created).alias("created"), F.count_if(F.col("outcome").startswith("EXISTING")).alias("existing"),
        F.count_if(created & F.col("ai")).alias("ai_permitted_created"),
    )


def source_ref_check(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items without a source, or whose vertical the source does not declare."""
    known = sources.select("source_id", F.col("verticals").alias("_verticals"))
    joined = items.join(known, "source_id", "left")
    problem = F.when(F.col("_verticals").isNull(), "UNKNOWN_SOURCE").when(~F.array_contains("_verticals", F.col("vertical")), "UNDECLARED_VERTICAL")
    return joined.withColumn("problem", problem).filter("problem is not null").drop("_verticals")

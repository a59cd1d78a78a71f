"""Mixing sources to target weights as a time-varying curriculum. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.shared import cut, n_words, partitions, read_documents

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Slope of each weight class over training time: rate 1 + slope * (2 t - 1), so heavy sources grow, light ones fade.
SLOPES = (0.5, 0.0, -0.5)
#: A source gives at most this many times its size.
MAX_REPEATS = 3.0
ROWS_PER_BUCKET = 500
MAX_BUCKETS = 1 << 16


def _in_order(rows: DataFrame, by: list[Column]) -> DataFrame:
    """rows with _part, _at (place in its part) and _before (rows in parts before it): range parts in order, none of them one task's whole table."""
    sorted_ = cut(rows.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sorted_ = sorted_.withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = sorted_.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each part
    earlier = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sorted_.join(F.broadcast(sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))), "_part")


def _sum_to(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows of _in_order with name_to, the sum of each column over all rows up to this one."""
    earlier = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_part").agg(*[F.sum(c).alias(c) for c in columns])
    sums = sums.select("_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0.0)).alias(f"_{c}") for c in columns])
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(F.broadcast(sums), "_part").withColumns({f"{c}_to": F.col(f"_{c}") + F.sum(c).over(inside) for c in columns}).drop(*[f"_{c}" for c in columns])


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, cap: float = MAX_REPEATS) -> DataFrame:
    """source, source_size (any others kept) -> also target, slope. One row per source.

    Targets share the total by weight, none above cap times its source's size. Sources in ascending order of
    cap / weight fill up first; what they cannot take is shared by weight among the rest, which is where repeated
    resharing ends. Sources are ranked and summed by range parts; only totals and one row per part are in one place.
    """
    def cycle(values) -> Column:
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("_rank") % len(values) + 1).cast("int"))

    ranked = _in_order(sizes, [F.col("source").asc_nulls_last()]).withColumn("_rank", F.col("_before") + F.col("_at"))
    ranked = ranked.withColumns({"_weight": cycle(weights), "slope": cycle(slopes), "_cap": F.col("source_size") * F.lit(cap)}).withColumn("_ratio", F.col("_cap") / F.col("_weight")).drop("_part", "_at", "_before", "_rank")
    total, weight = ranked.agg(F.sum("source_size"), F.sum("_weight")).first()
    filled = _sum_to(_in_order(ranked, [F.col("_ratio"), F.col("source").asc_nulls_last()]), ["_cap", "_weight"])
    level = (F.lit(total) - (F.col("_cap_to") - F.col("_cap"))) / (F.lit(weight) - (F.col("_weight_to") - F.col("_weight")))
    filled = filled.withColumn("_level", level).withColumn("_full", F.col("_cap") <= F.col("_weight") * F.col("_level"))
    filled = cut(filled)
    rest = filled.filter("not _full").agg(F.min(F.struct("_part", "_at", "_level")).alias("x")).select("x._level").first()[0]
    out = filled.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_weight") * F.lit(rest).cast("double")))
    return out.select(*sizes.columns, "slope", "target")


def training_time(share: Column, slope: Column) -> Column:
    """The time at which a source's cumulative demand t + slope * (t^2 - t) reaches a share of its target."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    return F.when(slope == 0, share).otherwise((root - (1 - slope)) / F.when(slope == 0, F.lit(1.0)).otherwise(2 * slope)) + 0.0


def mix_sources(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, cap: float = MAX_REPEATS) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, copies, positions; sorted by first position.

    Each source has its own schedule of weight over training time; its integral is the source's cumulative demand, and the
    inverse of that gives positions. Schedules are not divided by their sum at each time: time is the share of each
    source's own target, not of the tokens of all sources together. Within a source documents stand in the order of a digest of their id; the source repeats whole passes while the
    target has room, and the last pass ends inside a document, so each source's taken words equal its target, rounded.
    Positions are in [0, 1], one for each time that a document begins: the inverse of the source's cumulative demand
    at the words taken before it. Prefix sums are by (source, digest bucket) and then inside buckets, so that a source
    with a third of all rows is spread over many tasks.

    Null or blank text has size 0 and is not taken. A null source is a source of its own, last in order. Repeated rows
    are taken each for itself. An empty table gives an empty result.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"), F.xxhash64("text").alias("content")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    n = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    buckets = max(1, min(MAX_BUCKETS, n // ROWS_PER_BUCKET))
    targets = source_targets(sizes.drop("_rows"), weights, slopes, cap).withColumnRenamed("source", "_source")
    bucket = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(2**32)).cast("long")
    rows = rows.withColumn("bucket", bucket)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    offsets = offsets.join(targets.withColumnRenamed("_source", "_of"), F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    rows = rows.withColumn("start", F.col("_offset") + F.col("_inside"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("passes", passes)
    last = F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long") - F.col("start")
    rows = rows.withColumn("_last", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), last)))
    rows = rows.withColumns({
        "taken": F.col("size") * F.col("passes") + F.col("_last"),
        "copies": F.when(F.col("size") > 0, F.col("passes") + (F.col("_last") > 0).cast("long")).otherwise(F.lit(0).cast("long")),
    })
    time = lambda k: training_time(F.least(F.lit(1.0), (F.col("start") + k * F.col("source_size")) / F.col("target")), F.col("slope"))
    begins = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("copies"), F.lit(1)) - 1), time))
    out = rows.withColumn("positions", F.coalesce(begins, F.array().cast("array<double>")))
    return out.select(
        "row_id", "content", "doc_id", "source", "size", "source_size", "target", "taken", "copies", "positions"
    ).orderBy(F.try_element_at("positions", F.lit(1)).asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The training sequence: each document as often as mix_sources takes it, whole, range-sorted by position.

    A document that the last pass ends in is taken whole. Returns the columns of docs. Of rows with the same id and text
    one stands for all, as often as they are taken together.
    """
    columns = docs.columns
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    plan = mix_sources(docs, **how).filter("copies > 0").groupBy(name.alias("_ll_id"), F.col("content").alias("_ll_content"))
    plan = plan.agg(F.flatten(F.collect_list("positions")).alias("_ll_at"))
    marked = docs.withColumns({"_ll_id": name, "_ll_content": F.xxhash64("text")})
    out = marked.join(plan, ["_ll_id", "_ll_content"]).dropDuplicates(["_ll_id", "_ll_content"])
    return out.withColumn("_ll_at", F.explode("_ll_at")).orderBy("_ll_at", "doc_id").select(*columns)


def op5(spark, sf_dir: str) -> DataFrame:
    first = F.try_element_at("positions", F.lit(1)).alias("first_position")
    return mix_sources(read_documents(spark, sf_dir)).select("doc_id", "source", "size", "source_size", "target", "taken", "copies", first)


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
z AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM z),
w AS (SELECT *, [5.0, 2.0, 1.0][k % 3 + 1]::DOUBLE AS weight, [0.5, 0.0, -0.5][k % 3 + 1]::DOUBLE AS slope, source_size * 3.0::DOUBLE AS cap FROM r),
f AS (SELECT *, row_number() OVER o AS place, (sum(source_size) OVER () - (sum(cap) OVER o - cap)) / (sum(weight) OVER () - (sum(weight) OVER o - weight)) AS level FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
t AS (SELECT source, source_size, slope, CASE WHEN cap <= weight * level THEN cap ELSE weight * (SELECT arg_min(level, place) FROM f WHERE cap > weight * level) END::DOUBLE AS target FROM f),
s AS (SELECT d.*, source_size, slope, target, sum(size) OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR), doc_id) - size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM s),
l AS (SELECT *, greatest(0, least(size, floor(target - passes * source_size + 0.5)::BIGINT - start)) AS last FROM p),
c AS (SELECT *, CASE WHEN size > 0 THEN passes + (last > 0)::INT ELSE 0 END AS copies, least(1.0, start / target)::DOUBLE AS share FROM l)
SELECT doc_id, source, size, source_size, target, (size * passes + last)::BIGINT AS taken, copies::BIGINT AS copies,
 CASE WHEN copies > 0 THEN CASE WHEN slope = 0 THEN share ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope) END + 0.0 END AS first_position FROM c
"""

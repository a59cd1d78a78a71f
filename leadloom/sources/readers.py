"""Readers of item datasets, feeds, gold sets and stage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions.expr import not_blank

ITEM_DATASET = """
createdAt string,
sources array<struct<id:string,name:string,url:string,country:string,regions:array<string>,verticals:array<string>,
  rightsStatus:string,rightsBasis:string,aiProcessingAllowed:boolean,reliabilityScore:double>>,
items array<struct<fixtureId:string,sourceId:string,externalId:string,originalUrl:string,publishedAt:string,rawText:string,
  rawPayload:string,labels:struct<vertical:string,isAdvertisement:boolean,duplicateGroup:string,duplicateKind:string>>>
"""
GOLD_DATASET = """
items array<struct<id:string,split:string,
  source:struct<title:string,text:string,originalUrl:string,publishedAt:string,rightsBasis:string,sourceId:string,sourceName:string>,
  labels:struct<vertical:string,relevant:boolean,category:string,eventType:string,summary:string,
    facts:array<struct<id:string,statement:string,evidenceQuote:string>>,
    expectedAction:struct<kind:string,title:string,rationale:string>,importance:struct<score:int,reason:string>>>>
"""
_LINK = "array<struct<_href:string,_rel:string,_VALUE:string>>"
RSS_ITEM = T.StructType([
    T.StructField("guid", T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_isPermaLink", T.StringType())])),
    *[T.StructField(n, T.StringType()) for n in ("title", "link", "pubDate", "published", "updated", "date", "content:encoded", "encoded", "description", "summary", "content")],
])
ATOM_ENTRY = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("id", "title", "published", "updated")],
    T.StructField("link", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("_href", "_rel")]))),
    *[T.StructField(n, T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_type", T.StringType())])) for n in ("summary", "content")],
])
#: Date formats of feeds, weekday already removed. Fixed values.
DATE_FORMATS = ("dd MMM yyyy HH:mm:ss Z", "dd MMM yyyy HH:mm:ss z", "dd MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z")


def canonical_timestamp(value: Column) -> Column:
    """Instant of an ISO or RFC 822 date; null if neither reads it."""
    bare = F.regexp_replace(F.trim(value), r"^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,\s*", "")
    iso = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(bare))
    rfc = [F.when(~bare.rlike(r"^\d{4}-"), F.try_to_timestamp(F.regexp_replace(bare, "(?i:UT|GMT|UTC|Z)$", "+0000"), F.lit(f))) for f in DATE_FORMATS]
    return F.coalesce(iso, *rfc)


def _http(value: Column) -> Column:
    return F.when(value.rlike(r"(?i)^https?://[^\s/]+"), value)


def _split_valid(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.col("url").isNotNull() & F.col("raw_text").isNotNull()
    return items.filter(ok), items.filter(~ok)


def read_item_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON dataset files -> (sources, items)."""
    data = spark.read.schema(ITEM_DATASET).option("multiLine", True).json(path)
    sources = data.select(F.explode("sources").alias("s")).select("s.*")
    items = data.select(F.to_timestamp("createdAt").alias("created_at"), F.posexplode("items").alias("position", "i")).select("created_at", "position", "i.*")
    return sources, items.withColumn("publishedAt", canonical_timestamp(F.col("publishedAt")))


def read_rss_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """RSS 2.0 files -> (candidates, rows without an http URL or without text)."""
    raw = spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path)
    guid = not_blank(F.col("guid._VALUE"))
    url = F.coalesce(_http(not_blank(F.col("link"))), _http(guid))
    text = F.coalesce(*[not_blank(F.col(f"`{n}`")) for n in ("content:encoded", "encoded", "description", "summary", "content", "title")])
    when = F.coalesce(*[not_blank(F.col(n)) for n in ("pubDate", "published", "updated", "date")])
    return _split_valid(raw.select(
        F.coalesce(guid, url).alias("external_id"), url.alias("url"), not_blank(F.col("title")).alias("title"), text.alias("raw_text"),
        canonical_timestamp(when).alias("published_at"),
    ))


def read_atom_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Atom files -> (candidates, rows without an http URL or without text)."""
    raw = spark.read.format("xml").option("rowTag", "entry").schema(ATOM_ENTRY).load(path)
    links = F.filter("link", lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate"))
    url = F.coalesce(_http(not_blank(F.try_element_at(links, F.lit(1))["_href"])), _http(not_blank(F.col("id"))))
    text = F.coalesce(*[not_blank(c) for c in (F.col("content._VALUE"), F.col("summary._VALUE"), F.col("title"))])
    return _split_valid(raw.select(
        F.coalesce(not_blank(F.col("id")), url).alias("external_id"), url.alias("url"), not_blank(F.col("title")).alias("title"), text.alias("raw_text"),
        canonical_timestamp(F.coalesce(not_blank(F.col("published")), not_blank(F.col("updated")))).alias("published_at"),
    ))


def read_gold_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation JSON files -> items with nested labels and facts."""
    data = spark.read.schema(GOLD_DATASET).option("multiLine", True).json(path)
    return data.select(F.explode("items").alias("i")).select("i.*")


def read_stage(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    """A stage table with its declared schema; fmt jdbc takes the usual options."""
    if fmt == "jdbc":
        return spark.read.format("jdbc").options(**options).load()
    return spark.read.format(fmt).schema(schema).options(**options).load(path)

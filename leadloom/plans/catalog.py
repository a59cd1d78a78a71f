"""Queries over the driver's tables, one or more for each operator, and the same rows as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import expr, text
from leadloom.operators import classify, dedup, digest, evals, feedback, ingest, quality, scoring, serving, telemetry
from leadloom.operators.rules import RULES_V1, RULES_V2, Rule
from leadloom.plans.lineage import cut
from leadloom.plans.testviews import LATIN_RULES, Views, ascii_upper
from leadloom.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, **parts: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


SOURCES = """s0 AS (SELECT DISTINCT source AS source_id, CAST(substr(source, 4) AS INTEGER) AS n FROM documents),
sources AS (SELECT source_id, n, ['CONSTRUCTION', 'HORECA', 'OTHER'][n % 3 + 1] AS vertical, CAST(35 + n * 7 % 60 AS DOUBLE) AS reliability,
 CASE WHEN n % 10 = 9 THEN 'REVIEW_REQUIRED' ELSE 'OPEN_DATA' END AS rights, n % 10 <> 9 AS ai FROM s0)"""
RAW = """raw AS (SELECT doc_id AS id, source AS source_id, CASE WHEN doc_id % 10 <> 0 THEN 'ext-' || doc_id END AS external_id, sha256(text) AS h,
 TIMESTAMP '2026-01-01' + to_minutes(CAST(10 * doc_id AS INTEGER)) AS tm, text FROM documents)"""
ITEMS = RAW + """, items AS (SELECT id, source_id, CASE WHEN id % 10 <> 0 THEN 'e' || (id % 331) END AS ext, CASE WHEN id % 3 = 0 THEN 'u' || (id % 501) END AS url, h, tm, text FROM raw)"""
EDGES = ITEMS + """, e0 AS (
 SELECT min(id) OVER (PARTITION BY source_id, ext) AS a, id AS b, 0 AS p FROM items WHERE ext IS NOT NULL
 UNION ALL SELECT min(id) OVER (PARTITION BY url), id, 1 FROM items WHERE url IS NOT NULL
 UNION ALL SELECT min(id) OVER (PARTITION BY h), id, 2 FROM items),
edges AS (SELECT a, b, min(p) AS p FROM e0 WHERE a <> b GROUP BY a, b),
sym AS (SELECT a AS x, b AS y, a, p FROM edges UNION ALL SELECT b, a, a, p FROM edges)"""
CLUSTERS = EDGES + """, reach(x, y) AS (SELECT DISTINCT x, x FROM sym UNION SELECT reach.x, sym.y FROM reach JOIN sym ON reach.y = sym.x),
comp AS (SELECT x AS id, min(y) AS rep FROM reach GROUP BY x)"""
ASSIGNED = CLUSTERS + """, best AS (SELECT x AS id, y AS partner, p, row_number() OVER (PARTITION BY x ORDER BY p, a, y) AS r FROM sym),
assigned AS (SELECT i.id, coalesce(c.rep, i.id) AS rep, CASE WHEN coalesce(c.rep, i.id) = i.id THEN i.id ELSE b.partner END AS matched,
 CASE WHEN coalesce(c.rep, i.id) = i.id THEN 'REPRESENTATIVE' ELSE ['SOURCE_IDENTITY', 'CANONICAL_URL', 'NORMALIZED_HASH'][b.p + 1] END AS kind
 FROM items i LEFT JOIN comp c ON c.id = i.id LEFT JOIN best b ON b.id = i.id AND b.r = 1)"""
RECS = """recs AS (SELECT *, CASE WHEN total_score >= 85 THEN 'CRITICAL' WHEN total_score >= 70 THEN 'HIGH' WHEN total_score >= 55 THEN 'MEDIUM' WHEN total_score >= 40 THEN 'LOW' ELSE 'IGNORE' END AS band FROM (
 SELECT o_orderkey AS id, o_orderkey % 997 AS signal_id, o_custkey AS user_id, o_orderkey % 2 + 1 AS revision, (CAST(round(o_totalprice * 100) AS BIGINT) % 10001) / 100.0 AS total_score, o_orderdate AS created_at,
 o_orderpriority AS category, CASE o_orderstatus WHEN 'F' THEN 'CANDIDATE' WHEN 'O' THEN 'ACTIVE' ELSE 'ARCHIVED' END AS status FROM orders))"""
FEEDBACK = """events_f AS (SELECT event_id AS id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS rec, CASE event_type WHEN 'click' THEN 'USEFUL' WHEN 'error' THEN 'NOT_USEFUL' WHEN 'view' THEN 'ALREADY_KNOWN' WHEN 'signup' THEN 'SAVED' ELSE 'ACTED' END AS action,
 CASE WHEN event_id % 3 <> 0 THEN event_id END AS delivery_id, ts FROM events),
f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, rec, action ORDER BY ts, id) AS r FROM events_f) WHERE r = 1),
f2 AS (SELECT *, action IN ('USEFUL', 'NOT_USEFUL') AS mood, row_number() OVER (PARTITION BY user_id, rec, action IN ('USEFUL', 'NOT_USEFUL') ORDER BY ts, id) AS k FROM f1),
feedback AS (SELECT * FROM f2 WHERE NOT (mood AND k > 1)),
dl AS (SELECT event_id AS id, user_id + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS rec, 'k' || (event_id % 4000) AS key,
 CASE event_id % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'SENT' WHEN 2 THEN 'FAILED' ELSE 'SENT' END AS status, ts, CASE WHEN event_id % 2 = 0 THEN 'NEW' ELSE 'SAVED' END AS kind, event_id % 9 = 0 AS reused FROM events)"""
GOLD = r"""gold AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 < 2 THEN 'CALIBRATION' ELSE 'HOLDOUT' END AS split, 'u' || (doc_id % 390) AS url, text, source AS source_id, CASE WHEN doc_id % 2 = 0 THEN 'CONSTRUCTION' ELSE 'HORECA' END AS vertical,
 quality = 1 AS relevant, CASE WHEN quality = 1 OR toxic = 1 THEN 'CONTACT' ELSE 'IGNORE' END AS action, CASE WHEN quality = 1 THEN 30 + doc_id % 60 ELSE 20 END AS importance, regexp_extract(text, '^[^.\n]*') AS quote FROM labels JOIN documents USING (doc_id)),
judged AS (SELECT id, split, relevant, CASE WHEN id % 23 = 0 THEN 'MISSING' WHEN id % 17 = 0 THEN 'FAILED_ANALYSIS' WHEN id % 19 = 0 THEN 'THROWN' WHEN id % 13 = 0 THEN 'INVALID_ANALYSIS' ELSE 'SUCCEEDED' END AS validity,
 CASE WHEN id % 23 = 0 THEN 'AI_INTERNAL_ERROR' WHEN id % 17 = 0 OR id % 19 = 0 THEN CASE WHEN id % 4 = 3 THEN 'AI_INTERNAL_ERROR' ELSE 'E' || (id % 2) END WHEN id % 13 = 0 THEN 'AI_INVALID_RESPONSE' END AS code, length(text) % 3 = 0 AS said_no, text, quote FROM gold)"""

# ---------------------------------------------------------------- ingestion

@query("collection_permitted", f"WITH {SOURCES} SELECT source_id, rights <> 'REVIEW_REQUIRED' AS permitted FROM sources")
def _(v):
    return v.sources.select("source_id", ingest.collection_permitted(F.col("enabled"), F.col("rights"), F.col("type")).alias("permitted"))


@query("ai_permitted", f"WITH {SOURCES} SELECT source_id, ai AND rights = 'OPEN_DATA' AS permitted FROM sources")
def _(v):
    return v.sources.select("source_id", ingest.ai_permitted(F.col("enabled"), F.col("ai_allowed"), F.col("rights")).alias("permitted"))


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def _(v):
    return v.table("documents").select("doc_id", ingest.content_hash(F.col("text")).alias("content_hash"))


@query("resolve_raw_identity", f"WITH {RAW} SELECT id AS raw_item_id, CASE WHEN row_number() OVER (PARTITION BY source_id, h ORDER BY id) = 1 THEN 'CREATED' ELSE 'EXISTING_CONTENT_HASH' END AS outcome FROM raw")
def _(v):
    return ingest.resolve_raw_identity(v.raw).select("raw_item_id", "outcome")


@query("raw_identity_conflicts", "SELECT doc_id AS raw_item_id FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 7 = 0")
def _(v):
    changed = v.raw.withColumn("content_hash", F.when(F.col("raw_item_id") % 7 == 0, F.sha2("content_hash", 256)).otherwise(F.col("content_hash")))
    return ingest.raw_identity_conflicts(changed, v.raw).select("raw_item_id")


@query("ingestion_summary", f"""WITH {SOURCES}, {RAW}, o AS (SELECT source_id, row_number() OVER (PARTITION BY source_id, h ORDER BY id) = 1 AS new FROM raw)
SELECT source_id, count(*) AS candidates, count(*) FILTER (new) AS created, count(*) FILTER (NOT new) AS existing, count(*) FILTER (new AND ai AND rights = 'OPEN_DATA') AS ai_permitted_created FROM o JOIN sources USING (source_id) GROUP BY source_id""")
def _(v):
    return ingest.ingestion_summary(ingest.resolve_raw_identity(v.raw), v.sources)


@query("deterministic_uuid", """WITH h AS (SELECT doc_id, sha256('["ns","raw","' || doc_id || '"]') AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h""")
def _(v):
    return v.table("documents").select("doc_id", expr.deterministic_uuid("ns", "raw", F.col("doc_id")).alias("uuid"))


@query("canonical_timestamp", "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS rfc, CAST(epoch(o_orderdate) AS BIGINT) AS iso, NULL::BIGINT AS bad FROM orders")
def _(v):
    seconds = lambda c: F.unix_timestamp(readers.canonical_timestamp(c))
    day = F.date_format("o_orderdate", "E")
    return v.table("orders").select(
        "o_orderkey", seconds(F.concat(day, F.lit(", "), F.date_format("o_orderdate", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).alias("rfc"),
        seconds(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("iso"), seconds(F.concat(F.lit("no date "), F.col("o_orderkey").cast("string"))).alias("bad"),
    )


@query("source_ref_check", f"""WITH {SOURCES} SELECT doc_id AS raw_item_id, CASE WHEN s.source_id IS NULL THEN 'UNKNOWN_SOURCE' ELSE 'UNDECLARED_VERTICAL' END AS problem
FROM documents d LEFT JOIN sources s ON s.source_id = CASE WHEN doc_id % 100 = 0 THEN 'none' ELSE d.source END
WHERE s.source_id IS NULL OR s.vertical <> CASE WHEN doc_id % 2 = 0 THEN 'HORECA' ELSE 'OTHER' END""")
def _(v):
    items = v.raw.withColumns({"source_id": F.when(F.col("raw_item_id") % 100 == 0, "none").otherwise(F.col("source_id")), "vertical": F.when(F.col("raw_item_id") % 2 == 0, "HORECA").otherwise("OTHER")})
    return ingest.source_ref_check(items, v.sources).select("raw_item_id", "problem")


@query("append_new", "SELECT 0 AS pass, count(DISTINCT sha256(text)) AS created, count(*) - count(DISTINCT sha256(text)) AS existing FROM documents UNION ALL SELECT 1, 0, count(*) FROM documents")
def _(v):
    from leadloom.plans.lineage import new_table

    rows, path = v.table("documents").select("doc_id", F.sha2("text", 256).alias("h")), new_table(v.spark, "append_new")
    done = [sinks.append_new(rows, path, ["h"]) for _ in range(2)]
    return v.spark.createDataFrame([(i, d["created"], d["existing"]) for i, d in enumerate(done)], "pass int, created long, existing long")


@query("identity_conflicts", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 = 0 THEN 'source,n_chars' WHEN doc_id % 3 = 0 THEN 'source' ELSE 'n_chars' END AS differs FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def _(v):
    docs = v.table("documents").select("doc_id", "source", "n_chars")
    other = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "none").otherwise(F.col("source")).alias("source"), (F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("n_chars"))
    out = sinks.identity_conflicts(other, docs, ["doc_id"], ["source", "n_chars"])
    return out.select("doc_id", F.array_join("differs", ",").alias("differs"))


@query("upsert_sources", "SELECT s_suppkey AS id, s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' new' ELSE '' END AS name, TIMESTAMP '2026-01-01' AS created_at FROM supplier")
def _(v):
    at = lambda d: F.lit(d).cast("timestamp")
    old = v.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), at("2026-01-01").alias("created_at"), at("2026-01-01").alias("updated_at"))
    new = old.filter("id % 2 = 0").select("id", F.concat("name", F.lit(" new")).alias("name"), at("2026-02-01").alias("created_at"), at("2026-02-01").alias("updated_at"))
    return sinks.upsert_sources(old, new).select("id", "name", "created_at")


# ---------------------------------------------------------------- normalisation

_TAGS = "|".join(text.BLOCK_TAGS)
_STRIP = "html"
for _p in (r"(?s)<!--.*?-->", *[rf"(?is)<{t}\b[^>]*>.*?</{t}>" for t in ("script", "style", "noscript", "template", "head")], rf"(?i)</?(?:{_TAGS})\b[^>]*>"):
    _STRIP = f"regexp_replace({_STRIP}, '{_p}', chr(10), 'g')"


@query("strip_markup", f"SELECT page_id, md5(regexp_replace({_STRIP}, '<[^>]+>', ' ', 'g')) AS digest FROM pages")
def _(v):
    return v.table("pages").select("page_id", F.md5(text.strip_markup(F.col("html"))).alias("digest"))


def _sql_decode(x: str) -> str:
    """One pass: the ampersand itself comes last."""
    for name, char in text.NAMED_ENTITIES.items():
        if name != "amp":
            x = f"replace({x}, '&{name};', chr({ord(char)}))"
    return f"replace({x}, '&amp;', '&')"


@query("decode_entities", f"SELECT page_id, md5({_sql_decode('html')}) AS digest FROM pages")
def _(v):
    return v.table("pages").select("page_id", F.md5(text.decode_entities("html")).alias("digest"))


def _sql_lines(source: str, key: str) -> str:
    """tidy: key, text with its lines tidied. From a relation with key and text. Blank lines are counted, so that one stays where some were."""
    return f"""l0 AS (SELECT {key}, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {source}),
l1 AS (SELECT {key}, i, trim(regexp_replace(x, '[ \t\f\v]+', ' ', 'g')) AS x FROM l0), l2 AS (SELECT *, count(*) FILTER (x = '') OVER (PARTITION BY {key} ORDER BY i) AS blanks FROM l1),
l3 AS (SELECT *, lag(lower(x)) OVER (PARTITION BY {key} ORDER BY i) AS p FROM l2 WHERE x <> ''), l4 AS (SELECT *, lag(blanks) OVER (PARTITION BY {key} ORDER BY i) AS b FROM l3 WHERE p IS NULL OR p <> lower(x)),
tidy AS (SELECT {key}, string_agg(CASE WHEN b IS NULL THEN '' WHEN blanks > b THEN chr(10) || chr(10) ELSE chr(10) END || x, '' ORDER BY i) AS text FROM l4 GROUP BY {key})"""


@query("normalize_lines", f"WITH {_sql_lines('documents', 'doc_id')} SELECT doc_id, md5(coalesce(tidy.text, '')) AS digest FROM documents LEFT JOIN tidy USING (doc_id)")
def _(v):
    return v.table("documents").select("doc_id", F.md5(text.normalize_lines("text")).alias("digest"))


_SQL_TITLE = rf"nullif(left(trim(regexp_replace({_sql_decode("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '\s+', ' ', 'g')), 1000), '')"
_SQL_URL = r"regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '\?utm_[^&]*$', ''), '([^/])/+$', '\1')"


@query("normalize_items", f"""WITH plain AS (SELECT page_id, {_sql_decode(f"regexp_replace({_STRIP}, '<[^>]+>', ' ', 'g')")} AS text FROM pages), {_sql_lines('plain', 'page_id')}
SELECT page_id AS raw_item_id, CASE WHEN tidy.text IS NULL THEN 'REJECTED' ELSE 'SUCCEEDED' END AS status, {_SQL_TITLE} AS title, coalesce(tidy.text, '') AS text, CASE WHEN tidy.text IS NULL THEN NULL WHEN regexp_matches(tidy.text, '\\p{{Latin}}') THEN 'en' ELSE 'und' END AS language,
 sha256(tidy.text) AS normalized_hash, {_SQL_URL} AS canonical_url FROM pages LEFT JOIN tidy USING (page_id)""")
def _(v):
    raw = v.table("pages").select(F.col("page_id").alias("raw_item_id"), F.col("html").alias("raw_text"), F.lit(None).cast("string").alias("raw_payload"), F.col("url").alias("original_url"))
    return text.canonicalize_urls(text.normalize_items(raw), "original_url", "canonical_url").select("raw_item_id", "status", "title", "text", "language", "normalized_hash", "canonical_url")


@query("extract_title", f"SELECT page_id, {_SQL_TITLE} AS title FROM pages")
def _(v):
    return v.table("pages").select("page_id", text.extract_title(F.lit(None).cast("string"), F.col("html")).alias("title"))


@query("canonicalize_url", f"SELECT page_id, {_SQL_URL} AS canonical_url FROM pages")
def _(v):
    return text.canonicalize_urls(v.table("pages").select("page_id", "url"), "url", "canonical_url").select("page_id", "canonical_url")


@query("normalized_hash", f"WITH {_sql_lines('documents', 'doc_id')} SELECT doc_id AS raw_item_id, sha256(tidy.text) AS normalized_hash FROM documents LEFT JOIN tidy USING (doc_id)")
def _(v):
    return text.normalize_items(v.raw).select("raw_item_id", "normalized_hash")


def _cyrillic(v: Views) -> DataFrame:
    """Documents, some with Cyrillic words or lines that are boilerplate, some with none but them."""
    i, t = F.col("doc_id"), F.col("text")
    extra = F.when(i % 4 == 1, F.concat(t, F.lit("\nПоделиться\n"))).when(i % 4 == 2, F.concat(F.lit("Мы используем файлы cookie, да\n"), t)).when(i % 20 == 3, F.lit("Тендер на строительство школы")).when(i % 20 == 7, F.lit(" поделиться \n")).otherwise(t)
    return v.table("documents").withColumn("text", extra)


_CYRILLIC = "cyr AS (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN text || chr(10) || 'Поделиться' || chr(10) WHEN doc_id % 4 = 2 THEN 'Мы используем файлы cookie, да' || chr(10) || text WHEN doc_id % 20 = 3 THEN 'Тендер на строительство школы' WHEN doc_id % 20 = 7 THEN ' поделиться ' || chr(10) ELSE text END AS text FROM documents)"


@query("boilerplate_lines", f"""WITH {_CYRILLIC} SELECT line, count(*) AS n, line = 'поделиться' OR starts_with(line, 'мы используем файлы cookie') AS boilerplate FROM (SELECT trim(lower(unnest(string_split(text, chr(10))))) AS line FROM cyr) WHERE line <> '' GROUP BY line""")
def _(v):
    return text.boilerplate_lines(_cyrillic(v))


@query("detect_language", rf"WITH {_CYRILLIC}, n AS (SELECT doc_id, len(regexp_extract_all(text, '\p{{Cyrillic}}')) AS c, len(regexp_extract_all(text, '\p{{Latin}}')) AS l FROM cyr) SELECT doc_id, CASE WHEN c = 0 AND l = 0 THEN 'und' WHEN c >= l THEN 'ru' ELSE 'en' END AS language FROM n")
def _(v):
    return _cyrillic(v).select("doc_id", text.detect_language(F.col("text")).alias("language"))


@query("normalization_summary", f"WITH {_CYRILLIC} SELECT count(*) AS attempts, count(*) FILTER (doc_id % 20 <> 7) AS succeeded, count(*) FILTER (doc_id % 20 = 7) AS rejected, count(*) FILTER (doc_id % 2 = 1) AS created, count(*) FILTER (doc_id % 2 = 0) AS existing FROM cyr")
def _(v):
    raw = v.raw.drop("raw_text").join(_cyrillic(v).select(F.col("doc_id").alias("raw_item_id"), F.col("text").alias("raw_text")), "raw_item_id")
    return text.normalization_summary(text.normalize_items(raw), v.raw.filter("raw_item_id % 2 = 0").select("raw_item_id", F.lit(text.NORMALIZER_VERSION).alias("normalizer_version")))


@query("check_outcomes", "SELECT doc_id AS raw_item_id FROM documents WHERE doc_id % 40 = 0")
def _(v):
    ids = v.raw.select("raw_item_id", F.lit("normalizer-v1").alias("normalizer_version"))
    return text.check_outcomes(ids, ids.filter("raw_item_id % 40 <> 0")).select("raw_item_id")


# ---------------------------------------------------------------- duplicates

_KIND = "['SOURCE_IDENTITY', 'CANONICAL_URL', 'NORMALIZED_HASH'][p + 1] AS kind"


@query("dedup_candidates", f"WITH {SOURCES} SELECT doc_id AS id, source AS source_id, vertical FROM documents JOIN sources ON source_id = source")
def _(v):
    return dedup.dedup_candidates(v.raw.select("raw_item_id"), v.raw, v.sources).select(F.col("raw_item_id").alias("id"), "source_id", F.col("verticals")[0].alias("vertical"))


@query("observed_order", "SELECT source AS source_id, arg_min(doc_id, CASE WHEN doc_id % 4 = 0 THEN doc_id - 3000 ELSE doc_id END * 1000000 + doc_id) AS first_id FROM documents GROUP BY source")
def _(v):
    moved = F.when(F.col("id") % 4 == 0, F.timestamp_seconds(F.unix_seconds("observed_at") - 1800000))
    rows = v.items.withColumn("at", dedup.observed_at(moved, F.col("observed_at")))
    return rows.groupBy("source_id").agg(F.min(F.struct("at", "id")).alias("m")).select("source_id", F.col("m.id").alias("first_id"))


@query("exact_edges", f"WITH {EDGES} SELECT a, b, {_KIND} FROM edges")
def _(v):
    return dedup.exact_edges(v.items)


_GRAMS = r"""g0 AS (SELECT doc_id, md5(text) AS h, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents),
g1 AS (SELECT DISTINCT doc_id, h, array_to_string(t[i:i + 2], ' ') AS g FROM (SELECT doc_id, h, t, unnest(generate_series(1, greatest(len(t) - 2, 1))) AS i FROM g0 WHERE len(t) > 0))"""


@query("token_ngrams", f"WITH {_GRAMS} SELECT d.doc_id, count(g) AS n FROM documents d LEFT JOIN g1 USING (doc_id) GROUP BY d.doc_id")
def _(v):
    return v.table("documents").select("doc_id", F.size(dedup.token_ngrams(F.col("text"))).cast("long").alias("n"))


_PAIRS = f"""{_GRAMS}, g2 AS (SELECT DISTINCT h, g FROM g1), m AS (SELECT h, count(*) AS m FROM g2 GROUP BY h),
two AS (SELECT a.h AS x, b.h AS y, count(*) AS c FROM g2 a JOIN g2 b ON a.g = b.g AND a.h < b.h GROUP BY a.h, b.h),
near AS (SELECT x, y, c / least(p.m, q.m) AS similarity FROM two JOIN m p ON p.h = x JOIN m q ON q.h = y WHERE c / least(p.m, q.m) >= 0.95)"""


@query("near_text_similarity", f"WITH {_PAIRS} SELECT x AS key_a, y AS key_b, similarity FROM near")
def _(v):
    texts = v.table("documents").groupBy(F.md5("text").alias("key")).agg(F.first("text").alias("text"))
    return dedup.near_text_pairs(texts).select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"), "similarity")


@query("near_text_similarity_half", f"WITH {_PAIRS.replace('0.95', '0.5')} SELECT x AS key_a, y AS key_b, similarity FROM near")
def _(v):
    texts = v.table("documents").groupBy(F.md5("text").alias("key")).agg(F.first("text").alias("text"))
    return dedup.near_text_pairs(texts, 0.5).select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"), "similarity")


@query("near_edges", f"""WITH {SOURCES}, {_PAIRS}, it AS (SELECT doc_id AS id, md5(text) AS h, vertical FROM documents JOIN sources ON source_id = source),
sym AS (SELECT x, y, similarity FROM near UNION ALL SELECT y, x, similarity FROM near),
met AS (SELECT a.id, b.h, min(b.id) AS other, min(similarity) AS similarity FROM it a JOIN sym ON a.h = x JOIN it b ON b.h = y AND a.vertical = b.vertical AND abs(a.id - b.id) <= 1008 GROUP BY a.id, b.h)
SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b, similarity FROM met""")
def _(v):
    return dedup.near_edges(v.items)


@query("pairs_in_window", f"WITH {SOURCES}, it AS (SELECT doc_id AS id, vertical FROM documents JOIN sources ON source_id = source) SELECT a.vertical, count(*) AS pairs FROM it a JOIN it b ON a.vertical = b.vertical AND a.id < b.id AND b.id - a.id <= 144 GROUP BY a.vertical")
def _(v):
    return dedup.pairs_in_window(v.items.withColumn("vertical", F.col("verticals")[0]), window_hours=24)


@query("duplicate_clusters", f"WITH RECURSIVE {CLUSTERS} SELECT id AS node, rep AS component FROM comp")
def _(v):
    return dedup.duplicate_clusters(dedup.exact_edges(v.items))


@query("cluster_representatives", f"WITH RECURSIVE {CLUSTERS} SELECT rep AS component, rep AS representative_id FROM comp GROUP BY rep")
def _(v):
    return dedup.cluster_representatives(v.items, dedup.duplicate_clusters(dedup.exact_edges(v.items)))


@query("best_edge", f"WITH {EDGES}, b AS (SELECT x AS id, y AS matched_to_id, p, row_number() OVER (PARTITION BY x ORDER BY p, a, y) AS r FROM sym) SELECT id, matched_to_id, ['SOURCE_IDENTITY', 'CANONICAL_URL', 'NORMALIZED_HASH'][p + 1] AS match_kind FROM b WHERE r = 1")
def _(v):
    return dedup.best_edge(dedup.exact_edges(v.items).withColumn("similarity", F.lit(1.0)), v.items).drop("similarity")


@query("dedup_assignments", f"WITH RECURSIVE {ASSIGNED} SELECT id, rep AS representative_id, matched AS matched_to_id, kind AS match_kind, CASE WHEN kind = 'REPRESENTATIVE' THEN 0.0 ELSE abs(id - matched) / 6.0 END::DOUBLE AS time_distance_hours FROM assigned")
def _(v):
    return dedup.dedup_assignments(v.items, near=False).drop("similarity")


NEAR = SOURCES + ", " + _PAIRS + """, it AS (SELECT doc_id AS id, md5(text) AS h, vertical FROM documents JOIN sources ON source_id = source),
nsym AS (SELECT x, y, similarity FROM near UNION ALL SELECT y, x, similarity FROM near),
met AS (SELECT a.id, b.h, min(b.id) AS other, min(similarity) AS similarity FROM it a JOIN nsym ON a.h = x JOIN it b ON b.h = y AND a.vertical = b.vertical AND abs(a.id - b.id) <= 1008 GROUP BY a.id, b.h),
close AS (SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b, similarity FROM met),
every AS (SELECT a, b, p, 1.0::DOUBLE AS s FROM edges UNION ALL SELECT a, b, 3, similarity FROM close ANTI JOIN edges USING (a, b)),
both_ways AS (SELECT a AS x, b AS y, a, p, s FROM every UNION ALL SELECT b, a, a, p, s FROM every),
reached(x, y) AS (SELECT DISTINCT x, x FROM both_ways UNION SELECT reached.x, both_ways.y FROM reached JOIN both_ways ON reached.y = both_ways.x), heads AS (SELECT x AS id, min(y) AS rep FROM reached GROUP BY x),
ranked AS (SELECT x AS id, y AS partner, p, s, row_number() OVER (PARTITION BY x ORDER BY p, s DESC, a, y) AS r FROM both_ways),
placed AS (SELECT i.id, coalesce(c.rep, i.id) AS rep, CASE WHEN coalesce(c.rep, i.id) = i.id THEN i.id ELSE r.partner END AS matched, CASE WHEN coalesce(c.rep, i.id) = i.id THEN 'REPRESENTATIVE' ELSE ['SOURCE_IDENTITY', 'CANONICAL_URL', 'NORMALIZED_HASH', 'NEAR_TEXT'][r.p + 1] END AS kind,
 CASE WHEN coalesce(c.rep, i.id) = i.id THEN 1.0 ELSE r.s END::DOUBLE AS similarity FROM items i LEFT JOIN heads c ON c.id = i.id LEFT JOIN ranked r ON r.id = i.id AND r.r = 1)"""


@query("dedup_assignments_near", f"WITH RECURSIVE {EDGES}, {NEAR} SELECT id, rep AS representative_id, matched AS matched_to_id, kind AS match_kind, similarity, CASE WHEN kind = 'REPRESENTATIVE' THEN 0.0 ELSE abs(id - matched) / 6.0 END::DOUBLE AS time_distance_hours FROM placed")
def _(v):
    return dedup.dedup_assignments(v.items)


@query("dedup_increment", ORACLE["dedup_assignments_near"])
def _(v):
    """Two batches: what the second changes, beside what the first has made."""
    items = v.items
    late = F.col("id") % 3 == 1
    first = cut(dedup.dedup_assignments(items.filter(~late)))
    changed = cut(dedup.dedup_increment(items.filter(late), items.filter(~late), first))
    return first.join(changed, "id", "left_anti").unionByName(changed)


@query("dedup_metrics", f"WITH RECURSIVE {EDGES}, {NEAR} SELECT count(*) AS input_items, count(*) FILTER (kind = 'REPRESENTATIVE') AS clusters, count(*) FILTER (kind <> 'REPRESENTATIVE') AS duplicates, count(*) FILTER (kind NOT IN ('REPRESENTATIVE', 'NEAR_TEXT')) AS exact_duplicates, count(*) FILTER (kind = 'NEAR_TEXT') AS near_duplicates FROM placed")
def _(v):
    return dedup.dedup_metrics(dedup.dedup_assignments(v.items))


@query("check_dedup_coverage", "SELECT 'MISSING_ASSIGNMENT' AS problem, doc_id AS id FROM documents WHERE doc_id % 90 = 0 UNION ALL SELECT 'OUTSIDE_REFERENCE', -1 UNION ALL SELECT 'REPEATED_ASSIGNMENT', doc_id FROM documents WHERE doc_id % 91 = 1 UNION ALL SELECT 'UNKNOWN_ITEM', doc_id FROM documents WHERE doc_id % 91 = 1")
def _(v):
    """Two batches of assignments: one without some items and with a reference outside, one with some items twice. In a single one an id that is due for both would be neither."""
    items = v.items.select("id", "verticals")
    given = items.select("id", F.col("id").alias("matched_to_id"), F.col("id").alias("representative_id"))
    lacking = given.filter("id % 90 <> 0").withColumn("representative_id", F.when(F.col("id") == 5, -1).otherwise(F.col("id")))
    repeated = given.unionByName(given.filter("id % 91 = 1"))
    return dedup.check_dedup_coverage(items, lacking).unionByName(dedup.check_dedup_coverage(items, repeated))


# ---------------------------------------------------------------- classification

def _sql_rules(group: str, rules: list[Rule] = LATIN_RULES) -> str:
    plain = lambda p: p.replace("(?<![A-Za-z0-9_])", "(?:^|[^A-Za-z0-9_])").replace("(?![A-Za-z0-9_])", "(?:$|[^A-Za-z0-9_])")  # noqa: E731  no lookaround in DuckDB
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{plain(r.pattern)}', 'i') THEN '{r.id}' END" for r in rules if r.group == group) + "], lambda x: x IS NOT NULL)"


DECIDED = SOURCES + ", c0 AS (SELECT doc_id AS id, vertical AS sv, ai AND rights = 'OPEN_DATA' AS ai, " + ", ".join(f"{_sql_rules(g)} AS {g}" for g in ("construction", "horeca", "opportunity", "advertisement", "irrelevance")) + """ FROM documents JOIN sources ON source_id = source),
c1 AS (SELECT *, len(construction) * 2 + CASE WHEN sv = 'CONSTRUCTION' THEN 1 ELSE 0 END AS cs, len(horeca) * 2 + CASE WHEN sv = 'HORECA' THEN 1 ELSE 0 END AS hs FROM c0),
c2 AS (SELECT *, CASE WHEN cs = hs THEN 'OTHER' WHEN cs > hs THEN 'CONSTRUCTION' ELSE 'HORECA' END AS v,
 CASE WHEN NOT ai THEN 0 WHEN len(advertisement) >= 2 OR list_contains(advertisement, 'advertisement.explicit') THEN 1 WHEN len(irrelevance) > 0 THEN 2 WHEN cs = hs THEN 3 WHEN len(opportunity) = 0 THEN 4 ELSE 5 END AS k FROM c1),
c3 AS (SELECT *, CASE WHEN k = 0 THEN NULL WHEN k = 2 THEN 'OTHER' ELSE v END AS vertical,
 CASE WHEN k = 0 THEN 100 WHEN k = 2 AND v <> 'OTHER' THEN 95 WHEN v = 'OTHER' THEN CASE WHEN cs = 0 AND hs = 0 AND sv = 'OTHER' THEN 95 ELSE 40 END ELSE least(100, 60 + abs(cs - hs) * 5 + CASE WHEN sv = v THEN 10 ELSE 0 END) END AS confidence,
 CASE WHEN k = 5 THEN least(100, 50 + least(25, 10 * len(opportunity)) + least(15, 5 * CASE WHEN v = 'CONSTRUCTION' THEN len(construction) ELSE len(horeca) END) + CASE WHEN sv = v THEN 10 ELSE 0 END) ELSE 0 END AS relevance FROM c2),
decided AS (SELECT *, CASE k WHEN 0 THEN 'PERMISSION_DENIED' WHEN 5 THEN 'AI_ELIGIBLE' ELSE 'IRRELEVANT' END AS outcome,
 ['NO_AI_PERMITTED_EVIDENCE', 'ADVERTISEMENT', 'EXPLICITLY_IRRELEVANT', 'UNSUPPORTED_OR_AMBIGUOUS_VERTICAL', 'NO_OPPORTUNITY_CUE', 'RELEVANT_OPPORTUNITY'][k + 1] AS reason_code,
 CASE WHEN vertical = 'CONSTRUCTION' THEN CASE WHEN list_has_any(opportunity, ['opportunity.applications', 'opportunity.contractor', 'opportunity.procurement', 'opportunity.tender']) THEN 'CONSTRUCTION_TENDER' ELSE 'CONSTRUCTION_PROJECT' END
  WHEN vertical = 'HORECA' THEN CASE WHEN list_has_any(opportunity, ['opportunity.procurement', 'opportunity.supplier-selection', 'opportunity.tender']) THEN 'HORECA_PROCUREMENT' ELSE 'HORECA_OPENING' END WHEN vertical = 'OTHER' THEN 'OTHER' END AS category FROM c3)"""


def _decided(v: Views, rules: list[Rule] = LATIN_RULES, text=lambda: F.col("text")) -> DataFrame:
    ai = ingest.ai_permitted(F.col("enabled"), F.col("ai_allowed"), F.col("rights"))
    clusters = v.items.select(F.col("id").alias("representative_id"), F.when(ai, F.col("id")).alias("selected_id"), F.lit(None).cast("string").alias("title"), text().alias("text"), "verticals")
    return classify.classify_clusters(clusters, rules)


#: Phrases for the rule tables themselves: each document ends with some of them.
PHRASES = [
    "Строительство школы", "строительно-монтажные работы", "РЕКОНСТРУКЦИЯ моста", "капитального  ремонта", "Подрядчик найден", "стройматериалы", "HoReCa", "horecas", "xhoreca", "ресторанов", "гостиница у моря", "отель", "посадочных мест", "гостеприимство", "тендер", "закупки", "приём заявок", "прием  заявок",
    "отбор поставщиков", "запланировано", "открытие", "откроется", "бюджетом", "Реклама", "антиреклама", "скидки", "акция", "оставьте заявку", "закажите консультацию", "закупка не заявлена", "информация общего назначения", "построен дом", "возведён", "введен в строй", "сдана", "ничего", "погода",
]
_STEPS = (1, 5, 11)


def _phrased():
    pick = lambda k: F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("id") * k % len(PHRASES) + 1).cast("int"))
    return F.concat_ws(" . ", "text", *[pick(k) for k in _STEPS])


def _sql_decided(rules: list[Rule]) -> str:
    """DECIDED over documents that end with phrases, by other rules."""
    phrases = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"
    said = "SELECT * REPLACE (" + " || ' . ' || ".join(["text", *[f"{phrases}[doc_id * {k} % {len(PHRASES)} + 1]" for k in _STEPS]]) + " AS text) FROM documents"
    sql = DECIDED.replace("FROM documents JOIN sources", f"FROM ({said}) JOIN sources")
    for group in ("construction", "horeca", "opportunity", "advertisement", "irrelevance"):
        sql = sql.replace(f"{_sql_rules(group)} AS {group}", f"{_sql_rules(group, rules)} AS {group}")
    return sql


for _name, _rules in (("classify_clusters_v1", RULES_V1), ("classify_clusters_v2", RULES_V2)):
    query(_name, f"WITH {_sql_decided(_rules)} SELECT id AS representative_id, outcome, reason_code, vertical, category, confidence AS classification_confidence, relevance AS relevance_score FROM decided")(
        lambda v, rules=_rules: _decided(v, rules, _phrased).select("representative_id", "outcome", "reason_code", "vertical", "category", "classification_confidence", "relevance_score")
    )


@query("cluster_evidence", f"WITH RECURSIVE {ASSIGNED} SELECT rep AS representative_id, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM assigned GROUP BY rep")
def _(v):
    out = classify.cluster_evidence(dedup.dedup_assignments(v.items, near=False), v.items)
    return out.select("representative_id", F.size("evidence").cast("long").alias("n"), F.array_join(F.transform("evidence", lambda e: e["id"].cast("string")), ",").alias("ids"))


@query("select_evidence", f"WITH RECURSIVE {SOURCES}, {ASSIGNED} SELECT rep AS representative_id, coalesce(min(a.id) FILTER (ai AND a.id = rep), min(a.id) FILTER (ai)) AS selected_id FROM assigned a JOIN raw ON raw.id = a.id JOIN sources s ON s.source_id = raw.source_id GROUP BY rep")
def _(v):
    members = dedup.dedup_assignments(v.items, near=False).select("id", "representative_id").join(v.items.select("id", "observed_at", F.col("ai_allowed").alias("ai")), "id")
    return classify.select_evidence(members)


@query("match_rules", f"SELECT doc_id, array_to_string({_sql_rules('opportunity')}, ',') AS rules FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.array_join(classify.match_rules(F.col("text"), [r for r in LATIN_RULES if r.group == "opportunity"]), ",").alias("rules"))


@query("vertical_scores", f"WITH {DECIDED} SELECT id AS representative_id, CASE WHEN k = 0 THEN 0 ELSE cs END AS construction_score, CASE WHEN k = 0 THEN 0 ELSE hs END AS horeca_score FROM decided")
def _(v):
    return _decided(v).select("representative_id", "construction_score", "horeca_score")


@query("classification_confidence", f"WITH {DECIDED} SELECT id AS representative_id, vertical, confidence AS classification_confidence FROM decided")
def _(v):
    return _decided(v).select("representative_id", "vertical", "classification_confidence")


@query("signal_category", f"WITH {DECIDED} SELECT id AS representative_id, category FROM decided")
def _(v):
    return _decided(v).select("representative_id", "category")


@query("relevance_score", f"WITH {DECIDED} SELECT id AS representative_id, relevance AS relevance_score FROM decided")
def _(v):
    return _decided(v).select("representative_id", "relevance_score")


@query("classify_clusters", f"""WITH {DECIDED} SELECT id AS representative_id, outcome, reason_code, vertical, category, confidence AS classification_confidence, relevance AS relevance_score,
 array_to_string(CASE WHEN k = 0 THEN ['permission.no-ai-permitted-evidence'] ELSE list_concat(list_concat(list_concat(['source.vertical.' || lower(sv)], construction), horeca),
 CASE k WHEN 1 THEN advertisement WHEN 2 THEN irrelevance WHEN 3 THEN ['vertical.unsupported-or-ambiguous'] WHEN 4 THEN ['relevance.no-opportunity-cue'] ELSE opportunity END) END, ',') AS rules FROM decided""")
def _(v):
    return _decided(v).select("representative_id", "outcome", "reason_code", "vertical", "category", "classification_confidence", "relevance_score", F.array_join("matched_rule_ids", ",").alias("rules"))


@query("signal_id", f"""WITH {DECIDED}, h AS (SELECT id, sha256('["' || id || '","deduplicator-v1","classifier-v1","taxonomy-v1"]') AS h FROM decided WHERE k = 5)
SELECT id AS representative_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS signal_id FROM h""")
def _(v):
    return _decided(v).filter("outcome = 'AI_ELIGIBLE'").select("representative_id", classify.signal_id(F.col("representative_id"), "classifier-v1").alias("signal_id"))


@query("build_signals", f"WITH {DECIDED} SELECT id AS representative_id, vertical, id AS evidence_id FROM decided WHERE k = 5")
def _(v):
    members = v.items.select(F.col("id").alias("representative_id"), "id", "source_id", F.col("ai_allowed").alias("ai"))
    signals, evidence = classify.build_signals(_decided(v), members)
    return signals.join(evidence.select("signal_id", F.col("id").alias("evidence_id")), "signal_id").select("representative_id", "vertical", "evidence_id")


@query("classification_metrics", f"""WITH {DECIDED} SELECT count(*) AS clusters, count(*) FILTER (k = 5) AS eligible, count(*) FILTER (k BETWEEN 1 AND 4) AS irrelevant, count(*) FILTER (k = 0) AS denied,
 count(*) FILTER (vertical = 'CONSTRUCTION') AS construction, count(*) FILTER (vertical = 'HORECA') AS horeca, count(*) FILTER (vertical = 'OTHER') AS other FROM decided""")
def _(v):
    return classify.classification_metrics(_decided(v))


@query("check_decisions", f"WITH {DECIDED} SELECT 'LEAKED_EVIDENCE' AS problem, id::VARCHAR AS key FROM decided WHERE k <> 5 UNION ALL SELECT 'NOT_PERMITTED', id::VARCHAR FROM decided WHERE NOT ai")
def _(v):
    members = v.items.select(F.col("id").alias("representative_id"), "id", F.col("ai_allowed").alias("ai"))
    return classify.check_decisions(_decided(v), v.items.select(F.col("id").alias("signal_id"), "id"), members)


# ---------------------------------------------------------------- analysis

@query("analysis_candidates", "SELECT o_orderkey AS signal_id FROM orders WHERE o_orderstatus IN ('F', 'O')")
def _(v):
    from leadloom.operators.analyze import analysis_candidates

    return analysis_candidates(v.signals, "classifier-v2").select("signal_id")


def _requests(v: Views) -> DataFrame:
    from leadloom.operators.analyze import analysis_requests

    lines = v.table("lineitem")
    evidence = lines.select(
        F.col("l_orderkey").alias("signal_id"), (F.col("l_orderkey") + F.when(F.col("l_partkey") % 97 == 0, 1).otherwise(0)).alias("of_signal"), F.col("l_linenumber").alias("id"), F.concat(F.lit("src"), (F.col("l_suppkey") % 20).cast("string")).alias("source_id"),
    )
    declared = lines.groupBy(F.col("l_orderkey").alias("signal_id")).agg(F.collect_set("l_linenumber").alias("declared"))
    return analysis_requests(v.signals.select("signal_id", "status").join(declared, "signal_id", "left"), evidence, v.sources)


@query("analysis_requests", """WITH e AS (SELECT l_orderkey AS s, count(*) AS n, count(DISTINCT (l_linenumber, l_suppkey % 20)) AS pairs, count(*) FILTER (l_partkey % 97 = 0) AS outside, count(*) FILTER (l_suppkey % 10 = 9) AS refused FROM lineitem GROUP BY 1)
SELECT o_orderkey AS signal_id, coalesce(n, 0) AS evidence_count, CASE WHEN o_orderstatus = 'P' THEN 'SIGNAL_NOT_ANALYZABLE' WHEN coalesce(n, 0) = 0 THEN 'NO_EVIDENCE' WHEN pairs < n THEN 'DUPLICATE_EVIDENCE' WHEN outside > 0 THEN 'EVIDENCE_OUTSIDE_SIGNAL' WHEN refused > 0 THEN 'AI_PROCESSING_NOT_PERMITTED' END AS error
FROM orders LEFT JOIN e ON s = o_orderkey""")
def _(v):
    return _requests(v).select("signal_id", "evidence_count", "error")


@query("skip_existing_analyses", "SELECT o_orderkey AS signal_id FROM orders WHERE o_orderkey % 3 <> 0")
def _(v):
    from leadloom.operators.analyze import ANALYSIS_IDENTITY, skip_existing_analyses

    rows = v.signals.select("signal_id", *[F.lit("x").alias(c) for c in ANALYSIS_IDENTITY[1:]])
    return skip_existing_analyses(rows, rows.filter("signal_id % 3 = 0")).select("signal_id")


def _template(v: Views) -> DataFrame:
    from leadloom.operators.analyze import template_analysis

    one = F.struct(F.col("id").cast("string").alias("id"), "source_id", F.lit(None).cast("string").alias("title"), "text", F.array(F.lit("Lang"), F.lit("lang"), F.col("source_id")).alias("entities"))
    rows = v.items.select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("analysis_id"), F.col("id").cast("string").alias("signal_id"), F.lit("C").alias("category"), F.lit("OTHER").alias("vertical"),
                          (F.col("id") % 101).alias("relevance_score"), (F.col("id") % 97).alias("classification_confidence"), F.array(one).alias("evidence"))
    return template_analysis(rows)


@query("template_analysis", r"""SELECT 'a' || doc_id AS analysis_id, floor((doc_id % 101 + doc_id % 97) / 2 + 0.5)::DOUBLE AS business_impact, (doc_id % 97)::DOUBLE AS urgency, (doc_id % 97) / 100 AS confidence,
 'fact-' || substr(sha256('["a' || doc_id || '","' || doc_id || '","' || source || '"]'), 1, 32) AS fact_id, 'Lang,' || source AS entities, md5(trim(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 4000))) AS statement FROM documents""")
def _(v):
    return _template(v).select("analysis_id", "business_impact", "urgency", "confidence", F.col("facts")[0]["id"].alias("fact_id"), F.array_join("entities", ",").alias("entities"), F.md5(F.col("facts")[0]["statement"]).alias("statement"))


_LONG = "x" * 4001
#: (field, JSON that takes its place, reason): one response for each rule. SID stands for the request's source.
_RESPONSES = [
    ("summary", '"ok"', None), ("deadline", '"2026-02-01T10:00:00Z"', None), ("inferences", "[]", None), ("entities", "[]", None), ("risks", "[]", None),
    ("headline", '" "', "SCHEMA"), ("headline", '"h "', "SCHEMA"), ("headline", "5", "SCHEMA"), ("headline", f'"{_LONG[:501]}"', "SCHEMA"), ("summary", f'"{_LONG}"', "SCHEMA"), ("whyImportant", "null", "SCHEMA"), ("eventType", f'"{_LONG[:201]}"', "SCHEMA"),
    ("promptVersion", f'"{_LONG[:101]}"', "SCHEMA"), ("analysisVersion", '""', "SCHEMA"), ("schemaVersion", '"ai-analysis/v2"', "SCHEMA"), ("status", '"FAILED"', "SCHEMA"), ("createdAt", '"yesterday"', "SCHEMA"), ("createdAt", '"2026-02-31T10:00:00Z"', "SCHEMA"), ("deadline", '"soon"', "SCHEMA"), ("deadline", "5", "SCHEMA"),
    ("confidence", "1.5", "SCHEMA"), ("confidence", '"0.5"', "SCHEMA"), ("businessImpact", "101", "SCHEMA"), ("urgency", "-1", "SCHEMA"), ("actionability", "null", "SCHEMA"), ("sourceIds", "[]", "SCHEMA"), ("facts", "[]", "SCHEMA"), ("entities", "[1]", "SCHEMA"), ("entities", '["x "]', "SCHEMA"), ("risks", f'["{_LONG[:2001]}"]', "SCHEMA"),
    ("risks", "[" + ", ".join(f'"r{i}"' for i in range(21)) + "]", "SCHEMA"), ("facts", '[{"id": "f1", "sourceIds": ["SID"], "statement": "s", "more": 1}]', "SCHEMA"), ("facts", '[{"id": "f1", "sourceIds": [], "statement": "s"}]', "SCHEMA"), ("facts", '[{"id": "f1", "sourceIds": ["SID"]}]', "SCHEMA"),
    ("inferences", '[{"id": "i1", "basisFactIds": [], "statement": "x"}]', "SCHEMA"), ("candidateActions", '[{"kind": "REVIEW", "priority": 1, "rationale": "r", "title": "one"}]', "SCHEMA"),
    *[("candidateActions", f'[{{"kind": "REVIEW", "priority": 1, "rationale": "r", "title": "one"}}, {{"kind": "{k}", "priority": {p}, "rationale": "{r}", "title": "{t}"}}]', "SCHEMA") for k, p, r, t in (("CALL", 2, "r", "two"), ("VERIFY", 6, "r", "two"), ("VERIFY", 2, _LONG[:2001], "two"), ("VERIFY", 2, "r", _LONG[:301]), ("VERIFY", 1.5, "r", "two"))],
    ("signalId", '"other"', "IDENTITY"), ("correlationId", '"other"', "IDENTITY"), ("provider", '"other"', "IDENTITY"), ("model", '"other"', "IDENTITY"), ("analysisId", '"other"', "IDENTITY"), ("sourceIds", '["none"]', "PROVENANCE"), ("sourceIds", '["SID", "none"]', "PROVENANCE"),
    ("sourceIds", '["SID", "SID"]', "DOMAIN"), ("facts", '[{"id": "f1", "sourceIds": ["SID", "SID"], "statement": "s"}]', "DOMAIN"), ("facts", '[{"id": "f1", "sourceIds": ["SID"], "statement": "s"}, {"id": "f1", "sourceIds": ["SID"], "statement": "t"}]', "DOMAIN"), ("facts", '[{"id": "f1", "sourceIds": ["elsewhere"], "statement": "s"}]', "DOMAIN"),
    ("inferences", '[{"id": "i1", "basisFactIds": ["f9"], "statement": "x"}]', "DOMAIN"), ("inferences", '[{"id": "i1", "basisFactIds": ["f1", "f1"], "statement": "x"}]', "DOMAIN"), ("inferences", '[{"id": "i1", "basisFactIds": ["f1"], "statement": "x"}, {"id": "i1", "basisFactIds": ["f1"], "statement": "y"}]', "DOMAIN"),
    ("entities", '["Риск", "риск"]', "DOMAIN"), ("risks", '["Риск", "риск"]', "DOMAIN"), ("candidateActions", '[{"kind": "REVIEW", "priority": 1, "rationale": "r", "title": "Один"}, {"kind": "VERIFY", "priority": 2, "rationale": "r", "title": "один"}]', "DOMAIN"), ("extra", "1", "SCHEMA"), ("urgency", None, "SCHEMA"),
]
_RESPONSE = {
    "analysisVersion": '"v1"', "correlationId": '"c"', "provider": '"p"', "model": '"m"', "promptVersion": '"v1"', "schemaVersion": '"ai-analysis/v1"', "status": '"SUCCEEDED"', "createdAt": '"2026-01-01T00:00:00.000Z"', "headline": '"h"', "summary": '"s"', "whyImportant": '"w"', "eventType": '"e"', "deadline": "null",
    "confidence": "0.5", "businessImpact": "50", "urgency": "50.5", "actionability": "75", "entities": '["x"]', "risks": '["r"]', "sourceIds": '["SID"]', "facts": '[{"id": "f1", "sourceIds": ["SID"], "statement": "A statement"}]', "inferences": '[{"id": "i1", "basisFactIds": ["f1"], "statement": "x"}]',
    "candidateActions": '[{"kind": "VERIFY", "priority": 1, "rationale": "r", "title": "one"}, {"kind": "REVIEW", "priority": 2, "rationale": "r", "title": "two"}]',
}


@query("validate_responses", "SELECT 'a' || doc_id AS analysis_id, [" + ", ".join(f"'{r}'" if r else "NULL" for _, _, r in _RESPONSES) + f"][doc_id % {len(_RESPONSES)} + 1] AS reason FROM documents")
def _(v):
    from leadloom.operators.analyze import validate_responses

    bodies = []
    for field, value, _ in _RESPONSES:
        fields = {"analysisId": '"AID"', "signalId": '"GID"', **_RESPONSE, field: value}
        bodies.append("{" + ", ".join(f'"{k}": {x}' for k, x in fields.items() if x is not None) + "}")
    t = v.table("documents").select(F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("analysis_id"), F.col("doc_id").cast("string").alias("signal_id"), "source", (F.col("doc_id") % len(bodies) + 1).cast("int").alias("n"))
    body = F.element_at(F.array(*[F.lit(b) for b in bodies]), F.col("n"))
    for name, column in (("SID", "source"), ("AID", "analysis_id"), ("GID", "signal_id")):
        body = F.replace(body, F.lit(name), F.col(column))
    requests = t.select("analysis_id", "signal_id", F.lit("c").alias("correlation_id"), F.lit("p").alias("provider"), F.lit("m").alias("model"), F.array(F.col("source"), F.lit("elsewhere")).alias("allowed_source_ids"))
    return validate_responses(t.select("analysis_id", body.alias("response")), requests).select("analysis_id", "reason")


@query("analyze_with", "SELECT 'a' || doc_id AS analysis_id, CASE WHEN length(text) > 20000 THEN 'AI_INPUT_TOO_LARGE' END AS failure_code, CASE WHEN length(text) <= 20000 THEN length(text)::VARCHAR END AS response FROM documents")
def _(v):
    from leadloom.operators.analyze import analyze_with

    rows = v.table("documents").select(F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("analysis_id"), F.col("text").alias("input"))
    return analyze_with(rows, lambda row: str(len(row["input"])), 20_000).select("analysis_id", "failure_code", "response")


@query("identity_drift", "SELECT doc_id AS analysis_id, 'FAILED' AS status, 'AI_INVALID_RESPONSE' AS reason FROM documents WHERE doc_id % 6 = 0")
def _(v):
    from leadloom.operators.analyze import identity_drift

    asked = v.table("documents").select(F.col("doc_id").alias("analysis_id"), "source", "lang")
    return identity_drift(asked.withColumn("source", F.when(F.col("analysis_id") % 6 == 0, "x").otherwise(F.col("source"))), asked, ["source", "lang"])


@query("analysis_summary", """SELECT count(*) AS candidates, count(*) FILTER (doc_id % 4 IN (0, 1)) AS created, count(*) FILTER (doc_id % 4 = 2) AS existing, count(*) FILTER (doc_id % 4 = 1) AS failed, count(*) FILTER (doc_id % 4 = 3) AS permission_rejected,
 count(*) FILTER (doc_id % 4 IN (0, 1)) AS provider_calls, count(*) FILTER (doc_id % 4 = 0) AS succeeded FROM documents""")
def _(v):
    from leadloom.operators.analyze import analysis_summary

    names = F.array(*[F.lit(x) for x in ("SUCCEEDED", "FAILED", "EXISTING", "REFUSED")])
    return analysis_summary(v.table("documents").select(F.element_at(names, (F.col("doc_id") % 4 + 1).cast("int")).alias("status")))


# ---------------------------------------------------------------- scoring

_R = lambda x, k=2: f"floor((({x}) + 2.220446049250313e-16) * 1e{k} + 0.5) / 1e{k}"
FACTORS = f"""f0 AS (SELECT o_orderkey AS id, (o_orderkey % 101)::DOUBLE AS a, (o_orderkey * 7 % 101)::DOUBLE AS i, ((CAST(round(o_totalprice * 100) AS BIGINT) % 10001) / 100.0)::DOUBLE AS f, (o_custkey % 101)::DOUBLE AS c, (o_custkey * 3 % 101)::DOUBLE AS r, (o_orderkey * 13 % 101)::DOUBLE AS u FROM orders),
f1 AS (SELECT *, least(c, r) AS e FROM f0),
f2 AS (SELECT *, {_R('a * 0.1', 4)} AS pa, {_R('i * 0.35', 4)} AS pi, {_R('f * 0.25', 4)} AS pf, {_R('e * 0.1', 4)} AS pe, {_R('c * 0.1', 4)} AS pc, {_R('u * 0.2', 4)} AS pu FROM f1),
f3 AS (SELECT *, {_R('0.0 + pa + pi + pf + pc + pu')} AS v1, {_R('0.0 + pa + pi + pf + pe + pu')} AS raw_total, CASE WHEN e < 40 THEN 54 WHEN e < 60 THEN 69 WHEN e < 80 THEN 84 ELSE 100 END AS top, CASE WHEN e < 40 THEN 'LOW' WHEN e < 60 THEN 'MEDIUM' WHEN e < 80 THEN 'HIGH' ELSE 'CRITICAL' END AS gb FROM f2),
f4 AS (SELECT *, {_R('least(raw_total, top)')} AS total FROM f3)"""
_BAND = lambda x: f"CASE WHEN {x} >= 85 THEN 'CRITICAL' WHEN {x} >= 70 THEN 'HIGH' WHEN {x} >= 55 THEN 'MEDIUM' WHEN {x} >= 40 THEN 'LOW' ELSE 'IGNORE' END"


def _factors(v: Views) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = lambda x: x.cast("double")
    return v.table("orders").select(
        k.alias("id"), d(k % 101).alias("actionability"), d(k * 7 % 101).alias("business_impact"), ((F.round(F.col("o_totalprice") * 100).cast("long") % 10001) / 100.0).alias("company_fit"), d(c % 101).alias("confidence"), d(c * 3 % 101).alias("reliability"), d(k * 13 % 101).alias("urgency"),
    )


@query("opportunity_score_v1", f"WITH {FACTORS} SELECT id, v1 AS total_score FROM f4")
def _(v):
    return _factors(v).select("id", scoring.opportunity_score_v1(*[F.col(x) for x in ("actionability", "business_impact", "company_fit", "confidence", "urgency")]).alias("total_score"))


@query("opportunity_band", f"WITH {FACTORS} SELECT id, {_BAND('v1')} AS band FROM f4")
def _(v):
    total = scoring.opportunity_score_v1(*[F.col(x) for x in ("actionability", "business_impact", "company_fit", "confidence", "urgency")])
    return _factors(v).select("id", scoring.opportunity_band(total).alias("band"))


@query("confidence_guardrail_v2", f"WITH {FACTORS} SELECT id, e AS effective_confidence, gb AS guardrail_band, raw_total, total AS total_score, {_BAND('total')} AS band, total < raw_total AS guardrail_applied FROM f4")
def _(v):
    return scoring.with_opportunity_score_v2(_factors(v)).select("id", "effective_confidence", "guardrail_band", "raw_total", "total_score", "band", "guardrail_applied")


_F2 = lambda x: f"printf('%.2f', ({x})::DOUBLE + CASE WHEN ({x})::DOUBLE * 8 = floor(({x})::DOUBLE * 8) THEN 0.001 ELSE 0 END)"  # noqa: E731  exact ties go up


@query("score_explanation", f"""WITH {FACTORS} SELECT id, md5('Opportunity Score ' || {_F2('total')} || ' (' || {_BAND('total')} || '); rawWeightedScore ' || {_F2('raw_total')} || '; businessImpact ' || {_F2('i')} || '×35%=' || {_F2('pi')} || '; companyFit ' || {_F2('f')} || '×25%=' || {_F2('pf')} || '; urgency ' || {_F2('u')} || '×20%=' || {_F2('pu')}
 || '; effectiveConfidence min(analysisConfidence ' || {_F2('c')} || ', evidenceReliability ' || {_F2('r')} || ')=' || {_F2('e')} || '×10%=' || {_F2('pe')} || '; actionability ' || {_F2('a')} || '×10%=' || {_F2('pa')} || CASE WHEN total < raw_total THEN '; confidenceGuardrail capped priority at ' || gb || '/' || {_F2('top')} ELSE '; confidenceGuardrail not applied' END) AS digest
FROM f4""")
def _(v):
    rows = scoring.with_opportunity_score_v2(_factors(v))
    return rows.select("id", F.md5(scoring.score_explanation(rows)).alias("digest"))


@query("eligible_pairs", "WITH p AS (SELECT n_nationkey, ['CONSTRUCTION', 'HORECA', 'OTHER'][n_nationkey % 3 + 1] AS vertical FROM nation), a AS (SELECT o_orderkey, ['CONSTRUCTION', 'HORECA', 'OTHER'][o_orderkey % 3 + 1] AS vertical FROM orders WHERE o_orderstatus = 'F') SELECT n_nationkey AS profile_id, count(*) AS pairs FROM a JOIN p USING (vertical) WHERE vertical <> 'OTHER' GROUP BY 1")
def _(v):
    vertical = lambda k: F.element_at(F.array(*[F.lit(x) for x in ("CONSTRUCTION", "HORECA", "OTHER")]), (F.col(k) % 3 + 1).cast("int"))
    analyses = v.table("orders").select("o_orderkey", vertical("o_orderkey").alias("vertical"), F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").otherwise("FAILED").alias("status"))
    profiles = v.table("nation").select(F.col("n_nationkey").alias("profile_id"), F.array(vertical("n_nationkey")).alias("verticals"))
    return scoring.eligible_pairs(analyses, profiles).groupBy("profile_id").agg(F.count("*").alias("pairs"))


@query("normalize_terms", "SELECT p_partkey, p_name || ',' || lower(p_type) || ',' || lower(replace(p_brand, '#', ' ')) AS terms FROM part")
def _(v):
    return v.table("part").select("p_partkey", F.array_join(scoring.normalize_terms(F.array("p_name", "p_type", "p_brand", F.upper("p_name"), F.lit(" - "))), ",").alias("terms"))


_MATCH = """CASE WHEN length(c) < 3 OR length(w) < 3 THEN c = w ELSE contains(c, w) OR contains(w, c) OR len(list_filter(string_split(w, ' '), lambda y: len(list_filter(string_split(c, ' '), lambda x: least(5, length(x), length(y)) >= 3 AND left(x, least(5, length(x), length(y))::INT) = left(y, least(5, length(x), length(y))::INT))) = 0)) = 0 END"""


#: Parts of joins that make many rows of few, which Spark would put in a few tasks.
PARTS = 96


@query("matches_term", f"WITH t AS (SELECT DISTINCT a.p_partkey, a.p_name AS c, lower(b.p_name) AS w FROM part a JOIN part b ON a.p_size = b.p_size) SELECT p_partkey, w, {_MATCH} AS hit FROM t")
def _(v):
    part = v.table("part").select("p_partkey", "p_size", F.coalesce("p_name", F.lit("")).alias("c"), F.col("p_name").isNull().alias("none")).distinct()
    key, name = ["p_size", "c", "none"], F.when(~F.col("none"), F.col("c"))
    wanted = part.select("p_size", F.lower(name).alias("w")).distinct()
    hits = part.select(key).distinct().repartition(PARTS, *key).join(wanted, "p_size").select(*key, "w", scoring.matches_term(name, F.col("w")).alias("hit"))  # once for each pair of names
    return part.repartition(PARTS, *key).join(hits.hint("merge"), key).select("p_partkey", "w", "hit")


@query("term_matches", f"WITH a AS (SELECT DISTINCT p_name AS c FROM part), b AS (SELECT DISTINCT lower(p_type) AS w FROM part UNION SELECT DISTINCT trim(substr(p_name, 3, 6)) FROM part), t AS (SELECT * FROM a, b) SELECT c AS candidate, w AS wanted FROM t WHERE {_MATCH}")
def _(v):
    from leadloom.operators.terms import term_matches

    part = v.table("part")
    wanted = part.select(F.lower("p_type").alias("term")).unionByName(part.select(F.trim(F.substring("p_name", 3, 6)).alias("term")))
    return term_matches(part.select(F.col("p_name").alias("term")), wanted)


FIT = """p AS (SELECT p_partkey AS id, ['CONSTRUCTION', 'HORECA', 'OTHER'][p_partkey % 3 + 1] AS v, p_partkey % 4 AS g, p_partkey % 5 AS e, p_partkey % 2 = 0 AS t, p_retailprice AS x, p_partkey % 6 AS q, p_name FROM part),
fit AS (SELECT *, CASE WHEN v = 'CONSTRUCTION' THEN 100.0 ELSE 0 END AS fv, CASE WHEN g = 0 THEN 50.0 WHEN g = 1 THEN 100 ELSE 0 END AS fr, CASE WHEN e = 0 THEN 50.0 WHEN e = 1 THEN 100 ELSE 25 END AS fe, CASE WHEN NOT t THEN 50.0 WHEN contains(p_name, 'ring') THEN 100 ELSE 25 END AS fo,
 CASE WHEN q = 0 THEN 50.0 WHEN q = 1 THEN 0 WHEN x BETWEEN 950 AND 1500 THEN 100 ELSE 0 END AS fp, CASE WHEN e = 4 THEN 'EVENT_IGNORED' WHEN t AND contains(p_name, 'bolt') THEN 'EXCLUDED_TERM_MATCH' END AS exclusion FROM p)"""


def _fit(v: Views) -> DataFrame:
    k, none = F.col("p_partkey"), F.array().cast("array<string>")
    lit = lambda *x: F.array(*[F.lit(y) for y in x])
    rows = v.table("part").select(
        k.alias("id"), F.element_at(lit("CONSTRUCTION", "HORECA", "OTHER"), (k % 3 + 1).cast("int")).alias("v"), F.when(k % 4 == 0, none).when(k % 4 == 1, lit("Moscow Region")).otherwise(lit("Kazan")).alias("regions"),
        F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, "Tender!").when(k % 5 == 4, "Spam").otherwise("Opening").alias("event"), F.when(k % 2 == 0, F.array("p_name")).otherwise(none).alias("terms"),
        F.when(k % 6 != 0, F.col("p_retailprice")).alias("amount"), F.when(k % 6 == 1, "USD").otherwise("eur").alias("currency"),
    )
    rows = rows.withColumn("exclusion", scoring.fit_exclusions(F.col("event"), lit("spam"), F.col("terms"), lit("bolt")))
    criteria = [
        scoring.fit_vertical(F.col("v"), lit("CONSTRUCTION")), scoring.fit_region(F.col("regions"), lit("moscow")), scoring.fit_event_type(F.col("event"), lit("tender")),
        scoring.fit_offering(F.col("terms"), lit("ring"), none, none), scoring.fit_project_value(F.col("amount"), F.col("currency"), F.lit(950.0), F.lit(1500.0), F.lit("EUR")),
    ]
    out, total = scoring.company_fit(criteria, F.col("exclusion"))
    return rows.withColumns({"criteria": out, "fit": total})


for _i, (_n, _c) in enumerate((("fit_vertical", "fv"), ("fit_region", "fr"), ("fit_event_type", "fe"), ("fit_offering", "fo"), ("fit_project_value", "fp"))):
    query(_n, f"WITH {FIT} SELECT id, {_c} AS score FROM fit")(lambda v, i=_i: _fit(v).select("id", F.col("criteria")[i]["score"].alias("score")))


@query("fit_exclusions", f"WITH {FIT} SELECT id, exclusion FROM fit")
def _(v):
    return _fit(v).select("id", "exclusion")


@query("company_fit", f"""WITH {FIT} SELECT id, CASE WHEN exclusion IS NULL THEN {_R('fv * 0.3 + fr * 0.25 + fe * 0.2 + fo * 0.15 + fp * 0.1')} ELSE 0.0 END AS fit,
 concat_ws(',', CASE WHEN fv = 100 THEN 'CONSTRUCTION' END, CASE WHEN fr = 100 THEN 'moscow region' END, CASE WHEN fe = 100 THEN 'tender' END, CASE WHEN fo = 100 THEN p_name END) AS matched FROM fit""")
def _(v):
    return _fit(v).select("id", "fit", F.array_join(F.flatten("criteria.matched_values"), ",").alias("matched"))


@query("evidence_reliability", f"WITH {SOURCES}, f AS (SELECT l_orderkey AS a, l_linenumber AS f, max(reliability) AS best FROM lineitem JOIN sources ON n IN (l_suppkey % 20, l_partkey % 20) GROUP BY 1, 2) SELECT a AS analysis_id, min(best) AS reliability, NULL AS error FROM f GROUP BY 1")
def _(v):
    name = lambda c: F.concat(F.lit("src"), (F.col(c) % 20).cast("string"))
    facts = v.table("lineitem").select(F.col("l_orderkey").alias("analysis_id"), F.col("l_linenumber").alias("fact_id"), F.array(name("l_suppkey"), name("l_partkey")).alias("source_ids"))
    return scoring.evidence_reliability(facts, v.sources)


def _scored(v: Views) -> DataFrame:
    i = F.col("id")
    action = lambda t: F.struct(F.lit("REVIEW").alias("kind"), F.lit(t).alias("title"))
    actions = F.when(i % 13 == 0, F.array(action("One"))).when(i % 13 == 1, F.array(action("One"), action("oNE"))).otherwise(F.array(action("One"), action("Two")))
    sources = F.when(i % 17 == 0, F.array().cast("array<string>")).when(i % 17 == 1, F.array(F.lit("s"), F.lit("s"))).otherwise(F.array(F.lit("s"), F.lit("t")))
    return _fit(v).select(i.alias("signal_id"), i.alias("analysis_id"), (i % 10).alias("profile_id"), F.lit(1).alias("profile_revision"), "exclusion", "fit", actions.alias("candidate_actions"), sources.alias("source_ids"))


@query("build_recommendations", f"""WITH {FIT}, h AS (SELECT id, sha256('["pipeline","recommendation","' || id || '","' || id || '","' || (id % 10) || '","1","opportunity-score-v2"]') AS h FROM fit WHERE exclusion IS NULL)
SELECT id AS signal_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id,
 CASE WHEN id % 13 = 0 THEN 'One' WHEN id % 13 = 1 THEN 'One,oNE' ELSE 'One,Two' END AS titles, CASE WHEN id % 17 = 0 THEN '' WHEN id % 17 = 1 THEN 's,s' ELSE 's,t' END AS sources,
 CASE WHEN id % 13 = 0 THEN 'INVALID_RECOMMENDED_ACTION_COUNT' WHEN id % 13 = 1 THEN 'DUPLICATE_RECOMMENDED_ACTION' WHEN id % 17 IN (0, 1) THEN 'INVALID_SOURCE_IDS' END AS error FROM h""")
def _(v):
    return scoring.build_recommendations(_scored(v)).select("signal_id", "id", F.array_join("recommended_actions.title", ",").alias("titles"), F.array_join("source_ids", ",").alias("sources"), "error")


@query("scoring_summary", f"WITH {FIT} SELECT count(*) AS eligible_pairs, count(*) FILTER (exclusion IS NULL) AS scored, count(*) FILTER (exclusion IS NOT NULL) AS excluded, count(DISTINCT id % 10) AS profiles FROM fit")
def _(v):
    return scoring.scoring_summary(_scored(v))


# ---------------------------------------------------------------- profiles and reads

PROFILES = """profiles AS (SELECT c_custkey AS id, c_custkey AS user_id, revision, c_acctbal AS lo, 5000.0 + revision * 100 AS hi, c_mktsegment AS seg, CASE WHEN c_custkey % 5 <> 0 THEN 'EUR' END AS currency FROM customer, (SELECT unnest([1, 2]) AS revision))"""
_TOP = "ORDER BY total_score DESC, created_at DESC, id"


@query("latest_profiles", f"WITH {PROFILES} SELECT id, user_id, revision FROM profiles WHERE revision = 2")
def _(v):
    return serving.latest_profiles(v.profiles).select("id", "user_id", "revision")


@query("apply_profile_patches", """WITH p AS (SELECT c_custkey AS u, c_acctbal AS a, unnest([1, 2]) AS seq FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 4 <> 0)
SELECT u AS user_id, 2 + seq AS revision, CASE WHEN seq = 1 THEN 'USD' WHEN u % 2 = 0 THEN 'GBP' ELSE 'USD' END AS currency, CASE WHEN seq = 1 THEN a ELSE 7.0 END AS project_value_minimum FROM p""")
def _(v):
    ids = v.table("customer").select(F.col("c_custkey").alias("user_id"))
    users = ids.withColumn("status", F.when(F.col("user_id") % 4 == 0, "BLOCKED").otherwise("ACTIVE"))
    patches = ids.filter("user_id % 3 = 0").withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2))))
    patches = patches.withColumns({"currency": F.when(F.col("seq") == 1, "USD").when(F.col("user_id") % 2 == 0, "GBP"), "project_value_minimum": F.when(F.col("seq") == 2, 7.0)})
    return serving.apply_profile_patches(v.profiles, patches, users, ["currency", "project_value_minimum"]).select("user_id", "revision", "currency", "project_value_minimum")


@query("profile_conflicts", f"""WITH {PROFILES} SELECT id, revision, 'KEYWORDS_EXCLUDED' AS problem FROM profiles WHERE id % 7 = 0 UNION ALL SELECT id, revision, 'EVENTS_IGNORED' FROM profiles WHERE id % 11 = 0
UNION ALL SELECT id, revision, 'VALUE_RANGE' FROM profiles WHERE lo > hi OR lo < 0 UNION ALL SELECT id, revision, 'CURRENCY' FROM profiles WHERE currency IS NULL""")
def _(v):
    return serving.profile_conflicts(v.profiles)


@query("list_opportunities", f"WITH {RECS} SELECT user_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id {_TOP}) AS rank FROM recs WHERE total_score >= 40 AND status = 'CANDIDATE' AND created_at BETWEEN '1996-01-01' AND '2000-01-01') WHERE rank <= 3")
def _(v):
    return serving.list_opportunities(v.recommendations, 3, minimum_score=40, status="CANDIDATE", created_from="1996-01-01", created_to="2000-01-01").select("user_id", "id", "rank")


@query("page_after", f"WITH {RECS} SELECT id, total_score FROM recs WHERE total_score < 50 OR (total_score = 50 AND (created_at < '1998-01-01' OR (created_at = '1998-01-01' AND id > 100))) {_TOP} LIMIT 50")
def _(v):
    import datetime

    return serving.page_after(v.recommendations, {"total_score": 50.0, "created_at": datetime.datetime(1998, 1, 1), "id": 100}, 50).select("id", "total_score")


@query("ranked_page", ORACLE["page_after"])
def _(v):
    import datetime

    from leadloom.plans.lineage import new_table

    path = new_table(v.spark, "ranked")
    serving.write_ranked(v.recommendations, path, 100)
    return serving.ranked_page(v.spark, path, 50, {"total_score": 50.0, "created_at": datetime.datetime(1998, 1, 1), "id": 100}).select("id", "total_score")


@query("find_opportunity", f"WITH {RECS}, u AS (SELECT min(user_id) AS u, arg_min(signal_id, user_id) AS s FROM recs) SELECT id FROM recs, u WHERE user_id = 899 AND signal_id = 0 ORDER BY revision DESC, created_at DESC, id LIMIT 1")
def _(v):
    return serving.find_opportunity(v.recommendations, 899, 0).select("id")


_REC_FEED = "events_r AS (SELECT event_id AS id, user_id * 7 % 1500 AS user_id, event_id * 3 % 15000 AS rec, event_type, ts FROM events)"


def _rec_feedback(v: Views) -> DataFrame:
    return v.feedback.withColumns({"recommendation_id": F.col("id") * 3 % 15000})


@query("saved_opportunities", f"WITH {RECS} SELECT user_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id {_TOP}) AS rank FROM recs SEMI JOIN (SELECT event_id * 3 % 15000 AS id, event_type FROM events WHERE event_type = 'signup') e USING (id)) WHERE rank <= 5")
def _(v):
    saved = _rec_feedback(v).drop("user_id").join(v.recommendations.select(F.col("id").alias("recommendation_id"), "user_id"), "recommendation_id")
    return serving.saved_opportunities(v.recommendations, saved, 5).select("user_id", "id", "rank")


@query("opportunity_sources", "SELECT l_orderkey AS recommendation_id, count(*) AS n, min(p_name) AS first_url FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON s_suppkey = p_partkey % 100 GROUP BY 1")
def _(v):
    items = v.table("part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("url"), F.lit(None).cast("timestamp").alias("published_at"), (F.col("p_partkey") % 100).alias("source_id"))
    links = v.table("lineitem").select(F.col("l_orderkey").alias("recommendation_id"), F.col("l_partkey").alias("item_id"))
    out = serving.opportunity_sources(links, items, v.table("supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name")))
    return out.select("recommendation_id", F.size("links").cast("long").alias("n"), F.array_min(F.transform("links", lambda x: x["url"])).alias("first_url"))


@query("list_sources", f"WITH {SOURCES} SELECT source_id FROM sources WHERE ai AND vertical = 'HORECA'")
def _(v):
    return serving.list_sources(v.sources, enabled=True, ai_allowed=True, vertical="HORECA").select("source_id")


# ---------------------------------------------------------------- digests

DIGEST = RECS + """, cand AS (SELECT *, date_trunc('week', created_at) AS period_start FROM recs WHERE status IN ('ACTIVE', 'CANDIDATE') AND revision = 2),
uniq AS (SELECT * FROM (SELECT *, user_id % 5 AS person FROM cand) QUALIFY row_number() OVER (PARTITION BY person, period_start, signal_id % 40 ORDER BY total_score DESC, created_at DESC, id) = 1),
top5 AS (SELECT *, row_number() OVER (PARTITION BY person, period_start ORDER BY total_score DESC, created_at DESC, id) AS rank FROM uniq QUALIFY rank <= 5),
cats AS (SELECT person, period_start, category, count(*) AS current FROM uniq GROUP BY ALL),
trends AS (SELECT a.person, a.period_start, a.category, a.current, coalesce(b.current, 0) AS previous, a.current - coalesce(b.current, 0) AS delta,
 row_number() OVER (PARTITION BY a.person, a.period_start ORDER BY a.current - coalesce(b.current, 0) DESC, a.current DESC, a.category) AS rank
 FROM cats a LEFT JOIN cats b ON a.person = b.person AND a.category = b.category AND b.period_start = a.period_start - INTERVAL 7 DAY WHERE a.current > coalesce(b.current, 0) QUALIFY rank <= 5)"""


def _candidates(v: Views, kind: str = "WEEKLY") -> DataFrame:
    """Five people and forty signals, so that periods have several rows."""
    recs = v.recommendations
    live = recs.select(F.col("id").alias("signal_id"), "category", "created_at", "status")
    rows = recs.drop("category", "status", "signal_id").withColumn("signal_id", F.col("id"))
    profiles = v.profiles.filter("revision = 2").select("id", "revision")
    good = recs.select("analysis_id", F.lit("SUCCEEDED").alias("status"))
    out = digest.digest_candidates(rows, live, good, profiles, kind)
    return out.withColumns({"user_id": F.col("user_id") % 5, "signal_id": F.col("signal_id") % 997 % 40})


@query("digest_periods", "SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS day_start, date_trunc('week', o_orderdate)::TIMESTAMP AS week_start, date_trunc('week', o_orderdate)::TIMESTAMP + INTERVAL 7 DAY AS week_end, date_trunc('week', o_orderdate)::TIMESTAMP - INTERVAL 7 DAY AS week_before FROM orders")
def _(v):
    d, w = digest.digest_periods(F.col("o_orderdate"), "DAILY"), digest.digest_periods(F.col("o_orderdate"), "WEEKLY")
    return v.table("orders").select("o_orderkey", d[0].alias("day_start"), w[0].alias("week_start"), w[1].alias("week_end"), w[2].alias("week_before"))


@query("digest_candidates", f"WITH {DIGEST} SELECT id, period_start::TIMESTAMP AS period_start FROM cand")
def _(v):
    return _candidates(v).select("id", "period_start")


@query("unique_by_signal", f"WITH {DIGEST} SELECT id, person AS user_id FROM uniq")
def _(v):
    return digest.unique_by_signal(_candidates(v)).select("id", "user_id")


@query("digest_top5", f"WITH {DIGEST} SELECT id, person AS user_id, rank FROM top5")
def _(v):
    return digest.digest_top5(digest.unique_by_signal(_candidates(v))).select("id", "user_id", "rank")


@query("weekly_funnel", """WITH a AS (SELECT date_trunc('week', ts) AS w, count(*) AS n FROM events GROUP BY 1), b AS (SELECT date_trunc('week', ts) AS w, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1), c AS (SELECT date_trunc('week', ts + INTERVAL 7 DAY) AS w, count(*) AS n FROM events GROUP BY 1)
SELECT coalesce(a.w, b.w, c.w)::TIMESTAMP AS period_start, coalesce(a.n, 0) AS processed, coalesce(b.n, 0) AS unique_items, coalesce(c.n, 0) AS relevant FROM a FULL JOIN b ON a.w = b.w FULL JOIN c ON coalesce(a.w, b.w) = c.w""")
def _(v):
    e = v.table("events")
    heads = e.select(F.when(F.col("event_id") % 3 == 0, "REPRESENTATIVE").otherwise("NEAR_TEXT").alias("match_kind"), F.col("ts").alias("created_at"))
    signals = e.select((F.col("ts") + F.make_dt_interval(F.lit(7))).alias("created_at"))
    return digest.weekly_funnel(e.select(F.col("ts").alias("received_at")), heads, signals)


@query("category_trends", f"WITH {DIGEST} SELECT person AS user_id, period_start::TIMESTAMP AS period_start, category, current, previous, delta, rank FROM trends")
def _(v):
    return digest.category_trends(digest.unique_by_signal(_candidates(v)))


@query("build_digests", f"WITH {DIGEST} SELECT person AS user_id, 'WEEKLY' AS kind, period_start::TIMESTAMP AS period_start, count(*) AS opportunities, count(*) FILTER (band IN ('HIGH', 'CRITICAL')) AS high_priority FROM uniq GROUP BY ALL")
def _(v):
    return digest.build_digests(_candidates(v))["digests"].select("user_id", "kind", "period_start", "opportunities", "high_priority")


@query("check_digests", f"WITH {DIGEST} SELECT 'HIGH_PRIORITY' AS problem, person AS user_id, period_start::TIMESTAMP AS period_start FROM uniq WHERE person = 7 GROUP BY ALL")
def _(v):
    made = digest.build_digests(_candidates(v))
    broken = made["digests"].withColumn("high_priority", F.when(F.col("user_id") == 7, F.col("opportunities") + 1).otherwise(F.col("high_priority")))
    return digest.check_digests(broken, made["items"], made["trends"])


@query("digest_view", f"WITH {DIGEST} SELECT person AS user_id, period_start::TIMESTAMP AS period_start, string_agg(id::VARCHAR, ',' ORDER BY rank) AS ids FROM top5 GROUP BY ALL")
def _(v):
    out = digest.digest_view(digest.digest_top5(digest.unique_by_signal(_candidates(v))))
    return out.select("user_id", "period_start", F.array_join(F.transform("items", lambda x: x["id"].cast("string")), ",").alias("ids"))


@query("digest_counts", f"WITH {DIGEST}, {FEEDBACK} SELECT 'digests' AS what, 'WEEKLY' AS name, count(DISTINCT (person, period_start)) AS n FROM uniq UNION ALL SELECT 'deliveries', status, count(*) FROM dl GROUP BY status")
def _(v):
    return digest.digest_counts(digest.build_digests(_candidates(v))["digests"], v.deliveries)


# ---------------------------------------------------------------- feedback and deliveries

@query("record_feedback", f"WITH {FEEDBACK} SELECT id FROM feedback")
def _(v):
    return feedback.record_feedback(v.feedback)[0].select("id")


@query("feedback_conflicts", f"WITH {FEEDBACK} SELECT id FROM f2 WHERE mood AND k > 1")
def _(v):
    return feedback.record_feedback(v.feedback)[1].select("id")


@query("feedback_target", f"WITH {RECS}, f AS (SELECT event_id AS feedback_id, user_id, event_id % 997 AS signal_id FROM events) SELECT feedback_id, f.signal_id, r.id AS recommendation_id FROM f JOIN recs r ON r.user_id % 150 = f.user_id AND r.signal_id = f.signal_id QUALIFY row_number() OVER (PARTITION BY feedback_id ORDER BY revision DESC, created_at DESC, r.id) = 1")
def _(v):
    given = v.table("events").select(F.col("event_id").alias("feedback_id"), "user_id", (F.col("event_id") % 997).alias("signal_id"))
    return feedback.feedback_target(given, v.recommendations.withColumn("user_id", F.col("user_id") % 150)).select("feedback_id", "signal_id", "recommendation_id")


_KEPT = lambda v: feedback.record_feedback(v.feedback)[0]


@query("action_counts", f"WITH {FEEDBACK} SELECT user_id, " + ", ".join(f"count(*) FILTER (action = '{a}') AS {a}" for a in feedback.ACTIONS) + " FROM feedback GROUP BY user_id")
def _(v):
    return feedback.action_counts(_KEPT(v))


@query("feedback_attribution", f"WITH {FEEDBACK} SELECT user_id, count(*) FILTER (delivery_id IS NULL) AS direct, count(*) FILTER (delivery_id IS NOT NULL) AS telegram FROM feedback GROUP BY user_id")
def _(v):
    return feedback.feedback_attribution(_KEPT(v))


_PERCENT = lambda a, b: f"floor({a}::DOUBLE / {b} * 100 * 100.0 + 0.5) / 100.0"
COVER = FEEDBACK + f""", sent AS (SELECT DISTINCT user_id, rec FROM dl WHERE status = 'SENT'), fu AS (SELECT DISTINCT user_id, rec FROM feedback),
cover AS (SELECT user_id, count(*) AS sent, count(*) FILTER (fu.rec IS NOT NULL) AS answered, {_PERCENT('count(*) FILTER (fu.rec IS NOT NULL)', 'count(*)')} AS coverage FROM sent LEFT JOIN fu USING (user_id, rec) GROUP BY user_id)"""


@query("feedback_coverage", f"WITH {COVER} SELECT * FROM cover")
def _(v):
    return feedback.feedback_coverage(v.deliveries, _KEPT(v))


_GOOD, _BAD = "count(*) FILTER (action = 'USEFUL')", "count(*) FILTER (action = 'NOT_USEFUL')"


@query("positive_sentiment", f"WITH {FEEDBACK} SELECT user_id, {_GOOD} AS useful, {_BAD} AS not_useful, CASE WHEN {_GOOD} + {_BAD} > 0 THEN {_PERCENT(_GOOD, f'({_GOOD} + {_BAD})')} END AS positive FROM feedback GROUP BY user_id")
def _(v):
    return feedback.positive_sentiment(_KEPT(v))


@query("high_score_rejections", f"WITH {RECS}, f AS (SELECT event_id AS feedback_id, user_id, event_id * 3 % 15000 AS rec, ts FROM events WHERE event_type = 'error') SELECT feedback_id, f.user_id, total_score, row_number() OVER (PARTITION BY f.user_id ORDER BY total_score DESC, ts DESC, feedback_id) AS rank FROM f JOIN recs ON recs.id = rec WHERE band IN ('HIGH', 'CRITICAL') QUALIFY rank <= 10")
def _(v):
    return feedback.high_score_rejections(_rec_feedback(v), v.recommendations).select("feedback_id", "user_id", "total_score", "rank")


@query("feedback_summary", f"""WITH {COVER}, a AS (SELECT user_id, count(*) AS total, count(*) FILTER (delivery_id IS NULL) AS direct, CASE WHEN {_GOOD} + {_BAD} > 0 THEN {_PERCENT(_GOOD, f'({_GOOD} + {_BAD})')} END AS positive FROM feedback GROUP BY user_id)
SELECT user_id, coalesce(total, 0) AS total, coalesce(direct, 0) AS direct, positive, coalesce(sent, 0) AS sent, coalesce(answered, 0) AS answered, coalesce(coverage, 0) AS coverage, true AS consistent FROM a FULL JOIN cover USING (user_id)""")
def _(v):
    return feedback.feedback_summary(_KEPT(v), v.deliveries).select("user_id", "total", "direct", "positive", "sent", "answered", "coverage", "consistent")


@query("feedback_context_audit", f"WITH {FEEDBACK} SELECT id FROM events_f WHERE delivery_id IS NOT NULL AND delivery_id % 50 = 0")
def _(v):
    return feedback.feedback_context_audit(v.feedback, v.deliveries).select("id")


DELIVERED = FEEDBACK + """, dr AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY (status IN ('SENT', 'FAILED')) DESC, ts, id) AS k, first_value(status) OVER (PARTITION BY key ORDER BY (status IN ('SENT', 'FAILED')) DESC, ts, id) AS f FROM dl)"""


@query("delivery_outcomes", f"WITH {DELIVERED} SELECT id, status FROM dr WHERE k = 1")
def _(v):
    return feedback.delivery_outcomes(v.deliveries)[0].select("id", "status")


_CHANGED = DELIVERED.replace("FROM dl)", "FROM dc)").replace(", dr AS", ", dc AS (SELECT * REPLACE (CASE WHEN id % 4000 = 1 AND id > 4000 THEN 'FAILED' ELSE status END AS status) FROM dl), dr AS")


@query("delivery_conflicts", f"WITH {_CHANGED} SELECT id, status FROM dr WHERE k > 1 AND status IN ('SENT', 'FAILED') AND status <> f")
def _(v):
    changed = v.deliveries.withColumn("status", F.when((F.col("id") % 4000 == 1) & (F.col("id") > 4000), "FAILED").otherwise(F.col("status")))
    return feedback.delivery_outcomes(changed)[1].select("id", "status")


@query("new_deliveries", f"WITH {RECS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id {_TOP}) AS rank FROM recs WHERE status = 'CANDIDATE') SELECT 'NEW:' || user_id || ':' || id AS idempotency_key, rank FROM r WHERE rank <= 5 AND id % 3 <> 0")
def _(v):
    top = serving.list_opportunities(v.recommendations, 5, status="CANDIDATE")
    held = v.recommendations.filter("id % 3 = 0").select(F.concat_ws(":", F.lit("NEW"), F.col("user_id").cast("string"), F.col("id").cast("string")).alias("idempotency_key"))
    return feedback.new_deliveries(top, held).select("idempotency_key", "rank")


@query("delivery_status_counts", f"WITH {FEEDBACK} SELECT kind, status, reused, count(*) AS n FROM dl GROUP BY ALL")
def _(v):
    return feedback.delivery_status_counts(v.deliveries)


# ---------------------------------------------------------------- evaluation

@query("validate_gold", f"""WITH {GOLD}, g AS (SELECT *, CASE WHEN id % 31 = 0 THEN 'PRIVATE' ELSE vertical END AS v, CASE WHEN NOT relevant THEN CASE WHEN id % 29 = 0 THEN 'HORECA_OPENING' ELSE 'OTHER' END WHEN id % 11 = 0 THEN 'OTHER' ELSE vertical || '_PROJECT' END AS category, CASE WHEN id % 37 = 0 THEN 'TEST' ELSE split END AS s FROM gold),
n AS (SELECT unnest(['CONSTRUCTION', 'HORECA']) AS v), k AS (SELECT n.v, count(g.id) AS items, count(g.id) FILTER (relevant) AS relevant, count(g.id) FILTER (s = 'CALIBRATION') AS calibration FROM n LEFT JOIN g ON g.v = n.v GROUP BY n.v)
SELECT 'IRRELEVANT_ACTION' AS problem, id FROM g WHERE NOT relevant AND action <> 'IGNORE' UNION ALL SELECT 'RELEVANT_ACTION', id FROM g WHERE relevant AND id % 41 = 0 UNION ALL SELECT 'IMPORTANCE', id FROM g WHERE relevant AND importance < 40
UNION ALL SELECT 'REPEATED_URL', min(id) FROM g GROUP BY url HAVING count(*) > 1 UNION ALL SELECT 'REPEATED_TEXT', min(id) FROM g GROUP BY trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) HAVING count(*) > 1
UNION ALL SELECT 'VERTICAL', id FROM g WHERE v = 'PRIVATE' UNION ALL SELECT 'SPLIT', id FROM g WHERE s = 'TEST' UNION ALL SELECT 'IRRELEVANT_LABELS', id FROM g WHERE NOT relevant AND (category <> 'OTHER' OR id % 43 = 0) UNION ALL SELECT 'RELEVANT_CATEGORY', id FROM g WHERE relevant AND id % 11 = 0 AND v <> 'PRIVATE'
UNION ALL SELECT 'FACT_COUNT', id FROM g WHERE id % 47 = 0 UNION ALL SELECT 'FACT_IDS', id FROM g WHERE id % 47 = 0 UNION ALL SELECT 'QUOTE_NOT_IN_TEXT', id FROM g WHERE id % 53 = 0 AND id % 47 <> 0
UNION ALL SELECT 'BALANCE_' || v || '_ITEMS', NULL FROM k WHERE items <> 100 UNION ALL SELECT 'BALANCE_' || v || '_RELEVANT', NULL FROM k WHERE relevant <> 80 UNION ALL SELECT 'BALANCE_' || v || '_CALIBRATION', NULL FROM k WHERE calibration <> 40""")
def _(v):
    i, relevant, fact = F.col("id"), F.col("relevant"), F.col("facts")[0]
    category = F.when(~relevant, F.when(i % 29 == 0, "HORECA_OPENING").otherwise("OTHER")).when(i % 11 == 0, "OTHER").otherwise(F.concat("vertical", F.lit("_PROJECT")))
    facts = F.when(i % 47 == 0, F.array_repeat(fact, 4)).when(i % 53 == 0, F.array(fact.withField("evidenceQuote", F.concat(fact["evidenceQuote"], F.lit("@@"))))).otherwise(F.col("facts"))
    rows = v.gold.withColumns({
        "category": category, "event_type": F.when(relevant, "x").when(i % 43 == 0, "irrelevant_notice").otherwise("IRRELEVANT_NOTICE"), "action": F.when(relevant & (i % 41 == 0), "IGNORE").otherwise(F.col("action")), "facts": facts,
    })
    rows = rows.withColumns({"vertical": F.when(i % 31 == 0, "PRIVATE").otherwise(F.col("vertical")), "split": F.when(i % 37 == 0, "TEST").otherwise(F.col("split"))})
    return evals.validate_gold(rows, evals.GOLD_BALANCE)


@query("gold_summary", f"""WITH {GOLD} SELECT count(*) AS items, 1 AS facts_min, 1 AS facts_max, count(*) AS facts_total, count(*) FILTER (relevant) AS relevant, count(*) FILTER (NOT relevant) AS irrelevant, count(*) FILTER (split = 'CALIBRATION') AS calibration,
 count(*) FILTER (split = 'HOLDOUT') AS holdout, count(*) FILTER (vertical = 'CONSTRUCTION') AS construction, count(*) FILTER (vertical = 'HORECA') AS horeca FROM gold""")
def _(v):
    return evals.gold_summary(v.gold)


@query("select_split", f"WITH {GOLD} SELECT id FROM gold WHERE split = 'HOLDOUT'")
def _(v):
    return evals.select_split(v.gold, "HOLDOUT").select("id")


@query("eval_requests", f"WITH {GOLD} SELECT id, url, source_id, 'UNCLASSIFIED' AS category, 50 AS relevance_score, 50 AS classification_confidence FROM gold")
def _(v):
    return evals.eval_requests(v.gold).drop("text")


@query("prediction_validity", f"WITH {GOLD} SELECT id, validity FROM judged")
def _(v):
    return v.judged.select("id", "validity")


_RATE = lambda a, b: f"CASE WHEN {b} > 0 THEN floor(({a})::DOUBLE / ({b}) * 1e6 + 0.5) / 1e6 END"
_OUTCOMES = "count(*) AS items, count(*) FILTER (validity = 'SUCCEEDED') AS valid, count(*) FILTER (code IS NOT NULL) AS failures, count(*) FILTER (code = 'AI_INVALID_RESPONSE') AS invalid"


@query("validity_rates", f"WITH {GOLD}, c AS (SELECT {_OUTCOMES} FROM judged) SELECT *, failures - invalid AS provider_failures, {_RATE('valid', 'items')} AS coverage, {_RATE('valid', '(valid + invalid)')} AS valid_rate FROM c")
def _(v):
    return evals.validity_rates(v.judged)


@query("event_type_accuracy", f"WITH {GOLD}, c AS (SELECT count(*) AS valid, count(*) FILTER (relevant <> said_no) AS correct FROM judged WHERE validity = 'SUCCEEDED') SELECT *, floor(correct / valid * 1e6 + 0.5) / 1e6 AS accuracy FROM c")
def _(v):
    return evals.event_type_accuracy(v.judged)


_SIX = lambda a, b: f"floor({a}::DOUBLE / ({b}) * 1e6 + 0.5) / 1e6"
_CONF = "count(*) FILTER (NOT said_no AND relevant) AS tp, count(*) FILTER (NOT said_no AND NOT relevant) AS fp, count(*) FILTER (said_no AND NOT relevant) AS tn, count(*) FILTER (said_no AND relevant) AS fn"


@query("relevance_confusion", f"WITH {GOLD}, c AS (SELECT {_CONF} FROM judged WHERE validity = 'SUCCEEDED') SELECT *, {_SIX('tp', 'tp + fp')} AS precision, {_SIX('tp', 'tp + fn')} AS recall, {_SIX('2 * tp', '2 * tp + fp + fn')} AS f1, {_SIX('(tp + tn)', 'tp + fp + tn + fn')} AS accuracy FROM c")
def _(v):
    return evals.relevance_confusion(v.judged)


_SQ = lambda x: f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"


@query("fact_support", f"WITH {GOLD} SELECT id, 'f' || id AS fact_id, contains({_SQ('text')}, {_SQ('quote')}) AND id % 4 <> 0 AS supported FROM gold")
def _(v):
    g = v.gold
    made = g.select("id", F.col("facts")[0]["id"].alias("fact_id"), F.array("source_id").alias("source_ids"), F.col("facts")[0]["statement"].alias("statement"))
    return evals.fact_support(made, g.select("id", F.when(F.col("id") % 4 == 0, "other").otherwise(F.col("source_id")).alias("source_id"), "text"))


@query("expected_fact_recall", f"WITH {GOLD} SELECT id, 'f' || id AS fact_id, id % 5 <> 0 AS matched FROM gold")
def _(v):
    facts = v.gold.select("id", F.col("facts")[0]["id"].alias("fact_id"), F.col("facts")[0]["evidenceQuote"].alias("evidenceQuote"))
    made = facts.select("id", F.when(F.col("id") % 5 == 0, "@@").otherwise(F.concat(F.lit("So:  "), "evidenceQuote")).alias("statement"))
    return evals.expected_fact_recall(facts, made)


_RUN = "l_returnflag AS provider, l_linestatus AS model, 'p' AS prompt_version, 'ALL' AS split"
LATENCY = f"SELECT {_RUN}, floor(min(l_quantity) * 1000 + 0.5) / 1000 AS min, floor(avg(l_quantity) * 1000 + 0.5) / 1000 AS mean, floor(max(l_quantity) * 1000 + 0.5) / 1000 AS max, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.95) AS p95 FROM lineitem GROUP BY ALL"
TOKENS = f"""SELECT {_RUN}, count(*) AS n, count(*) FILTER (l_linenumber <> 7) AS with_usage, sum(l_partkey) FILTER (l_linenumber <> 7) AS input_tokens, sum(l_suppkey) FILTER (l_linenumber <> 7) AS output_tokens, 'PARTIAL' AS usage,
 floor(sum(l_suppkey) FILTER (l_linenumber <> 7) * 1000 / sum(l_quantity) FILTER (l_linenumber <> 7) * 1000 + 0.5) / 1000 AS tokens_per_second FROM lineitem GROUP BY ALL"""


@query("latency_stats", LATENCY)
def _(v):
    return evals.latency_stats(v.runs)


@query("token_throughput", TOKENS)
def _(v):
    return evals.token_throughput(v.runs)


@query("eval_failures", f"WITH {GOLD} SELECT CASE WHEN code = 'AI_INVALID_RESPONSE' THEN 'INVALID' ELSE 'PROVIDER' END AS kind, code, count(*) AS n FROM judged WHERE code IS NOT NULL GROUP BY ALL")
def _(v):
    return evals.eval_failures(v.judged)


@query("failure_rows", f"WITH {GOLD} SELECT id, CASE WHEN validity = 'MISSING' THEN 'THROWN' ELSE validity END AS kind, code FROM judged WHERE code IS NOT NULL")
def _(v):
    return evals.failure_rows(v.judged)


def _report(v: Views) -> DataFrame:
    """Gold items dealt to the six runs of lineitem."""
    pick = lambda n, *x: F.element_at(F.array(*[F.lit(y) for y in x]), (F.col("id") % n + 1).cast("int"))
    judged = v.judged.withColumns({"provider": pick(3, "A", "N", "R"), "model": pick(2, "F", "O"), "prompt_version": F.lit("p"), "split": F.lit("ALL")})
    return evals.benchmark_report(judged, v.runs)


_OK = "validity = 'SUCCEEDED'"
_LOW = lambda x: f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"
_CONFUSION = ", ".join(x.replace("FILTER (", f"FILTER ({_OK} AND ") for x in _CONF.split(", "))
REPORT = f"""{GOLD}, fc AS (SELECT *, {_LOW('quote')} AS q, {_LOW("quote || CASE WHEN id % 5 = 0 THEN ' and what no text says' ELSE '' END")} AS s1, {_LOW(f"translate(left(text, 20), '{ascii_lowercase}', '{ascii_uppercase}')")} AS s2, {_LOW('text')} AS low FROM judged),
c AS (SELECT ['A', 'N', 'R'][id % 3 + 1] AS provider, ['F', 'O'][id % 2 + 1] AS model, {_OUTCOMES}, {_CONFUSION}, count(*) FILTER ({_OK} AND relevant <> said_no) AS event_correct, count(*) AS expected_facts, count(*) FILTER ({_OK}) AS evaluated_expected_facts,
 count(*) FILTER ({_OK} AND (contains(s1, q) OR contains(q, s1) OR contains(s2, q) OR contains(q, s2))) AS matched_expected_facts, 2 * count(*) FILTER ({_OK}) AS generated_facts,
 count(*) FILTER ({_OK} AND contains(low, s1)) + count(*) FILTER ({_OK} AND id % 7 <> 0 AND contains(low, s2)) AS supported_generated_facts FROM fc GROUP BY 1, 2),
l AS ({LATENCY}), t AS ({TOKENS}),
report AS (SELECT c.*, failures - invalid AS provider_failures, {_RATE('valid', 'items')} AS coverage, {_RATE('valid', '(valid + invalid)')} AS valid_rate, {_RATE('event_correct', 'valid')} AS event_accuracy, {_RATE('tp + tn', '(tp + fp + tn + fn)')} AS accuracy,
 {_RATE('tp', '(tp + fp)')} AS precision, {_RATE('tp', '(tp + fn)')} AS recall, {_RATE('2 * tp', '(2 * tp + fp + fn)')} AS f1, {_RATE('matched_expected_facts', 'evaluated_expected_facts')} AS expected_fact_recall, {_RATE('supported_generated_facts', 'generated_facts')} AS generated_fact_support_rate,
 generated_facts - supported_generated_facts AS hallucination_count, l.p95, t.tokens_per_second, t.n AS samples, t.with_usage FROM c LEFT JOIN l USING (provider, model) LEFT JOIN t USING (provider, model))"""
_REPORTED = [
    "provider", "model", "items", "valid", "failures", "invalid", "provider_failures", "coverage", "valid_rate", "tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1", "event_correct", "event_accuracy",
    "expected_facts", "evaluated_expected_facts", "matched_expected_facts", "expected_fact_recall", "generated_facts", "supported_generated_facts", "hallucination_count", "generated_fact_support_rate", "p95", "tokens_per_second", "samples",
]


@query("benchmark_report", f"WITH {REPORT} SELECT {', '.join(_REPORTED)} FROM report")
def _(v):
    return _report(v).select(*_REPORTED)


_BROKEN = {
    "CONFUSION_SUM": "tp + fp + tn + fn <> valid", "RATE_ACCURACY": f"accuracy <> {_RATE('tp + tn', 'valid')}", "RATE_PRECISION": f"precision <> {_RATE('tp', '(tp + fp)')}", "RATE_RECALL": f"recall <> {_RATE('tp', '(tp + fn)')}", "RATE_F1": f"f1 <> {_RATE('2 * tp', '(2 * tp + fp + fn)')}",
    "HALLUCINATION_COUNT": "model = 'O'", "LATENCY_SAMPLES": "samples <> items", "TOKEN_SAMPLES": "with_usage > items", "FAILURE_CLASSES": "provider = 'N'", "EVENT_CORRECT": "provider = 'R'", "RATE_EVENT_ACCURACY": "provider = 'R'",
}


@query("check_report", f"WITH {REPORT}, b AS (SELECT * REPLACE (CASE WHEN provider = 'A' THEN tp + 1 ELSE tp END AS tp) FROM report) SELECT provider, model, problem FROM (" + " UNION ALL ".join(f"SELECT provider, model, '{k}' AS problem FROM b WHERE {c}" for k, c in _BROKEN.items()) + ")")
def _(v):
    when = lambda c, x: F.when(F.col("provider") == c, x).otherwise(0)
    broken = _report(v).withColumns({
        "tp": F.col("tp") + when("A", 1), "provider_failures": F.col("provider_failures") + when("N", 1), "event_correct": F.when(F.col("provider") == "R", F.col("valid") + 1).otherwise(F.col("event_correct")),
        "hallucination_count": F.col("hallucination_count") + F.when(F.col("model") == "O", 1).otherwise(0),
    })
    return evals.check_report(broken).select("provider", "model", "problem")


@query("corpus_overlap", f"SELECT item_id FROM benchmark WHERE {_SQ('text')} IN (SELECT {_SQ('text')} FROM documents) OR item_id % 4 = 0")
def _(v):
    bench = v.table("benchmark")
    corpus = v.table("documents").select("text").unionByName(bench.filter("item_id % 4 = 0").select(ascii_upper(F.concat(F.lit("  "), "text")).alias("text")))
    return evals.corpus_overlap(bench, corpus).select("item_id")


# ---------------------------------------------------------------- audits, telemetry, streams

def _audited(v: Views) -> dict[str, DataFrame]:
    """Tables with rows that break rules, one in so many."""
    i, n = F.col("id"), F.col("n")
    ts = lambda c: F.timestamp_micros(F.lit(1767225600000000) + c * 1000000)
    sources = v.sources.withColumns({
        "type": F.when(n % 4 == 0, "PARTNER_TELEGRAM").when(n % 4 == 1, "MANUAL").otherwise("RSS"), "poll_interval_minutes": F.when(n % 4 == 2, F.lit(15)).when(n % 4 == 0, F.lit(0)), "created_at": ts(n), "updated_at": ts(n - F.when(n % 5 == 0, 1).otherwise(0)),
        "last_success_at": F.when(n % 3 == 0, ts(n - F.when(n % 6 == 0, 1).otherwise(0))), "last_error_at": F.lit(None).cast("timestamp"), "regions": F.when(n % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("name")), "rights_basis": F.when(n % 2 == 0, "licence").otherwise(" "),
        "name": F.when(n % 11 == 0, " ").otherwise(F.col("name")), "reliability": F.col("reliability") + F.when(n % 13 == 0, 100).otherwise(0), "ai_allowed": F.lit(True),
    })
    k = F.col("o_orderkey")
    recs = v.table("orders").select(
        *[(k % m - F.when(k % m == 1, 2).otherwise(0)).alias(c) for m, c in ((101, "business_impact"), (97, "company_fit"), (89, "urgency"), (83, "confidence"), (79, "actionability"))], (k % 103).alias("total_score"), F.slice(F.array(*[F.lit(x) for x in "abcdefg"]), 1, (k % 7 + 1).cast("int")).alias("recommended_actions"),
    )
    signals = v.table("orders").select(
        k.alias("id"), (k % 111).alias("relevance_score"), (k % 50).alias("classification_confidence"), F.col("o_orderdate").alias("updated_at"), (F.col("o_orderdate") + F.make_dt_interval(F.when(k % 9 == 0, 1).otherwise(0))).alias("created_at"), F.when(k % 5 == 0, "SUPERSEDED").otherwise("ACTIVE").alias("status"),
        F.when(k % 10 == 0, k).when(k % 5 == 0, k + 1).when(k % 11 == 0, F.lit(1)).alias("superseded_by"), F.array_repeat(F.lit("r"), (k % 3).cast("int")).alias("rule_ids"),
    )
    digests = v.table("orders").select(
        F.when(k % 2 == 0, "DAILY").otherwise("WEEKLY").alias("kind"), F.col("o_orderdate").alias("period_start"), (F.col("o_orderdate") + F.make_dt_interval(F.when(k % 2 == 0, 1).when(k % 3 == 0, 6).otherwise(7))).alias("period_end"),
        *[F.when((k % 2 == 1) | (k % 26 == 0), k % m).alias(c) for m, c in ((50, "processed_count"), (40, "unique_count"), (30, "relevant_count"), (20, "opportunity_count"), (25, "high_priority_count"))],
    )
    attempts = v.raw.select(
        F.when(F.col("raw_item_id") % 4 == 0, "REJECTED").otherwise("SUCCEEDED").alias("status"), F.when(F.col("raw_item_id") % 8 == 0, "EMPTY").when(F.col("raw_item_id") % 9 == 1, "ODD").alias("rejection_code"), F.when(F.col("raw_item_id") % 4 != 0, F.col("raw_item_id")).alias("normalized_item_id"), F.when(F.col("raw_item_id") % 12 == 0, " ").when(F.col("raw_item_id") % 4 == 0, "no text").alias("rejection_detail"),
    )
    assignments = v.items.select("id", F.when(i % 3 == 0, i).otherwise(i - 1).alias("representative_id"), F.when(i % 6 == 0, i).otherwise(i - 1).alias("matched_to_id"), F.when(i % 3 == 0, "REPRESENTATIVE").otherwise("NEAR_TEXT").alias("match_kind"), ((i % 30) / 28).alias("similarity"), (F.lit(0.0) - F.when(i % 17 == 0, 1.0).otherwise(0.0)).alias("time_distance_hours"))
    return {
        "sources": sources, "raw_items": v.raw, "deliveries": v.deliveries.withColumn("created_at", F.col("updated_at") + F.make_dt_interval(mins=F.when(i % 21 == 0, 1).otherwise(0))), "recommendations": recs, "signals": signals, "digests": digests, "normalization_attempts": attempts,
        "assignments": assignments.withColumn("similarity", F.when(i % 3 == 0, 1.0).otherwise(F.col("similarity"))), "profiles": v.profiles, "digest_items": v.table("lineitem").select(F.col("l_linenumber").alias("rank")),
        "digest_trends": v.table("lineitem").select((F.col("l_linenumber") - 1).alias("rank"), F.col("l_suppkey").alias("current"), F.col("l_linenumber").alias("previous"), (F.col("l_suppkey") - F.col("l_linenumber") + F.when(F.col("l_partkey") % 10 == 0, 1).otherwise(0)).alias("delta")),
    }


def _sql_audit(table: str, source: str, **broken: str) -> str:
    return " UNION ALL ".join(f"SELECT '{table}' AS table_name, '{k}' AS constraint_name, " + (f"NULL::BIGINT AS violations, '{c[1:]}' AS missing FROM (SELECT 1)" if c.startswith("-") else f"count(*) FILTER ({c}) AS violations, NULL AS missing FROM {source}") for k, c in broken.items())


_K = "o_orderkey"
_OUT = lambda m: f"{_K} % {m} = 1 OR {_K} % {m} > 100"
_AUDITS = [
    _sql_audit("sources", "sources", name="n % 11 = 0", dimensions="n % 7 = 0", reliability="reliability + CASE WHEN n % 13 = 0 THEN 100 ELSE 0 END > 100", verticals="false", time_order="n % 5 = 0 OR n % 6 = 0", poll_policy="n % 4 IN (0, 3)", ai_permission="n % 10 = 9 OR n % 2 = 1", ai_rights="n % 10 = 9", telegram="n % 4 = 0"),
    _sql_audit("raw_items", "documents", raw_text="trim(text) = ''", content_hash="false"),
    _sql_audit("deliveries", "events", outcome="event_id % 4 = 3", reason="-failure_reason", key="false", time_order="event_id % 21 = 0"),
    _sql_audit("recommendations", "orders", business_impact=_OUT(101), company_fit=_OUT(97), urgency=_OUT(89), confidence=_OUT(83), actionability=_OUT(79), total_score=f"{_K} % 103 > 100", actions=f"{_K} % 7 + 1 NOT BETWEEN 2 AND 5"),
    _sql_audit("signals", "orders", relevance_score=f"{_K} % 111 > 100", classification_confidence="false", time_order=f"{_K} % 9 = 0", rule_ids=f"{_K} % 3 = 0", supersession=f"{_K} % 10 = 0 OR ({_K} % 5 <> 0 AND {_K} % 11 = 0)"),
    _sql_audit("digests", "orders", period=f"{_K} % 2 = 1 AND {_K} % 3 = 0", alignment=f"{_K} % 2 = 1 AND isodow(o_orderdate) <> 1", summary=f"{_K} % 26 = 0", counts=f"{_K} % 2 = 1 AND {_K} % 25 > {_K} % 20"),
    _sql_audit("normalization_attempts", "documents", outcome="(doc_id % 4 = 0 AND doc_id % 8 <> 0 AND doc_id % 9 <> 1) OR (doc_id % 4 <> 0 AND doc_id % 9 = 1)", payload="doc_id % 12 = 0"),
    _sql_audit("assignments", "documents", similarity="doc_id % 3 <> 0 AND doc_id % 30 > 28", distance="doc_id % 17 = 0", representative="doc_id % 3 = 0 AND (doc_id % 6 <> 0 OR doc_id % 17 = 0)"),
    _sql_audit("profiles", "profiles", revision="false", range="lo > hi", dimensions="false", services="-services_and_products", project_value_minimum="lo < 0", project_value_maximum="hi < 0", currency="currency IS NULL", time_order="-created_at,updated_at"),
    _sql_audit("digest_items", "lineitem", rank="l_linenumber > 5"), _sql_audit("digest_trends", "lineitem", counts="l_suppkey - l_linenumber <= 0 OR l_partkey % 10 = 0", rank="l_linenumber NOT BETWEEN 2 AND 6"),
]


@query("audit_constraints", f"WITH {SOURCES}, {PROFILES} " + " UNION ALL ".join(_AUDITS))
def _(v):
    return quality.audit_constraints(_audited(v))


@query("audit_uniqueness", """SELECT 'documents' AS table_name, 'source,h' AS keys, (SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY source, md5(text) HAVING count(*) > 1)) AS duplicates
UNION ALL SELECT 'orders', 'o_orderkey', 0 UNION ALL SELECT 'deliveries', 'channel,idempotency_key', (SELECT count(*) FROM (SELECT 1 FROM events GROUP BY event_id % 4000 HAVING count(*) > 1))""")
def _(v):
    return quality.audit_uniqueness({"documents": (v.table("documents").select("source", F.md5("text").alias("h")), ["source", "h"]), "orders": (v.table("orders"), ["o_orderkey"]), "deliveries": (v.deliveries, ["channel", "idempotency_key"])})


@query("audit_references", """SELECT 'lineitem.order' AS reference, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS dangling
UNION ALL SELECT 'orders.customer', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL SELECT 'labels.page', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT page_id FROM pages))""")
def _(v):
    t = v.table
    return quality.audit_references({
        "lineitem.order": (t("lineitem"), ["l_orderkey"], t("orders"), ["o_orderkey"]), "orders.customer": (t("orders"), ["o_custkey"], t("customer"), ["c_custkey"]), "labels.page": (t("labels"), ["doc_id"], t("pages"), ["page_id"]),
    })


@query("audit_item_dataset", """SELECT 'RAW_EVIDENCE' AS problem, source || '|' || md5(text) AS key FROM documents GROUP BY source, md5(text) HAVING count(*) > 1
UNION ALL SELECT 'EXTERNAL_ID', source || '|' || 'x' || (doc_id % 300) FROM documents GROUP BY source, doc_id % 300 HAVING count(*) > 1 UNION ALL SELECT 'LABEL_PAIR', doc_id::VARCHAR FROM documents WHERE (doc_id % 12 = 0) <> (doc_id % 6 = 0)""")
def _(v):
    i = F.col("doc_id")
    return quality.audit_item_dataset(v.table("documents").select(
        i.alias("fixture_id"), F.col("source").alias("source_id"), F.concat(F.lit("x"), (i % 300).cast("string")).alias("external_id"), F.md5("text").alias("content_hash"), F.when(i % 12 == 0, "g").alias("duplicate_group"), F.when(i % 6 == 0, "EXACT").alias("duplicate_kind"),
    ))


@query("dedup_quality", """WITH p AS (SELECT text AS rep, CASE WHEN doc_id % 4 <> 0 THEN text || (doc_id % 2) END AS g FROM documents), n AS (SELECT (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*) AS c FROM p GROUP BY rep)) AS predicted, (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*) AS c FROM p WHERE g IS NOT NULL GROUP BY g)) AS labelled)
SELECT predicted::BIGINT AS predicted, labelled::BIGINT AS labelled, labelled::BIGINT AS "both", labelled / predicted AS precision, labelled / labelled AS recall FROM n""")
def _(v):
    docs = v.table("documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("representative_id"), F.when(F.col("doc_id") % 4 != 0, F.concat(F.md5("text"), (F.col("doc_id") % 2).cast("string"))).alias("duplicate_group"))
    return quality.dedup_quality(docs, docs)


@query("quality_gates", """WITH v AS (SELECT 'duplicates' AS gate, 100.0 * (1 - count(DISTINCT text) / count(*)) AS value, 5.0 AS bound FROM documents UNION ALL SELECT 'parse_success', 100.0, 98.0 UNION ALL SELECT 'positive_sentiment', (SELECT 100.0 * count(*) FILTER (event_type = 'click') / count(*) FILTER (event_type IN ('click', 'error')) FROM events), 60.0)
SELECT gate, value::DOUBLE AS value, bound, CASE WHEN gate = 'duplicates' THEN value < bound ELSE value > bound END AS passed FROM v""")
def _(v):
    docs, e = v.table("documents"), F.col("event_type")
    values = docs.agg((100.0 * (1 - F.count_distinct("text") / F.count("*"))).alias("value")).select(F.lit("duplicates").alias("gate"), "value")
    values = values.unionByName(docs.agg((100.0 * F.count_if(F.col("text").isNotNull()) / F.count("*")).alias("value")).select(F.lit("parse_success").alias("gate"), "value"))
    mood = v.table("events").agg((100.0 * F.count_if(e == "click") / F.count_if(e.isin("click", "error"))).alias("value")).select(F.lit("positive_sentiment").alias("gate"), "value")
    return quality.quality_gates(values.unionByName(mood))


@query("stage_summary", f"WITH {RAW}, o AS (SELECT row_number() OVER (PARTITION BY source_id, h ORDER BY id) = 1 AS new FROM raw) SELECT 'raw_items' AS stage, count(*) AS input, count(*) FILTER (new) AS created, count(*) FILTER (NOT new) AS existing, 0 AS rejected FROM o")
def _(v):
    return quality.stage_summary({"raw_items": ingest.resolve_raw_identity(v.raw)})


def _operational(events: DataFrame) -> DataFrame:
    labels = F.create_map(F.lit("eventKind"), F.concat(F.lit(" "), F.upper("event_type")), F.lit("Shard"), (F.col("event_id") % 3).cast("string"))
    return events.select("ts", F.concat(F.lit("op"), F.initcap("event_type"), F.lit("Done")).alias("name"), labels.alias("labels"), (F.col("event_id") % 4).alias("value"))


@query("event_counters", "SELECT 'op_' || event_type || '_done_total' AS name, 'event_kind=' || event_type || ',shard=' || (event_id % 3) AS labels, sum(event_id % 4)::DOUBLE AS value FROM events WHERE event_id % 4 <> 0 GROUP BY 1, 2")
def _(v):
    return telemetry.event_counters(_operational(v.table("events")))


@query("read_rss_items", "SELECT 'g' || doc_id AS external_id, 'https://x.test/' || doc_id AS url, doc_id * 60 + 1767225600 AS at FROM documents WHERE doc_id % 10 <> 0")
def _(v):
    from leadloom.plans.lineage import new_table

    i, path = F.col("doc_id"), new_table(v.spark, "rss")
    when = F.timestamp_seconds(i * 60 + 1767225600)
    v.table("documents").select(
        F.struct(F.concat(F.lit("g"), i.cast("string")).alias("_VALUE"), F.lit("false").alias("_isPermaLink")).alias("guid"), F.when(i % 10 != 0, F.concat(F.lit("https://x.test/"), i.cast("string"))).alias("link"),
        F.concat(F.date_format(when, "E"), F.lit(", "), F.date_format(when, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT")).alias("pubDate"), F.concat(F.lit("Text of "), "source").alias("description"),
    ).write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(path)
    return readers.read_rss_items(v.spark, path)[0].select("external_id", "url", F.unix_timestamp("published_at").alias("at"))


@query("read_atom_items", "SELECT 'i' || doc_id AS external_id, 'https://x.test/' || doc_id AS url, source AS raw_text FROM documents")
def _(v):
    from leadloom.plans.lineage import new_table

    i, path = F.col("doc_id").cast("string"), new_table(v.spark, "atom")
    link = F.array(F.struct(F.lit("https://x.test/self").alias("_href"), F.lit("self").alias("_rel")), F.struct(F.concat(F.lit("https://x.test/"), i).alias("_href"), F.lit("alternate").alias("_rel")))
    v.table("documents").select(F.concat(F.lit("i"), i).alias("id"), link.alias("link"), F.col("source").alias("title"), F.lit("2026-01-01T00:00:00Z").alias("updated")).write.format("xml").option("rowTag", "entry").option("rootTag", "feed").save(path)
    return readers.read_atom_items(v.spark, path)[0].select("external_id", "url", "raw_text")


@query("read_item_dataset", "SELECT doc_id::VARCHAR AS id, source AS source_id, md5(text) AS digest FROM documents")
def _(v):
    from leadloom.plans.lineage import new_table

    i, path = F.col("doc_id").cast("string"), new_table(v.spark, "dataset")
    item = F.struct(i.alias("fixtureId"), F.col("source").alias("sourceId"), F.col("text").alias("rawText"))
    v.table("documents").groupBy(F.floor(F.col("doc_id") / 100)).agg(F.collect_list(item).alias("items")).select(F.lit("2026-01-01T00:00:00Z").alias("createdAt"), "items").write.option("maxRecordsPerFile", 1).json(path)
    return readers.read_item_dataset(v.spark, path)[1].select(F.col("fixtureId").alias("id"), F.col("sourceId").alias("source_id"), F.md5("rawText").alias("digest"))


@query("read_gold_dataset", f"WITH {GOLD} SELECT id::VARCHAR AS id, split, quote FROM gold")
def _(v):
    from leadloom.plans.lineage import new_table

    path = new_table(v.spark, "gold")
    item = F.struct(F.col("id").cast("string").alias("id"), "split", F.struct("text").alias("source"), F.struct("relevant", "facts").alias("labels"))
    v.gold.groupBy(F.floor(F.col("id") / 100)).agg(F.collect_list(item).alias("items")).select("items").write.option("maxRecordsPerFile", 1).json(path)
    return readers.read_gold_dataset(v.spark, path).select("id", "split", F.col("labels.facts")[0]["evidenceQuote"].alias("quote"))


@query("write_stage", "SELECT o_orderpriority AS category, count(*) AS n FROM orders GROUP BY 1")
def _(v):
    from leadloom.plans.lineage import new_table

    path = new_table(v.spark, "written")
    sinks.write_stage(v.recommendations.select("id", "category", "status"), path, partition_by=["category"])
    return readers.read_stage(v.spark, path, "id long, status string, category string").groupBy("category").agg(F.count("*").alias("n"))


@query("read_stage", "SELECT o_orderkey AS id, o_orderpriority AS category FROM orders WHERE o_orderstatus = 'F'")
def _(v):
    from leadloom.plans.lineage import new_table

    path = new_table(v.spark, "stage")
    sinks.write_stage(v.recommendations.select("id", "category", "status"), path, partition_by=["status"])
    return readers.read_stage(v.spark, path, "id long, category string, status string").filter("status = 'CANDIDATE'").select("id", "category")


def _landed(v: Views, rows: DataFrame, name: str) -> tuple[str, str]:
    """Rows as landed files for a stream, and a folder for its checkpoint."""
    from leadloom.plans.lineage import new_table

    path = new_table(v.spark, name)
    rows.write.parquet(path)
    return path, new_table(v.spark, f"{name}-state")


@query("stream_ingest", "SELECT source AS source_id, sha256(text) AS content_hash FROM documents GROUP BY ALL")
def _(v):
    from leadloom.plans.lineage import new_table
    from leadloom.streaming.jobs import stream_ingest

    path, state = _landed(v, v.raw.select("raw_item_id", "source_id", "raw_text", "received_at"), "landed")
    out, schema = new_table(v.spark, "ingested"), v.spark.read.parquet(path).schema
    for k in range(2):  # the second run replays the files with a new checkpoint
        stream_ingest(v.spark.readStream.schema(schema).parquet(path), out, f"{state}-{k}").awaitTermination()
    return v.spark.read.parquet(out).select("source_id", "content_hash")


@query("stream_counters", "SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, 'op_' || event_type || '_done_total' AS name, 'event_kind=' || event_type || ',shard=' || (event_id % 3) AS labels, sum(event_id % 4)::DOUBLE AS value FROM events WHERE event_id % 4 <> 0 GROUP BY 1, 2, 3")
def _(v):
    from leadloom.plans.lineage import new_table
    from leadloom.streaming.jobs import stream_counters

    end = v.spark.range(1).select(F.lit("2100-01-01").cast("timestamp").alias("ts"), F.lit("end").alias("name"), F.create_map(F.lit("k"), F.lit("v")).alias("labels"), F.lit(1).cast("long").alias("value"))
    path, state = _landed(v, _operational(v.table("events")).unionByName(end), "events")
    out = new_table(v.spark, "counters")
    live = stream_counters(v.spark.readStream.schema(v.spark.read.parquet(path).schema).parquet(path))
    live.writeStream.option("checkpointLocation", state).outputMode("append").format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.parquet(out).filter("name <> 'end_total'")


@query("stream_feedback", f"WITH {FEEDBACK} SELECT id FROM feedback")
def _(v):
    from leadloom.plans.lineage import new_table
    from leadloom.streaming.jobs import stream_feedback

    path, state = _landed(v, v.feedback, "feedback")
    out, schema = new_table(v.spark, "feedback-out"), v.spark.read.parquet(path).schema
    for k in range(2):
        stream_feedback(v.spark.readStream.schema(schema).parquet(path), out, f"{state}-{k}").awaitTermination()
    return v.spark.read.parquet(out).select("id")


def _sql_pipeline() -> str:
    """Counts of both runs of the pipeline: kept contents, tidied texts, clusters of equal and near texts, decisions of their earliest items, pairs with profiles."""
    lines = _sql_lines("kept", "doc_id")
    grams = _PAIRS.replace("FROM documents", "FROM norm")
    decided = DECIDED.removeprefix(SOURCES + ", ").replace("FROM documents JOIN sources", "FROM heads JOIN sources")
    word = "len(list_filter(string_split(t, ' '), lambda x: least(5, length(x), length(w)) >= 3 AND left(x, least(5, length(x), length(w))::INT) = left(w, least(5, length(x), length(w))::INT))) > 0"
    made = {
        "sources": "(SELECT count(*) FROM sources)", "profiles": "(SELECT count(*) FROM customer)", "raw_items": "(SELECT count(*) FROM kept)", "raw_conflicts": "0", "normalization": "(SELECT count(*) FROM kept)", "items": "(SELECT count(*) FROM norm)",
        "assignments": "(SELECT count(*) FROM norm)", "decisions": "(SELECT count(*) FROM heads)", "signals": "(SELECT count(*) FROM decided WHERE k = 5)", "analyses": "(SELECT count(*) FROM decided WHERE k = 5)", "recommendations": "(SELECT count(*) FROM pairs WHERE NOT excluded)",
    }
    refused = {"normalization": "(SELECT count(*) FROM kept) - (SELECT count(*) FROM norm)", "recommendations": "(SELECT count(*) FROM pairs WHERE excluded)"}
    rows = " UNION ALL ".join(f"SELECT '{stage}' AS stage, {n} AS n, {refused.get(stage, 0)} AS refused" for stage, n in made.items())
    return f"""WITH RECURSIVE {SOURCES},
kept AS (SELECT * FROM documents SEMI JOIN (SELECT min(doc_id) AS doc_id FROM documents JOIN sources ON source_id = source WHERE rights = 'OPEN_DATA' GROUP BY source, text) USING (doc_id)), {lines},
norm AS (SELECT doc_id, source, tidy.text AS text FROM kept JOIN tidy USING (doc_id)), {grams},
it AS (SELECT doc_id AS id, md5(text) AS h, vertical FROM norm JOIN sources ON source_id = source), nsym AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
links AS (SELECT a.id AS x, b.id AS y FROM it a JOIN nsym ON a.h = x JOIN it b ON b.h = y AND a.vertical = b.vertical AND abs(a.id - b.id) <= 1008 UNION SELECT id, min(id) OVER (PARTITION BY h) FROM it UNION SELECT min(id) OVER (PARTITION BY h), id FROM it),
reach(x, y) AS (SELECT DISTINCT x, x FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x), comp AS (SELECT x AS id, min(y) AS rep FROM reach GROUP BY x),
heads AS (SELECT norm.* FROM norm SEMI JOIN (SELECT DISTINCT rep AS doc_id FROM comp) USING (doc_id)), {decided},
terms AS (SELECT DISTINCT rep, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS t FROM comp JOIN norm ON doc_id = id),
words AS (SELECT DISTINCT CASE WHEN c_custkey % 7 = 0 THEN lower(c_mktsegment) ELSE 'none' END AS w FROM customer),
hits AS (SELECT DISTINCT rep, w FROM terms, words WHERE contains(t, w) OR contains(w, t) OR {word}),
pairs AS (SELECT rep IS NOT NULL AS excluded FROM decided JOIN customer ON vertical = CASE WHEN c_custkey % 2 = 0 THEN 'CONSTRUCTION' ELSE 'HORECA' END LEFT JOIN hits ON rep = id AND w = CASE WHEN c_custkey % 7 = 0 THEN lower(c_mktsegment) ELSE 'none' END WHERE k = 5),
made AS ({rows})
SELECT 0 AS pass, stage, n AS created, 0 AS existing, refused AS rejected FROM made UNION ALL SELECT 1, stage, 0, n, 0 FROM made"""


@query("run_pipeline", _sql_pipeline())
def _(v):
    from leadloom.plans.lineage import new_table
    from leadloom.plans.pipeline import run_pipeline

    people = v.profiles.filter("revision = 1").withColumns({"services_and_products": F.array(F.lit("tion")), "target_clients": F.array(F.lit("hotel"))})
    sources = v.sources.withColumn("regions", F.array(F.concat(F.lit("NATION_"), F.col("n").cast("string"))))
    out = new_table(v.spark, "pipeline")
    rows = []
    for k in range(2):
        counts = run_pipeline(v.spark, out, sources, v.raw, people, LATIN_RULES)
        rows += [(k, stage, c["created"], c["existing"], c["rejected"]) for stage, c in counts.items()]
    return v.spark.createDataFrame(rows, "pass int, stage string, created long, existing long, rejected long")

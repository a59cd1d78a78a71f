"""How far the sources of a language differ in their words: exact texts collapse first, sparse counts are compared."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.shared import as_bytes, cut, number_rows, read_documents, stored

#: A language keeps the terms of this many of its documents.
LEAST_DOCS = 10
#: Ranks of the terms that a source uses more than its language.
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Distinct (language, source, term) entries that a task holds before it passes them on.
HELD = 400_000
#: Bytes of terms, A-Z lowered, all others as blanks: letters, and all bytes of code points from U+0080.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, lang, held (source, copies) -> partial counts: lang, source, term, n, docs."""
    counts: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}
    size = 0

    def passed() -> Iterator[pa.RecordBatch]:
        for key, held in counts.items():
            terms, seen = list(held), docs[key]
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(terms)), pa.array([key[1]] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64()), pa.array([seen[t] for t in terms], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )

    for batch in batches:
        langs, holders = batch.column("lang").to_pylist(), batch.column("held").to_pylist()
        for text, lang, held in zip(as_bytes(batch.column("text")), langs, holders, strict=True):
            words = text.translate(_TERMS).split()
            if not words:
                continue
            weighed = Counter(words) if len(held) > 1 or held[0]["copies"] > 1 else None
            for one in held:
                key, copies = (lang, one["source"]), one["copies"]
                all_, each = counts.setdefault(key, Counter()), docs.setdefault(key, Counter())
                before = len(all_)
                if weighed is None:
                    all_.update(words)
                    each.update(set(words))
                else:
                    for term, n in weighed.items():
                        all_[term] += n * copies
                        each[term] += copies
                size += len(all_) - before
        if size > HELD:
            yield from passed()
            counts, docs, size = {}, {}, 0
    yield from passed()


def term_counts(docs: DataFrame, is_table: bool = False) -> tuple[DataFrame, DataFrame]:
    """(counts, members): lang, source, term, n, docs of all texts; each (lang, source) that occurs.

    Rows of one text in one language are one group with the number of its rows by source; only its first row is
    tokenised, and what it holds counts for each source as often as the source has the text. Groups are found by
    digests, so that a text of a third of all rows costs each task one row; a group lists its sources, not its rows.
    Tasks pass partial counts, a row for each of their sources of a term; these are dealt by language and term, and so
    stay for all that is summed by term afterwards.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = number_rows(docs.select("text", "lang", "source"), is_table).select("row_id", empty("text"), empty("lang"), empty("source"))
    each = rows.groupBy("lang", F.unhex(F.sha2("text", 256)).alias("sha"), "source").agg(F.count("*").alias("copies"), F.min("row_id").alias("first"))
    each = cut(each)
    held = F.collect_list(F.struct("source", "copies")).alias("held")
    groups = each.groupBy("lang", "sha").agg(F.min("first").alias("row_id"), held).drop("sha")
    texts = rows.select("row_id", "text").join(groups.hint("shuffle_hash"), "row_id").select("text", "lang", "held")
    parts = texts.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counts = parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return counts, each.select("lang", "source").distinct()


def _share(n: Column | str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exact; null without terms."""
    n = n if isinstance(n, Column) else F.col(n)
    wide = lambda x: x.cast("decimal(20,0)")
    parts = {"a": wide(n + 2), "b": wide(F.col(total) + 2 * F.col(terms))}
    quotient = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * parts["a"], F.when(F.col(terms) > 0, parts["b"]))
    return 1 + quotient


def _distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); below 10^18 for shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, is_table: bool = False) -> DataFrame:
    """lang, source, part, item, value, rank. Part pair: each other source of the language, by descending difference of
    their terms' shares; part term: the `top` terms that stand out from the language's shares.

    Only counts above 0 are stored. A pair's value is that of two sources without any terms (terms * a number), plus
    what the terms of either change against the other's zero share (taken by distinct share, not by term), plus what
    the terms that both have change again; so terms meet only the sources that hold them. Each pair of sources that a
    term makes is a pair of the result, summed in the task that makes it.

    Null text, lang and source are ''. Repeated rows count each. Ties in value go by item in code point order. A
    language without kept terms has pairs of value 0 and no terms; a source without terms is compared too. An empty
    table gives an empty result. Columns other than text, lang and source are not read. is_table: see number_rows.
    """
    counts, members = term_counts(docs, is_table)
    same = Window.partitionBy("lang", "term")  # a row for each source
    kept = counts.withColumns({"all_docs": F.sum("docs").over(same), "all_n": F.sum("n").over(same)}).filter(F.col("all_docs") >= least_docs)
    rows = stored(kept.select("lang", "source", "term", "n", "all_n"), "kept_counts")
    langs = rows.groupBy("lang", "term").agg(F.first("all_n").alias("all_n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("all_total"))
    sizes = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    totals = members.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("total"), zero("terms"), zero("all_total"))
    totals = cut(totals.withColumn("p0", _share(F.lit(0), "total", "terms")))
    shares = rows.join(totals, ["lang", "source"]).select("lang", "source", "term", _share("n", "total", "terms").alias("p"), "p0", _share("all_n", "all_total", "terms").alias("q"))
    shares = stored(shares, "shares")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    told = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    told = told.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    pair = ["lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b")]
    others = totals.select("lang", F.col("source").alias("other"), F.col("p0").alias("o0"))
    base = totals.join(others, "lang").filter("source < other")
    base = base.select(*pair, F.when(F.col("terms") > 0, F.col("terms") * _distance(F.col("p0"), F.col("o0"))).otherwise(0).alias("v"))
    by_share = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("k"))
    alone = by_share.join(others, "lang").filter("source <> other")
    alone = alone.select(*pair, (F.col("k") * (_distance(F.col("p"), F.col("o0")) - _distance(F.col("p0"), F.col("o0")))).alias("v"))
    two = shares.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("o"), F.col("p0").alias("o0"))
    both = shares.join(two, ["lang", "term"]).filter("source < other")
    p, p0, o, o0 = (F.col(c) for c in ("p", "p0", "o", "o0"))
    both = both.select(*pair, (_distance(p, o) - _distance(p, o0) - _distance(p0, o) + _distance(p0, o0)).alias("v"))
    total = lambda df: df.groupBy("lang", "a", "b").agg(F.sum("v").alias("v"))
    pairs = cut(total(base.unionByName(total(alone)).unionByName(total(both))))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")
    ranked = pairs.select("lang", sides, F.col("v").alias("value")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    ranked = ranked.withColumn("rank", F.row_number().over(best))
    return ranked.unionByName(told).select("lang", "source", "part", "item", "value", "rank")


def op11(spark, sf_dir: str) -> DataFrame:
    return source_divergence(read_documents(spark, sf_dir), is_table=True)


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
o AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS all_n FROM o GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(all_n)::HUGEINT AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT o.lang, o.source, o.term, count(*)::HUGEINT AS n FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.all_n + 2)) // (l.total + 2 * l.v) AS q
 FROM g JOIN k ON g.lang = k.lang JOIN l ON l.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
t AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
w AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM r UNION ALL SELECT * FROM t))
SELECT * FROM w WHERE part = 'pair' OR rank <= 10
"""

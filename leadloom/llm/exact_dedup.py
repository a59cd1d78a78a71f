"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.shared import cut, join_counted, number_rows, read_documents


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128, is_table: bool = False) -> DataFrame:
    """One row per input row: row_id, doc_id, keep_id, group_size, kept, text_sha256.

    Lengths that occur once drop out first, then (length, prefix hash) pairs that occur once; only rows of the groups
    that survive are grouped by the hash of their full content. The digest of each row is a result, so lengths, prefix
    hashes and digests are taken in one scan; no text is shuffled. Every level counts with map-side combination, and
    rows meet the counts of hot keys by a bounded broadcast, so a group of a third of all rows burdens no task.

    Null text counts as empty. Of equal texts the row with the largest id stays; of repeated rows with that id, the
    one read last (row_id). Null ids are smallest. An empty table gives an empty result. Other columns are ignored.
    is_table: docs is read from files; see number_rows.
    """
    rows = number_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), is_table)
    return _refined(rows, prefix_chars)


def _refined(rows: DataFrame, prefix_chars: int) -> DataFrame:
    """rows: row_id, doc_id, text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(rows.select(
        "row_id", "doc_id", F.octet_length(text).alias("n_bytes"),
        F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix"), F.unhex(F.sha2(text, 256)).alias("sha"),
    ))
    total = rows.count()
    alone = []
    for key in (["n_bytes"], ["n_bytes", "prefix"]):
        sizes = rows.groupBy(*key).agg(F.count("*").alias("size")).filter("size > 1")
        marked = cut(join_counted(rows, sizes, key, "size", total))
        alone.append(marked.filter("size is null").select("row_id", "doc_id", "sha"))
        rows = marked.filter("size is not null").drop("size")
    groups = rows.groupBy("sha").agg(F.max(F.struct("doc_id", "row_id")).alias("keep"), F.count("*").alias("group_size"))
    same = join_counted(rows.select("row_id", "doc_id", "sha"), groups, ["sha"], "group_size", total)
    digest = F.lower(F.hex("sha")).alias("text_sha256")
    out = same.select("row_id", "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("keep.row_id")).alias("kept"), digest)
    for one in alone:
        out = out.unionByName(one.select("row_id", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest))
    return out


def drop_copies(docs: DataFrame, prefix_chars: int = 128, is_table: bool = False) -> DataFrame:
    """The rows that exact_dedup keeps, with all their columns: of equal texts the row with the largest id (of those the one
    read last), whatever else shares its id.

    is_table: docs is read from files; see number_rows.
    Null text counts as empty. An empty table gives an empty result.
    """
    rows = number_rows(docs, is_table, "_ll_row")
    away = _refined(rows.select(F.col("_ll_row").alias("row_id"), "doc_id", "text"), prefix_chars).filter("not kept").select(F.col("row_id").alias("_ll_row"))
    return rows.join(away.hint("shuffle_hash"), "_ll_row", "left_anti").select(*docs.columns)


def op10(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(read_documents(spark, sf_dir), is_table=True).drop("row_id")


OP10_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

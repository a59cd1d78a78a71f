"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark, merged to maximal intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.shared import Words, as_bytes, chunks, cut, mix, read_documents, with_row_ids

WINDOW = 20
#: Words of an anchor. Each window's anchor is its anchor-length part of least hash, so equal windows have equal anchors.
ANCHOR = 8
#: A run of windows is a number: its first window, and in the lowest bits how many they are.
ANCHOR_BITS = 16


def anchors_of(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of adjacent windows with one anchor place: text, first window, number of windows, hash of the anchor."""
    parts, first = words.grams(anchor)
    span = window - anchor + 1
    n = np.maximum(np.diff(first) - span + 1, 0)  # windows of each text
    start = np.concatenate(([0], np.cumsum(n)))
    if not start[-1]:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(start[-1]) + (first[:-1] - start[:-1])[text]  # in parts, of each window's first word
    place = at + sliding_window_view(parts, span)[at].argmin(axis=1)
    new = np.concatenate(([True], (np.diff(place) != 0) | (np.diff(text) != 0)))
    runs = np.flatnonzero(new)
    return text[runs], runs - start[text[runs]], np.diff(np.concatenate((runs, [start[-1]]))), parts[place[runs]]


def repeats_inside(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows, start of each text's windows, and which windows occur earlier in their own text."""
    one, first = words.grams(window)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    again = np.ones(len(one), bool)
    again[np.unique(one ^ mix(text.astype(np.uint64) + np.uint64(1)), return_index=True)[1]] = False
    return one, first, again


def _anchor_rows(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, row_id = as_bytes(batch.column("text")), batch.column("row_id").to_numpy(zero_copy_only=False)
            for lo, hi in chunks(texts):
                text, first, n, value = anchors_of(Words(texts[lo:hi]), window, anchor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row_id[lo + text]), pa.array(first << ANCHOR_BITS | n), pa.array((value >> np.uint64(16)).view(np.int64))],
                    names=["row_id", "run", "anchor"],
                )

    return rows.mapInArrow(run, "row_id long, run long, anchor long")


def _window_rows(rows: DataFrame, window: int) -> DataFrame:
    """Windows of the candidate runs, the first of each kind in a document: two hashes, id, row, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            row_id, doc_id = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row_id", "doc_id"))
            runs = batch.column("runs")
            ends, flat = np.asarray(runs.offsets), np.asarray(runs.values)
            firsts, counts = flat >> ANCHOR_BITS, flat & ((1 << ANCHOR_BITS) - 1)
            for lo, hi in chunks(texts):
                words = Words(texts[lo:hi])
                one, first, again = repeats_inside(words, window)
                two, _ = Words(texts[lo:hi], which=1).grams(window, 1)
                mine = slice(ends[lo], ends[hi])
                text = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
                begin, n = first[text] + firsts[mine], counts[mine]
                at = np.repeat(begin - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
                of = np.repeat(text, n) if len(n) else np.zeros(0, np.int64)
                new = ~again[at]
                at, of = at[new], of[new]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(one[at].view(np.int64)), pa.array((two[at] >> np.uint64(48)).astype(np.uint16).view(np.int16)),
                        pa.array(doc_id[lo + of]), pa.array(row_id[lo + of]), pa.array((at - first[of]).astype(np.int32)),
                    ],
                    names=["one", "two", "doc_id", "row_id", "start"],
                )

    return rows.mapInArrow(run, "one long, two short, doc_id long, row_id long, start int")


def intervals(removed: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of removed words, end exclusive."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], removed, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False, is_table: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256; with_text adds kept (text) and removed (intervals).

    Every window of `window` words is hashed. A window is a repeat if its words also start earlier: in a smaller id,
    or earlier in the same document. All words that repeats cover go; adjacent ones merge into maximal intervals.

    Equal windows have equal anchors, so only windows whose anchor is counted twice or more are counted themselves:
    that leaves out no repeat and spares most of the shuffle. Windows are compared by 80 bits of two
    independent hashes of their words (words of more than 64 bytes by digest). Whole copies of a
    text are found by its digest first and count for nothing else: whatever they repeat or have repeated, their
    first one does too. Counts combine map-side; joins on a common passage can be split by Spark.

    is_table: see number_rows. Null text has no words. Documents shorter than a window keep all. Null ids are smallest; rows that share an id do
    not take words from each other, except whole copies of the same text, of which the first read stays. An empty
    table gives an empty result.
    """
    # all joins on row_id take the same columns, under the same names, of rows whose row_id cannot be null (no filter), so that text is shuffled once for all
    rows = with_row_ids(docs, is_table).select(F.coalesce("row_id", F.lit(-1).cast("long")).alias("row_id"), "doc_id", "text")
    least = F.coalesce("doc_id", F.lit(-(2**63)))
    digest = rows.select("row_id", least.alias("doc_id"), F.unhex(F.sha2("text", 256)).alias("sha"))
    firsts = digest.groupBy("sha").agg(F.min(F.struct("doc_id", "row_id")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = cut(digest.join(firsts, "sha").filter("row_id <> first.row_id").select("row_id"))

    fresh = rows.join(copies, "row_id", "left_anti").select("row_id", "doc_id", "text")
    anchors = _anchor_rows(fresh, window, anchor)
    common = anchors.groupBy("anchor").count().filter("count > 1").select("anchor")
    runs = anchors.join(common, "anchor").groupBy("row_id").agg(F.collect_list("run").alias("runs"))
    windows = _window_rows(rows.join(runs, "row_id").select("row_id", least.alias("doc_id"), "text", "runs"), window)
    earliest = windows.groupBy("one", "two").agg(F.min("doc_id").alias("least"))
    repeats = windows.join(earliest, ["one", "two"]).filter("doc_id > least")
    starts = repeats.groupBy("row_id").agg(F.collect_list("start").alias("starts"))
    joined = rows.join(starts, "row_id", "left").join(copies.withColumn("copy", F.lit(True)), "row_id", "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, removed array<struct<start:int,end:int>>" * with_text

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts, copy = as_bytes(batch.column("text")), batch.column("starts").to_pylist(), batch.column("copy").to_pylist()
            out: list[list] = [[] for _ in range(5)]
            for lo, hi in chunks(texts):
                words = Words(texts[lo:hi])
                _, first, again = repeats_inside(words, window)
                for i in range(lo, hi):
                    each = texts[i].split()
                    bad = again[first[i - lo] : first[i - lo + 1]].copy()
                    if copy[i]:
                        bad[:] = True
                    elif starts[i]:
                        bad[starts[i]] = True
                    gone = np.zeros(len(each), bool)
                    if bad.any():
                        change = np.zeros(len(each) + 1, np.int64)
                        change[: len(bad)] += bad
                        change[window : window + len(bad)] -= bad
                        gone = np.cumsum(change)[:-1] > 0
                        each = [each[j] for j in np.flatnonzero(~gone)]
                    kept = b" ".join(each)
                    for column, x in zip(out, (len(gone), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None, gone)):
                        column.append(x)
            columns = [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            if with_text:
                spans = [[{"start": a, "end": b} for a, b in intervals(g)] for g in out[4]]
                columns += [pa.array(out[3], pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "removed"][: len(columns)])

    return joined.select("doc_id", "text", "starts", "copy").mapInArrow(keep, schema)


def op2(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read_documents(spark, sf_dir), is_table=True)


OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS s FROM d WHERE len(w) >= 20)),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, s + o AS p FROM rep, (SELECT unnest(generate_series(0, 19)) AS o)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

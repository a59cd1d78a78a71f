"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.shared import mix, partitions, read_documents

#: Words of a paragraph cell; longer paragraphs are cut after every so many words from their start.
CELL_WORDS = 12
#: Cells of the sketch in a fingerprint, and hashes of each digest.
CELLS, HASHES = 48, 3
#: Differences are taken with sketches of up to so many doublings of CELLS; each retry doubles.
DOUBLINGS = 12
ROUNDS = 60
#: Text of a range of ids, and most ranges (their bounds, 8 bytes each, are part of the plan); a task streams through its ranges.
RANGE_BYTES, MOST_RANGES = 64 << 20, 1 << 16


def digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests of a text's paragraph cells. Lines are paragraphs; a blank line is none."""
    cells = []
    for line in text.split("\n"):
        words = line.split(" ")
        for i in range(0, len(words), CELL_WORDS):
            cell = " ".join(words[i : i + CELL_WORDS])
            if cell.strip():
                cells.append(cell)
    blake = hashlib.blake2b
    joined = b"".join([blake(c.encode("utf-8", "surrogatepass"), digest_size=8).digest() for c in dict.fromkeys(cells)])
    return np.unique(np.frombuffer(joined, np.uint64))


def places(keys: np.ndarray, cells: int) -> np.ndarray:
    """The HASHES different cells of each key: one in each part of the sketch."""
    part = cells // HASHES
    return np.stack([(mix(keys + np.uint64(7919 * (i + 1))) % np.uint64(part)).astype(np.int64) + i * part for i in range(HASHES)])


def check(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ np.uint64(0x5851F42D4C957F2D))


def sketch(sets: list[np.ndarray], cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, key sums and check sums (both by exclusive or) of the cells of each set."""
    n = len(sets)
    count, key, sums = np.zeros(n * cells, np.int64), np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64)
    keys = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    base = np.repeat(np.arange(n) * cells, [len(s) for s in sets])
    checks = check(keys)
    for at in places(keys, cells):
        np.add.at(count, base + at, 1)
        np.bitwise_xor.at(key, base + at, keys)
        np.bitwise_xor.at(sums, base + at, checks)
    return count.reshape(n, cells), key.reshape(n, cells), sums.reshape(n, cells)


_CELL = np.dtype([("count", ">u2"), ("key", ">u8"), ("check", ">u8")])


def fingerprint(count: np.ndarray, key: np.ndarray, sums: np.ndarray) -> list[str]:
    """Sketches as hexadecimal text: of each cell the count (modulo 2^16) and the whole key and check sums."""
    packed = np.zeros(count.shape, _CELL)
    packed["count"], packed["key"], packed["check"] = count & 0xFFFF, key, sums
    return [row.tobytes().hex() for row in packed]


def subtract(left: str, right: str) -> tuple[set[int], set[int]] | None:
    """Digests that only the left and only the right text has, recovered from two stored fingerprints alone.

    None if peeling gets stuck: then make both again with more cells.
    """
    a, b = (np.frombuffer(bytes.fromhex(x), _CELL) for x in (left, right))
    count = (a["count"].astype(np.int64) - b["count"].astype(np.int64) + 0x8000) % 0x10000 - 0x8000
    key, sums = (a[c].astype(np.uint64) ^ b[c].astype(np.uint64) for c in ("key", "check"))
    keys, sign, _, clean = peel(count, key, sums, len(a))
    return ({int(k) for k in keys[sign > 0]}, {int(k) for k in keys[sign < 0]}) if clean[0] else None


def peel(count: np.ndarray, key: np.ndarray, sums: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests in subtracted sketches that lie one after another, their signs, which sketch each is of, and which came out empty."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        pure = np.flatnonzero((np.abs(count) == 1) & (check(key) == sums))
        if not len(pure):
            break
        _, once = np.unique(key[pure] ^ mix((pure // cells).astype(np.uint64) + np.uint64(1)), return_index=True)
        at = pure[once]
        keys, sign, pair = key[at], count[at], at // cells
        found.append((keys, sign, pair))
        checks = check(keys)
        for place in places(keys, cells):
            np.add.at(count, pair * cells + place, -sign)
            np.bitwise_xor.at(key, pair * cells + place, keys)
            np.bitwise_xor.at(sums, pair * cells + place, checks)
    clean = ~((count != 0) | (key != 0) | (sums != 0)).reshape(-1, cells).any(axis=1)
    keys, sign, pair = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64))
    return keys, sign, pair, clean


def differences(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of sets how many digests only the left and only the right one has, and the cells that sufficed.

    The first sketches are those of the fingerprints. They are subtracted cell by cell; cells that hold one digest are
    peeled until none is left. Pairs that do not come out empty are tried again with twice the cells. Batches of pairs
    are peeled together.
    """
    n = len(left)
    only_left, only_right, used = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    todo = np.arange(n)
    for doubling in range(DOUBLINGS):
        if not len(todo):
            break
        cells = CELLS << doubling
        for lo in range(0, len(todo), max(1, (1 << 18) // cells)):
            some = todo[lo : lo + max(1, (1 << 18) // cells)]
            a, b = sketch([left[i] for i in some], cells), sketch([right[i] for i in some], cells)
            _, sign, pair, clean = peel((a[0] - b[0]).ravel(), (a[1] ^ b[1]).ravel(), (a[2] ^ b[2]).ravel(), cells)
            got = np.stack([np.bincount(pair[sign > 0], minlength=len(some)), np.bincount(pair[sign < 0], minlength=len(some))])
            done = some[clean]
            only_left[done], only_right[done], used[done] = got[0, clean], got[1, clean], cells
        todo = todo[used[todo] == 0]
    for i in todo:  # larger than the largest sketch: the sets themselves
        same = len(np.intersect1d(left[i], right[i], assume_unique=True))
        only_left[i], only_right[i] = len(left[i]) - same, len(right[i]) - same
    return only_left, only_right, used


def likeness(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Twice the common digests over the digests of both sets of each pair; 1 for two empty sets."""
    a, b, _ = differences(left, right)
    size = np.array([len(x) + len(y) for x, y in zip(left, right)])
    return np.where(size > 0, (size - a - b) / np.maximum(size, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The last half of text replaced by the first as many code points of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def range_of(value: Column, bounds: list) -> Column:
    """Number of the ascending bounds that a value reaches, by binary search."""
    if not bounds:
        return F.lit(0)
    n, steps = len(bounds), [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    table = F.lit(bounds)

    def step(at: Column, by: Column) -> Column:
        return F.when((at + by <= n) & (F.element_at(table, F.least(at + by, F.lit(n))) <= value), at + by).otherwise(at)

    return F.aggregate(F.lit(steps), F.lit(0), step)


def fingerprint_documents(docs: DataFrame, pieces: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are dealt to ranges of ids; the first row of each range goes to the range before it as well, and the
    very first to the last one, so that each task sees the next document of all its own in one pass. Of the ids only
    the bounds and first ids of the ranges come to the driver.

    Null text is empty; an empty text has an empty set of digests and is like an empty one. Of repeated rows each
    follows the other in an order by text; they share a range, which one task streams through. Rows with a null id come
    before all others. A single document is followed by itself. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    least = F.coalesce("doc_id", F.lit(-(2**63)))
    ids = rows.select(least.alias("id"))
    if pieces is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        pieces = max(2 * partitions(spark), min(MOST_RANGES, size // RANGE_BYTES))
    marks = ids.agg(F.percentile_approx("id", [i / pieces for i in range(1, pieces)] or [0.5], max(10000, 20 * pieces)).alias("q"), F.count("*").alias("n")).first()
    bounds = sorted(set(marks["q"] or []))
    placed = rows.withColumn("_id", least).withColumn("piece", range_of(F.col("_id"), bounds))
    firsts = {r["piece"]: r["id"] for r in placed.groupBy("piece").agg(F.min("_id").alias("id")).collect()}  # a row for each range
    order = sorted(firsts)
    earlier = {p: order[i - 1] for i, p in enumerate(order)}  # the very first row follows the last one
    opens = F.col("_id") == F.element_at(F.lit([firsts.get(p, -1) for p in range(len(bounds) + 1)]), F.col("piece") + 1)
    follows = F.element_at(F.lit([earlier.get(p, 0) for p in range(len(bounds) + 1)]), F.col("piece") + 1)
    own = F.struct(F.col("piece").alias("piece"), F.lit(0).alias("ahead"))
    copies = F.when(opens, F.array(own, F.struct(follows.cast("int").alias("piece"), F.lit(1).alias("ahead")))).otherwise(F.array(own))
    dealt = placed.withColumn("to", F.explode(copies)).select("doc_id", "text", "_id", "to.piece", "to.ahead")
    dealt = dealt.repartition(pieces, "piece").sortWithinPartitions("piece", "ahead", "_id", "text")

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def results(ids: list, texts: list[str], following: list[str], sets: list[np.ndarray], next_sets: list[np.ndarray]) -> pa.RecordBatch:
        changed = [edited(t, f) for t, f in zip(texts, following)]
        changed_sets = [digests(t) for t in changed]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array(fingerprint(*sketch(sets, CELLS)), pa.string()), pa.array(fingerprint(*sketch(changed_sets, CELLS)), pa.string()),
                pa.array(likeness(sets, changed_sets), pa.float64()), pa.array(likeness(sets, next_sets), pa.float64()),
            ],
            names=[x.split()[0] for x in schema.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # piece, id, text, digests, ahead of the row before
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("piece", "doc_id", "text", "ahead")]
            for piece, doc_id, text, ahead in zip(*columns):
                own = digests(text)
                if held is not None and held[0] == piece and not held[4]:
                    for kept, new in zip(out, (held[1], held[2], text, held[3], own)):
                        kept.append(new)
                    if len(out[0]) == 256:
                        yield results(*out)
                        out = ([], [], [], [], [])
                held = (piece, doc_id, text, own, ahead)
        if out[0]:
            yield results(*out)

    return dealt.mapInArrow(run, schema)


def op7(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read_documents(spark, sf_dir))

"""Small helpers that the operators of this package share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.plans.lineage import cut, new_table, shared_dir, small_batches, stored

__all__ = ["cut", "new_table", "shared_dir", "stored"]

#: Code points that separate words: space and U+0009 to U+000D.
SPACES = r"\x20\x09-\x0D"
#: Longer words (in bytes) are hashed by a cryptographic digest.
LONG = 64
#: Byte budget of one vectorised step inside a task.
CHUNK_BYTES = 1 << 20


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Files of a table that are numbered by a broadcast list; rows of more files are written to the shared folder once.
MOST_FILES = 50_000
#: Bits of a row's place in its file.
PLACE_BITS = 40


def number_rows(docs: DataFrame, is_table: bool = False, name: str = "row_id") -> DataFrame:
    """docs with a number for each row (column name) that stays the same in every later plan, however scans are split.

    is_table: docs is read from Parquet files, whose rows are named by file and place in it; files are numbered in the
    order of their paths. Other rows may come in another order each time, so they are written to the shared folder
    first, and so are those of more than MOST_FILES files. Cells of a cut table have fixed places.
    """
    if is_table:
        files = [r[0] for r in docs.select("_metadata.file_path").distinct().limit(MOST_FILES + 1).collect()]
        if len(files) <= MOST_FILES:
            paths = docs.sparkSession.createDataFrame([(p, i) for i, p in enumerate(sorted(files))], "_ll_file string, _ll_number long")
            placed = docs.select("*", F.col("_metadata.file_path").alias("_ll_file"), F.col("_metadata.row_index").alias("_ll_place"))
            number = F.shiftleft("_ll_number", PLACE_BITS) + F.col("_ll_place")
            return placed.join(F.broadcast(paths), "_ll_file").select(*docs.columns, number.alias(name))
    return cut(docs).withColumn(name, F.monotonically_increasing_id())


def with_row_ids(docs: DataFrame, is_table: bool) -> DataFrame:
    """row_id, doc_id, text (null as empty) of docs; row ids stay the same however often and by whom the rows are read."""
    rows = number_rows(docs.select("doc_id", "text"), is_table)
    return rows.select("row_id", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(doc_id.cast("string")) % 3


def n_words(text: Column) -> Column:
    """Number of maximal runs of non-separators; 0 for null. Native."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(rf"[^{SPACES}]+")).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """rows left join keys, where size is the number of rows of a key.

    Keys of more than 1/1024 of all rows, of which there are fewer than 1024, are broadcast: no task gets a hot key.
    """
    hot = F.broadcast(keys.filter(F.col(size) * 1024 > total))
    rare = keys.filter(F.col(size) * 1024 <= total)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(rare, on, "left"))


# ---------------------------------------------------------------- vectorised hashing inside tasks

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20240501)
#: Two independent families: of each a number for each byte, and a base.
_BYTES = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _BYTES[0]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser, so that all bits of a polynomial hash count."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of a base and of its inverse modulo 2^64."""
    if which not in _powers or len(_powers[which][0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        base = _BASES[which]
        out = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.empty(size, dtype=np.uint64)
            p[0] = 1
            done = 1
            while done < size:  # doubling: p[done + i] = p[i] * b^done
                step = min(done, size - done)
                p[done : done + step] = p[:step] * np.uint64(pow(b, done, 2**64))
                done += step
            out.append(p)
        _powers[which] = (out[0], out[1])
    return _powers[which]


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Rabin-Karp hashes modulo 2^64 of values[start:end], from one pass of prefix sums."""
    power, inverse = _power(len(values), which)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


class Words:
    """Words of some texts: hashes, and for each text the range of its words.

    Polynomial hashes modulo 2^64 are blind to some differences between long strings, so words of more than LONG bytes
    have a part of a cryptographic digest as their hash. which names one of two independent families of hashes.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, which: int = 0):
        buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        if lower:
            buf = _LOWER[buf]
        gap = _SPACE[buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).view(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.hash = rolling(_BYTES[which][buf], self.starts, self.ends, which)
        for i in np.flatnonzero(self.ends - self.starts > LONG):
            digest = hashlib.blake2b(buf[self.starts[i] : self.ends[i]].tobytes(), digest_size=16).digest()
            self.hash[i] = np.frombuffer(digest, np.uint64)[which]
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.starts, at)
        self.buf, self.at = buf, at

    def grams(self, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows within a text, and for each text the start of its windows."""
        counts = np.diff(self.first)
        n = np.maximum(counts - k + 1, 0)
        first = np.concatenate(([0], np.cumsum(n)))
        starts = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], n)
        return rolling(self.hash, starts, starts + k, which), first


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some bytes together; a longer text is alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]

"""Language identification by the nearest of several clustered centroids per language."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.shared import _LOWER, chunks, fold, mix, read_documents

#: Hashed features: byte 2-grams and 3-grams of the lowered text, in this many buckets.
FEATURES = 4096
#: Rows of each language that centroids are clustered from (those with the smallest digests of their ids), and of all.
SAMPLE_PER_LANGUAGE = 400
SAMPLE = 4000
CENTROIDS = 4
#: A text is rejected if it is farther from its centroid than this share of the sample, by this margin.
FAR_SHARE, FAR_MARGIN = 0.99, 0.15
UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]")
#: Bytes below 128 that are no letters count as one: a gap between words.
_PLAIN = np.where((np.arange(256) < 128) & ~np.isin(_LOWER, np.arange(97, 123)), 32, _LOWER).astype(np.uint64)
_BUCKET = np.uint64(64 - int(np.log2(FEATURES)))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _LETTERS.finditer(text))


def frequencies(texts: list[bytes]) -> np.ndarray:
    """Square roots of the n-gram counts of each text, by bucket."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for lo, hi in chunks(texts, 1 << 19):
        buf = _PLAIN[np.frombuffer(b" ".join([b"", *texts[lo:hi], b""]), np.uint8)]
        of = np.repeat(np.arange(hi - lo), [len(t) + 1 for t in texts[lo:hi]])
        pair = buf[:-1] * np.uint64(257) + buf[1:] + np.uint64(1 << 20)
        three = pair[:-1] * np.uint64(263) + buf[2:]
        n = len(of)
        for grams in (pair[:n], three[: n - 1]):
            at = of[: len(grams)] * FEATURES + (mix(grams) >> _BUCKET).astype(np.int64)
            out[lo:hi] += np.bincount(at, minlength=(hi - lo) * FEATURES).reshape(hi - lo, FEATURES)
    return np.sqrt(out)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit rows by cosine: the farthest rows start, means follow. Deterministic."""
    seeds = [0]
    while len(seeds) < min(k, len(x)):
        near = (x @ x[seeds].T).max(axis=1)
        if near.min() > 1 - 1e-6:
            break
        seeds.append(int(near.argmin()))
    c = x[seeds]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = unit(np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))]))
    return c


class Centroids:
    def __init__(self, idf: np.ndarray, languages: list[str], centers: np.ndarray, radius: np.ndarray):
        self.idf, self.languages, self.centers, self.radius = idf, languages, centers, radius

    def nearest(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the nearest centroid, its cosine, and whether it is too far from it."""
        cosine = unit(frequencies(texts) * self.idf) @ self.centers.T
        best = cosine.argmax(axis=1)
        near = cosine[np.arange(len(texts)), best]
        return best, near, 1 - near > self.radius[best]


def learn(
    docs: DataFrame, lang_col: str = "lang", sample_per_language: int = SAMPLE_PER_LANGUAGE, sample: int = SAMPLE, centroids: int = CENTROIDS
) -> Centroids | None:
    """Centroids from rows whose fold is not 1 and that have a language and a letter; None without such rows.

    Document frequencies are of all these rows, summed in Spark in the same scan as the sizes of the languages, of which
    one row each comes to the driver. The centroids come from a bounded sample:
    sample_per_language rows of each language, sample rows in all at most; its vectors come to the driver.
    """
    spark = docs.sparkSession
    rows = docs.filter(F.col(lang_col).isNotNull() & F.coalesce(fold(F.col("doc_id")) != 1, F.lit(False)) & F.col("text").rlike(r"\p{L}"))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), "text")

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with each feature, and, where at is null, rows of each language."""
        df, languages = np.zeros(FEATURES, np.int64), Counter()
        for batch in batches:
            texts = [x.encode() for x in batch.column("text").to_pylist()]
            for lo in range(0, len(texts), 256):
                df += (frequencies(texts[lo : lo + 256]) > 0).sum(axis=0)
            languages.update(batch.column("lang").to_pylist())
        if languages:
            at, names = [*range(FEATURES), *[None] * len(languages)], [*[None] * FEATURES, *languages]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(names, pa.string()), pa.array([*df.tolist(), *languages.values()], pa.int64())], names=["at", "lang", "n"])

    counts = rows.select("lang", "text").mapInArrow(presence, "at long, lang string, n long").groupBy("at", "lang").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    if not len(counts):
        return None
    features, sizes = counts[counts["at"].notna()], counts[counts["at"].isna()]
    df = np.zeros(FEATURES)
    df[features["at"].astype(int)] = features["n"]
    idf = (np.log((sizes["n"].sum() + 1) / (df + 1)) + 1).astype(np.float32)
    languages = sorted(sizes["lang"])
    each = max(1, min(sample_per_language, sample // len(languages)))
    # digests below a language's bound are about 4 * each rows, so the window below meets a bounded number of rows
    bounds = spark.createDataFrame([(x, min(1.0, 4 * each / int(n))) for x, n in zip(sizes["lang"], sizes["n"])], "lang string, bound double")
    digest = F.md5(F.col("doc_id").cast("string"))
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("digest", "doc_id"))
    chosen = rows.join(F.broadcast(bounds), "lang").filter(share < F.col("bound")).withColumn("digest", digest)
    chosen = chosen.withColumn("rank", rank).filter(F.col("rank") <= each).select("lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(frequencies([t.encode() for t in batch.column("text").to_pylist()]) * idf)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "v"])

    got = chosen.mapInArrow(vectors, "lang string, v binary").toArrow().to_pandas()
    names, centers, radius = [], [], []
    for name in languages:
        x = np.stack([np.frombuffer(v, np.float32) for v in sorted(got["v"][got["lang"] == name])])
        c = cluster(x, centroids)
        near = x @ c.T
        far = 1 - near.max(axis=1)
        centers.append(c)
        names += [name] * len(c)
        radius += [float(np.quantile(far, FAR_SHARE)) + FAR_MARGIN] * len(c)
    return Centroids(idf, names, np.concatenate(centers), np.array(radius))


def identify_language(docs: DataFrame, reject: bool = False, **how) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, rejected.

    Each whole text becomes a normalised TF-IDF vector of its n-grams and gets the language of the centroid with the
    largest cosine, which is the score. A text too far from that centroid, by the distances in the sample, is marked
    rejected; with reject its language is und.

    Text that is null or has no letter: und, score 0, not rejected. Where nothing could be learned, all are und.
    Rows with null ids are predicted, not held out and not learned from. Repeated rows are predicted each.
    """
    model = learn(docs, **how)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            known = np.array([model is not None and has_letter(t) for t in texts], bool)
            names, score, far = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts), bool)
            at = np.flatnonzero(known)
            for lo in range(0, len(at), 256):
                some = at[lo : lo + 256]
                best, near, out = model.nearest([texts[i].encode() for i in some])
                names[some] = [model.languages[b] for b in best]
                score[some], far[some] = np.clip(near, 0, 1), out
            if reject:
                names[far] = UNKNOWN
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(far)],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        predict, "doc_id long, lang_pred string, score double, rejected boolean"
    )
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op1(spark, sf_dir: str) -> DataFrame:
    return identify_language(read_documents(spark, sf_dir))

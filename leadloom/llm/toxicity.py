"""Toxicity by class-conditional Kneser-Ney models over the beginnings of words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from leadloom.llm.shared import _BYTE, as_bytes, chunks, cut, fold, mix, read_documents, rolling

#: The sample that is learned from is bounded: so many labelled texts of each class, those with the smallest digests of
#: their ids, and so many bytes of them; a text of more than a tenth of these bytes is not taken into the sample.
SAMPLE_PER_CLASS, SAMPLE_BYTES = 3000, 12 << 20
#: Order of the models: a byte, or the end of a word, is predicted from up to ORDER - 1 bytes of the word before it.
ORDER = 12
#: Bytes of a word before a byte in the highest level of the shared continuation counts; each level below takes one byte less.
CHAIN = 4
#: Shares of its words that a toxic text may take from the toxic model, the others from the ordinary one; 1 is the plain comparison
#: of both classes. Which of them, and which weight of toxic texts in the calibration, is chosen on left-out parts of the sample.
SHARES, TOXIC_WEIGHTS = (1.0, 0.3, 0.1, 0.03, 0.01, 0.003), (1.0, 2.0, 4.0, 8.0)
#: Words of no evidence that each text is taken to have besides its own, so that very short texts need several signs.
PRIOR_WORDS = 40
#: Parts of the sample; each is scored by a model of the others for the calibration.
PARTS = 4
THRESHOLD = 0.7
#: Bytes of text that a task takes apart at a time.
STEP_BYTES = 1 << 18

#: Letters and digits of ASCII lowered, its other characters as spaces; bytes of other characters as they are.
_FOLDED = np.array([ord(chr(c).lower()) if chr(c).isalnum() or c > 127 else 32 for c in range(128)] + list(range(128, 256)), np.uint8)
#: Tell windows inside words, and what comes before their last byte, from beginnings of the same bytes.
_INSIDE, _CONTEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


class Beginnings:
    """All beginnings of the words of some texts, in order, each with its context (the beginning before its last byte).

    Beyond ORDER bytes a window of ORDER bytes slides to the end of the word. Context 0 is the start of a word.
    """

    def __init__(self, texts: list[bytes]):
        buf = _FOLDED[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], buf == 32)).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        of_text = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        self.words = np.diff(of_text)  # of each text
        self.word_text = np.repeat(np.arange(len(texts)), self.words)
        depth = ends - starts + 1
        self.first = np.concatenate(([0], np.cumsum(depth)))  # of each word
        start = np.repeat(starts, depth)
        at = start + np.arange(self.first[-1]) - np.repeat(self.first[:-1], depth)
        values, from_ = _BYTE[buf], np.maximum(start, at - (ORDER - 1))
        self.deep = np.flatnonzero(from_ > start)
        self.hash = rolling(values, from_, at + 1)
        self.hash[self.deep] ^= _INSIDE
        self.context = np.zeros(len(self.hash), np.uint64)
        self.context[1:] = self.hash[:-1]
        self.context[self.first[:-1]] = 0
        self.context[self.deep] = rolling(values, from_[self.deep], at[self.deep]) ^ _CONTEXT
        self.byte, self.before = buf[at], np.zeros(len(at), np.uint32)  # the last bytes before, the nearest in the lowest bits
        for i in range(CHAIN):
            self.before |= np.where(at - i > start, buf[np.maximum(at - i - 1, 0)], 0).astype(np.uint32) << np.uint32(8 * i)
        self.text = np.repeat(self.word_text, depth)


class Table:
    """hash -> value, 0 where unknown: sorted hashes, and where those of each leading bits begin. Tasks hold what travels and build nothing."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        self.hashes, one = np.unique(hashes, return_index=True)
        self.values = values[one].astype(np.float32)
        bits = max(1, len(self.hashes).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.concatenate(([0], np.cumsum(np.bincount((self.hashes >> self.shift).astype(np.int64), minlength=1 << bits)))).astype(np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and the value of each."""
        known, got = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.float32)
        head = (hashes >> self.shift).astype(np.int64)
        at, end = self.starts[head], self.starts[head + 1]
        rest = np.flatnonzero(at < end)
        while len(rest):  # as often as a head has hashes
            hit = self.hashes[at[rest]] == hashes[rest]
            got[rest[hit]], known[rest[hit]] = self.values[at[rest[hit]]], True
            rest = rest[~hit]
            at[rest] += 1
            rest = rest[at[rest] < end[rest]]
        return known, got


class Ratios:
    """Log ratios toxic / ordinary of all known beginnings, and of contexts' backoffs."""

    def __init__(self, hashes: np.ndarray, ratios: np.ndarray, contexts: np.ndarray, backoffs: np.ndarray):
        self.ratios, self.backoffs = Table(hashes, ratios), Table(contexts, backoffs)

    def score(self, texts: list[bytes], shares: tuple[float, ...]) -> np.ndarray:
        """For each share, the log-likelihood of each text as a toxic one less that as an ordinary one, over its number of words."""
        b = Beginnings(texts)
        if not len(b.hash):
            return np.zeros((len(shares), len(texts)))
        known, each = self.ratios.find(b.hash)
        rest = np.flatnonzero(~known)
        each[rest] = self.backoffs.find(b.context[rest])[1]
        words = np.add.reduceat(each.astype(np.float64), b.first[:-1])
        toxic = [words if s == 1 else np.logaddexp(np.log(1 - s), np.log(s) + words) for s in shares]
        return np.stack([np.bincount(b.word_text, x, len(texts)) / (b.words + PRIOR_WORDS) for x in toxic])


def _estimate(items: list[float], explained: list[float]) -> list[float]:
    """Absolute discounts of counts 1, 2 and more. items: how many have the counts 1 to 4; explained: see below.

    By the counts of counts, an item counted n times is expected (n + 1) * items[n + 1] / items[n] times in as many other
    texts. What the distribution that a model backs off to expects of these items already (explained, on average) is no
    merit of their own count, so only the rest is kept of n. A discount is at least y * n / 2 and at most n.
    """
    n1, n2 = items[:2]
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    out = []
    for n in (1, 2, 3):
        again = (n + 1) * items[n] / items[n - 1] if items[n - 1] else 0.0
        out.append(min(float(n), max(y * n / 2, n - max(0.0, again - explained[n - 1]))))
    return out


def _discount(count: Column, discounts: list[float]) -> Column:
    d1, d2, d3 = map(F.lit, discounts)
    return F.when(count >= 3, d3).when(count >= 2, d2).when(count >= 1, d1).otherwise(0.0)


def continuations(counts: DataFrame) -> DataFrame:
    """(before, byte, base): the probability of byte after CHAIN bytes, by a chain of interpolated continuation counts.

    counts has one row for each distinct beginning (before, byte). The highest level counts in how many contexts a byte
    follows the CHAIN bytes; each level below counts in how many ways of one byte more it follows one byte less, down to no
    byte at all and then to equal probabilities. Each level has its own estimated discounts. A window has 256 rows at most.
    """
    levels = [cut(counts.groupBy("before", "byte").agg(F.count("*").alias("n")))]
    for length in range(CHAIN - 1, -1, -1):
        shorter = F.col("before").bitwiseAND(F.lit((1 << 8 * length) - 1))
        levels.append(levels[-1].groupBy(shorter.alias("before"), "byte").agg(F.count("*").alias("n")))
    each = reduce(DataFrame.unionByName, [level.select(F.lit(CHAIN - i).alias("length"), "n") for i, level in enumerate(levels)])
    kinds = {(r["length"], r["n"]): r["items"] for r in each.filter("n <= 4").groupBy("length", "n").agg(F.count("*").alias("items")).collect()}
    lower = None
    for length, level in enumerate(reversed(levels)):
        discounts = _estimate([kinds.get((length, n), 0) for n in (1, 2, 3, 4)], [0.0, 0.0, 0.0])
        same = Window.partitionBy("before")
        free = _discount(F.col("n"), discounts)
        rows = level.withColumns({"less": free, "all": F.sum("n").over(same), "free": F.sum(free).over(same)})
        if lower is None:
            rows = rows.withColumn("below_base", F.lit(1 / 256))
        else:
            rows = rows.withColumn("below", F.col("before").bitwiseAND(F.lit((1 << 8 * (length - 1)) - 1)))
            rows = rows.join(lower.select(F.col("before").alias("below"), "byte", F.col("base").alias("below_base")), ["below", "byte"])
        p = (F.col("n") - F.col("less") + F.col("free") * F.col("below_base")) / F.col("all")
        lower = rows.select("before", "byte", p.alias("base"))
    return lower


#: The counts that a model is made of.
_COUNTS = ("toxic", "ordinary", "both")


def _with_sums(counts: DataFrame) -> DataFrame:
    """counts with both and, of its context, toxic_all, ordinary_all and both_all. A context has 256 beginnings at most."""
    counts = counts.withColumn("both", F.col("toxic") + F.col("ordinary"))
    same = Window.partitionBy("context")
    return counts.withColumns({f"{c}_all": F.sum(c).over(same) for c in _COUNTS})


def estimate_discounts(counts: DataFrame) -> dict[str, list[float]]:
    """Discounts of the counts of each class and of both together. From (context, toxic, ordinary); 18 numbers come to the driver.

    A class's counts back off to shared ones; what these expect is taken from the other class's counts in the same context.
    """
    values = []
    for c, other in (("toxic", "ordinary"), ("ordinary", "toxic"), ("both", None)):
        expected = F.lit(0.0) if other is None else F.when(F.col(f"{other}_all") > 0, F.col(f"{c}_all") * F.col(other) / F.col(f"{other}_all")).otherwise(0.0)
        for n in (1, 2, 3, 4):
            values += [F.count(F.when(F.col(c) == n, 1)).alias(f"{c}_items_{n}"), F.avg(F.when(F.col(c) == n, expected)).alias(f"{c}_explained_{n}")]
    row = _with_sums(counts).agg(*values).first()
    return {c: _estimate([row[f"{c}_items_{n}"] for n in (1, 2, 3, 4)], [row[f"{c}_explained_{n}"] or 0.0 for n in (1, 2, 3)]) for c in _COUNTS}


def kneser_ney(counts: DataFrame, discounts: dict[str, list[float]]) -> DataFrame:
    """(hash, value, is_context): the log ratios of interpolated Kneser-Ney models of both classes.

    From (hash, context, base, toxic, ordinary): texts of each class that have a beginning, and base, the probability
    of its last byte by the shared continuation counts. A class's own discounted count given the context backs off to
    the counts of both classes together, and these to base. Every beginning has its row, however rare; one that neither
    class knows has the ratio of its context's backoffs.
    """
    same = Window.partitionBy("context")
    rows = _with_sums(counts).withColumns({f"{c}_less": _discount(F.col(c), discounts[c]) for c in _COUNTS})
    rows = rows.withColumns({f"{c}_free": F.sum(f"{c}_less").over(same) for c in _COUNTS})
    rows = rows.withColumn("place", F.row_number().over(same.orderBy("hash")))
    free = lambda c: F.when(F.col(f"{c}_all") > 0, F.col(f"{c}_free") / F.col(f"{c}_all")).otherwise(1.0)
    own = lambda c: F.when(F.col(f"{c}_all") > 0, (F.col(c) - F.col(f"{c}_less")) / F.col(f"{c}_all")).otherwise(0.0)
    shared = own("both") + free("both") * F.col("base")
    p = lambda c: own(c) + free(c) * shared
    row = lambda h, a, b, is_context: F.struct(h.alias("hash"), F.log(a / b).cast("float").alias("value"), F.lit(is_context).alias("is_context"))
    ratio = row(F.col("hash"), p("toxic"), p("ordinary"), False)
    backoff = row(F.col("context"), free("toxic"), free("ordinary"), True)
    return rows.select(F.explode(F.when(F.col("place") == 1, F.array(ratio, backoff)).otherwise(F.array(ratio))).alias("r")).select("r.*")


def count_beginnings(sample: DataFrame) -> DataFrame:
    """(hash, context, byte, before, toxic, ordinary): arrays of the texts with a beginning, by part. From (text, toxic, part)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            kind = batch.column("toxic").to_numpy(zero_copy_only=False) * PARTS + batch.column("part").to_numpy(zero_copy_only=False)
            for lo, hi in chunks(texts, STEP_BYTES):
                b = Beginnings(texts[lo:hi])
                once = np.unique(b.hash ^ mix(b.text.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
                rows = np.stack((b.hash[once], kind[lo + b.text[once]].astype(np.uint64)), axis=1)
                _, one, n = np.unique(mix(rows[:, 0]) + rows[:, 1], return_index=True, return_counts=True)
                at = once[one]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.hash[at].view(np.int64)), pa.array(b.context[at].view(np.int64)), pa.array(b.byte[at].astype(np.int32)),
                     pa.array(b.before[at].astype(np.int64)), pa.array(rows[one, 1].astype(np.int32)), pa.array(n)],
                    names=["hash", "context", "byte", "before", "kind", "n"],
                )

    rows = sample.mapInArrow(count, "hash long, context long, byte int, before long, kind int, n long")
    part = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).cast("double")
    return rows.groupBy("hash", "context", "byte", "before").agg(
        F.array(*[part(PARTS + p) for p in range(PARTS)]).alias("toxic"), F.array(*[part(p) for p in range(PARTS)]).alias("ordinary")
    )


def _total(parts: str) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def _model(counts: DataFrame, discounts: dict[str, list[float]], left_out: int | None = None) -> Ratios:
    """The model of all parts, or of all but one. Its rows, which the sample bounds, come to the driver."""
    n = lambda c: (_total(c) - (F.lit(0.0) if left_out is None else F.element_at(c, left_out + 1))).alias(c)
    rows = counts.select("hash", "context", "base", n("toxic"), n("ordinary")).filter("toxic + ordinary > 0")
    table = kneser_ney(rows, discounts).toArrow()
    hashes, value, context = (table.column(c).to_numpy() for c in ("hash", "value", "is_context"))
    hashes = hashes.view(np.uint64)
    return Ratios(hashes[~context], value[~context], hashes[context], value[context])


def calibrate(x: np.ndarray, y: np.ndarray, weight: float) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps, slightly shrunk; slope 1, offset -3 without both classes."""
    if len(set(y.tolist())) < 2:
        return 1.0, -3.0
    scale = max(float(x.std()), 1e-9)
    a = np.stack((x / scale, np.ones_like(x)), axis=1)
    w, each = np.zeros(2), np.where(y > 0, weight, 1.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        g = a.T @ (each * (p - y)) + 0.01 * np.array([w[0], 0])
        h = (a * (each * p * (1 - p))[:, None]).T @ a + 0.01 * np.diag([1, 1e-3])
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -3, 3)
    return float(w[0] / scale), float(w[1])


def choose_calibration(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> tuple[float, float, float]:
    """Share, slope and offset, from scores x of left-out texts (a row for each of SHARES) and their labels y.

    Of all shares and weights of toxic texts, those are taken whose curve gives the best F1 at the threshold on these
    texts, all of them from the sample; of equal ones the first.
    """
    best = (-1.0, SHARES[0], 1.0, -3.0)
    for share, each in zip(SHARES, x):
        for weight in TOXIC_WEIGHTS:
            slope, offset = calibrate(each, y, weight)
            found = 1 / (1 + np.exp(-(slope * each + offset))) >= threshold
            f1 = 2 * float(y[found].sum()) / max(1.0, float(found.sum() + y.sum()))
            if f1 > best[0] + 1e-12:
                best = (f1, share, slope, offset)
    return best[1:]


def _scored(rows: DataFrame, model, shares: tuple[float, ...]) -> DataFrame:
    """rows and, as _ll_x, the scores of text by the broadcast model, one for each share."""
    columns = rows.columns
    at_text = columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            texts = as_bytes(batch.column(at_text))
            x = np.zeros((len(shares), len(texts)))
            for lo, hi in chunks(texts, STEP_BYTES):
                x[:, lo:hi] = known.score(texts[lo:hi], shares)
            each = pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * len(shares), pa.array(x.T.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, each], names=[*columns, "_ll_x"])

    return rows.mapInArrow(score, StructType([*rows.schema.fields, StructField("_ll_x", ArrayType(DoubleType()))]))


def choose_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(text, toxic, part): the bounded sample of labelled rows whose fold is not 1, each text of a class once.

    Only ids, digests and sizes of at most per_class rows of each class come to the driver.
    """
    spark = docs.sparkSession
    named = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    named = named.filter(fold(F.col("doc_id")) != 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("sha", F.md5("text"))
    keyed = rows.select("doc_id", "sha", F.octet_length("text").alias("size")).filter(F.col("size") * 10 <= most_bytes).join(named, "doc_id")  # no text in this shuffle
    place = F.struct(F.md5(F.col("doc_id").cast("string")).alias("digest"), "doc_id", "size")
    keyed = cut(keyed.groupBy("toxic", "sha").agg(F.min(place).alias("x")).select("toxic", "sha", "x.*"))
    chosen = []
    for c in (0, 1):
        room = most_bytes
        for r in keyed.filter(F.col("toxic") == c).orderBy("digest", "sha").limit(per_class).collect():
            room -= r["size"]
            if room < 0:
                break
            chosen.append((r["doc_id"], r["sha"], c))
    part = F.pmod(F.crc32(F.concat(F.lit("part "), F.col("doc_id").cast("string"))), F.lit(PARTS)).cast("int")
    picked = F.broadcast(spark.createDataFrame(chosen, "doc_id long, sha string, toxic int"))  # 2 * per_class rows at most
    return rows.join(picked, ["doc_id", "sha"]).dropDuplicates(["doc_id", "sha"]).select("text", "toxic", part.alias("part"))


def train(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS, threshold: float = THRESHOLD):
    """Broadcast model of the whole sample, share, slope and offset, from a bounded sample of rows whose fold is not 1.

    Counts and Kneser-Ney levels are made in Spark. The calibration scores each part of the sample with a model of the
    other parts, one part after another, so that the driver and tasks hold one model at a time.
    """
    sample = cut(choose_sample(docs, labels, sample_per_class))
    context = docs.sparkSession.sparkContext
    counts = cut(count_beginnings(sample))
    counts = cut(counts.join(continuations(counts), ["before", "byte"]).select("hash", "context", "base", "toxic", "ordinary"))
    discounts = estimate_discounts(counts.select("context", _total("toxic").alias("toxic"), _total("ordinary").alias("ordinary")))
    x, y = [], []
    for part in range(PARTS):
        model = context.broadcast(_model(counts, discounts, part))
        scored = _scored(sample.filter(F.col("part") == part), model, SHARES).select("toxic", "_ll_x").toArrow()
        x.append(scored.column("_ll_x").combine_chunks().flatten().to_numpy().reshape(-1, len(SHARES)))
        y.append(scored.column("toxic").to_numpy().astype(np.float64))
        model.destroy()
    share, slope, offset = choose_calibration(np.concatenate(x).T, np.concatenate(y), threshold)
    return context.broadcast(_model(counts, discounts)), share, slope, offset


def _probability(slope: float, offset: float) -> Column:
    return 1 / (1 + F.exp(-(F.lit(slope) * F.element_at("_ll_x", 1) + F.lit(offset))))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted.

    Words (A-Z lowered, split at ASCII characters other than letters and digits) are read byte by byte from their beginnings
    to their end; a byte is predicted from up to ORDER - 1 bytes of its word before it. Each class has an interpolated Kneser-Ney
    model with estimated fractional discounts, which backs off to counts that both share and then to a chain of continuation
    counts. The ordinary log-likelihood of a text is that of the ordinary model; the toxic one takes each word from the toxic
    model with a probability out of SHARES, else from the ordinary one; the share is chosen on left-out parts of the sample.
    The difference over the number of words (and PRIOR_WORDS) may have either sign; it goes through a logistic curve that
    was fitted on the same left-out parts.

    Null and empty text has difference 0 and so the score of a text without evidence. Rows with null ids are scored;
    held_out is then false. Labels that contradict each other count as toxic. Without labels of both classes scores
    stay below the threshold. Repeated rows are scored each; equal texts have equal scores. An empty table gives an
    empty result. Columns other than doc_id and text are not read.
    """
    model, share, slope, offset = train(docs, labels, sample_per_class, threshold)
    scored = _scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, (share,))
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), _probability(slope, offset).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns, in one pass after the training.

    Each row is judged by its own text, whatever its id: null and repeated ids stay or go like any other. Null and
    empty texts stay. An empty table gives an empty result.
    """
    model, share, slope, offset = train(docs, labels, sample_per_class, threshold)
    return _scored(docs, model, (share,)).filter(_probability(slope, offset) < threshold).select(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))

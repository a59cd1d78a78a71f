"""Token counts with a digest cache: only distinct contents that the cache lacks are encoded."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.shared import cut, join_counted, new_table, read_documents

CACHE_SCHEMA = "content_sha256 string, tokenizer_sha256 string, n_tokens long"
LIMIT = 1024
#: Characters on whose classes all regex engines agree; texts with others go to the reference library itself.
UNCOMMON = re.compile("[^\t\n\r\x20-\x7e¡-¬®-ɏΑ-ΡΣ-ϿА-я–—‘-”…€]")


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _known(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def counter(tokenizer: str, ranks: str | None = None) -> Callable[[list[str]], list[int]]:
    """Counts as the tokenizer's library gives them: .json by tokenizers, .model by sentencepiece.

    ranks: the same vocabulary as a rank file. It encodes texts of common characters several times faster, by the
    same merges; added tokens of the .json count one each, as its default has it.
    """
    if tokenizer.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import json

    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer)
    model.no_truncation()
    model.no_padding()
    slow = lambda text: len(model.encode(text, add_special_tokens=False).ids)
    if ranks is None:
        return lambda texts: [slow(x) for x in texts]
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    with open(tokenizer, encoding="utf-8") as f:
        added = [x["content"] for x in json.load(f)["added_tokens"]]
    split = re.compile("|".join(map(re.escape, added))) if added else None

    def count(text: str) -> int:
        if UNCOMMON.search(text):
            return slow(text)
        parts = split.split(text) if split else [text]
        return len(parts) - 1 + sum(len(fast.encode_ordinary(x)) for x in parts)

    return lambda texts: [count(x) for x in texts]


def count_tokens(
    docs: DataFrame, cache_path: str, tokenizer: str, ranks: str | None = None, limit: int = LIMIT
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit, cached (known before this run).

    The cache is a parquet table of (content digest, tokenizer digest, count) at cache_path, read once; new counts are
    appended, and the table is created with the first ones. One row per distinct missing content is encoded; the smallest id stands for its copies, so only
    ids meet in the choice and a group of a third of all rows costs each task one row.

    Null text is empty and has 0 tokens. Repeated rows are counted each. An empty table gives an empty result and
    appends nothing. A changed tokenizer file has another digest and shares no counts.
    """
    spark = docs.sparkSession
    version = file_digest(tokenizer)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("content_sha256", F.unhex(F.sha2("text", 256)))  # 32 bytes in each shuffle; letters only in the cache
    digests = cut(keyed.select("doc_id", "content_sha256", F.octet_length("text").cast("long").alias("n_bytes")))
    total = digests.count()
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    contents = digests.groupBy("content_sha256").agg(F.min(name).alias("name"), F.count("*").alias("copies"))
    contents = cut(contents.join(_cached(spark, cache_path, version), "content_sha256", "left"))
    missing = contents.filter("n_tokens is null").select("content_sha256", "name")
    chosen = keyed.withColumn("name", name).join(missing, ["name", "content_sha256"], "left_semi").select("content_sha256", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer, ranks)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("content_sha256"), pa.array(count(texts), pa.int64())], names=["content_sha256", "n_tokens"])

    counted = cut(chosen.mapInArrow(encode, "content_sha256 binary, n_tokens long").dropDuplicates(["content_sha256"]))
    if not counted.isEmpty():
        counted.select(F.lower(F.hex("content_sha256")).alias("content_sha256"), F.lit(version).alias("tokenizer_sha256"), "n_tokens").write.mode("append").parquet(cache_path)
    old = contents.filter("n_tokens is not null").select("content_sha256", "copies", "n_tokens", F.lit(True).alias("cached"))
    new = counted.join(contents.select("content_sha256", "copies"), "content_sha256").select("content_sha256", "copies", "n_tokens", F.lit(False).alias("cached"))
    out = join_counted(digests, old.unionByName(new), ["content_sha256"], "copies", total)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cached")


def _cached(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """content_sha256 (32 bytes), n_tokens of the cache, one row each; empty if there is no cache yet.

    A run that was broken off and run again may have stored a count twice.
    """
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    return stored.filter(F.col("tokenizer_sha256") == version).groupBy(F.unhex("content_sha256").alias("content_sha256")).agg(F.min("n_tokens").alias("n_tokens"))


def op3(spark, sf_dir: str) -> DataFrame:
    return count_tokens(
        read_documents(spark, sf_dir), new_table(spark, "token_cache"),
        _known("byte_bpe_50k.json"), _known("byte_bpe_50k.tiktoken"),
    )

"""Digests in shuffles are bytes; only the cache of token counts holds them as letters."""

from leadloom.llm import token_counts


def test_digests_are_bytes(spark, tmp_path, monkeypatch):
    seen, kept = [], token_counts.cut
    monkeypatch.setattr(token_counts, "cut", lambda df: (seen.append(dict(df.dtypes)), kept(df))[1])
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "doc_id long, text string")
    run = lambda: sorted(map(tuple, token_counts.count_tokens(docs, f"{tmp_path}/cache", token_counts._known("byte_bpe_50k.json")).collect()))
    first, again = run(), run()
    assert [x[:4] for x in first] == [x[:4] for x in again] and [x[4] for x in first] == [False] * 3 and [x[4] for x in again] == [True] * 3
    assert seen and all(t["content_sha256"] == "binary" for t in seen)
    assert all(len(r["content_sha256"]) == 64 for r in spark.read.parquet(f"{tmp_path}/cache").collect())

"""What the operators write, shuffle and hold, besides their results."""

import pickle

import numpy as np

from leadloom.llm import divergence, jaccard, substrings, toxicity


def nodes(plan):
    """All nodes of an executed plan, those of finished stages included."""
    kind = plan.nodeName()
    if kind == "AdaptiveSparkPlan":
        return nodes(plan.executedPlan())
    if kind.endswith("QueryStage"):
        return nodes(plan.plan())
    below = plan.children()
    return [plan, *[x for i in range(below.size()) for x in nodes(below.apply(i))]] if kind != "ReusedExchange" else [plan]


def test_table_of_a_task(spark):
    """A table is found as it travels: nothing is built beside it."""
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 2**64, 100_000, dtype=np.uint64, endpoint=False)
    hashes[:3] = (0, 2**64 - 1, hashes[7])
    values = rng.random(len(hashes)).astype(np.float32)
    table = pickle.loads(pickle.dumps(toxicity.Table(hashes, values)))
    known, got = table.find(np.concatenate((hashes[3:], [np.uint64(12345), hashes[0], hashes[1]])))
    assert known.sum() == len(known) - 1 and not known[-3] and got[-3] == 0
    assert (got[5:-3] == values[8:]).all() and (got[-2:] == values[:2]).all()
    flat = [x for v in vars(table).values() for x in (v if isinstance(v, list) else [v])]
    held = sum(x.nbytes for v in flat for x in (v if isinstance(v, tuple) else (v,)) if isinstance(x, np.ndarray))
    assert held <= 24 * len(hashes)
    none = toxicity.Table(np.zeros(0, np.uint64), np.zeros(0, np.float32))
    assert not none.find(hashes)[0].any()


def test_text_is_shuffled_once(spark, tmp_path):
    """All joins of op2 on the row share one shuffle of text, and copies count for no anchor."""
    texts = [" ".join(f"w{k * 100 + i}" for i in range(40)) for k in range(6)]
    texts += [texts[0], texts[0], " ".join(texts[1].split()[5:30]) + " x y z", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/d.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = substrings.remove_repeats(spark.read.parquet(f"{tmp_path}/d.parquet"), is_table=True)
        got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {**{i: (40, 0) for i in range(6)}, 6: (40, 40), 7: (40, 40), 8: (28, 25), 9: (0, 0)}
    assert sum(x.nodeName().startswith("Scan parquet") for x in nodes(out._jdf.queryExecution().executedPlan())) == 1


def test_alike_sets_meet_once(spark):
    """Sets of one size and one list of frequent tokens do not make all pairs of their tokens each."""
    sets, tokens = 300, 10
    index = spark.createDataFrame([(t, t, r, 100, sets) for r in range(sets) for t in (range(tokens) if r % 2 else range(1, tokens + 1))], "token long, pos int, row_id long, n long, df long")
    edges = jaccard.candidate_edges(index, 85)
    assert {(r["a"], r["b"]) for r in edges.collect()} == {(0, 1)} | {(r % 2, r) for r in range(2, sets)}
    made = [x.metrics().apply("numOutputRows").value() for x in nodes(edges._jdf.queryExecution().executedPlan()) if x.nodeName() == "Generate"]
    assert made and sum(made) < sets * tokens


def test_only_kept_counts_are_stored(spark, monkeypatch):
    """op11 sums by term where the partial counts arrive: no table of all counts, none of kept terms."""
    seen, kept = {}, divergence.stored
    monkeypatch.setattr(divergence, "stored", lambda df, name: seen.setdefault(name, kept(df, name)))
    docs = spark.createDataFrame([("a b b", "x", "s"), ("a c", "x", "t"), ("a", "y", "s")], "text string, lang string, source string")
    divergence.source_divergence(docs, least_docs=2).collect()
    assert {name: df.count() for name, df in seen.items()} == {"kept_counts": 2, "shares": 2}

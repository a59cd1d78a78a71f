"""What near texts cost: bytes shuffled for each n-gram and for each pair that is compared."""

import random

from leadloom.operators import dedup


def shuffled(spark, run):
    total = lambda: sum(x.totalShuffleWrite() for x in (executors.apply(i) for i in range(executors.size())))
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    before = total()
    rows = run()
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return rows, total() - before


def pairs(spark, texts, threshold):
    frame = spark.createDataFrame([(f"{i:064x}", t) for i, t in enumerate(texts)], "key string, text string")
    rows, size = shuffled(spark, lambda: dedup.near_text_pairs(frame, threshold).collect())
    got = {tuple(sorted((int(r["key_a"], 16), int(r["key_b"], 16)))): round(r["similarity"], 12) for r in rows}
    sets = [{tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} for w in (t.split() for t in texts)]
    common = {(i, j): len(sets[i] & sets[j]) / min(len(sets[i]), len(sets[j])) for j in range(len(texts)) for i in range(j)}
    assert got == {p: round(s, 12) for p, s in common.items() if s >= threshold} and len(got) > 10
    return size


def test_large_sets_do_not_travel_to_small_ones(spark):
    r = random.Random(6)
    word = lambda: f"w{r.randrange(10**9)}"
    notice = [word() for _ in range(8)]
    texts = [" ".join([word() for _ in range(3)] + notice[i % 2 :]) for i in range(40)]
    texts += [" ".join([word() for _ in range(1500)] + notice) for _ in range(40)]
    texts += [t.replace(" ", " again ", 1) for t in texts[40:]]
    assert pairs(spark, texts, 0.5) < 50 * 120 * 1000

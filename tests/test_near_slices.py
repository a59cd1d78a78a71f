"""N-grams that nothing asks for are not shuffled a second time; slices of them give the same pairs."""

import random

from leadloom.operators import dedup
from tests.test_near_volume import pairs


def texts(r):
    word = lambda: f"w{r.randrange(10**9)}"
    rows = [[word() for _ in range(600)] for _ in range(60)]
    return [" ".join(t) for t in rows] + [" ".join([*t[:300], word(), *t[301:]]) for t in rows]


def test_only_asked_grams_travel_again(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        size = pairs(spark, texts(random.Random(2)), 0.95)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert size < 50 * 120 * 600


def test_slices(spark, monkeypatch):
    monkeypatch.setattr(dedup, "FEW_GRAMS", 100)
    for threshold in (0.5, 0.95):
        pairs(spark, texts(random.Random(3)), threshold)

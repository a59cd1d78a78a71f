"""The index of terms against the rule itself, on all pairs."""

import random

import pytest

from leadloom.operators import scoring, terms


def matches(c, w):
    if len(c) < 3 or len(w) < 3:
        return c == w
    like = lambda a, b: min(5, len(a), len(b)) >= 3 and a[: min(5, len(a), len(b))] == b[: min(5, len(a), len(b))]
    return w in c or c in w or all(any(like(a, b) for a in c.split(" ")) for b in w.split(" "))


def some_terms(seed, n):
    r = random.Random(seed)
    stems = ["construct", "build", "bui", "hotel", "hot", "ring", "spring", "a", "b", "ab", "cd", "abcd", "стро", "строительство", "строит", "x1", "road"]
    out = [" ".join(r.choice(stems) + r.choice(["", "", "s", "ing", "ion"]) for _ in range(r.choice([1, 1, 2, 3, 6]))) for _ in range(n)]
    return [*out, "a b", "ab cd", "b c", "b cd e", "ab cd ef gh", "ab", "ab", "abc", "ing"]


@pytest.mark.parametrize("seed", [1, 2])
def test_term_matches(spark, seed):
    some, others = some_terms(seed, 120), some_terms(seed + 10, 90)
    frame = lambda x: spark.createDataFrame([(t,) for t in [*x, None, ""]], "term string")
    got = sorted(map(tuple, terms.term_matches(frame(some), frame(others)).collect()))
    assert got == sorted((c, w) for c in set(some) for w in set(others) if matches(c, w)) and len(got) > 200
    assert terms.term_matches(frame([]), frame(others)).count() == 0 == terms.term_matches(frame(some), frame([])).count()


def test_matched_lists(spark):
    r = random.Random(3)
    lists = [[r.choice(some_terms(5, 60)).title() for _ in range(r.randint(0, 4))] for _ in range(40)] + [None, [], [" - "]]
    wanted = [[r.choice(some_terms(6, 60)) for _ in range(r.randint(0, 3))] for _ in range(30)] + [None]
    frame = lambda x, k: spark.createDataFrame(list(enumerate(x)), f"{k} long, v array<string>")
    from pyspark.sql import functions as F

    a, b = terms.term_lists(frame(lists, "a"), "a", F.col("v")), terms.term_lists(frame(wanted, "b"), "b", F.col("v"))
    met = terms.matched_lists(a, b)
    got = a.select("a", "list_id").join(met, "list_id").join(b.select("b", F.col("list_id").alias("wanted_id")), "wanted_id")
    got = {(x["a"], x["b"]): x["matched"] for x in got.collect()}
    norm = lambda v: list(dict.fromkeys(x for x in (t.lower().strip(" -") for t in v or []) if x))
    want = {(i, j): hit for i, v in enumerate(lists) for j, w in enumerate(wanted) if (hit := [c for c in norm(v) if any(matches(c, x) for x in norm(w))])}
    assert got == want and want


def test_pairs_in_parts(spark, monkeypatch):
    analyses = spark.createDataFrame([(i, "HORECA" if i % 3 else "OTHER", "SUCCEEDED") for i in range(90)], "id long, vertical string, status string")
    profiles = spark.createDataFrame([(p, ["HORECA", "OTHER"]) for p in range(7)], "profile_id long, verticals array<string>")
    whole = sorted(map(tuple, scoring.eligible_pairs(analyses, profiles).select("id", "profile_id").collect()))
    monkeypatch.setattr(scoring, "PART_PAIRS", 50)
    parts = scoring.eligible_pairs(analyses, profiles)
    assert sorted(map(tuple, parts.select("id", "profile_id").collect())) == whole and len(whole) == 60 * 7
    assert scoring.eligible_pairs(analyses, profiles.limit(0)).count() == 0

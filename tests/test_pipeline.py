"""Incremental clusters against full runs, and the item pipeline against plain Python."""

import datetime
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from leadloom.operators import dedup
from leadloom.plans.pipeline import current_assignments, run_pipeline
from leadloom.plans.stages import Stages
from leadloom.plans.testviews import LATIN_RULES, Views

SF = "/root/testdata/sf0.001"
ITEM = "id long, observed_at timestamp, source_id string, external_id string, canonical_url string, normalized_hash string, text string, verticals array<string>"
START = datetime.datetime(2026, 1, 1)


def some_items(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [[r.choice(words) for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(n):
        text = list(r.choice(base)) if r.random() < 0.7 else [r.choice(words) for _ in range(r.randint(0, 20))]
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            text.append(r.choice(words))
        text = " ".join(text)
        at = START + datetime.timedelta(hours=r.randint(0, 900))
        rows.append((i, at, r.choice("abc"), r.choice([None, None, f"e{r.randint(0, 40)}"]), r.choice([None, None, f"u{r.randint(0, 60)}"]), str(hash(text)), text, r.sample(["CONSTRUCTION", "HORECA", "OTHER"], r.choice([1, 1, 2]))))
    return rows


@pytest.mark.parametrize("seed,cuts", [(1, [40]), (2, [5, 6, 70]), (3, [])])
def test_clusters_do_not_depend_on_batches(spark, seed, cuts):
    rows = some_items(seed, 110)
    random.Random(seed).shuffle(rows)  # batches are not in the order of time
    full = {r["id"]: r for r in dedup.dedup_assignments(spark.createDataFrame(rows, ITEM)).collect()}
    stored = {}
    edges = [0, *cuts, len(rows)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        known = spark.createDataFrame([(i, r["representative_id"]) for i, r in stored.items()], "id long, representative_id long")
        got = dedup.dedup_increment(spark.createDataFrame(rows[lo:hi], ITEM), spark.createDataFrame(rows[:lo], ITEM), known)
        stored |= {r["id"]: r for r in got.collect()}
    assert stored == full and len({r["representative_id"] for r in full.values()}) < 100
    assert {r["match_kind"] for r in full.values()} == set(dedup.KINDS)


def test_increment_touches_little(spark):
    """Clusters that a batch does not touch are not made again."""
    at = lambda h: START + datetime.timedelta(hours=h)
    old = [(i, at(i), "s", f"e{i // 2}", None, f"h{i}", f"text number {i}", ["HORECA"]) for i in range(10)]
    known = spark.createDataFrame([(i, i - i % 2) for i in range(10)], "id long, representative_id long")
    got = dedup.dedup_increment(spark.createDataFrame([(20, at(-5), "s", "e3", None, "x", "other words", ["HORECA"])], ITEM), spark.createDataFrame(old, ITEM), known)
    assert {r["id"]: (r["representative_id"], r["matched_to_id"]) for r in got.collect()} == {20: (20, 20), 6: (20, 20), 7: (20, 20)}


def inputs(spark):
    v = Views(spark, SF)
    people = v.profiles.filter("revision = 1").withColumns({"services_and_products": F.array(F.lit("Tion")), "target_clients": F.array(F.lit("hotel"), F.lit("ment con"))})
    return v.sources.withColumn("regions", F.array(F.concat(F.lit("NATION_"), F.col("n").cast("string")))), v.raw, people


def norm(terms):
    out = (re.sub(r"[\W_]+", " ", (t or "").lower()).strip() for t in terms or [])
    return list(dict.fromkeys(x for x in out if x))


def hits(c, w):
    if len(c) < 3 or len(w) < 3:
        return c == w
    like = lambda a, b: (n := min(5, len(a), len(b))) >= 3 and a[:n] == b[:n]
    return w in c or c in w or all(any(like(a, b) for a in c.split(" ")) for b in w.split(" "))


def half_up(x, digits=2):
    return math.floor((x + 2.220446049250313e-16) * 10**digits + 0.5) / 10**digits


def expected_score(analysis, profile, terms, regions, reliability):
    """None if excluded, else the total score; by the rules of scoring, one pair at a time."""
    event = " ".join(norm([analysis["event_type"]]))
    common = lambda some, wanted: any(hits(c, w) for c in norm(some) for w in norm(wanted))
    if event in norm(profile["ignored_event_types"]) or common(terms, profile["excluded_keywords"]):
        return None
    fit = [
        (100, 0.30), (50 if not regions else 100 if common(regions, profile["regions"]) else 0, 0.25), (100 if event in norm(profile["interested_event_types"]) else 25, 0.20),
        (50 if not terms else 100 if common(terms, profile["services_and_products"] + profile["keywords"] + profile["target_clients"]) else 25, 0.15), (50, 0.10),
    ]
    company = half_up(sum(half_up(w * s) for s, w in fit))
    confidence = min(half_up(analysis["confidence"] * 100), reliability)
    parts = [(analysis["actionability"], 0.10), (analysis["business_impact"], 0.35), (company, 0.25), (confidence, 0.10), (analysis["urgency"], 0.20)]
    top = 54 if confidence < 40 else 69 if confidence < 60 else 84 if confidence < 80 else 100
    return half_up(min(half_up(sum(half_up(s * w, 4) for s, w in parts)), top))


def brute_assignments(items, verticals):
    """representative of each item, all pairs compared."""
    grams = lambda t: {" ".join(x[i : i + 3]) for x in [re.findall(r"[^\W_]+", t.lower())] for i in range(max(1, len(x) - 2))} if re.findall(r"[^\W_]+", t) else set()
    rows = sorted(items, key=lambda r: (r["observed_at"], r["id"]))
    sets, parent = [grams(r["text"]) for r in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            exact = (a["external_id"] and (a["source_id"], a["external_id"]) == (b["source_id"], b["external_id"])) or (a["canonical_url"] and a["canonical_url"] == b["canonical_url"]) or a["normalized_hash"] == b["normalized_hash"]
            near = abs(a["observed_at"] - b["observed_at"]) <= datetime.timedelta(hours=168) and set(verticals[a["source_id"]]) & set(verticals[b["source_id"]]) and sets[i] and sets[j] and len(sets[i] & sets[j]) / min(len(sets[i]), len(sets[j])) >= 0.95
            if exact or near:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {r["id"]: rows[find(i)]["id"] for i, r in enumerate(rows)}


def test_pipeline_against_plain_python(spark, tmp_path):
    sources, raw, people = inputs(spark)
    counts = run_pipeline(spark, str(tmp_path), sources, raw, people, LATIN_RULES)
    known = {s["source_id"]: s for s in sources.collect()}
    documents = spark.read.parquet(f"{SF}/documents.parquet").collect()
    contents = {(d["source"], d["text"]) for d in documents if known[d["source"]]["rights"] == "OPEN_DATA"}
    assert counts["raw_items"]["created"] == counts["normalization"]["created"] == counts["items"]["created"] == len(contents)

    stages = Stages(spark, str(tmp_path))
    items = stages.read("items").collect()
    got = {r["id"]: r["representative_id"] for r in current_assignments(stages).collect()}
    assert got == brute_assignments(items, {k: s["verticals"] for k, s in known.items()})
    assert counts["decisions"]["created"] == len(set(got.values())) < len(got)

    of_signal = {r["signal_id"]: r for r in stages.read("signals").collect()}
    by_id = {r["id"]: r for r in items}
    for s in of_signal.values():
        members = sorted(i for i, head in got.items() if head == s["representative_id"])
        assert [int(e["id"]) for e in s["evidence"]] == members and all(e["text"] == by_id[int(e["id"])]["text"] for e in s["evidence"])
    analyses = stages.read("analyses").collect()
    assert len(analyses) == len(of_signal) == counts["analyses"]["created"]
    want, excluded = {}, 0
    profiles = people.collect()
    for a in analyses:
        evidence = of_signal[a["signal_id"]]["evidence"]
        terms = [x for e in evidence for x in (e["title"], e["text"]) if x is not None]
        regions = [x for s in a["source_ids"] for x in known[s]["regions"]]
        reliability = min(max(known[s]["reliability"] for s in f["sourceIds"]) for f in a["facts"])
        for p in profiles:
            if a["vertical"] in p["verticals"] and a["vertical"] != "OTHER":
                score = expected_score(a, p, terms, regions, reliability)
                excluded += score is None
                if score is not None:
                    want[a["analysis_id"], p["id"]] = score
    rows = stages.read("recommendations").collect()
    assert {(r["analysis_id"], r["profile_id"]): r["total_score"] for r in rows} == want and len(rows) == len(want) > 1000
    assert counts["recommendations"] == {"input": len(want) + excluded, "created": len(want), "existing": 0, "rejected": excluded}


def test_pipeline_in_batches(spark, tmp_path):
    """Items in two runs, new profiles, a changed source: what is new is worked on, and clusters are those of one run."""
    sources, raw, people = inputs(spark)
    whole, parts = f"{tmp_path}/whole", f"{tmp_path}/parts"
    run_pipeline(spark, whole, sources, raw, people, LATIN_RULES)
    run_pipeline(spark, parts, sources, raw.filter("raw_item_id % 3 = 0"), people.filter("id < 100"), LATIN_RULES)
    second = run_pipeline(spark, parts, sources.withColumn("name", F.when(F.col("source_id") == "src1", "other").otherwise(F.col("name"))), raw, people, LATIN_RULES)
    assert second["sources"]["created"] == 1 and second["profiles"]["created"] == people.count() - 100
    a, b = Stages(spark, whole), Stages(spark, parts)

    def clusters(s):
        named = current_assignments(s).join(s.read("items").select("id", "raw_item_id"), "id")
        head = s.read("items").select(F.col("id").alias("representative_id"), F.col("raw_item_id").alias("head"))
        return {r["raw_item_id"]: r["head"] for r in named.join(head, "representative_id").collect()}

    assert clusters(a) == clusters(b)
    heads = set(clusters(b).values())
    raw_of = {r["id"]: r["raw_item_id"] for r in b.read("items").collect()}
    stands = lambda s, of: {(of[x["representative_id"]], r["profile_id"], r["total_score"]) for r in s.read("recommendations").collect() for x in [signal[r["signal_id"]]] if of[x["representative_id"]] in heads}
    signal = {r["signal_id"]: r for r in a.read("signals").collect()}
    one = stands(a, {r["id"]: r["raw_item_id"] for r in a.read("items").collect()})
    signal = {r["signal_id"]: r for r in b.read("signals").collect()}
    two = stands(b, raw_of)
    assert {x[:2] for x in one} == {x[:2] for x in two} and len(one & two) > 0.9 * len(one)  # a signal that has an analysis keeps it, whatever joins its cluster later
    third = run_pipeline(spark, parts, sources.withColumn("name", F.when(F.col("source_id") == "src1", "other").otherwise(F.col("name"))), raw, people, LATIN_RULES)
    assert all(x["created"] == 0 for x in third.values())
    summary = Stages(spark, parts).records().groupBy("run").count().collect()
    assert {r["run"] for r in summary} == {0, 1, 2} and {r["count"] for r in summary} == {len(third)}


def test_pipeline_goes_on_where_it_broke(spark, tmp_path, monkeypatch):
    from leadloom.plans import pipeline

    sources, raw, people = inputs(spark)
    raw = raw.filter("raw_item_id < 60")
    whole = pipeline.run_pipeline(spark, f"{tmp_path}/a", sources, raw, people, LATIN_RULES)
    with monkeypatch.context() as m:
        m.setattr(pipeline, "_decided", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            pipeline.run_pipeline(spark, f"{tmp_path}/b", sources, raw, people, LATIN_RULES)
    spark.read.parquet(f"{tmp_path}/b/assignments").filter("id < 0").drop("run").write.mode("overwrite").parquet(f"{tmp_path}/b/decisions/run=0")  # a partition without its record
    rest = pipeline.run_pipeline(spark, f"{tmp_path}/b", sources, raw, people, LATIN_RULES)
    assert rest["assignments"]["created"] == 0 and all(rest[s]["created"] == whole[s]["created"] for s in ("decisions", "signals", "analyses", "recommendations"))


def answer(row):
    request = json.loads(row["input"])
    if int(request["evidence"][0]["id"]) % 5 == 0:
        raise ValueError("no answer")
    source = "elsewhere" if int(request["evidence"][0]["id"]) % 5 == 1 else request["evidence"][0]["source_id"]
    action = lambda t: {"kind": "REVIEW", "priority": 1, "rationale": "because", "title": t}
    fact = {"id": "f1", "sourceIds": [source], "statement": "a fact"}
    return json.dumps({
        "analysisId": request["analysis_id"], "signalId": request["signal_id"], "correlationId": request["correlation_id"], "provider": request["provider"], "model": request["model"], "promptVersion": "p", "schemaVersion": "ai-analysis/v1",
        "analysisVersion": "a", "status": "SUCCEEDED", "createdAt": "2026-01-01T00:00:00Z", "headline": "h", "summary": "s", "whyImportant": "w", "eventType": "tender", "deadline": None, "confidence": 0.9, "businessImpact": 80, "urgency": 70,
        "actionability": 60, "entities": [], "risks": [], "sourceIds": [source], "facts": [fact], "inferences": [], "candidateActions": [action("one"), action("two")],
    })


def test_pipeline_with_a_model(spark, tmp_path):
    sources, raw, people = inputs(spark)
    raw = raw.filter("raw_item_id < 120")
    counts = run_pipeline(spark, str(tmp_path), sources, raw, people, LATIN_RULES, model=answer, provider={"provider": "own", "model": "m1"})
    rows = Stages(spark, str(tmp_path)).read("analyses").join(Stages(spark, str(tmp_path)).read("signals").select("signal_id", F.col("evidence")[0]["id"].cast("long").alias("first")), "signal_id").collect()
    kind = {0: ("FAILED", "AI_PROVIDER_ERROR"), 1: ("FAILED", "PROVENANCE")}
    assert rows and all((r["status"], r["reason"]) == kind.get(r["first"] % 5, ("SUCCEEDED", None)) for r in rows)
    assert counts["recommendations"]["created"] > 0
    scored = {r["analysis_id"] for r in Stages(spark, str(tmp_path)).read("recommendations").collect()}
    assert scored <= {r["analysis_id"] for r in rows if r["status"] == "SUCCEEDED"}
    again = run_pipeline(spark, str(tmp_path), sources, raw, people, LATIN_RULES, model=lambda row: 1 / 0, provider={"provider": "own", "model": "m1"})
    assert all(x["created"] == 0 for x in again.values())

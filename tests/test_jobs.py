import datetime
import random

import pytest
from pyspark.sql import functions as F

from leadloom.operators import classify, dedup, evals, feedback, ingest, scoring
from leadloom.operators.rules import RULES_V1, RULES_V2
from leadloom.sources import readers, sinks


def at(hours):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=hours)


def test_raw_identity(spark):
    rows = [("s", "a", "h1", at(0), 0), ("s", "b", "h1", at(1), 1), ("s", "a", "h1", at(2), 2), ("s", "a", "h2", at(3), 3), ("t", "a", "h1", at(4), 4), ("s", None, "h3", at(5), 5)]
    df = spark.createDataFrame(rows, "source_id string, external_id string, content_hash string, received_at timestamp, position long")
    got = {r["position"]: r["outcome"] for r in ingest.resolve_raw_identity(df).collect()}
    assert got == {0: "CREATED", 1: "EXISTING_CONTENT_HASH", 2: "EXISTING_EXTERNAL_ID", 3: "CONFLICT", 4: "CREATED", 5: "CREATED"}
    again = ingest.resolve_raw_identity(df.filter("position in (0, 4)"), df.filter("position in (0, 4)").select("source_id", "external_id", "content_hash"))
    assert {r["outcome"] for r in again.collect()} == {"EXISTING_EXTERNAL_ID"}


def items(spark, rows):
    schema = "id long, observed_at timestamp, source_id string, external_id string, canonical_url string, normalized_hash string, text string, verticals array<string>"
    return spark.createDataFrame(rows, schema)


def test_near_edges_are_brute_force(spark):
    r = random.Random(2)
    vocab = "a b c d e f g h".split()
    rows = []
    for i in range(60):
        t = " ".join(r.choice(vocab) for _ in range(r.randint(1, 12))) if i < 40 else rows[r.randrange(40)][6] + r.choice(["", " a", " zz"])
        rows.append((i, at(r.randrange(400)), "s", None, None, t, t, r.sample(["X", "Y"], r.randint(1, 2))))
    got = {x["id"]: x["representative_id"] for x in dedup.dedup_assignments(items(spark, rows), threshold=0.8).collect()}

    def grams(t):
        w = t.split()
        return {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}

    root = {x[0]: x[0] for x in rows}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in rows:
        for b in rows:
            if a[0] < b[0]:
                ga, gb = grams(a[6]), grams(b[6])
                near = abs((a[1] - b[1]).total_seconds()) <= 168 * 3600 and set(a[7]) & set(b[7]) and len(ga & gb) / min(len(ga), len(gb)) >= 0.8
                if a[5] == b[5] or near:
                    root[find(a[0])] = find(b[0])
    head = {}
    for x in sorted(rows, key=lambda x: (x[1], x[0])):
        head.setdefault(find(x[0]), x[0])
    assert got == {x[0]: head[find(x[0])] for x in rows}


def test_best_edge_and_metrics(spark):
    rows = [
        (1, at(0), "s", "e1", "u1", "h1", "one two three four", ["X"]), (2, at(48), "s", "e1", "u2", "h2", "one two three four five", ["X"]), (3, at(50), "t", None, "u1", "h3", "other words here now", ["X"]),
        (4, at(60), "t", "q", None, "h4", "alone in the dark night", ["X"]),
    ]
    got = {x["id"]: tuple(x)[1:] for x in dedup.dedup_assignments(items(spark, rows)).collect()}
    assert got == {1: (1, 1, "REPRESENTATIVE", 1.0, 0.0), 2: (1, 1, "SOURCE_IDENTITY", 1.0, 48.0), 3: (1, 1, "CANONICAL_URL", 1.0, 50.0), 4: (4, 4, "REPRESENTATIVE", 1.0, 0.0)}


def decide(spark, rules, text, verticals):
    df = spark.createDataFrame([(1, 1, None, text, verticals)], "representative_id long, selected_id long, title string, text string, verticals array<string>")
    return classify.classify_clusters(df, rules).first()


def test_classifier(spark):
    d = decide(spark, RULES_V1, "Тендер на строительство школы, приём заявок", ["CONSTRUCTION"])
    assert (d["outcome"], d["category"], d["vertical"], d["classification_confidence"], d["relevance_score"]) == ("AI_ELIGIBLE", "CONSTRUCTION_TENDER", "CONSTRUCTION", 85, 90)
    assert decide(spark, RULES_V1, "Реклама: скидки в ресторане", ["HORECA"])["reason_code"] == "ADVERTISEMENT"
    notice = decide(spark, RULES_V1, "Информация общего назначения о ресторане", ["HORECA"])
    assert (notice["reason_code"], notice["vertical"], notice["category"], notice["classification_confidence"]) == ("EXPLICITLY_IRRELEVANT", "OTHER", "OTHER", 95)
    assert decide(spark, RULES_V1, "Построен новый дом", ["CONSTRUCTION"])["reason_code"] == "NO_OPPORTUNITY_CUE"
    assert decide(spark, RULES_V2, "Построен новый дом", ["CONSTRUCTION"])["outcome"] == "AI_ELIGIBLE"
    denied = spark.createDataFrame([(1, None, None, None, None)], "representative_id long, selected_id long, title string, text string, verticals array<string>")
    d = classify.classify_clusters(denied).first()
    assert (d["outcome"], d["vertical"], d["classification_confidence"]) == ("PERMISSION_DENIED", None, 100)


def test_scores(spark):
    df = spark.createDataFrame([(75.0, 80.0, 85.0, 85.0, 35.0, 70.0), (80.0, 80.0, 85.0, 80.0, 90.0, 80.0)], "actionability double, business_impact double, company_fit double, confidence double, reliability double, urgency double")
    got = scoring.with_opportunity_score_v2(df).collect()
    assert (got[0]["total_score"], got[0]["band"], got[0]["guardrail_applied"], got[0]["effective_confidence"]) == (54.0, "LOW", True, 35.0)
    assert (got[1]["raw_total"], got[1]["band"], got[1]["guardrail_applied"]) == (81.25, "HIGH", False)
    terms = spark.createDataFrame([("гостиницы", "гостиничный"), ("ab", "abc"), ("новая кухня", "кухня"), ("дом", "сад")], "c string, w string")
    assert [r[0] for r in terms.select(scoring.matches_term(F.col("c"), F.col("w"))).collect()] == [True, False, True, False]


def test_feedback(spark):
    rows = [(1, "u", "r", "USEFUL", None, at(0)), (2, "u", "r", "NOT_USEFUL", None, at(1)), (3, "u", "r", "SAVED", 5, at(2)), (4, "u", "r", "USEFUL", None, at(3))]
    kept, clash = feedback.record_feedback(spark.createDataFrame(rows, "id long, user_id string, recommendation_id string, action string, delivery_id long, created_at timestamp"))
    assert {r["id"] for r in kept.collect()} == {1, 3} and {r["id"] for r in clash.collect()} == {2}


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text("""<rss><channel><item><guid isPermaLink="false">g1</guid><title>T</title><link>https://x.test/1</link><pubDate>Tue, 01 Sep 2026 10:00:00 GMT</pubDate><description>Body</description></item>
<item><guid>https://x.test/2</guid><title>Only title</title><pubDate>not a date</pubDate></item><item><title>no url</title></item></channel></rss>""")
    good, bad = readers.read_rss_items(spark, str(tmp_path / "a.xml"))
    got = {r["external_id"]: r for r in good.collect()}
    assert got["g1"]["url"] == "https://x.test/1" and got["g1"]["published_at"] == datetime.datetime(2026, 9, 1, 10) and got["g1"]["raw_text"] == "Body"
    assert got["https://x.test/2"]["raw_text"] == "Only title" and got["https://x.test/2"]["published_at"] is None and bad.count() == 1
    (tmp_path / "b.xml").write_text("""<feed><entry><id>i1</id><title>T</title><link rel="self" href="https://x.test/s"/><link href="https://x.test/e"/><updated>2026-09-01T10:00:00Z</updated><summary>S</summary></entry></feed>""")
    row = readers.read_atom_items(spark, str(tmp_path / "b.xml"))[0].first()
    assert (row["url"], row["raw_text"], row["external_id"], row["published_at"]) == ("https://x.test/e", "S", "i1", datetime.datetime(2026, 9, 1, 10))


def test_datasets(spark, tmp_path):
    import json

    (tmp_path / "d.json").write_text(json.dumps({"createdAt": "2026-01-01T00:00:00Z", "sources": [{"id": "s", "verticals": ["HORECA"]}], "items": [{"fixtureId": "f", "sourceId": "s", "rawText": "x", "labels": {"vertical": "HORECA"}}]}))
    sources, rows = readers.read_item_dataset(spark, str(tmp_path / "d.json"))
    assert sources.first()["id"] == "s" and rows.first()["labels"]["vertical"] == "HORECA"
    (tmp_path / "g.json").write_text(json.dumps({"items": [{"id": "g", "split": "HOLDOUT", "labels": {"relevant": True, "facts": [{"id": "f", "evidenceQuote": "q"}]}}]}))
    assert readers.read_gold_dataset(spark, str(tmp_path / "g.json")).first()["labels"]["facts"][0]["evidenceQuote"] == "q"


def test_append_twice(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert sinks.append_new(rows, str(tmp_path / "t"), ["k"]) == {"created": 2, "existing": 1}
    assert sinks.append_new(rows, str(tmp_path / "t"), ["k"]) == {"created": 0, "existing": 3}
    assert readers.read_stage(spark, str(tmp_path / "t"), "k int, v string").count() == 2


def test_latency_is_nearest_rank(spark):
    runs = spark.createDataFrame([("p", "m", "v", "ALL", float(x), 10, 5) for x in range(1, 21)], "provider string, model string, prompt_version string, split string, latency_ms double, input_tokens long, output_tokens long")
    r = evals.latency_stats(runs).first()
    assert (r["p50"], r["p95"]) == (10.0, 19.0)
    t = evals.token_throughput(runs).first()
    assert t["usage"] == "COMPLETE" and t["tokens_per_second"] == pytest.approx(100 * 1000 / 210, abs=1e-3)


def test_null_identities_are_appended_once(spark, tmp_path):
    rows = spark.createDataFrame([(None, "a"), (1, "b"), (None, "c")], "k int, v string")
    for buckets in (None, 8):
        path = str(tmp_path / f"t{buckets}")
        assert sinks.append_new(rows, path, ["k"], buckets) == {"created": 2, "existing": 1}
        assert sinks.append_new(rows, path, ["k"], buckets) == {"created": 0, "existing": 3}
        assert spark.read.parquet(path).count() == 2


def test_published_rates(spark):
    """160 relevant and 40 irrelevant items, all answered as relevant, each fact quoted: 0.8, 1.0, 0.888889."""
    facts = [("f", "s", "quoted words")]
    gold = spark.createDataFrame(
        [(i, i < 160, "irrelevant_notice" if i >= 160 else "OPENING", "Some  quoted words here", "s1", facts) for i in range(200)],
        "id long, relevant boolean, event_type string, text string, source_id string, facts array<struct<id:string,statement:string,evidenceQuote:string>>",
    )
    said = spark.createDataFrame([(i, "SUCCEEDED", "unclassified", True, None, [("p", ["s1"], "some QUOTED words")]) for i in range(200)], "id long, status string, event_type string, valid boolean, failure_code string, facts array<struct<id:string,sourceIds:array<string>,statement:string>>")
    judged = evals.prediction_validity(gold, said)
    r = evals.relevance_confusion(judged).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.8, 1.0, 0.888889)
    named = {k: F.lit(k) for k in evals.RUN}
    runs = spark.range(200).select(*[c.alias(k) for k, c in named.items()], F.lit(5.0).alias("latency_ms"), F.lit(None).cast("long").alias("input_tokens"), F.lit(None).cast("long").alias("output_tokens"))
    report = evals.benchmark_report(judged.withColumns(named), runs)
    row = report.first()
    assert (row["coverage"], row["valid_rate"], row["event_accuracy"], row["hallucination_count"], row["matched_expected_facts"], row["supported_generated_facts"], row["p95"], row["usage"]) == (1.0, 1.0, 0.0, 0, 200, 200, 5.0, "UNAVAILABLE")
    assert evals.check_report(report).count() == 0
    shouted = said.withColumn("event_type", F.lit(" IRRELEVANT_Notice "))
    assert evals.relevance_confusion(evals.prediction_validity(gold, shouted)).first()["tn"] == 40


def test_criteria_name_what_matched(spark):
    row = spark.range(1).select(
        scoring.fit_region(F.array(F.lit("Moscow Region"), F.lit("Kazan")), F.array(F.lit("moscow"))).alias("region"), scoring.fit_event_type(F.lit("Tender!"), F.array(F.lit("tender"))).alias("event"),
        scoring.fit_vertical(F.lit("HORECA"), F.array(F.lit("CONSTRUCTION"))).alias("vertical"),
    ).first()
    assert (row["region"]["matched_values"], row["event"]["matched_values"], row["vertical"]["matched_values"]) == (["moscow region"], ["tender"], [])


def test_rules_over_absent_columns_are_reported(spark):
    from leadloom.operators.quality import audit_constraints

    got = {r["constraint_name"]: (r["violations"], r["missing"]) for r in audit_constraints({"users": spark.createDataFrame([(0,), (2,)], "revision int")}).collect()}
    assert got == {"revision": (1, None), "time_order": (None, "created_at,updated_at")}

"""Streams whose state is in the state store: repeated, late and replayed rows over several batches."""

import datetime
import random

from leadloom.operators.feedback import record_feedback
from leadloom.streaming.jobs import stream_feedback, stream_ingest

START = datetime.datetime(2026, 1, 1)
RAW = "source_id string, raw_text string, received_at timestamp, n int"
FEEDBACK = "id long, user_id long, recommendation_id long, action string, created_at timestamp"


def landed(spark, tmp_path, rows, schema, batch):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b={batch}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def stored(spark, path, schema):
    return spark.read.parquet(path).select(*[c.split()[0] for c in schema.split(", ")])


def test_ingest_over_batches(spark, tmp_path):
    r = random.Random(1)
    at = lambda d: START + datetime.timedelta(days=d)
    batches = [[(r.choice(["a", "b", None]), r.choice(["x", "y", "z", None, f"t{r.randint(0, 9)}"]), at(r.choice([40 - 10 * b, 40 + b])), b * 100 + i) for i in range(30)] for b in range(3)]  # later batches have older rows too
    out, seen, want = f"{tmp_path}/out", set(), []
    for b, rows in enumerate(batches):
        stream_ingest(landed(spark, tmp_path, rows, RAW, b), out, f"{tmp_path}/state").awaitTermination()
        first = {}
        for s, t, when, n in rows:
            if (s, t) not in seen and ((s, t) not in first or when < first[s, t][2]):
                first[s, t] = (s, t, when, n)
        seen |= set(first)
        want += [(s, t, when) for s, t, when, _ in first.values()]
        got = sorted(((x["source_id"], x["raw_text"], x["received_at"]) for x in stored(spark, out, RAW).collect()), key=str)
        assert got == sorted(want, key=str)
    stream_ingest(landed(spark, tmp_path, batches[0], RAW, 7), out, f"{tmp_path}/state").awaitTermination()  # rows that come again
    assert stored(spark, out, RAW).count() == len(want)
    new = landed(spark, tmp_path, [("new", "x", at(1), 5)], RAW, 8)
    stream_ingest(new, out, f"{tmp_path}/state-2").awaitTermination()  # a new checkpoint replays everything
    assert sorted(map(str, stored(spark, out, RAW).select("source_id", "raw_text").collect())) == sorted(map(str, [*stored(spark, out, RAW).select("source_id", "raw_text").distinct().collect()]))
    assert stored(spark, out, RAW).count() == len(want) + 1


def test_batches_do_not_read_the_table(spark, tmp_path):
    """Once there is a checkpoint, the table can be anything: what has been seen is in the state."""
    out = f"{tmp_path}/out"
    stream_ingest(landed(spark, tmp_path, [("a", f"t{i}", START, i) for i in range(50)], RAW, 0), out, f"{tmp_path}/state").awaitTermination()
    spark.createDataFrame([], RAW + ", content_hash string").write.mode("overwrite").parquet(out)
    query = stream_ingest(landed(spark, tmp_path, [("a", f"t{i}", START, i) for i in range(45, 53)], RAW, 1), out, f"{tmp_path}/state")
    query.awaitTermination()
    assert sorted(x["raw_text"] for x in stored(spark, out, RAW).collect()) == ["t50", "t51", "t52"]
    assert sum(p["numInputRows"] for p in query.recentProgress) == 8


def test_feedback_over_batches(spark, tmp_path):
    r = random.Random(2)
    actions = ["USEFUL", "NOT_USEFUL", "SAVED", "ACTED", None]
    rows = [(i, r.choice([1, 2, None]), r.randint(0, 4), r.choice(actions), START + datetime.timedelta(minutes=i // 2)) for i in range(120)]
    out = f"{tmp_path}/out"
    for b in range(3):  # in the order of time, as record_feedback takes all of them
        stream_feedback(landed(spark, tmp_path, rows[40 * b : 40 * b + 40], FEEDBACK, b), out, f"{tmp_path}/state").awaitTermination()
    kept, _ = record_feedback(spark.createDataFrame([x for x in rows if x[3] is not None], FEEDBACK))
    want = {x["id"] for x in kept.collect()}
    got = stored(spark, out, FEEDBACK).collect()
    assert {x["id"] for x in got if x["action"] is not None} == want and len(got) == len({x["id"] for x in got})
    assert len([x for x in got if x["action"] is None]) == len({x[1:3] for x in rows if x[3] is None})
    stream_feedback(landed(spark, tmp_path, [(500, 1, 0, "USEFUL", START), (501, 1, 77, "NOT_USEFUL", START), (502, 1, 77, "USEFUL", START)], FEEDBACK, 3), out, f"{tmp_path}/state-2").awaitTermination()
    assert {x["id"] for x in stored(spark, out, FEEDBACK).collect()} - {x["id"] for x in got} == {501}

"""Streams keep identities in Spark's own deduplication: no Python worker goes through them one by one."""

import datetime

from leadloom.streaming.jobs import stream_feedback, stream_ingest
from tests.test_streams import FEEDBACK, RAW, START, landed, stored


def operators(query) -> set[str]:
    return {s["operatorName"] for p in query.recentProgress for s in p["stateOperators"]}


def test_state_is_spark_s_own(spark, tmp_path):
    one, two = f"{tmp_path}/one", f"{tmp_path}/two"
    raw = stream_ingest(landed(spark, tmp_path / "r", [("a", "t", START, 1), ("a", "t", START, 1)], RAW, 0), one, f"{tmp_path}/s1")
    raw.awaitTermination()
    said = stream_feedback(landed(spark, tmp_path / "f", [(2, 1, 1, "USEFUL", START), (1, 1, 1, "NOT_USEFUL", START), (3, 1, 1, "SAVED", START)], FEEDBACK, 0), two, f"{tmp_path}/s2")
    said.awaitTermination()
    assert operators(raw) == operators(said) == {"dedupe"}
    assert stored(spark, one, RAW).count() == 1 and sorted(x["id"] for x in stored(spark, two, FEEDBACK).collect()) == [1, 3]


def test_days(spark, tmp_path):
    """Within the days an identity is known, from its own checkpoint and from another."""
    out, late = f"{tmp_path}/out", START + datetime.timedelta(days=900)
    for batch, (when, state) in enumerate([(START, "a"), (late, "a"), (late, "b")]):
        stream_ingest(landed(spark, tmp_path, [("s", "t", when, batch), ("s", f"t{batch}", when, batch)], RAW, batch), out, f"{tmp_path}/{state}", days=2).awaitTermination()
    assert sorted(x["raw_text"] for x in stored(spark, out, RAW).collect()) == ["t", "t0", "t1", "t2"]

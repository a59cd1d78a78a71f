"""Ingestion leaves no second copy of the raw texts in the shared folder."""

import datetime
import os
import random

from leadloom.plans import pipeline
from leadloom.plans.lineage import shared_dir
from leadloom.plans.stages import Stages


def test_raw_texts_are_kept_once(spark, tmp_path):
    r = random.Random(1)
    at = datetime.datetime(2026, 1, 1)
    rows = [("s", f"e{i}", f"https://x.test/{i}", at, at, i, r.randbytes(10_000).hex(), None) for i in range(60)]
    given = spark.createDataFrame(rows, "source_id string, external_id string, url string, published_at timestamp, received_at timestamp, position long, raw_text string, raw_payload string")
    folder = shared_dir(spark).removeprefix("file://")
    size = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(folder) for f in names)
    before = size()
    stages = Stages(spark, str(tmp_path / "out"))
    pipeline._ingested(stages, given, spark.createDataFrame([("s",)], "source_id string"))
    assert size() - before < 60 * 5_000  # the texts have 60 * 20,000 bytes
    assert sorted(x["raw_text"] for x in stages.read("raw_items").collect()) == sorted(x[6] for x in rows)

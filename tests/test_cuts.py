"""Cuts leave no shuffle files."""

import time

from leadloom.plans.lineage import cut, stored


def test_cut_leaves_no_shuffle_files(spark):
    files = lambda: sum(f.getName().startswith("shuffle_") for f in _all(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()))
    frame = spark.range(1000).repartition(3).groupBy("id").count()
    before = files()
    one, two = cut(frame), stored(frame, "test")
    until = time.time() + 20
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before
    assert one.count() == two.count() == frame.count() == 1000


def _all(seq):
    return [seq.apply(i) for i in range(seq.size())]

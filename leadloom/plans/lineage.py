"""Lineage cuts and tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where it is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        local = sc.master.startswith("local[") or sc.master == "local"
        named = tempfile.mkdtemp(prefix="spark-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


#: Spark's removal of an execution's shuffle files at its end. Else they stay until the driver's heap fills and is collected.
_REMOVAL = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is planned and run inside leaves no shuffle files; what it has made is read from the shared folder."""
    before = spark.conf.get(_REMOVAL, "false")
    spark.conf.set(_REMOVAL, "true")
    try:
        yield
    finally:
        spark.conf.set(_REMOVAL, before)


def cut(df: DataFrame) -> DataFrame:
    """Lineage cut in the shared folder; survives lost executors. Its shuffles leave the disk as soon as it is made."""
    shared_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own, under this setting


def new_table(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder (at a fresh path unless one is given): a lineage cut for many small rows, which a checkpoint would not compress."""
    path = path or new_table(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def emptied(spark: SparkSession, *paths: str) -> None:
    """Takes the rows of stored tables off the disk, once nothing reads them any more."""
    for path in paths:
        spark.createDataFrame([], "none int").coalesce(1).write.mode("overwrite").parquet(path)


#: Rows of an Arrow batch, where the session has Spark's default of 10,000: texts are long, and both the executor and its Python worker hold a batch whole.
ARROW_ROWS = 1000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches of ARROW_ROWS rows for Python workers, unless the session names another number."""
    if spark.conf.get(_ARROW) == "10000":
        spark.conf.set(_ARROW, ARROW_ROWS)

"""Structured Streaming forms of ingestion, counters and feedback. What has been seen is in the state store; replays add nothing."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadloom.operators.feedback import SENTIMENT
from leadloom.operators.telemetry import counter_rows
from leadloom.sources.sinks import same, stored_rows

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _state_store(spark: SparkSession) -> None:
    """Identities are kept in the RocksDB store, not in memory; another choice of the session stays."""
    if spark.conf.get(_PROVIDER, "HDFSBackedStateStoreProvider").endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _first_rows(rows: DataFrame, identity: dict[str, Column], place: Column, path: str, checkpoint: str, once: bool, days: int | None = None) -> StreamingQuery:
    """Of the rows of one identity the first one ever, by place within its batch; later ones, in this batch or another, are left out.

    The state store holds identities only, in Spark's own deduplication: a batch is all its rows and, beside them, one
    marked row of each identity that is new, and the first row of each marked identity is written. Each batch is a partition
    (run, batch) of the table, so a batch that is run again replaces itself. Of the table only what other checkpoints
    have written is read, by its identities; the files of this one are not.
    """
    spark, columns, schema = rows.sparkSession, rows.columns, rows.schema
    _state_store(spark)
    run, keys = hashlib.sha256(checkpoint.encode()).hexdigest()[:16], list(identity)
    named = rows.select(F.struct(*columns).alias("_row"), place.alias("_place"), *[c.alias(k) for k, c in identity.items()])
    dealt = named.repartition(*keys)  # by state partitions; both uses have all columns, so Spark reads and deals the batch once
    if days is None:
        marks = dealt.dropDuplicates(keys)
    else:  # an identity is dropped when the watermark, which trails by the delay, has passed its own time and the delay
        marks = dealt.withColumn("_at", F.current_timestamp()).withWatermark("_at", f"{days * 12} hours").dropDuplicatesWithinWatermark(keys).drop("_at")
    batches = dealt.withColumn("_new", F.lit(False)).unionByName(marks.withColumn("_new", F.lit(True)))

    def save(batch: DataFrame, number: int) -> None:
        first = batch.groupBy(*keys).agg(F.min_by("_row", "_place").alias("_row"), F.bool_or("_new").alias("_new")).filter("_new")
        stored = stored_rows(batch.sparkSession, path, schema, files=True).filter(~F.contains("_file", F.lit(f"/run={run}/")))
        if days is not None:
            stored = stored.filter(F.col("_written") > F.current_timestamp() - F.make_dt_interval(F.lit(days)))
        stored = stored.select(*[c.alias(k) for k, c in identity.items()]).distinct()
        first.join(stored, same(first, stored, keys), "left_anti").select("_row.*").write.mode("overwrite").parquet(f"{path}/run={run}/batch={number}")

    writer = batches.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_ingest(raw: DataFrame, path: str, checkpoint: str, once: bool = True, days: int | None = None) -> StreamingQuery:
    """Raw rows (source_id, raw_text, received_at, ...) -> new items at path, the first row of each content of a source.

    State holds identities, in the state store and not in memory, so a batch reads neither its own table nor other
    identities, whatever their number. A new checkpoint takes the identities that the table has from others as seen;
    a batch that is run again gives the same rows once. Late rows are judged like others: no watermark drops them.
    days: identities are forgotten so long after they were written; None keeps them. Null sources and texts are values
    like others. Of rows of one batch the one received first is kept.
    """
    hashed = raw.withColumn("content_hash", F.sha2("raw_text", 256))
    place = F.struct(F.col("received_at").isNull(), "received_at")
    return _first_rows(hashed, {"_source": F.col("source_id"), "_content": F.col("content_hash")}, place, path, checkpoint, once, days)


def stream_counters(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counters by tumbling window."""
    rows = counter_rows(events).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), "name", "labels").agg(F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), "name", "labels", "value")


def _group(action: Column) -> Column:
    """What an action is the first of: the two sentiments are one; no action is a kind of its own."""
    return F.when(action.isin(*SENTIMENT), "sentiment").when(action.isNotNull(), F.concat(F.lit("action "), action)).otherwise("none")


def stream_feedback(events: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Continuous record_feedback: the first write wins across batches.

    State holds the kinds of action that a user has sent for a recommendation, so a batch reads no feedback of its own
    checkpoint. A new checkpoint takes what the table has from others as seen. Within a batch the order is that of
    created_at and id; a row that comes in a later batch is later, whatever its time says.
    """
    identity = {"_user": F.col("user_id"), "_recommendation": F.col("recommendation_id"), "_group": _group(F.col("action"))}
    return _first_rows(events, identity, F.struct("created_at", "id"), path, checkpoint, once)

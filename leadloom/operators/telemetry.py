"""Operational events to counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snake(name: Column) -> Column:
    """camelCase and dashes to lower snake case."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"), r"[^A-Za-z0-9]+", "_"))


def label_text(labels: Column) -> Column:
    """Labels as sorted name=value text, both normalised."""
    pairs = F.transform(F.map_entries(labels), lambda e: F.concat_ws("=", snake(e["key"]), F.lower(F.trim(e["value"]))))
    return F.array_join(F.array_sort(pairs), ",")


def counter_rows(events: DataFrame) -> DataFrame:
    """(ts, name, labels, value) of events (ts, name, labels map, value); increments of 0 drop out."""
    return events.select("ts", F.concat(snake(F.col("name")), F.lit("_total")).alias("name"), label_text(F.col("labels")).alias("labels"), F.col("value").cast("double").alias("value")).filter("value <> 0")


def event_counters(events: DataFrame) -> DataFrame:
    return counter_rows(events).groupBy("name", "labels").agg(F.sum("value").alias("value"))

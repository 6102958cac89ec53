"""Nested event parameters: unnest, filter by key, count values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unnest_params(events: DataFrame) -> DataFrame:
    """One row per event parameter; events without parameters disappear."""
    return events.select(
        "event_id", "event_name", F.inline("event_params").alias("param_key", "param_value")
    ).select(
        "event_id",
        "event_name",
        "param_key",
        F.col("param_value.string_value").alias("string_value"),
    )


def param_values(events: DataFrame, key: str) -> DataFrame:
    """Values of one key. Other parameters are dropped inside the array, before it is unnested."""
    wanted = F.filter("event_params", lambda p: p["key"] == key)
    return events.select("event_id", F.explode(wanted).alias("_param")).select(
        "event_id", F.col("_param.value.string_value").alias("string_value")
    )


def param_value_counts(events: DataFrame, key: str, event_name: str) -> DataFrame:
    """How often each value of `key` occurs in events of one name; NULL is a value."""
    return (
        param_values(events.where(F.col("event_name") == event_name), key)
        .groupBy("string_value")
        .agg(F.count("*").alias("cnt"))
        .orderBy(F.col("cnt").desc(), F.col("string_value").asc_nulls_last())
    )

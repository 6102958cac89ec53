"""Engagement bounds, label flags and latest device per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.skew import heavy_keys, salted_join
from ebbtide.schema import USER, ChurnRules

DEVICE_COLUMNS = ("country_name", "device_os", "device_lang")


def engagement_events(events: DataFrame, rules: ChurnRules = ChurnRules()) -> DataFrame:
    return events.where(F.col("event_name") == rules.engagement_event)


def log_end(events: DataFrame, rules: ChurnRules = ChurnRules()) -> DataFrame:
    """One row: time of the last engagement event of all users (reads two columns)."""
    return engagement_events(events, rules).agg(F.max("event_timestamp").alias("log_end_us"))


def engagement_span(events: DataFrame, rules: ChurnRules = ChurnRules()) -> DataFrame:
    """First and last engagement per user, in microseconds; one map-side combined aggregate."""
    return (
        engagement_events(events, rules)
        .groupBy(USER)
        .agg(
            F.min("event_timestamp").alias("first_us"),
            F.max("event_timestamp").alias("last_us"),
        )
    )


def engagement_bounds(events: DataFrame, rules: ChurnRules = ChurnRules()) -> DataFrame:
    """First and last engagement per user, and the end of the log on each row.

    The end of the log is one aggregated row that is broadcast: a window over the whole log
    would move all rows into one task.
    """
    return (
        engagement_span(events, rules)
        .crossJoin(F.broadcast(log_end(events, rules)))
        .select(
            USER,
            F.timestamp_micros("first_us").alias("user_first_engagement"),
            F.timestamp_micros("last_us").alias("user_last_engagement"),
            F.timestamp_micros("log_end_us").alias("max_ts_events"),
        )
    )


def heavy_users(events: DataFrame) -> DataFrame:
    """Users with more events than one task should read (reads one column)."""
    return heavy_keys(events.select(USER), USER)


def engagement_bounds_window(events: DataFrame, rules: ChurnRules = ChurnRules()) -> DataFrame:
    """First and last engagement attached to each engagement event (rows are kept).

    Equal to a window over the user's partition, but the bounds come from an aggregate, so
    that a user with very many events is never sorted or buffered in one task. Rows without
    a user id form one group; its single span is broadcast to them.
    """
    rows = engagement_events(events, rules).select("event_id", USER, "event_timestamp")
    span = engagement_span(events, rules)
    known, unknown = F.col(USER).isNotNull(), F.col(USER).isNull()
    facts, dims = rows.where(known), span.where(known)
    joined = salted_join(facts, dims, USER, heavy_users(events), ["event_id"])
    nobody = F.broadcast(span.where(unknown).drop(USER))  # one row
    columns = ["event_id", USER, "event_timestamp", "first_us", "last_us"]
    anonymous = rows.where(unknown).crossJoin(nobody)
    return joined.select(*columns).unionByName(anonymous.select(*columns))


def flag_columns(rules: ChurnRules = ChurnRules()) -> dict[str, F.Column]:
    """0/1 flags over `first_us`, `last_us` and `log_end_us`."""
    first, last, end = F.col("first_us"), F.col("last_us"), F.col("log_end_us")

    def flag(condition):
        return F.when(condition, F.lit(1)).otherwise(F.lit(0))

    return {
        "is_enable": flag(~(first > end - rules.censor_micros)),
        "bounced": flag(last <= first + rules.bounce_micros),
        "churned": flag(last < first + rules.churn_micros),
    }


def user_flags(events: DataFrame, rules: ChurnRules = ChurnRules()) -> DataFrame:
    spans = engagement_span(events, rules).crossJoin(F.broadcast(log_end(events, rules)))
    flags = flag_columns(rules)
    return spans.select(USER, *[c.alias(name) for name, c in flags.items()])


def _device_values() -> list[F.Column]:
    sources = ("geo.country", "device.operating_system", "device.language")
    return [F.col(s).alias(d) for s, d in zip(sources, DEVICE_COLUMNS)]


def latest_device(events: DataFrame, rules: ChurnRules = ChurnRules()) -> DataFrame:
    """Country, system and language of the user's latest engagement event.

    `row_number() = 1` is cut to one row per user and task before the shuffle
    (WindowGroupLimit), so heavy users cost no more than light ones.
    """
    newest = Window.partitionBy(USER).orderBy(
        F.col("event_timestamp").desc(), F.col("event_id").desc()
    )
    return (
        engagement_events(events, rules)
        .select(USER, "event_id", "event_timestamp", *_device_values())
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") == 1)
        .select(USER, *DEVICE_COLUMNS)
    )


def engagement_profile(events: DataFrame, rules: ChurnRules = ChurnRules()) -> DataFrame:
    """Bounds and latest device in one pass and one shuffle of the engagement events.

    The greatest (time, id) with its device is a struct, which Spark aggregates by sorting: each
    task sorts its engagement events by user once before the shuffle.

    A NULL user id gets no device: it is equal to no other id, so a join would find none.
    """
    newest = F.max_by(
        F.struct(*_device_values()), F.struct(F.col("event_timestamp"), F.col("event_id"))
    )
    grouped = (
        engagement_events(events, rules)
        .groupBy(USER)
        .agg(
            F.min("event_timestamp").alias("first_us"),
            F.max("event_timestamp").alias("last_us"),
            newest.alias("_device"),
        )
    )
    known = F.col(USER).isNotNull()
    return grouped.select(
        USER,
        "first_us",
        "last_us",
        *[F.when(known, F.col(f"_device.{c}")).alias(c) for c in DEVICE_COLUMNS],
    )

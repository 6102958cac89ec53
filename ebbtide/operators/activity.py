"""Events of the first day after a user's first engagement, and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.skew import salted_join
from ebbtide.operators.engagement import engagement_span, heavy_users
from ebbtide.schema import COUNTERS, TRACKED_EVENTS, USER, ChurnRules


def within_first_day(
    events: DataFrame,
    spans: DataFrame,
    heavy: DataFrame,
    rules: ChurnRules = ChurnRules(),
) -> DataFrame:
    """Events joined with their user's span, up to and including the end of the first day.

    There is no lower bound: events before the first engagement belong to the first day.
    The rows of `heavy` users (see `heavy_keys`) are spread over many tasks by event id.
    """
    in_time = F.col("event_timestamp") <= F.col("first_us") + rules.churn_micros
    return salted_join(events, spans, USER, heavy, ["event_id"], condition=in_time)


def first_day_events(events: DataFrame, rules: ChurnRules = ChurnRules()) -> DataFrame:
    """All event columns of the first day of every user with an engagement."""
    spans = engagement_span(events, rules).select(USER, "first_us")
    joined = within_first_day(events, spans, heavy_users(events), rules)
    return joined.select(*events.columns)


def counter_columns() -> list[F.Column]:
    return [
        F.sum(F.when(F.col("event_name") == name, F.lit(1)).otherwise(F.lit(0)))
        .cast("long")
        .alias(counter)
        for name, counter in zip(TRACKED_EVENTS, COUNTERS)
    ]


def behavior_counts(events: DataFrame, rules: ChurnRules = ChurnRules()) -> DataFrame:
    """The eleven first-day counters per user; names that never occur count 0."""
    spans = engagement_span(events, rules).select(USER, "first_us")
    narrow = events.select(USER, "event_id", "event_timestamp", "event_name")
    joined = within_first_day(narrow, spans, heavy_users(events), rules)
    return joined.groupBy(USER).agg(*counter_columns())

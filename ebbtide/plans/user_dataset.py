"""The per-user dataset: one row per engaged user with labels, device and first-day counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.activity import counter_columns, within_first_day
from ebbtide.operators.engagement import (
    DEVICE_COLUMNS,
    engagement_profile,
    flag_columns,
    heavy_users,
)
from ebbtide.schema import COUNTERS, TRACKED_EVENTS, USER, USER_SCHEMA, ChurnRules


def user_dataset(
    events: DataFrame, rules: ChurnRules = ChurnRules(), end: DataFrame | None = None
) -> DataFrame:
    """Nineteen columns per user.

    Plan, the same at every size, in four scans: the engagement events give bounds and device per
    user; two narrow scans that are summed up at once give the end of the log and the events per
    user; the tracked events are joined with the bounds, heavy users spread, and counted per user
    and task before the counts are shuffled. `end` may give the end of the log
    (one row, `log_end_us`) when the caller knows it.
    """
    profile = engagement_profile(events, rules)
    carried = [USER, "first_us", "last_us", *DEVICE_COLUMNS]
    tracked = events.where(F.col("event_name").isin(*TRACKED_EVENTS)).select(
        USER, "event_id", "event_timestamp", "event_name"
    )
    counted = (
        within_first_day(tracked, profile.where(F.col(USER).isNotNull()), heavy_users(events), rules)
        .groupBy(*carried)
        .agg(*counter_columns())
    )
    # Each user with an id owns at least the engagement event that made them a user, so the
    # inner join loses none. Rows without an id form one user without device and counters.
    anonymous = profile.where(F.col(USER).isNull()).select(
        *carried, *[F.lit(None).cast("long").alias(c) for c in COUNTERS]
    )
    users = counted.unionByName(anonymous).crossJoin(
        F.broadcast(profile.agg(F.max("last_us").alias("log_end_us")) if end is None else end)
    )
    flags = flag_columns(rules)
    return users.withColumns(flags).select(
        F.timestamp_micros("first_us").alias("user_first_engagement"),
        *USER_SCHEMA.fieldNames()[1:],
    )


def trainable(users: DataFrame) -> DataFrame:
    """Users whose label is final and who did not bounce."""
    return users.where((F.col("is_enable") == 1) & (F.col("bounced") == 0))


def undecided(users: DataFrame) -> DataFrame:
    """Users who did not bounce but whose label may still change."""
    return users.where((F.col("is_enable") == 0) & (F.col("bounced") == 0))

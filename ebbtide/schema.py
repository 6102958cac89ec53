"""Column roles, label rules and Spark schemas of the event log and the per-user dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

USER = "user_pseudo_id"
LABEL = "churned"
FIRST_SEEN = "user_first_engagement"

# Event names that are counted per user during the first day.
TRACKED_EVENTS = (
    "user_engagement",
    "level_start_quickplay",
    "level_end_quickplay",
    "level_complete_quickplay",
    "level_reset_quickplay",
    "post_score",
    "spend_virtual_currency",
    "ad_reward",
    "challenge_a_friend",
    "completed_5_levels",
    "use_extra_steps",
)

COUNTERS = tuple(f"cnt_{name}" for name in TRACKED_EVENTS)
CATEGORIES = ("country_name", "device_os", "device_lang")
IGNORED = (FIRST_SEEN, USER, "is_enable", "bounced")


@dataclass(frozen=True)
class ColumnRoles:
    """Which columns of a per-user frame are features, which is the label, which are left out."""

    numeric: tuple[str, ...] = COUNTERS
    categorical: tuple[str, ...] = CATEGORIES
    ignored: tuple[str, ...] = IGNORED
    label: str = LABEL

    def numeric_only(self) -> "ColumnRoles":
        return ColumnRoles(self.numeric, (), self.ignored + self.categorical, self.label)


@dataclass(frozen=True)
class ChurnRules:
    """Thresholds that turn engagement times into labels."""

    engagement_event: str = "user_engagement"
    churn_hours: int = 24
    bounce_minutes: int = 10
    censor_hours: int = 48

    @property
    def churn_micros(self) -> int:
        return self.churn_hours * 3_600_000_000

    @property
    def bounce_micros(self) -> int:
        return self.bounce_minutes * 60_000_000

    @property
    def censor_micros(self) -> int:
        return self.censor_hours * 3_600_000_000


EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("event_timestamp", T.LongType()),
        T.StructField(USER, T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("geo", T.StructType([T.StructField("country", T.StringType())])),
        T.StructField(
            "device",
            T.StructType(
                [
                    T.StructField("operating_system", T.StringType()),
                    T.StructField("language", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "event_params",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("key", T.StringType()),
                        T.StructField(
                            "value",
                            T.StructType([T.StructField("string_value", T.StringType())]),
                        ),
                    ]
                )
            ),
        ),
    ]
)

USER_SCHEMA = T.StructType(
    [
        T.StructField(FIRST_SEEN, T.TimestampType()),
        T.StructField(USER, T.StringType()),
        T.StructField("is_enable", T.IntegerType()),
        T.StructField("bounced", T.IntegerType()),
        *[T.StructField(c, T.StringType()) for c in CATEGORIES],
        *[T.StructField(c, T.LongType()) for c in COUNTERS],
        T.StructField(LABEL, T.IntegerType()),
    ]
)

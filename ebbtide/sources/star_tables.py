"""Event log in the schema of `EVENT_SCHEMA`, derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.schema import USER

# Fixed values of the mapping from the test tables to game events.
WEEK_ZERO = "2024-01-01"


# Only the columns the event log needs; a given schema saves the job that infers one.
TABLE_SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, props string",
    "customer": "c_custkey long, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


# event_type -> event names, picked by k modulo the number of names
EVENT_NAMES = {
    "purchase": ["user_engagement"],
    "click": ["level_start_quickplay", "post_score"],
    "view": ["level_end_quickplay", "level_complete_quickplay"],
    "error": ["level_reset_quickplay", "spend_virtual_currency", "use_extra_steps"],
    "signup": ["ad_reward", "challenge_a_friend", "completed_5_levels"],
}
SYSTEMS = ["IOS", "ANDROID", "ANDROID"]
LANGUAGES = ["en-us"] * 5 + ["de-de", "en-in", "es-us", "pt-br", None]
SCREENS = ["game_board", "menu", "shop", None]


def _pick(values: list, k):
    """The value at position `k` modulo the number of values; `k` is evaluated once."""
    if len(values) == 1:
        return F.lit(values[0])
    choices = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(choices, k % len(values) + 1)


def _event_name(k):
    name = F
    for event_type, names in EVENT_NAMES.items():
        name = name.when(F.col("event_type") == event_type, _pick(names, k))
    return name


def _param(key: str, value):
    return F.struct(F.lit(key).alias("key"), F.struct(value.alias("string_value")).alias("value"))


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """The event log over `events`, `customer` and `nation`.

    Customers are grouped by their key before the join. This tells Catalyst that the left
    join cannot multiply rows, so jobs that never look at the country lose the join. The
    customer table grows with the data: how to join it is left to the size estimates.
    """
    raw = table(spark, folder, "events")
    nations = table(spark, folder, "nation")  # 25 rows
    homes = (
        table(spark, folder, "customer")
        .join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .groupBy(F.col("c_custkey").alias("user_id"))
        .agg(F.max("n_name").alias("_country"))
    )
    events = raw.join(homes, "user_id", "left")
    ts = F.col("ts").cast("timestamp")
    k = F.get_json_object("props", "$.k").cast("int")
    week = F.floor(F.datediff(F.col("ts"), F.lit(WEEK_ZERO).cast("date")) / 7).cast("string")
    return events.select(
        "event_id",
        F.to_date("ts").alias("event_date"),
        F.unix_micros(ts).alias("event_timestamp"),
        F.concat(F.col("user_id").cast("string"), F.lit("_w"), week).alias(USER),
        _event_name(k).alias("event_name"),
        F.struct(F.col("_country").alias("country")).alias("geo"),
        F.struct(
            _pick(SYSTEMS, k).alias("operating_system"),
            _pick(LANGUAGES, k).alias("language"),
        ).alias("device"),
        F.array(
            _param("k", k.cast("string")), _param("firebase_screen_class", _pick(SCREENS, k))
        ).alias("event_params"),
    )

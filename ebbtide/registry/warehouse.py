"""Queries on the event log: scans, bounds, devices, counters, parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.functions.timing import calendar_columns, shift, wall_clock
from ebbtide.operators import activity, engagement, event_params
from ebbtide.plans.user_dataset import trainable, undecided, user_dataset
from ebbtide.registry import common
from ebbtide.registry.oracle import COUNTERS_SQL, EV, USERS, q
from ebbtide.schema import FIRST_SEEN, USER, ChurnRules
from ebbtide.sources.event_log import read_event_day, read_event_log, union_shards
from ebbtide.sources.sql_text import SQL_FOLDER, run_sql_file

RULES = ChurnRules()
DAY = "2024-01-07"
SCREEN = "firebase_screen_class"


def flat(events):
    """Scalar columns of events, nested ones taken apart."""
    return events.select(
        "event_id",
        "event_date",
        "event_timestamp",
        USER,
        "event_name",
        F.col("geo.country").alias("country_name"),
        F.col("device.operating_system").alias("device_os"),
        F.col("device.language").alias("device_lang"),
        F.size("event_params").alias("n_params"),
    )


def scan_events(spark, folder):
    return flat(read_event_log(spark, common.log_folder(spark, folder)))


def scan_one_day(spark, folder):
    return flat(read_event_day(spark, common.log_folder(spark, folder), DAY))


def union_loose_shards(spark, folder):
    """Day shards with different columns, stacked by name: those of odd days have no device."""
    events = flat(read_event_log(spark, common.log_folder(spark, folder)))
    odd = F.dayofmonth("event_date") % 2 == 1
    return union_shards([events.where(~odd), events.where(odd).drop("device_os", "device_lang")])


def nested_fields(spark, folder):
    return common.log(spark, folder).select(
        "event_id",
        F.col("geo.country").alias("country_name"),
        F.col("device.operating_system").alias("device_os"),
        F.col("device.language").alias("device_lang"),
    )


def filter_event(spark, folder):
    rows = engagement.engagement_events(common.log(spark, folder))
    return rows.select("event_id", USER, "event_timestamp")


def filter_param_key(spark, folder):
    return event_params.param_values(common.log(spark, folder), SCREEN)


def param_value_counts(spark, folder):
    return event_params.param_value_counts(common.log(spark, folder), SCREEN, "user_engagement")


def unnest_params(spark, folder):
    return event_params.unnest_params(common.log(spark, folder))


def engagement_bounds(spark, folder):
    bounds = engagement.engagement_bounds(common.log(spark, folder))
    return bounds.select(USER, *[wall_clock(c).alias(c) for c in bounds.columns if c != USER])


def engagement_bounds_window(spark, folder):
    return engagement.engagement_bounds_window(common.log(spark, folder))


def user_flags(spark, folder):
    return engagement.user_flags(common.log(spark, folder))


def latest_device(spark, folder):
    return engagement.latest_device(common.log(spark, folder))


def first_day_events(spark, folder):
    rows = activity.first_day_events(common.log(spark, folder))
    return rows.select("event_id", USER, "event_timestamp", "event_name")


def star_projection(spark, folder):
    """All columns of the joined events (`e.*`)."""
    return flat(activity.first_day_events(common.log(spark, folder)).alias("e").select("e.*"))


def behavior_counts(spark, folder):
    return activity.behavior_counts(common.log(spark, folder))


def user_dataset_query(spark, folder):
    return common.shown(user_dataset(common.log(spark, folder)))


def sql_from_file(spark, folder):
    rules = {
        "engagement_event": RULES.engagement_event,
        "churn_hours": RULES.churn_hours,
        "censor_hours": RULES.censor_hours,
        "bounce_minutes": RULES.bounce_minutes,
    }
    frame = run_sql_file(
        spark, SQL_FOLDER / "user_dataset.sql", rules, {"events": common.log(spark, folder)}
    )
    return common.shown(frame)


def population_train(spark, folder):
    return common.shown(trainable(common.users(spark, folder)))


def population_not_yet(spark, folder):
    return common.shown(undecided(common.users(spark, folder)))


def star_except(spark, folder):
    return common.train(spark, folder).drop(FIRST_SEEN, USER)


def time_scalars(spark, folder):
    ts = F.timestamp_micros("event_timestamp")
    return common.log(spark, folder).select(
        "event_id",
        wall_clock(ts).alias("event_time"),
        wall_clock(shift(ts, "HOUR", 24)).alias("plus_24_hours"),
        wall_clock(shift(ts, "HOUR", -48)).alias("minus_48_hours"),
        wall_clock(shift(ts, "MINUTE", 10)).alias("plus_10_minutes"),
        wall_clock(F.timestamp_millis(F.floor(F.col("event_timestamp") / 1000))).alias("to_millis"),
    )


def calendar_features(spark, folder):
    calendar = calendar_columns(FIRST_SEEN)
    return common.users(spark, folder).select(
        USER, *[c.alias(name) for name, c in calendar.items()]
    )


QUERIES = {
    "scan_events": scan_events,
    "scan_one_day": scan_one_day,
    "union_loose_shards": union_loose_shards,
    "nested_fields": nested_fields,
    "filter_event": filter_event,
    "filter_param_key": filter_param_key,
    "param_value_counts": param_value_counts,
    "unnest_params": unnest_params,
    "engagement_bounds": engagement_bounds,
    "engagement_bounds_window": engagement_bounds_window,
    "user_flags": user_flags,
    "latest_device": latest_device,
    "first_day_events": first_day_events,
    "star_projection": star_projection,
    "behavior_counts": behavior_counts,
    "user_dataset": user_dataset_query,
    "sql_from_file": sql_from_file,
    "population_train": population_train,
    "population_not_yet": population_not_yet,
    "star_except": star_except,
    "time_scalars": time_scalars,
    "calendar_features": calendar_features,
}

FLAT_SQL = """event_id, event_date, event_timestamp, user_pseudo_id, event_name, country_name,
  device_os, device_lang, CAST(2 AS INTEGER) AS n_params"""
SPAN_SQL = """span AS (SELECT user_pseudo_id, min(event_timestamp) AS first_us,
  max(event_timestamp) AS last_us FROM ev WHERE event_name = 'user_engagement' GROUP BY ALL)"""
FIRST_DAY_SQL = """ev JOIN span USING (user_pseudo_id)
  WHERE event_timestamp <= first_us + 86400000000"""

ORACLE = {
    "scan_events": q(EV, f"SELECT {FLAT_SQL} FROM ev"),
    "scan_one_day": q(EV, f"SELECT {FLAT_SQL} FROM ev WHERE event_date = DATE '{DAY}'"),
    "union_loose_shards": q(
        EV,
        f"""SELECT {FLAT_SQL} FROM ev WHERE day(event_date) % 2 = 0
        UNION ALL SELECT event_id, event_date, event_timestamp, user_pseudo_id, event_name,
          country_name, NULL, NULL, 2 FROM ev WHERE day(event_date) % 2 = 1""",
    ),
    "nested_fields": q(EV, "SELECT event_id, country_name, device_os, device_lang FROM ev"),
    "filter_event": q(
        EV,
        """SELECT event_id, user_pseudo_id, event_timestamp FROM ev
        WHERE event_name = 'user_engagement'""",
    ),
    "filter_param_key": q(EV, "SELECT event_id, screen AS string_value FROM ev"),
    "param_value_counts": q(
        EV,
        """SELECT screen AS string_value, count(*) AS cnt FROM ev
        WHERE event_name = 'user_engagement' GROUP BY ALL ORDER BY cnt DESC""",
    ),
    "unnest_params": q(
        EV,
        f"""SELECT event_id, event_name, 'k' AS param_key, CAST(k AS VARCHAR) AS string_value FROM ev
        UNION ALL SELECT event_id, event_name, '{SCREEN}', screen FROM ev""",
    ),
    "engagement_bounds": q(
        f"{EV}, {SPAN_SQL}",
        """SELECT user_pseudo_id, make_timestamp(first_us) AS user_first_engagement,
        make_timestamp(last_us) AS user_last_engagement,
        make_timestamp((SELECT max(last_us) FROM span)) AS max_ts_events FROM span""",
    ),
    "engagement_bounds_window": q(
        EV,
        """SELECT event_id, user_pseudo_id, event_timestamp,
        min(event_timestamp) OVER (PARTITION BY user_pseudo_id) AS first_us,
        max(event_timestamp) OVER (PARTITION BY user_pseudo_id) AS last_us
        FROM ev WHERE event_name = 'user_engagement'""",
    ),
    "user_flags": q(USERS, "SELECT user_pseudo_id, is_enable, bounced, churned FROM users"),
    "latest_device": q(
        EV,
        """SELECT user_pseudo_id, country_name, device_os, device_lang FROM ev
        WHERE event_name = 'user_engagement' QUALIFY row_number() OVER
        (PARTITION BY user_pseudo_id ORDER BY event_timestamp DESC, event_id DESC) = 1""",
    ),
    "first_day_events": q(
        f"{EV}, {SPAN_SQL}",
        f"SELECT event_id, user_pseudo_id, event_timestamp, event_name FROM {FIRST_DAY_SQL}",
    ),
    "star_projection": q(f"{EV}, {SPAN_SQL}", f"SELECT {FLAT_SQL} FROM {FIRST_DAY_SQL}"),
    "behavior_counts": q(
        f"{EV}, {SPAN_SQL}",
        f"SELECT user_pseudo_id, {COUNTERS_SQL} FROM {FIRST_DAY_SQL} GROUP BY user_pseudo_id",
    ),
    "user_dataset": q(USERS, "SELECT * FROM users"),
    "sql_from_file": q(USERS, "SELECT * FROM users"),
    "population_train": q(USERS, "SELECT * FROM users WHERE is_enable = 1 AND bounced = 0"),
    "population_not_yet": q(USERS, "SELECT * FROM users WHERE is_enable = 0 AND bounced = 0"),
    "star_except": q(
        USERS,
        """SELECT * EXCLUDE (user_first_engagement, user_pseudo_id) FROM users
        WHERE is_enable = 1 AND bounced = 0""",
    ),
    "time_scalars": q(
        EV,
        """SELECT event_id, make_timestamp(event_timestamp) AS event_time,
        make_timestamp(event_timestamp) + INTERVAL 24 HOUR AS plus_24_hours,
        make_timestamp(event_timestamp) - INTERVAL 48 HOUR AS minus_48_hours,
        make_timestamp(event_timestamp) + INTERVAL 10 MINUTE AS plus_10_minutes,
        make_timestamp((event_timestamp // 1000) * 1000) AS to_millis FROM ev""",
    ),
    "calendar_features": q(
        USERS,
        """SELECT user_pseudo_id, CAST(month(user_first_engagement) AS INTEGER) AS month,
        CAST(dayofyear(user_first_engagement) AS INTEGER) AS julianday,
        CAST(dayofweek(user_first_engagement) + 1 AS INTEGER) AS dayofweek,
        CAST(hour(user_first_engagement) AS INTEGER) AS hour FROM users""",
    ),
}

"""Shared parts of the check queries: the event log and the per-user dataset in ANSI-style SQL."""

from __future__ import annotations

from ebbtide.schema import COUNTERS, TRACKED_EVENTS


def q(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


EV = """raw AS (
  SELECT event_id, ts, user_id, event_type,
    CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k
  FROM events),
ev AS (
  SELECT event_id, CAST(ts AS DATE) AS event_date, epoch_us(ts) AS event_timestamp,
    CAST(user_id AS VARCHAR) || '_w'
      || CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS VARCHAR) AS user_pseudo_id,
    CASE event_type
      WHEN 'purchase' THEN 'user_engagement'
      WHEN 'click' THEN CASE k % 2 WHEN 0 THEN 'level_start_quickplay' ELSE 'post_score' END
      WHEN 'view' THEN CASE k % 2 WHEN 0 THEN 'level_end_quickplay'
        ELSE 'level_complete_quickplay' END
      WHEN 'error' THEN CASE k % 3 WHEN 0 THEN 'level_reset_quickplay'
        WHEN 1 THEN 'spend_virtual_currency' ELSE 'use_extra_steps' END
      WHEN 'signup' THEN CASE k % 3 WHEN 0 THEN 'ad_reward'
        WHEN 1 THEN 'challenge_a_friend' ELSE 'completed_5_levels' END
    END AS event_name,
    n_name AS country_name,
    CASE k % 3 WHEN 0 THEN 'IOS' ELSE 'ANDROID' END AS device_os,
    CASE k % 10 WHEN 9 THEN NULL WHEN 8 THEN 'pt-br' WHEN 7 THEN 'es-us' WHEN 6 THEN 'en-in'
      WHEN 5 THEN 'de-de' ELSE 'en-us' END AS device_lang,
    CASE k % 4 WHEN 0 THEN 'game_board' WHEN 1 THEN 'menu' WHEN 2 THEN 'shop' END AS screen,
    k
  FROM raw LEFT JOIN customer ON user_id = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey)"""

COUNTERS_SQL = ",\n  ".join(
    f"CAST(count(*) FILTER (event_name = '{event}') AS BIGINT) AS {counter}"
    for event, counter in zip(TRACKED_EVENTS, COUNTERS)
)

_COUNTER_LIST = ", ".join(COUNTERS)

USERS = f"""{EV},
u_span AS (
  SELECT user_pseudo_id, min(event_timestamp) AS f, max(event_timestamp) AS l
  FROM ev WHERE event_name = 'user_engagement' GROUP BY user_pseudo_id),
u_dev AS (
  SELECT user_pseudo_id, country_name, device_os, device_lang FROM ev
  WHERE event_name = 'user_engagement' QUALIFY row_number() OVER
    (PARTITION BY user_pseudo_id ORDER BY event_timestamp DESC, event_id DESC) = 1),
u_cnt AS (
  SELECT user_pseudo_id, {COUNTERS_SQL}
  FROM ev JOIN u_span USING (user_pseudo_id)
  WHERE event_timestamp <= f + 86400000000 GROUP BY user_pseudo_id),
users AS (
  SELECT make_timestamp(f) AS user_first_engagement, s.user_pseudo_id,
    CASE WHEN f > (SELECT max(l) FROM u_span) - 172800000000 THEN 0 ELSE 1 END AS is_enable,
    CASE WHEN l <= f + 600000000 THEN 1 ELSE 0 END AS bounced,
    country_name, device_os, device_lang, {_COUNTER_LIST},
    CASE WHEN l < f + 86400000000 THEN 1 ELSE 0 END AS churned
  FROM u_span s LEFT JOIN u_dev d ON s.user_pseudo_id = d.user_pseudo_id
  LEFT JOIN u_cnt c ON s.user_pseudo_id = c.user_pseudo_id)"""

TRAIN = f"""{USERS},
train AS (SELECT * FROM users WHERE is_enable = 1 AND bounced = 0)"""

SCORED = f"""{TRAIN},
scored AS (SELECT user_pseudo_id, churned,
  1.0::DOUBLE / (1.0::DOUBLE + cnt_user_engagement + cnt_post_score) AS score FROM train),
hard AS (SELECT *, CASE WHEN score > 0.2::DOUBLE THEN 1 ELSE 0 END AS prediction FROM scored)"""


def bucket_sql(column: str, buckets: int, seed: int | None = None) -> str:
    return f"{hash_sql(column, seed)} % {buckets}"


def hash_sql(column: str, seed: int | None = None) -> str:
    text = column if seed is None else f"'{seed}:' || {column}"
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"

"""Small event logs written by hand."""

from __future__ import annotations

from datetime import date, timedelta

from ebbtide.schema import EVENT_SCHEMA

MINUTE = 60_000_000
HOUR = 60 * MINUTE
T0 = 1_538_352_000_000_000  # 2018-10-01 00:00:00 UTC


def event(number, user, at, name="user_engagement", country="Chile", system="IOS", lang="es-cl", params=()):
    day = date(2018, 10, 1) + timedelta(days=at // (24 * HOUR))
    return (number, day, T0 + at, user, name, (country,), (system, lang), [(k, (v,)) for k, v in params])


def log(spark, rows):
    numbered = [event(i, *r) if isinstance(r, tuple) else event(i, **r) for i, r in enumerate(rows)]
    return spark.createDataFrame(numbered, EVENT_SCHEMA)

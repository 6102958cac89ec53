"""Time arithmetic on microsecond epochs and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros_to_timestamp(col: str | Column) -> Column:
    return F.timestamp_micros(col)


def shift(ts: str | Column, unit: str, amount: int) -> Column:
    """`ts` moved by `amount` units (HOUR, MINUTE, ...); negative amounts go back in time."""
    return F.timestamp_add(unit, F.lit(amount), F.col(ts) if isinstance(ts, str) else ts)


def wall_clock(ts: str | Column) -> Column:
    """Timestamp without zone, for output that is compared outside Spark."""
    return (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")


def calendar_columns(ts: str | Column) -> dict[str, Column]:
    """Month, day of year, day of week (Sunday = 1) and hour of a timestamp."""
    return {
        "month": F.month(ts),
        "julianday": F.dayofyear(ts),
        "dayofweek": F.dayofweek(ts),
        "hour": F.hour(ts),
    }

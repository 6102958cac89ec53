"""Stable hashes of ids: the same id falls into the same bucket in every run and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hash(col: str | Column, seed: int | str | None = None) -> Column:
    """Unsigned 32-bit integer from the first eight hex digits of an md5 digest.

    A seed is put in front of the id, so that different splits are independent.
    """
    text = (F.col(col) if isinstance(col, str) else col).cast("string")
    if seed is not None:
        text = F.concat(F.lit(f"{seed}:"), text)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def bucket(col: str | Column, buckets: int, seed: int | str | None = None) -> Column:
    return F.pmod(stable_hash(col, seed), F.lit(buckets)).cast("int")

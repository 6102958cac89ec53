"""Heavy keys: count them, spread them in a join.

A key is heavy when it has more rows than one task should read. Counts are exact and combined
before their shuffle, and the same plan runs at every size: a small input just has no heavy key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000
# The limit grows with the input, so that a table of heavy keys never has more rows than this.
MOST_HEAVY = 100_000


def heavy_keys(df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(key, _fanout): keys with more rows than a task should read, and over how many tasks to
    spread them. At most MOST_HEAVY rows, so that it may be broadcast."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows"))
    total = counts.agg(F.sum("_rows").alias("_total"))
    limit = F.greatest(F.lit(rows_per_task), F.ceil(F.col("_total") / MOST_HEAVY))
    return (
        counts.crossJoin(F.broadcast(total))  # one row
        .where(F.col("_rows") > limit)
        .select(key, F.ceil(F.col("_rows") / limit).cast("int").alias("_fanout"))
    )


def salted_join(
    facts: DataFrame,
    dims: DataFrame,
    key: str,
    heavy: DataFrame,
    spread_by: list[str],
    condition: Column | None = None,
) -> DataFrame:
    """Inner join in which the rows of a heavy key are spread over `_fanout` partitions.

    `dims` has one row per key; only its heavy rows are repeated. `heavy` is bounded by
    construction (see `heavy_keys`), so that it may be broadcast. Facts and dims grow with the
    data, and a small file holds many rows: neither goes through the driver.
    """
    marked = F.broadcast(heavy)
    salt = F.pmod(F.xxhash64(*spread_by), F.col("_fanout")).cast("int")
    left = (
        facts.join(marked, key, "left")
        .withColumn("_salt", F.coalesce(salt, F.lit(0)))
        .drop("_fanout")
    )
    every_salt = F.sequence(F.lit(0), F.coalesce("_fanout", F.lit(1)) - 1)
    right = (
        dims.join(marked, key, "left").withColumn("_salt", F.explode(every_salt)).drop("_fanout")
    )
    joined = left.join(right.hint("merge"), [key, "_salt"])
    return (joined if condition is None else joined.where(condition)).drop("_salt")

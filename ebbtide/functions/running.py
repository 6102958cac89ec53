"""Running totals over a global order without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.session import materialize


def with_ranges(df: DataFrame, *order: Column, ranges: int | None = None) -> DataFrame:
    """Add `_range`: the rows in ranges of the given order, numbered in that order.

    A range exchange on the values themselves deals the rows out, into as many ranges as the session's
    shuffle partitions, fewer for few bytes, or `ranges` at most; rows that are equal in the order share
    one. The result is stored, so that branches of a plan that read it agree on the ranges.
    """
    spread = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    return materialize(spread.withColumn("_range", F.spark_partition_id()), "ranges")


def running_totals(
    df: DataFrame,
    key: str,
    sums: dict[str, str],
    by: list[str] | None = None,
    ties: list[str] | None = None,
    descending: bool = False,
    ranges: int | None = None,
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Add inclusive running sums of `sums` ({input column: output column}) in the order of `key`.

    Rows are put in ranges of the groups and the key, of any type (see `with_ranges`). Each range of each
    group is summed in its own task and moved by the total of the ranges before it; only those totals (a
    row per range of a group) meet in one place. Callers aggregate to one row per key value first, so a
    frequent value is a single row here; rows with equal keys are put in order by `ties`, which also tell
    ranges apart. `totals` adds sums over all rows of the group.
    """
    by, ties = by or [], [t for t in ties or [] if t != key]
    order = [F.col(key).desc() if descending else F.col(key).asc(), *[F.col(t).asc() for t in ties]]
    ranged = with_ranges(df, *[F.col(c) for c in by], *order, ranges=ranges)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*by, "_range")
        .agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
        .select(
            *[F.col(c).alias(f"_off_{c}") for c in by],
            F.col("_range").alias("_off_range"),
            *[
                F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}")
                for c in sums
            ],
        )
    )
    inside = (
        Window.partitionBy(*by, "_range")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    if not by:  # a row per range: read the stored ranges once for these, and once for the rest
        offsets = F.broadcast(df.sparkSession.createDataFrame(offsets.collect(), offsets.schema))
    on = [F.col("_range") == F.col("_off_range")]
    on += [F.col(c).eqNullSafe(F.col(f"_off_{c}")) for c in by]
    local = ranged.withColumns({f"_in_{c}": F.sum(c).over(inside) for c in sums})
    result = local.join(offsets, on).select(
        *df.columns,
        *[(F.col(f"_in_{c}") + F.col(f"_before_{c}")).alias(out) for c, out in sums.items()],
    )
    if not totals:
        return result
    whole = [F.sum(c).alias(out) for c, out in totals.items()]
    if not by:
        total = ranged.agg(*whole)
        return result.crossJoin(F.broadcast(df.sparkSession.createDataFrame(total.collect(), total.schema)))  # one row
    per_group = ranged.groupBy(*[F.col(c).alias(f"_all_{c}") for c in by]).agg(*whole)
    same = [F.col(c).eqNullSafe(F.col(f"_all_{c}")) for c in by]
    return result.join(per_group, same).drop(*[f"_all_{c}" for c in by])

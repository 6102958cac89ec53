"""Counts of values: frequency tables, top categories, missing and distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.running import running_totals
from ebbtide.schema import LABEL


def value_counts(df: DataFrame, column: str | Column, name: str = "value") -> DataFrame:
    """Frequency of each value, most frequent first; missing values are left out."""
    value = F.col(column) if isinstance(column, str) else column
    return (
        df.select(value.alias(name))
        .na.drop()
        .groupBy(name)
        .agg(F.count("*").alias("cnt"))
        .orderBy(F.col("cnt").desc(), F.col(name).asc())
    )


def prefix_counts(df: DataFrame, column: str, length: int = 2) -> DataFrame:
    return value_counts(df, F.substring(column, 1, length), "prefix")


def top_categories(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The `n` most frequent values; ties go to the smaller value."""
    return value_counts(df, column, column).limit(n)


def keep_top_categories(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Rows whose category is one of the `n` most frequent. At most `n` rows are broadcast."""
    top = top_categories(df, column, n).select(column)
    return df.join(F.broadcast(top), column, "left_semi")


def category_by_label(
    df: DataFrame, columns: tuple[str, ...], label: str = LABEL, n: int = 10
) -> DataFrame:
    """Rows per top category and label, for each column; rows with any NULL are left out.

    The top categories are chosen before incomplete rows are dropped.
    """
    parts = [
        keep_top_categories(df, c, n)
        .na.drop()
        .groupBy(F.lit(c).alias("column"), F.col(c).alias("category"), F.col(label))
        .agg(F.count("*").alias("cnt"))
        for c in columns
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values per column, in one pass."""
    one_row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns]
    )
    return one_row.select(F.inline(pairs))


def describe_schema(df: DataFrame) -> DataFrame:
    """Position, name, type and number of present values of each column."""
    one_row = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("column"),
            F.lit(dtype).alias("dtype"),
            F.col(name).alias("non_null"),
        )
        for i, (name, dtype) in enumerate(df.dtypes)
    ]
    return one_row.select(F.inline(F.array(*rows)))


def unfold(
    df: DataFrame, columns: list[str], by: list[str] | None = None, kind: str = "string"
) -> DataFrame:
    """One row (by..., position, value) per cell of the given columns.

    Columns are numbered, so that grouping works on an integer; `name_at` gives the name
    back after the aggregation.
    """
    cells = F.array(*[F.col(c).cast(kind) for c in columns])
    return df.select(*(by or []), F.posexplode(cells).alias("position", "value"))


def name_at(columns: list[str], position: str = "position") -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col(position) + 1)


def value_frequencies(
    df: DataFrame, columns: list[str], by: list[str] | None = None, kind: str = "string"
) -> DataFrame:
    """Long table (by..., column, value, cnt) of the values of several columns.

    One shuffle for all columns; equal values are combined before it.
    """
    by = by or []
    counted = unfold(df, columns, by, kind).groupBy(*by, "position", "value")
    return counted.agg(F.count("*").alias("cnt")).select(
        *by, name_at(columns).alias("column"), "value", "cnt"
    )


def exact_quantiles(
    freq: DataFrame, by: list[str], points: tuple[float, ...], name: str = "quantiles"
) -> DataFrame:
    """Quantiles per group of a frequency table (by..., value, cnt), linear between values.

    The value at a rank is the smallest one whose running count exceeds the rank, so the
    groups end in plain minima: no task holds all values of a group.
    """
    running = running_totals(
        freq, "value", {"cnt": "_upto"}, by=by, ties=["value"], totals={"cnt": "_n"}
    )

    def at_rank(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") > rank, F.col("value")))

    parts = []
    for q in points:
        rank = (F.col("_n") - 1) * F.lit(q)
        low, high = at_rank(F.floor(rank)), at_rank(F.ceil(rank))
        parts.append(low + F.max(rank - F.floor(rank)) * (high - low))
    return running.groupBy(*by).agg(F.array(*parts).alias(name))


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct values of each column as they are and in lower case."""
    if approximate:
        sketches = unfold(df, columns).groupBy("position").agg(
            F.approx_count_distinct("value").alias("n_distinct"),
            F.approx_count_distinct(F.lower("value")).alias("n_distinct_lower"),
        )
        return sketches.select(
            name_at(columns).alias("column"), "n_distinct", "n_distinct_lower"
        )
    values = value_frequencies(df, columns)
    lowered = values.groupBy("column", F.lower("value").alias("lower_value")).agg(
        F.count("value").alias("spellings")
    )
    return lowered.groupBy("column").agg(
        F.sum("spellings").alias("n_distinct"), F.count("lower_value").alias("n_distinct_lower")
    )

"""Profile of all columns of a table as a long frame (column, stat, number, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.operators.distributions import pairwise_correlations
from ebbtide.operators.frequencies import exact_quantiles, name_at, unfold, value_frequencies

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def _numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _cell(column, stat: str, number=None, text=None):
    return F.struct(
        (F.lit(column) if isinstance(column, str) else column).alias("column"),
        F.lit(stat).alias("stat"),
        (F.lit(None) if number is None else number).cast("double").alias("number"),
        (F.lit(None) if text is None else text).cast("string").alias("text"),
    )


def _count_stats(freq: DataFrame) -> DataFrame:
    """Counts, distinct values and most frequent value from the frequency table."""
    present = F.col("value").isNotNull()
    # min over (-cnt, value): the most frequent value, the smaller one of equals
    top = F.min(F.when(present, F.struct((-F.col("cnt")).alias("c"), F.col("value").alias("v"))))
    per_column = freq.groupBy("column").agg(
        F.sum("cnt").alias("rows"),
        F.sum(F.when(present, F.lit(0)).otherwise(F.col("cnt"))).alias("missing"),
        F.count("value").alias("distinct"),
        F.count_if(present & (F.col("cnt") == 1)).alias("unique"),
        top.alias("top"),
    )
    name = F.col("column")
    cells = [
        _cell(name, "count", F.col("rows") - F.col("missing")),
        _cell(name, "missing", F.col("missing")),
        _cell(name, "distinct", F.col("distinct")),
        _cell(name, "unique", F.col("unique")),
        _cell(name, "top_count", -F.col("top.c")),
        _cell(name, "top", None, F.col("top.v")),
    ]
    return per_column.select(F.inline(F.array(*cells)))


def _number_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Moments of the numeric columns in one pass."""
    stats = {
        "min": F.min("value"),
        "max": F.max("value"),
        "mean": F.avg("value"),
        "std": F.stddev_samp("value"),
        "sum": F.sum("value"),
        "zeros": F.count_if(F.col("value") == 0),
    }
    moments = (
        unfold(df, columns, kind="double")
        .groupBy("position")
        .agg(*[f.alias(stat) for stat, f in stats.items()])
    )
    cells = [_cell(name_at(columns), stat, F.col(stat)) for stat in stats]
    return moments.select(F.inline(F.array(*cells)))


def _quantile_stats(df: DataFrame, columns: list[str], exact: bool) -> DataFrame:
    if exact:
        freq = value_frequencies(df, columns, kind="double").where(F.col("value").isNotNull())
        quantiles = exact_quantiles(freq, ["column"], QUANTILES, "q")
    else:
        points = F.array(*[F.lit(q) for q in QUANTILES])
        quantiles = (
            unfold(df, columns, kind="double")
            .groupBy("position")
            .agg(F.percentile_approx("value", points, F.lit(10000)).alias("q"))
            .withColumn("column", name_at(columns))
        )
    cells = [
        _cell(F.col("column"), f"q{int(q * 100):02d}", F.col("q")[i])
        for i, q in enumerate(QUANTILES)
    ]
    return quantiles.select(F.inline(F.array(*cells)))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one."""
    distinct = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return distinct.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def profile_table(df: DataFrame, exact: bool = True) -> DataFrame:
    """Counts, distinct and most frequent values, moments, quantiles, duplicates, correlations.

    All counts come from one frequency table of (column, value).
    """
    numeric = _numeric_columns(df)
    parts = [_count_stats(value_frequencies(df, df.columns))]
    if numeric:
        parts.append(_number_stats(df, numeric))
        parts.append(_quantile_stats(df, numeric, exact))
    parts.append(
        duplicate_rows(df).select(F.inline(F.array(_cell("*", "duplicates", F.col("duplicates")))))
    )
    if len(numeric) > 1:
        pairs = pairwise_correlations(df, tuple(numeric), label=None)
        parts.append(
            pairs.select(
                F.concat_ws("~", "x", "y").alias("column"),
                F.lit("corr").alias("stat"),
                F.col("corr").alias("number"),
                F.lit(None).cast("string").alias("text"),
            )
        )
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked

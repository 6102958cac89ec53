"""Class weights of a binary label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.schema import LABEL


def label_counts(df: DataFrame, label: str = LABEL) -> DataFrame:
    """One row: users, positives and negatives."""
    return df.agg(
        F.count(label).alias("n"),
        F.count_if(F.col(label) == 1).alias("n_pos"),
        F.count_if(F.col(label) == 0).alias("n_neg"),
    )


def base_rate_weights(df: DataFrame, label: str = LABEL, name: str = "weight") -> DataFrame:
    """Positive rows weigh one over the positive rate, negative rows weigh one."""
    one_row = label_counts(df, label).select((F.col("n_pos") / F.col("n")).alias("_rate"))
    weight = F.when(F.col(label) == 1, F.try_divide(F.lit(1.0), F.col("_rate")))
    return df.crossJoin(F.broadcast(one_row)).withColumn(name, weight.otherwise(F.lit(1.0))).drop(
        "_rate"
    )


def balanced_weights(df: DataFrame, label: str = LABEL, name: str = "weight") -> DataFrame:
    """Rows weigh n / (classes * rows of their class), so that classes weigh the same."""
    one_row = label_counts(df, label).withColumn(
        "_classes", (F.col("n_pos") > 0).cast("int") + (F.col("n_neg") > 0).cast("int")
    )
    own = F.when(F.col(label) == 1, F.col("n_pos")).otherwise(F.col("n_neg"))
    return (
        df.crossJoin(F.broadcast(one_row))
        .withColumn(name, F.col("n") / (F.col("_classes") * own))
        .drop("n", "n_pos", "n_neg", "_classes")
    )

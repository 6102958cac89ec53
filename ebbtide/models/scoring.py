"""Scores of a fitted model."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.schema import LABEL, USER


def predict(model: PipelineModel, users: DataFrame) -> DataFrame:
    """User, label if known, hard label."""
    scored = model.transform(users)
    return scored.select(*_known(scored), F.col("prediction").cast("int").alias("prediction"))


def predict_proba(model: PipelineModel, users: DataFrame) -> DataFrame:
    """User, label if known, hard label, probabilities of both classes."""
    scored = model.transform(users)
    p = vector_to_array("probability")
    return scored.select(
        *_known(scored),
        F.col("prediction").cast("int").alias("prediction"),
        p[0].alias("probability_0"),
        p[1].alias("probability_1"),
    )


def predict_threshold(model: PipelineModel, users: DataFrame, threshold: float = 0.5) -> DataFrame:
    """User, predicted label, label by threshold (strict), probability of churn."""
    return predict_proba(model, users).select(
        USER,
        F.col("prediction").alias("predicted_churned"),
        F.when(F.col("probability_1") > threshold, F.lit(1)).otherwise(F.lit(0)).alias(
            "churned_by_threshold"
        ),
        F.col("probability_1").alias("probability"),
    )


def _known(scored: DataFrame) -> list[str]:
    return [c for c in (USER, LABEL) if c in scored.columns]

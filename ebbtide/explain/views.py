"""Frames behind the explanation charts."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.explain.shapley import vector_names
from ebbtide.features.builder import FEATURES, feature_names
from ebbtide.models.storage import split_model
from ebbtide.operators.distributions import bin_index
from ebbtide.schema import USER


def observations_table(model: PipelineModel, users: DataFrame) -> DataFrame:
    """The model's input with one named column per feature."""
    stages, _ = split_model(model)
    featured = stages.transform(users)
    values = vector_to_array(FEATURES)
    return featured.select(
        USER, *[values[i].alias(n) for i, n in enumerate(feature_names(featured))]
    )


def feature_importance(model: PipelineModel, users: DataFrame, n: int = 10) -> DataFrame:
    """The `n` features the model relies on most: (feature, importance)."""
    _, learned = split_model(model)
    if hasattr(learned, "featureImportances"):
        values = learned.featureImportances.toArray()
    else:
        values = abs(learned.coefficients.toArray())
    rows = [(name, float(v)) for name, v in zip(vector_names(model, users), values)]
    frame = users.sparkSession.createDataFrame(rows, "feature string, importance double")
    return frame.orderBy(F.col("importance").desc(), "feature").limit(n)


def shap_summary(shap: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature; `shap` is the long frame."""
    return shap.groupBy("feature").agg(
        F.avg(F.abs("shap")).alias("mean_abs_shap"), F.count("*").alias("n")
    )


def shap_distribution(shap: DataFrame, bins: int = 20) -> DataFrame:
    """Users per feature and bin of the contribution, with the mean feature value of the bin."""
    limits = shap.groupBy("feature").agg(F.min("shap").alias("_low"), F.max("shap").alias("_high"))
    binned = shap.join(F.broadcast(limits), "feature")  # one row per feature
    return (
        binned.groupBy(
            "feature", bin_index(F.col("shap"), F.col("_low"), F.col("_high"), bins).alias("bin")
        )
        .agg(
            F.count("*").alias("cnt"),
            F.avg("value").alias("mean_value"),
            F.min("shap").alias("lowest"),
            F.max("shap").alias("highest"),
        )
    )


def shap_one_row(shap: DataFrame) -> DataFrame:
    """Per user the contributions from the largest on, and the running sum from the base value."""
    order = Window.partitionBy(USER).orderBy(F.abs("shap").desc(), "feature")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return shap.select(
        USER,
        F.row_number().over(order).alias("rank"),
        "feature",
        "value",
        "shap",
        (F.col("base") + F.sum("shap").over(upto)).alias("running"),
    )

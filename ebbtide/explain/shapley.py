"""Shapley values of tree and linear models as Spark jobs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.explain import leafgame
from ebbtide.explain.trees import leaves
from ebbtide.features.builder import FEATURES, feature_names
from ebbtide.models.storage import split_model
from ebbtide.schema import USER

# shipped with the task, so that executors need not have this package installed
cloudpickle.register_pickle_by_value(leafgame)


def tree_shap(model: PipelineModel, users: DataFrame) -> DataFrame:
    """(user, features, shap, base): arrays per user, in the order of the feature vector.

    Users stay where they are; the leaves are broadcast and are as large as the model. For
    deep forests on many users prefer importances: the work grows with leaves times rows.
    """
    stages, trees = split_model(model)
    spark = users.sparkSession
    found = leaves(spark, trees)
    base = sum(leaf.value * math.prod(leaf.cover) for leaf in found)
    games = [leafgame.prepare(l.features, l.low, l.high, l.cover, l.value, l.missing) for l in found]
    shared = spark.sparkContext.broadcast(games)
    explain_rows = leafgame.explain_rows

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            rows = np.stack(batch["features"].to_numpy())
            yield batch.assign(shap=list(explain_rows(rows, shared.value)), base=base)

    vectors = stages.transform(users).select(USER, vector_to_array(FEATURES).alias("features"))
    return vectors.mapInPandas(
        explain, f"{USER} string, features array<double>, shap array<double>, base double"
    )


def linear_shap(model: PipelineModel, users: DataFrame, background: DataFrame) -> DataFrame:
    """The same for logistic regression: coefficient times distance from the background mean."""
    stages, linear = split_model(model)
    means = (
        stages.transform(background).agg(Summarizer.mean(F.col(FEATURES)).alias("m")).first()["m"]
    )
    coefficients = linear.coefficients.toArray()
    base = float(linear.intercept + coefficients @ means.toArray())

    def literal(values):
        return F.array(*[F.lit(float(v)) for v in values])

    vectors = stages.transform(users).select(USER, vector_to_array(FEATURES).alias("features"))
    shap = F.zip_with(
        F.zip_with("features", literal(means.toArray()), lambda x, m: x - m),
        literal(coefficients),
        lambda x, c: x * c,
    )
    return vectors.select(USER, "features", shap.alias("shap"), F.lit(base).alias("base"))


def vector_names(model: PipelineModel, users: DataFrame) -> list[str]:
    stages, _ = split_model(model)
    return feature_names(stages.transform(users.limit(0)))


def shap_long(shap: DataFrame, names: list[str]) -> DataFrame:
    """One row per user and feature: (user, feature, value, shap, base)."""
    name = F.array(*[F.lit(n) for n in names])
    cells = F.arrays_zip(name.alias("feature"), F.col("features").alias("value"), F.col("shap"))
    return shap.select(USER, "base", F.inline(cells).alias("feature", "value", "shap")).select(
        USER, "feature", "value", "shap", "base"
    )

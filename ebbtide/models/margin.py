"""Scores of models that give a margin per feature vector, computed in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add_scores(df: DataFrame, vector: str, margins: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Add rawPrediction, probability and prediction of a two-class model as Spark ML names them."""

    @F.pandas_udf("double")
    def margin(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            yield pd.Series(margins(np.stack(vectors.to_numpy())) if len(vectors) else [], dtype=float)

    scored = df.withColumn("_margin", margin(vector_to_array(vector)))
    p = 1 / (1 + F.exp(-F.col("_margin")))
    return (
        scored.withColumn("rawPrediction", array_to_vector(F.array(-F.col("_margin"), F.col("_margin"))))
        .withColumn("probability", array_to_vector(F.array(1 - p, p)))
        .withColumn("prediction", (F.col("_margin") > 0).cast("double"))
        .drop("_margin")
    )

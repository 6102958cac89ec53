"""Class weights as a stage: learned from label counts, added as a column while training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasLabelCol, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable

from ebbtide.features.base import Param, Params, TypeConverters, keyword_only
from ebbtide.operators.weighting import label_counts


class _Weighted(HasLabelCol, HasWeightCol, DefaultParamsReadable, DefaultParamsWritable):
    pass


class LabelWeighter(Estimator, _Weighted):
    """`balanced`: classes weigh the same in total; `base_rate`: positives weigh 1 / positive rate."""

    scheme = Param(Params._dummy(), "scheme", "balanced or base_rate", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, labelCol="churned", weightCol="_weight", scheme="balanced"):
        super().__init__()
        self._setDefault(labelCol="churned", weightCol="_weight", scheme="balanced")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "LabelWeighterModel":
        counts = label_counts(df, self.getLabelCol()).first()
        n, positives, negatives = counts["n"], counts["n_pos"], counts["n_neg"]
        classes = (positives > 0) + (negatives > 0)
        if self.getOrDefault(self.scheme) == "balanced":
            weights = [n / (classes * c) if c else 1.0 for c in (negatives, positives)]
        else:
            weights = [1.0, n / positives if positives else 1.0]
        model = LabelWeighterModel(
            labelCol=self.getLabelCol(), weightCol=self.getWeightCol(), weights=weights
        )
        return model


class LabelWeighterModel(Model, _Weighted):
    weights = Param(Params._dummy(), "weights", "of label 0 and 1", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, labelCol="churned", weightCol="_weight", weights=None):
        super().__init__()
        self._setDefault(labelCol="churned", weightCol="_weight")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        negative, positive = self.getOrDefault(self.weights)
        if self.getLabelCol() not in df.columns:  # scoring rows without a label
            return df.withColumn(self.getWeightCol(), F.lit(1.0))
        weight = F.when(F.col(self.getLabelCol()) == 1, F.lit(positive)).otherwise(F.lit(negative))
        return df.withColumn(self.getWeightCol(), weight)

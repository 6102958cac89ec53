"""Shared parts of the feature stages: column params and persistence."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame


class _Columns(HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Column-wise stage. Without output columns the input columns are replaced."""

    def pairs(self) -> list[tuple[str, str]]:
        inputs = self.getInputCols()
        outputs = self.getOutputCols() if self.isDefined(self.outputCols) else inputs
        return list(zip(inputs, outputs))

    def _copy_columns_to(self, model):
        model._set(inputCols=self.getInputCols())
        if self.isDefined(self.outputCols):
            model._set(outputCols=self.getOutputCols())
        return model


class ColumnTransformer(Transformer, _Columns):
    """A stage without learned state: `expression(column)` gives the new column."""

    def expression(self, column: str):
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({out: self.expression(c) for c, out in self.pairs()})


class ColumnEstimator(Estimator, _Columns):
    """A stage whose state is learned by one aggregate over all its columns."""


class ColumnModel(Model, _Columns):
    """Learned stage: `expression(column, position)` gives the new column."""

    def expression(self, column: str, position: int):
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {out: self.expression(c, i) for i, (c, out) in enumerate(self.pairs())}
        )


__all__ = [
    "ColumnEstimator",
    "ColumnModel",
    "ColumnTransformer",
    "Param",
    "Params",
    "TypeConverters",
    "keyword_only",
]

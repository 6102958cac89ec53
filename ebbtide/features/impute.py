"""Replace missing values by a constant or by the most frequent value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.features.base import (
    ColumnEstimator,
    ColumnModel,
    ColumnTransformer,
    Param,
    Params,
    TypeConverters,
    keyword_only,
)


class ConstantImputer(ColumnTransformer):
    """NULL becomes a constant number."""

    fillValue = Param(Params._dummy(), "fillValue", "replacement", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, fillValue=0.0):
        super().__init__()
        self._setDefault(fillValue=0.0)
        self._set(**self._input_kwargs)

    def expression(self, column: str):
        return F.coalesce(F.col(column).cast("double"), F.lit(self.getOrDefault(self.fillValue)))


class ModeImputer(ColumnEstimator):
    """NULL becomes the most frequent value; of equally frequent values the smallest."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ModeImputerModel":
        columns = [c for c, _ in self.pairs()]
        # counts per value are shuffled by value; one task sees a winner per task, not all values
        best = F.min(F.struct((-F.col("count")).alias("n"), F.col("value"))).alias("best")
        modes = []
        for c in columns:
            counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).count()
            found = counts.agg(best).first()["best"]
            modes.append(found["value"] if found else None)
        return self._copy_columns_to(ModeImputerModel(modes=modes))


class ModeImputerModel(ColumnModel):
    modes = Param(Params._dummy(), "modes", "most frequent value per column", TypeConverters.identity)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, modes=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def expression(self, column: str, position: int):
        return F.coalesce(F.col(column), F.lit(self.getOrDefault(self.modes)[position]))

"""Scalers of numeric columns as native expressions."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.features.base import (
    ColumnEstimator,
    ColumnModel,
    Param,
    Params,
    TypeConverters,
    keyword_only,
)


class ZScaler(ColumnEstimator):
    """(x - mean) / standard deviation. `ddof` 0 divides by the population deviation, 1 by the
    sample deviation. A constant column is only centred."""

    ddof = Param(Params._dummy(), "ddof", "0 population, 1 sample", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, ddof=0):
        super().__init__()
        self._setDefault(ddof=0)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "LinearScalerModel":
        columns = [c for c, _ in self.pairs()]
        deviation = F.stddev_pop if self.getOrDefault(self.ddof) == 0 else F.stddev_samp
        row = df.agg(
            *[F.avg(c).alias(f"mean_{c}") for c in columns],
            *[deviation(c).alias(f"std_{c}") for c in columns],
        ).first()
        model = LinearScalerModel(
            centers=[row[f"mean_{c}"] or 0.0 for c in columns],
            widths=[row[f"std_{c}"] or 1.0 for c in columns],
        )
        return self._copy_columns_to(model)


class RangeScaler(ColumnEstimator):
    """(x - min) / (max - min); a constant column becomes 0."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "LinearScalerModel":
        columns = [c for c, _ in self.pairs()]
        row = df.agg(
            *[F.min(c).alias(f"min_{c}") for c in columns],
            *[F.max(c).alias(f"max_{c}") for c in columns],
        ).first()
        low = [float(row[f"min_{c}"] or 0.0) for c in columns]
        high = [float(row[f"max_{c}"] or 0.0) for c in columns]
        model = LinearScalerModel(
            centers=low, widths=[(h - lo) or 1.0 for lo, h in zip(low, high)]
        )
        return self._copy_columns_to(model)


class LinearScalerModel(ColumnModel):
    centers = Param(Params._dummy(), "centers", "subtracted", TypeConverters.toListFloat)
    widths = Param(Params._dummy(), "widths", "divided by", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, centers=None, widths=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def expression(self, column: str, position: int):
        center = self.getOrDefault(self.centers)[position]
        width = self.getOrDefault(self.widths)[position]
        return (F.col(column) - F.lit(center)) / F.lit(width)


class QuantileScaler(ColumnEstimator):
    """Map values to their quantile, uniform on 0...1 or to a normal distribution.

    `quantiles` landmarks are learned per column. Values between two landmarks are
    interpolated; a landmark value that spans several quantiles gets their middle.
    """

    quantiles = Param(Params._dummy(), "quantiles", "number of landmarks", TypeConverters.toInt)
    output = Param(Params._dummy(), "output", "uniform or normal", TypeConverters.toString)
    exact = Param(Params._dummy(), "exact", "exact landmarks", TypeConverters.toBoolean)

    @keyword_only
    def __init__(
        self, *, inputCols=None, outputCols=None, quantiles=1000, output="uniform", exact=False
    ):
        super().__init__()
        self._setDefault(quantiles=1000, output="uniform", exact=False)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "QuantileScalerModel":
        columns = [c for c, _ in self.pairs()]
        n = self.getOrDefault(self.quantiles)
        points = F.array(*[F.lit(i / (n - 1)) for i in range(n)])

        def landmarks(c: str) -> Column:
            value = F.col(c).cast("double")
            if self.getOrDefault(self.exact):
                return F.percentile(value, points)
            return F.percentile_approx(value, points, F.lit(10 * n))

        row = df.agg(*[landmarks(c).alias(c) for c in columns]).first()
        steps = []
        for c in columns:
            spans: dict[float, list[float]] = {}
            for i, value in enumerate(row[c] or []):  # no landmarks without values
                spans.setdefault(float(value), []).append(i / (n - 1))
            steps.append([[v, q[0], q[-1]] for v, q in spans.items()])
        model = QuantileScalerModel(steps=steps, output=self.getOrDefault(self.output))
        return self._copy_columns_to(model)


class QuantileScalerModel(ColumnModel):
    """`steps` holds per column the landmarks [value, lowest quantile, highest quantile]."""

    steps = Param(Params._dummy(), "steps", "landmarks per column", TypeConverters.identity)
    output = Param(Params._dummy(), "output", "uniform or normal", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, steps=None, output="uniform"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        result = df
        for i, (column, out) in enumerate(self.pairs()):
            steps = self.getOrDefault(self.steps)[i]
            if steps:
                result = self._map(result, column, out, steps)
            else:
                result = result.withColumn(out, F.lit(None).cast("double"))
        return result

    def _map(self, df: DataFrame, column: str, out: str, steps: list) -> DataFrame:
        # the step below a value is found by binary search in the JVM
        splits = [-math.inf] + [s[0] for s in steps] + [math.inf]
        finder = Bucketizer(
            splits=splits, inputCol="_x", outputCol="_slot", handleInvalid="keep"
        )
        found = finder.transform(df.withColumn("_x", F.col(column).cast("double")))
        values, low, high = (F.array(*[F.lit(float(s[k])) for s in steps]) for k in range(3))
        slot = F.col("_slot").cast("int")
        left, right = F.get(values, slot - 1), F.get(values, slot)
        left_q, right_q = F.get(high, slot - 1), F.get(low, slot)
        between = left_q + (F.col("_x") - left) * (right_q - left_q) / (right - left)
        uniform = (
            F.when(F.col("_x").isNull(), F.lit(None).cast("double"))
            .when(slot == 0, F.lit(0.0))
            .when(F.col("_x") == F.lit(float(steps[0][0])), F.lit(0.0))
            .when(F.col("_x") >= F.lit(float(steps[-1][0])), F.lit(1.0))
            .when(F.col("_x") == left, (F.get(low, slot - 1) + F.get(high, slot - 1)) / 2)
            .otherwise(between)
        )
        result = found.withColumn(out, uniform).drop("_x", "_slot")
        if self.getOrDefault(self.output) == "normal":
            # over the finished column: the formula names its input many times
            result = result.withColumn(out, probit(F.col(out)))
        return result


# Coefficients of Acklam's rational approximation of the inverse normal
# distribution (relative error below 1.2e-9).
PROBIT_CENTRE_TOP = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
PROBIT_CENTRE_BOTTOM = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01, 1.0,
)
PROBIT_TAIL_TOP = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
PROBIT_TAIL_BOTTOM = (
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
    3.754408661907416e00, 1.0,
)
PROBIT_EDGE = 0.02425
PROBIT_CLIP = 1e-7


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def probit(p: Column) -> Column:
    """Inverse of the standard normal distribution function, clipped near 0 and 1."""
    q = F.greatest(F.least(p, F.lit(1 - PROBIT_CLIP)), F.lit(PROBIT_CLIP))

    def tail(side: Column) -> Column:
        r = F.sqrt(-2 * F.log(side))
        return _polynomial(r, PROBIT_TAIL_TOP) / _polynomial(r, PROBIT_TAIL_BOTTOM)

    d = q - 0.5
    centre = (
        d * _polynomial(d * d, PROBIT_CENTRE_TOP) / _polynomial(d * d, PROBIT_CENTRE_BOTTOM)
    )
    value = F.when(q < PROBIT_EDGE, tail(q)).when(q > 1 - PROBIT_EDGE, -tail(1 - q))
    return F.when(p.isNotNull(), value.otherwise(centre))

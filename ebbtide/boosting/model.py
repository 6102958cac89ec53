"""Boosters as stages of Spark ML: an estimator, and the model that scores feature vectors."""

from __future__ import annotations

import dataclasses
import json

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.boosting.kernel import Tree, code_rows, leaf_of
from ebbtide.boosting.params import LINEAR, Booster
from ebbtide.boosting.train import Fit, train
from ebbtide.models.margin import add_scores


class _Columns(HasFeaturesCol, HasLabelCol, HasWeightCol, DefaultParamsReadable, DefaultParamsWritable):
    pass


def binary_positions(df: DataFrame, vector: str) -> set[int]:
    """Positions of a vector that hold 0 or 1, by the metadata of the column."""
    attributes = df.schema[vector].metadata.get("ml_attr", {}).get("attrs", {})
    return {a["idx"] for a in attributes.get("binary", [])}


def stacked(df: DataFrame, features: str, label: str, weight: str | None, key: Column, part: int = 0, held=None) -> DataFrame:
    """Rows of a frame with vectors in the form that `train` reads."""
    return df.select(
        F.lit(part).alias("part"),
        F.xxhash64(key).alias("key"),
        (F.lit(False) if held is None else held).alias("held"),
        F.col(label).cast("double").alias("label"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"),
        vector_to_array(features).alias("x"),
    )


class BoostingClassifier(Estimator, _Columns):
    """Fits one `Booster` on a vector column. `heldCol` may name a boolean column of rows that are not
    learned from, but on which the loss is taken; `keyCol` a column by whose hash rows are sampled (the
    features by default)."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", weightCol=None, booster=None, keyCol=None, heldCol=None):
        super().__init__()
        given = {k: v for k, v in self._input_kwargs.items() if k.endswith("Col") and k not in ("keyCol", "heldCol")}
        self._set(**{k: v for k, v in given.items() if v is not None})
        self.booster, self.keyCol, self.heldCol = booster or Booster(), keyCol, heldCol

    def _fit(self, df: DataFrame) -> "BoostedModel":
        features = self.getFeaturesCol()
        weight = self.getWeightCol() if self.isDefined(self.weightCol) else None
        key = F.col(self.keyCol) if self.keyCol else vector_to_array(features)
        held = F.coalesce(F.col(self.heldCol), F.lit(False)) if self.heldCol else None
        rows = stacked(df, features, self.getLabelCol(), weight, key, held=held)
        fit = Fit(0, self.booster)
        trainer = train(rows, [fit], {0: binary_positions(df, features)})
        return BoostedModel.learned(fit, trainer.cuts[0], featuresCol=features, labelCol=self.getLabelCol())


class BoostedModel(Model, _Columns):
    """Scores vectors; adds rawPrediction, probability and prediction. `learned` is kept as JSON."""

    content = Param(Params._dummy(), "content", "what was learned, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", content=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @classmethod
    def learned(cls, fit: Fit, cuts: list[np.ndarray], **columns) -> "BoostedModel":
        trees = [
            {**{k: v.tolist() for k, v in t._asdict().items() if k != "depth"}, "depth": t.depth, "weight": w, "gain": g, "cover": c}
            for t, w, g, c in zip(fit.trees, fit.weights, fit.gains, fit.covers)
        ]
        content = {
            "booster": dataclasses.asdict(fit.booster),
            "cuts": [c.tolist() for c in cuts],
            "trees": trees,
            "linear": None if fit.linear is None else fit.linear.tolist(),
            "loss": fit.loss,
        }
        return cls(content=json.dumps(content), **columns)

    def _read(self) -> dict:
        if getattr(self, "_parsed", None) is None:
            self._parsed = json.loads(self.getOrDefault(self.content))
        return self._parsed

    @property
    def booster(self) -> Booster:
        return Booster(**self._read()["booster"])

    @property
    def loss(self) -> list[tuple[float, float]]:
        """Mean loss of learning and of held rows before each round and after the last."""
        return [tuple(pair) for pair in self._read()["loss"]]

    @property
    def numFeatures(self) -> int:
        return len(self._read()["cuts"])

    @property
    def cuts(self) -> list[np.ndarray]:
        return [np.array(c, float) for c in self._read()["cuts"]]

    @property
    def trees(self) -> list[tuple[Tree, float]]:
        """Trees with their factors."""
        kinds = {"feature": np.int64, "code": np.int64, "missing_left": bool, "left": np.int64, "right": np.int64, "value": float}
        return [(Tree(*[np.array(t[k], d) for k, d in kinds.items()], t["depth"]), t["weight"]) for t in self._read()["trees"]]

    @property
    def covers(self) -> list[np.ndarray]:
        """Sum of Hessians of each node of each tree."""
        return [np.array(t["cover"], float) for t in self._read()["trees"]]

    @property
    def coefficients(self) -> DenseVector:
        return Vectors.dense(self._read()["linear"][:-1])

    @property
    def intercept(self) -> float:
        return self._read()["linear"][-1]

    @property
    def featureImportances(self) -> DenseVector:
        """Share of each feature in the gain of all splits; of a linear model in absolute coefficients."""
        total = np.zeros(self.numFeatures)
        if self.booster.kind == LINEAR:
            total += np.abs(self.coefficients.toArray())
        for tree, own in zip(self.trees, self._read()["trees"]):
            inner = tree[0].feature >= 0
            np.add.at(total, tree[0].feature[inner], np.array(own["gain"])[inner])
        return Vectors.dense(total / total.sum() if total.sum() else total)

    def _margins(self):
        if self.booster.kind == LINEAR:
            w = np.array(self._read()["linear"])
            return lambda x: np.nan_to_num(x) @ w[:-1] + w[-1]
        cuts, trees = self.cuts, self.trees

        def margins(x: np.ndarray) -> np.ndarray:
            codes = code_rows(x, cuts)
            out = np.zeros(len(x))
            for tree, weight in trees:
                out += weight * tree.value[leaf_of(tree, codes)]
            return out

        return margins

    def _transform(self, df: DataFrame) -> DataFrame:
        return add_scores(df, self.getFeaturesCol(), self._margins())

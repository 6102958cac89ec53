"""Forests as stages of Spark ML. Trees are a table; the model never needs them whole on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasWeightCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.boosting.model import binary_positions
from ebbtide.forest import kernel
from ebbtide.forest.kernel import Forest, Grown
from ebbtide.forest.train import TASK_BYTES, TREES, block_of, train
from ebbtide.session import bound_batches, materialize

#: Trees of at most this size are sent whole to the tasks that score; larger ones meet the rows in a join.
BROADCAST_BYTES = 1 << 26
_NODE_BYTES = 44


class ForestClassifier(Estimator, HasFeaturesCol, HasLabelCol, HasWeightCol):
    """Fits a `Forest` on a vector column. Rows are sampled by a hash of `keyCol` (the features by default),
    so rows with one key are drawn together; null weights and labels are left out."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", weightCol=None, forest=None, keyCol=None, taskBytes=TASK_BYTES):
        super().__init__()
        given = {k: v for k, v in self._input_kwargs.items() if k in ("featuresCol", "labelCol", "weightCol")}
        self._set(**{k: v for k, v in given.items() if v is not None})
        self.forest, self.keyCol, self.taskBytes = forest or Forest(), keyCol, taskBytes

    def _fit(self, df: DataFrame) -> "ForestModel":
        features = self.getFeaturesCol()
        weight = F.col(self.getWeightCol()) if self.isDefined(self.weightCol) else F.lit(1.0)
        key = F.col(self.keyCol) if self.keyCol else vector_to_array(features)
        rows = df.select(
            F.xxhash64(key).alias("key"),
            F.col(self.getLabelCol()).cast("double").alias("label"),
            weight.cast("double").alias("weight"),
            vector_to_array(features).alias("x"),
        ).na.drop()
        trees = train(rows, self.forest, binary_positions(df, features), self.taskBytes)
        width = df.schema[features].metadata.get("ml_attr", {}).get("num_attrs")
        if width is None:
            first = df.select(F.size(vector_to_array(features)).alias("n")).first()
            width = first["n"] if first else 0
        return ForestModel(trees=trees, featuresCol=features, labelCol=self.getLabelCol(), width=width)


class ForestModel(Model, HasFeaturesCol, HasLabelCol, MLWritable, MLReadable):
    """Scores vectors; adds rawPrediction, probability and prediction. A row's probability is the mean of
    the shares in the leaves it comes to."""

    width = Param(Params._dummy(), "width", "number of features", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, trees=None, featuresCol="features", labelCol="label", width=0):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if k != "trees"})
        self.trees, self._sent, self._size = trees, None, None

    @property
    def numFeatures(self) -> int:
        return self.getOrDefault(self.width)

    def size(self) -> dict[str, int]:
        """Number of trees and nodes, and the depth of the deepest tree."""
        if self._size is None:
            found = self.trees.agg(
                # a tree that hangs at a node begins with that node
                (F.sum(F.size("feature")) - F.count_if(F.col("node") >= 0)).alias("nodes"), F.countDistinct("tree").alias("trees"), F.max(F.col("above") + F.col("depth")).alias("depth")
            ).first()
            self._size = {"trees": found["trees"], "nodes": found["nodes"] or 0, "depth": found["depth"] or 0}
        return self._size

    @property
    def featureImportances(self) -> DenseVector:
        """Share of each feature in the loss of impurity, by tree, and the mean over trees."""
        cells = self.trees.select("tree", F.explode(F.arrays_zip("feature", "gain")).alias("c")).where("c.feature >= 0")
        by_tree = cells.groupBy("tree", F.col("c.feature").alias("feature")).agg(F.sum("c.gain").alias("gain"))
        totals = by_tree.groupBy("tree").agg(F.sum("gain").alias("total"))
        shares = by_tree.join(totals, "tree").where("total > 0").groupBy("feature").agg(F.sum(F.col("gain") / F.col("total")))
        out = np.zeros(self.numFeatures)
        for feature, share in shares.collect():
            out[feature] = share
        return Vectors.dense(out / out.sum() if out.sum() else out)

    def _transform(self, df: DataFrame) -> DataFrame:
        if self._small():
            return self._by_broadcast(df)
        return self._by_join(df)

    def _small(self) -> bool:
        return self.size()["nodes"] * _NODE_BYTES <= BROADCAST_BYTES

    def _by_broadcast(self, df: DataFrame) -> DataFrame:
        if self._sent is None:
            self._sent = df.sparkSession.sparkContext.broadcast(read_trees(self.trees))
        sent = self._sent

        @F.pandas_udf("double")
        def share(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            trees = sent.value
            for vectors in batches:
                if not len(vectors):
                    yield pd.Series([], dtype=float)
                    continue
                x = np.stack(vectors.to_numpy()).astype(float)
                yield pd.Series(_shares(trees, np.where(np.isnan(x), -np.inf, x)))

        return _with_scores(df.withColumn("_share", share(vector_to_array(self.getFeaturesCol()))))

    def _by_join(self, df: DataFrame) -> DataFrame:
        """Rows go down the tops in blocks, and what comes to one node meets the tree that hangs there.

        The frame is stored with a number a row, by which the scores come back. Nodes to which many rows
        come are dealt to several tasks.
        """
        width, rows_a_task = self.numFeatures, max(1, TASK_BYTES // (8 * max(1, self.numFeatures)))
        bound_batches(df.sparkSession)
        numbered = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "rows-to-score")
        tops = read_trees(self.trees.where("node = -1"))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                x, ids = block_of(batch, width), batch["_row"].to_numpy()
                for tree, own in tops.items():
                    leaves = kernel.leaf_of(own[-1], x)
                    out = [(tree, int(i), int((leaves == i).sum()), float(own[-1].value[i]), ids[leaves == i].tobytes(), x[leaves == i].tobytes())
                           for i in np.unique(leaves)]
                    columns = list(zip(*out))
                    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.binary())
                    names = ["tree", "node", "n", "top", "ids", "x"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        features = vector_to_array(self.getFeaturesCol()).alias("x")
        routed = materialize(
            numbered.select("_row", features).mapInArrow(route, "tree int, node int, n long, top double, ids binary, x binary"), "routed"
        )
        lots = routed.groupBy("tree", "node").agg(F.ceil(F.sum("n") / rows_a_task).cast("int").alias("lots"))
        lots = materialize(lots, "routed-lots")
        lot = F.pmod(F.xxhash64("ids"), F.col("lots")).cast("int")
        places = routed.join(lots, ["tree", "node"]).select("tree", "node", lot.alias("lot"), "top", "ids", "x")
        copies = lots.select("tree", "node", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("copy"))
        below = self.trees.where("node >= 0").join(copies, ["tree", "node"]).withColumnRenamed("copy", "lot")

        def meet(segments, trees):
            own = next((g for by_node in _grown(trees.rename_columns([c[1:] for c in trees.column_names])).values() for g in by_node.values()), None)
            ids, shares = [np.zeros(0, np.int64)], [np.zeros(0)]
            for top, i, x in zip(segments["top"].to_pylist(), segments["ids"], segments["x"]):  # read where they lie
                ids.append(np.frombuffer(i.as_buffer(), np.int64))
                rows = np.frombuffer(x.as_buffer()).reshape(-1, width)
                shares.append(np.full(len(rows), top) if own is None else own.value[kernel.leaf_of(own, rows)])
            return pa.table({"_row": np.concatenate(ids), "_one": np.concatenate(shares)})

        key = ["tree", "node", "lot"]
        below = below.toDF(*[f"_{c}" for c in below.columns])
        met = places.groupBy(*key).cogroup(below.groupBy(*[f"_{c}" for c in key])).applyInArrow(meet, "_row long, _one double")
        # shares are added in the order of their size, so that sums do not depend on the tasks
        shares = met.groupBy("_row").agg(
            (F.aggregate(F.array_sort(F.collect_list("_one")), F.lit(0.0), lambda a, b: a + b) / F.lit(len(tops))).alias("_share")
        )
        return _with_scores(numbered.join(shares, "_row").drop("_row"))

    def write(self) -> "MLWriter":
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> "MLReader":
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.trees.write.parquet(f"{path}/trees")


class _ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ForestModel(trees=self.sparkSession.read.schema(TREES).parquet(f"{path}/trees"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def _grown(table: pa.Table) -> dict[int, dict[int, Grown]]:
    """Trees of a table by tree and by the node at which they hang."""
    out: dict[int, dict[int, Grown]] = {}
    for row in table.to_pylist():
        arrays = [np.array(row[c], k) for c, k in zip(Grown._fields, kernel.KINDS)]
        out.setdefault(row["tree"], {})[row["node"]] = Grown(*arrays, row["depth"])
    return out


def read_trees(trees: DataFrame) -> dict[int, dict[int, Grown]]:
    return _grown(trees.orderBy("tree", "node").toArrow())


def _shares(trees: dict[int, dict[int, Grown]], x: np.ndarray) -> np.ndarray:
    """Mean share of class 1; added up in the order of size, as the join does it."""
    each = np.empty((len(trees), len(x)))
    for at, own in enumerate(trees.values()):
        leaves = kernel.leaf_of(own[-1], x)
        each[at] = own[-1].value[leaves]
        for node in np.unique(leaves):
            if int(node) in own:
                here, below = leaves == node, own[int(node)]
                each[at][here] = below.value[kernel.leaf_of(below, x[here])]
    each.sort(axis=0)
    return np.cumsum(each, axis=0)[-1] / len(trees) if len(trees) else np.zeros(len(x))


def _with_scores(df: DataFrame) -> DataFrame:
    p = F.col("_share")
    return (
        df.withColumn("rawPrediction", array_to_vector(F.array(1 - p, p)))
        .withColumn("probability", array_to_vector(F.array(1 - p, p)))
        .withColumn("prediction", (p > 0.5).cast("double"))
        .drop("_share")
    )

"""A network of rectified units, fitted by data-parallel mini-batches.

Rows lie in blocks of vectors. A step is one job: every task sums loss and gradients over the rows of its
blocks that a seeded hash puts in the step's batch, the sums of a few tasks meet in one, and the driver,
which holds the weights, adds up the rest and moves by Adam. A batch is a share of the rows, so a job has
as much to do as the data is large, and an epoch takes `batches` jobs at every size. Rows that
are one block are nothing to share out: their task takes all steps itself.
"""

from __future__ import annotations

import dataclasses
import json
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.boosting.kernel import drawn, losses
from ebbtide.models.margin import add_scores
from ebbtide.session import bound_batches, materialize, release

BLOCK_ROWS = 1 << 14
#: Blocks of a partition: what a task has in memory when it stores them or reads them back.
KEPT_BYTES = 1 << 24
_BLOCK = "block long, n int, x binary, label binary, weight binary, held binary, key binary"
_SUM = "lot int, block long, sums binary"


@dataclass(frozen=True)
class Network:
    """`hidden` units per layer; `batches` an epoch; `early_stop` epochs without a better loss on held
    rows end the fit, and the weights of the least loss are kept."""

    hidden: tuple[int, ...] = (128,)
    epochs: int = 50
    batches: int = 4
    learn_rate: float = 0.001
    fade: tuple[float, float] = (0.9, 0.999)
    epsilon: float = 1e-8
    early_stop: int = 0
    seed: int = 42


def shapes(width: int, hidden: tuple[int, ...]) -> list[tuple[int, int]]:
    sizes = [width, *hidden, 1]
    return list(zip(sizes, sizes[1:]))


def first_weights(width: int, network: Network) -> np.ndarray:
    """All layers in one array: weights scaled for rectified units, then zero offsets, layer by layer."""
    draw = np.random.default_rng(network.seed)
    parts = []
    for a, b in shapes(width, network.hidden):
        parts += [draw.normal(size=a * b) * math.sqrt(2 / max(1, a)), np.zeros(b)]
    return np.concatenate(parts)


def layers(weights: np.ndarray, width: int, hidden: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in shapes(width, hidden):
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def forward(own: list, x: np.ndarray) -> list[np.ndarray]:
    """What each layer gives, the input first; the last one is the margin."""
    out = [x]
    for number, (w, b) in enumerate(own):
        z = out[-1] @ w + b
        out.append(z if number == len(own) - 1 else np.maximum(z, 0))
    return out


def gradient(own: list, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed logistic loss and its gradient by all weights, in one array."""
    given = forward(own, x)
    margin = given[-1][:, 0]
    delta = (weight * (1 / (1 + np.exp(-margin)) - label))[:, None]
    parts = []
    for (w, _), below in zip(reversed(own), reversed(given[:-1])):
        parts = [(below.T @ delta).ravel(), delta.sum(axis=0), *parts]
        delta = (delta @ w.T) * (below > 0)
    return losses(margin, label, weight), np.concatenate(parts)


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in fields.split(", "))])
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _into_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            rows = batch.slice(at, BLOCK_ROWS)
            n = rows.num_rows
            x = np.nan_to_num(rows["x"].flatten().to_numpy(zero_copy_only=False).astype(float))
            key = rows["key"].to_numpy()
            plain = [rows[c].to_numpy(zero_copy_only=False).astype(t).tobytes() for c, t in (("label", "f8"), ("weight", "f8"), ("held", "?"))]
            yield _batch([(int(key[0]), n, x.tobytes(), *plain, key.tobytes())], _BLOCK)


def _sums(rows: dict, weights: np.ndarray, epoch: int, batch: int, network: Network, width: int) -> np.ndarray:
    """Of one block: summed loss, weight and gradient of the batch, and loss and weight of held rows."""
    own = layers(weights, width, network.hidden)
    share = (batch / network.batches, (batch + 1) / network.batches)
    x = np.frombuffer(rows["x"]).reshape(rows["n"], width)
    label, weight = np.frombuffer(rows["label"]), np.frombuffer(rows["weight"])
    held = np.frombuffer(rows["held"], bool)
    key = np.frombuffer(rows["key"], np.int64).astype(np.uint64)
    salt = (network.seed << 20) + epoch + 1
    used = drawn(key, salt, share[1]) & ~held
    used &= ~drawn(key, salt, share[0]) if share[0] else True
    loss, slope = gradient(own, x[used], label[used], weight[used])
    aside = [0.0, 0.0]
    if batch == 0 and held.any():
        margin = forward(own, x[held])[-1][:, 0]
        aside = [losses(margin, label[held], weight[held]), float(weight[held].sum())]
    return np.concatenate([[loss, weight[used].sum(), *aside], slope])


def _steps(blocks: DataFrame, network: Network, width: int, lots: int):
    """`run(weights, epoch, batch)`: the blocks' sums, by a job."""

    def run(weights: np.ndarray, epoch: int, batch: int) -> np.ndarray:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, first = None, 0
            for batch_ in batches:
                for row in batch_.to_pylist():
                    found = _sums(row, weights, epoch, batch, network, width)
                    first = row["block"] if total is None else first
                    total = found if total is None else total + found
            if total is not None:
                yield _batch([(first % lots, first, total.tobytes())], _SUM)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, first = None, 0
            for batch_ in batches:
                for block, data in zip(batch_["block"].to_pylist(), batch_["sums"].to_pylist()):
                    found = np.frombuffer(data)
                    first = block if total is None else first
                    total = found if total is None else total + found
            if total is not None:
                yield _batch([(0, first, total.tobytes())], _SUM)

        met = blocks.mapInArrow(sums, _SUM).repartition(lots, "lot").sortWithinPartitions("block").mapInArrow(meet, _SUM)
        found = sorted((r["block"], r["sums"]) for r in met.collect())
        return sum((np.frombuffer(s) for _, s in found), np.zeros(4 + len(weights)))

    return run


def _learn(run, network: Network, width: int) -> tuple[np.ndarray, list]:
    """All epochs over steps that `run` takes: the weights, and the losses of each epoch."""
    weights = first_weights(width, network)
    slow, fast = np.zeros_like(weights), np.zeros_like(weights)
    best, kept, history, step = math.inf, weights, [], 0
    for epoch in range(network.epochs + 1):
        losses_, held_loss = [0.0, 0.0], None
        for batch in range(network.batches if epoch < network.epochs else 1):
            loss, mass, aside, aside_mass, *slope = run(weights, epoch, batch)
            if batch == 0:
                held_loss = aside / aside_mass if aside_mass else None
                if network.early_stop and held_loss is not None and held_loss < best:
                    best, kept = held_loss, weights
            losses_ = [losses_[0] + loss, losses_[1] + mass]
            if epoch == network.epochs or not mass:
                continue
            step += 1
            slope = np.array(slope) / mass
            slow = network.fade[0] * slow + (1 - network.fade[0]) * slope
            fast = network.fade[1] * fast + (1 - network.fade[1]) * slope * slope
            move = slow / (1 - network.fade[0] ** step)
            weights = weights - network.learn_rate * move / (np.sqrt(fast / (1 - network.fade[1] ** step)) + network.epsilon)
        history.append((losses_[0] / losses_[1] if losses_[1] else 0.0, held_loss))
        held = [h for _, h in history if h is not None]
        patience = network.early_stop
        if patience and len(held) > patience and min(held[-patience:]) >= min(held[:-patience]):
            break
    return kept if network.early_stop and best < math.inf else weights, history


def _learn_whole(blocks: DataFrame, network: Network, width: int) -> tuple[np.ndarray, list]:
    """Of rows that are one block: all steps in the task that holds it."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch_ in batches:
            for row in batch_.to_pylist():
                learned = _learn(lambda *step: _sums(row, *step, network, width), network, width)
                yield pa.RecordBatch.from_pydict({"learned": pa.array([pickle.dumps(learned)], pa.binary())})

    return pickle.loads(blocks.mapInArrow(learn, "learned binary").first()["learned"])


class _Columns(HasFeaturesCol, HasLabelCol, HasWeightCol, DefaultParamsReadable, DefaultParamsWritable):
    pass


def _tasks(df: DataFrame, blocks: int, rows: int, width: int) -> int:
    """Partitions: no more than there are blocks, one a core, and more only where they would exceed KEPT_BYTES."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(blocks, max(cores, math.ceil(rows * (8 * width + 25) / KEPT_BYTES))))


class NetworkClassifier(Estimator, _Columns):
    """Fits a `Network` on a vector column. Rows of `heldCol` are not learned from, but the loss is taken
    on them; rows are put in batches by a hash of `keyCol` (the features by default)."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", weightCol=None, network=None, keyCol=None, heldCol=None):
        super().__init__()
        given = {"featuresCol": featuresCol, "labelCol": labelCol, "weightCol": weightCol}
        self._set(**{k: v for k, v in given.items() if v is not None})
        self.network, self.keyCol, self.heldCol = network or Network(), keyCol, heldCol

    def _blocks(self, df: DataFrame, width: int) -> DataFrame:
        """Blocks of rows, in as many partitions as they fill, for every core at most unless one had more than KEPT_BYTES."""
        x = vector_to_array(self.getFeaturesCol())
        weight = F.col(self.getWeightCol()) if self.isDefined(self.weightCol) else F.lit(1.0)
        held = F.coalesce(F.col(self.heldCol), F.lit(False)) if self.heldCol else F.lit(False)
        rows = df.where(F.col(self.getLabelCol()).isNotNull()).select(
            F.xxhash64(F.col(self.keyCol) if self.keyCol else x).alias("key"),
            held.alias("held"), F.col(self.getLabelCol()).cast("double").alias("label"),
            weight.cast("double").alias("weight"), x.alias("x"),
        )
        n = rows.count()
        tasks = _tasks(df, math.ceil(n / BLOCK_ROWS), n, width)
        return rows.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_into_blocks, _BLOCK)

    def _fit(self, df: DataFrame) -> "NetworkModel":
        network = self.network
        first = df.select(F.size(vector_to_array(self.getFeaturesCol())).alias("n")).first()
        width = first["n"] if first else 0
        bound_batches(df.sparkSession)
        stored = materialize(self._blocks(df, width), "network-blocks")
        facts = stored.agg(F.count(F.lit(1)).alias("number"), F.sum("n").alias("n")).first()
        number = facts["number"]
        tasks = _tasks(df, number, facts["n"] or 0, width)
        blocks = stored.repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if number == 1:
                learned, history = _learn_whole(blocks, network, width)
            else:
                learned, history = _learn(_steps(blocks, network, width, max(1, math.isqrt(tasks))), network, width)
        finally:
            blocks.unpersist()
            release(stored)
        content = {
            "network": dataclasses.asdict(network), "width": width, "weights": learned.tolist(), "loss": history
        }
        return NetworkModel(content=json.dumps(content), featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol())


class NetworkModel(Model, _Columns):
    """Scores vectors; adds rawPrediction, probability and prediction. What was learned is kept as JSON."""

    content = Param(Params._dummy(), "content", "what was learned, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", content=None):
        super().__init__()
        self._set(**{k: v for k, v in {"featuresCol": featuresCol, "labelCol": labelCol, "content": content}.items() if v is not None})

    @property
    def loss(self) -> list[tuple[float, float | None]]:
        """Mean loss of the epoch's batches, and of held rows at its start, per epoch."""
        return [tuple(pair) for pair in json.loads(self.getOrDefault(self.content))["loss"]]

    def _transform(self, df: DataFrame) -> DataFrame:
        read = json.loads(self.getOrDefault(self.content))
        own = layers(np.array(read["weights"]), read["width"], tuple(read["network"]["hidden"]))
        return add_scores(df, self.getFeaturesCol(), lambda x: forward(own, np.nan_to_num(x))[-1][:, 0])

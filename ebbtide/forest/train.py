"""Forests as Spark jobs: large nodes level by level, small ones whole in one task.

As long as a node has more rows than a task should hold, it is split by counts: tasks sum the weights of
both classes by code of the features that the node draws, the sums of all tasks stream through a sort by
(tree, node), and the driver gets a split per node. All large nodes of all trees take part in one job a
level. A node of fewer rows is handed over: its rows go to one task, which grows the tree below it to
pure leaves, by every value and not by codes, with no further job however deep it gets. What the driver
holds is the part of the trees above such nodes; what hangs below is a table.

Large nodes are cut at no more than 255 places a feature; one whose rows these do not tell apart in any
feature is a leaf.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.boosting.kernel import code_rows
from ebbtide.boosting.train import learn_cuts
from ebbtide.forest import kernel
from ebbtide.forest.kernel import Forest, Grown
from ebbtide.session import bound_batches, materialize, release

#: Features of a handed-over node's rows: what a task reads of them.
TASK_BYTES = 1 << 26
#: Sums that a task gathers before it lets them go.
SUM_BYTES = 1 << 26

#: The top of a tree has node -1; other rows hang at a node of it, `above` levels below the root.
TREES = (
    "tree int, node int, above int, feature array<int>, threshold array<double>, left array<int>, right array<int>, "
    "value array<double>, gain array<double>, cover array<double>, depth int"
)
_SUMS = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("sums", pa.binary())])
_ROWS = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("x", pa.binary()), ("weights", pa.binary())])


def tree_row(tree: int, node: int, above: int, grown: Grown) -> tuple:
    return (tree, node, above, *[a.tolist() for a in grown[:-1]], int(grown.depth))


@dataclass
class _Node:
    name: int
    depth: int
    rows: float = 0.0
    weights: tuple[float, float] = (0.0, 0.0)
    feature: int = -1
    threshold: float = 0.0
    children: tuple[int, int] = (0, 0)
    gain: float = 0.0
    tries: int = 0


class _Top:
    """The part of a tree that the driver knows."""

    def __init__(self, forest: Forest, tree: int):
        self.nodes = [_Node(kernel.root_name(forest.seed, tree), 0)]

    def split(self, i: int, feature: int, threshold: float, gain: float, left: np.ndarray) -> tuple[int, int]:
        node = self.nodes[i]
        node.feature, node.threshold, node.gain = feature, threshold, gain
        node.children = len(self.nodes), len(self.nodes) + 1
        rest = np.array([node.rows, *node.weights]) - left
        for side, sums in ((False, left), (True, rest)):
            self.nodes.append(_Node(kernel.child_name(node.name, side), node.depth + 1, sums[0], (sums[1], sums[2])))
        return node.children

    def grown(self) -> Grown:
        ns = self.nodes
        shares = [n.weights[1] / sum(n.weights) if sum(n.weights) > 0 else 0.0 for n in ns]
        return Grown(
            np.array([n.feature for n in ns], np.int32), np.array([n.threshold for n in ns], float),
            np.array([n.children[0] for n in ns], np.int32), np.array([n.children[1] for n in ns], np.int32),
            np.array(shares, float), np.array([n.gain for n in ns], float), np.array([sum(n.weights) for n in ns], float),
            max(n.depth for n in ns),
        )


def block_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The features of a batch, missing ones as the least value there is."""
    x = batch["x"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), width)
    return np.where(np.isnan(x), -np.inf, x)


def joined(cells: pa.ChunkedArray, width: int) -> np.ndarray:
    """The rows of numbers that cells hold, one below the other; cells are read where they lie."""
    return np.concatenate([np.frombuffer(cell.as_buffer()).reshape(-1, width) for cell in cells])


class _Sample:
    """A batch's rows in one tree's sample: places, weights a class, and the node each has come to."""

    def __init__(self, forest: Forest, tree: int, top: Grown, batch: pa.RecordBatch, x: np.ndarray, unit: float):
        times = kernel.times_drawn(forest, tree, batch["key"].to_numpy().astype(np.uint64))
        self.rows = np.flatnonzero(times)
        label = batch["label"].to_numpy()[self.rows] > 0
        weight = np.rint(batch["weight"].to_numpy()[self.rows] / unit) * unit * times[self.rows]
        self.weights = np.column_stack([np.where(label, 0.0, weight), np.where(label, weight, 0.0)])
        self.node = kernel.leaf_of(top, x[self.rows])

    def by_node(self) -> dict[int, np.ndarray]:
        """Places within the sample by node."""
        order = np.argsort(self.node, kind="stable")
        names, starts = np.unique(self.node[order], return_index=True)
        return dict(zip(names.tolist(), np.split(order, starts[1:])))


def _streamed(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[int, int, list[bytes]]]:
    """What sorted rows hold, one (tree, node) after the other, as one running sum."""
    key, total = None, None
    for batch in batches:
        for tree, node, sums in zip(batch["tree"].to_pylist(), batch["node"].to_pylist(), batch[name].to_pylist()):
            if (tree, node) != key:
                if key is not None:
                    yield (*key, total)
                key, total = (tree, node), np.frombuffer(sums).copy()
            else:
                total += np.frombuffer(sums)
    if key is not None:
        yield (*key, total)


class Trainer:
    """Grows one forest over rows of key, label, weight and x."""

    def __init__(self, rows: DataFrame, forest: Forest, binary: set[int] = frozenset(), task_bytes: int = TASK_BYTES):
        self.spark, self.forest = rows.sparkSession, forest
        bound_batches(self.spark)
        stack = rows.select(F.lit(0).alias("part"), F.lit(False).alias("held"), "key", "label", "weight", "x")
        self.rows = materialize(stack, "forest-rows")
        facts = self.rows.agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("most"), F.max(F.size("x")).alias("width")).first()
        self.n, self.width = facts["n"], facts["width"] or 0
        # sums of drawn weights stay below 2**52 units, where doubles are exact
        self.unit = 2.0 ** (math.ceil(math.log2(max(1.0, 20.0 * self.n * (facts["most"] or 1.0)))) - 52)
        self.small = max(forest.min_rows, task_bytes // (8 * max(1, self.width)))
        self.tops = [_Top(forest, t) for t in range(forest.trees)]
        self.binary = binary

    def train(self) -> DataFrame:
        """The trees, as a stored table of `TREES`."""
        if self.n:
            self._grow_tops()
        tops = [tree_row(t, -1, 0, top.grown()) for t, top in enumerate(self.tops)]
        trees = self.spark.createDataFrame(tops, TREES)
        if self.handed:
            trees = trees.unionByName(self._handed_over())
        stored = materialize(trees, "forest-trees")
        release(self.rows)
        return stored

    @property
    def handed(self) -> dict[int, set[int]]:
        """Leaves of the tops that are grown in one task each."""
        found = {}
        for t, top in enumerate(self.tops):
            own = {i for i, n in enumerate(top.nodes) if n.feature < 0 and self._divisible(n) and n.rows <= self.small}
            if own:
                found[t] = own
        return found

    def _divisible(self, node: _Node) -> bool:
        deep = node.depth == self.forest.max_depth > 0
        return node.rows >= self.forest.min_rows and min(node.weights) > 0 and not deep

    def _grow_tops(self) -> None:
        for tree, _, sums in self._run(self._count_roots, lambda tree, node, total: total):
            self.tops[tree].nodes[0].rows, self.tops[tree].nodes[0].weights = sums[0], (sums[1], sums[2])
        most = self.forest.drawn(self.width)
        large = lambda n: self._divisible(n) and n.rows > self.small
        waiting = [(t, 0) for t, top in enumerate(self.tops) if large(top.nodes[0])]
        cuts = learn_cuts(self.rows, {0: set(self.binary)})[0] if waiting else []
        while waiting:
            orders: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
            for t, i in waiting:
                node = self.tops[t].nodes[i]
                orders[t][i] = kernel.feature_order(node.name, self.width)[node.tries * most : (node.tries + 1) * most]
            measure, search = self._jobs(dict(orders), cuts)
            found = {(t, i): sums for t, i, sums in self._run(measure, search)}
            again = []
            for t, i in waiting:
                top, node = self.tops[t], self.tops[t].nodes[i]
                feature, code, gain, *left = found[t, i]
                if feature >= 0:
                    threshold = -np.inf if code == 0 else cuts[int(feature)][int(code) - 1]
                    children = top.split(i, int(feature), float(threshold), gain, np.array(left))
                    again += [(t, c) for c in children if large(top.nodes[c])]
                else:
                    node.tries += 1
                    again += [(t, i)] if node.tries * most < self.width else []
            waiting = again

    def _run(self, measure, search) -> list[tuple[int, int, np.ndarray]]:
        """One job: sums of tasks by (tree, node), and what `search` makes of each."""

        def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for tree, node, total in _streamed(batches, "sums"):
                yield _sums([(tree, node, search(tree, node, total))])

        summed = self.rows.mapInArrow(measure, "tree int, node int, sums binary")
        sorted_ = summed.repartition("tree", "node").sortWithinPartitions("tree", "node")
        got = sorted_.mapInArrow(answers, "tree int, node int, sums binary").collect()
        return [(r["tree"], r["node"], np.frombuffer(r["sums"])) for r in got]

    @property
    def _count_roots(self):
        forest, width, unit = self.forest, self.width, self.unit
        bare = Grown(*[np.array([v]) for v in (-1, 0.0, 0, 0, 0.0, 0.0, 0.0)], 0)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = np.zeros((forest.trees, 3))
            for batch in batches:
                x = np.zeros((len(batch), max(1, width)))
                for t in range(forest.trees):
                    sample = _Sample(forest, t, bare, batch, x, unit)
                    totals[t] += [len(sample.rows), *sample.weights.sum(axis=0)]
            yield _sums([(t, 0, totals[t]) for t in range(forest.trees)])

        return measure

    def _jobs(self, orders: dict[int, dict[int, np.ndarray]], cuts: list[np.ndarray]):
        """Sums (feature, code, (rows, weights of the classes)) of the nodes asked for, and their splits."""
        forest, width, unit = self.forest, self.width, self.unit
        tops = {t: self.tops[t].grown() for t in orders}
        codes_of = max(len(c) for c in cuts) + 2

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], np.ndarray] = {}
            size = 0
            for batch in batches:
                x = block_of(batch, width)
                codes = code_rows(np.where(np.isneginf(x), np.nan, x), cuts)
                for t, nodes in orders.items():
                    sample = _Sample(forest, t, tops[t], batch, x, unit)
                    for node, places in sample.by_node().items():
                        if node not in nodes:
                            continue
                        own = codes[np.ix_(sample.rows[places], nodes[node])]
                        cells = (np.arange(own.shape[1]) * codes_of + own).ravel()
                        each = [np.ones(len(places)), *sample.weights[places].T]
                        found = np.stack(
                            [np.bincount(cells, np.repeat(v, own.shape[1]), own.shape[1] * codes_of) for v in each], axis=1
                        )
                        if (t, node) in held:
                            held[t, node] += found
                        else:
                            held[t, node] = found
                            size += found.nbytes
                    if size > SUM_BYTES:
                        yield from _let_go(held)
                        held, size = {}, 0
            yield from _let_go(held)

        def search(tree: int, node: int, total: np.ndarray) -> np.ndarray:
            tried = orders[tree][node]
            sums = total.reshape(len(tried), codes_of, 3)
            upto = np.cumsum(sums, axis=1)
            whole = upto[:, -1:]
            apart = (upto[..., 0] > 0) & (upto[..., 0] < whole[..., 0])
            if not apart.any():
                return np.array([-1.0, 0, 0, 0, 0, 0])
            gains = np.where(apart, kernel.gini_gain(upto[..., 1:], whole[..., 1:]), -np.inf)
            at, code = divmod(int(np.argmax(gains)), codes_of)
            return np.array([tried[at], code, gains[at, code], *upto[at, code]], float)

        return measure, search

    def _handed_over(self) -> DataFrame:
        """Rows of small nodes, each to its task, and the trees below."""
        forest, width, unit, handed = self.forest, self.width, self.unit, self.handed
        tops = {t: self.tops[t].grown() for t in handed}
        starts = {(t, i): (self.tops[t].nodes[i].name, self.tops[t].nodes[i].depth) for t, own in handed.items() for i in own}

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = block_of(batch, width)
                for t, nodes in handed.items():
                    sample = _Sample(forest, t, tops[t], batch, x, unit)
                    rows = [
                        (t, node, x[sample.rows[places]].tobytes(), sample.weights[places].tobytes())
                        for node, places in sample.by_node().items()
                        if node in nodes
                    ]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROWS)], schema=_ROWS)

        def finish(key, table):
            t, node = key[0].as_py(), key[1].as_py()
            x, weights = joined(table["x"], width), joined(table["weights"], 2)
            name, above = starts[t, node]
            grown = kernel.grow(forest, name, above, x, weights)
            row = (t, node, above, *grown[:-1], int(grown.depth))
            return pa.Table.from_arrays([pa.array([c], f.type) for c, f in zip(row, _trees_schema())], schema=_trees_schema())

        rows = sum(self.tops[t].nodes[i].rows for t, i in starts)
        wave = 4 * self.spark.sparkContext.defaultParallelism
        tasks = min(len(starts), max(wave, math.ceil(rows / self.small)))
        dealt = self.rows.mapInArrow(deal, "tree int, node int, x binary, weights binary").repartition(tasks, "tree", "node")
        return dealt.groupBy("tree", "node").applyInArrow(finish, TREES)


def _trees_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in TREES.split(", "))])


def _sums(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    columns = list(zip(*[(t, n, s.tobytes()) for t, n, s in rows])) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SUMS)], schema=_SUMS)


def _let_go(held: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    keys = list(held)
    for at in range(0, len(keys), 64):
        yield _sums([(*key, held[key].ravel()) for key in keys[at : at + 64]])


def train(rows: DataFrame, forest: Forest, binary: set[int] = frozenset(), task_bytes: int = TASK_BYTES) -> DataFrame:
    return Trainer(rows, forest, binary, task_bytes).train()

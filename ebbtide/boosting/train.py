"""Boosting as Spark jobs: all fits of a search advance together, one job per level of their trees.

The rows of a fit's part (a fold with the features learned for it) lie in blocks: one Spark row holds
the codes, labels, weights and keys of up to BLOCK_ROWS rows, and the margins that the part's fits
have come to. A job sums, for every fit and open node, gradients and Hessians per feature and code
over the blocks of a task, adds the tasks' histograms up by (fit, node), and finds the splits where they
meet. The driver gets a split per node, as large as the model; trees go out with the next job. Margins
are stored every STORE_EVERY rounds, and those of the trees since then computed as needed, so lineage
stays short and no state is lost with an executor.

A part of few rows is nothing to share out: each of its fits is handed over to one task, which does all
its rounds (see `whole`), and all such fits are one job. With fits for every core, parts of up to
WHOLE_BYTES are handed over likewise. Both ways learn the same models.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.boosting import kernel
from ebbtide.boosting.growth import GrowingTree
from ebbtide.boosting.kernel import Split, Tree
from ebbtide.boosting.params import DROPPING, LINEAR, Booster
from ebbtide.boosting.whole import Whole, add_tree, gram, linear_step, split_of
from ebbtide.functions.running import running_totals
from ebbtide.session import bound_batches, materialize, release

BLOCK_ROWS = 1 << 12
#: Blocks that are cut, and written to a file, by one task.
LOT_BLOCKS = 4
#: Blocks of a partition that is kept: what a task has in memory when it stores them or reads them back.
KEPT_BYTES = 1 << 25
#: Sums that a task lets go at once.
SUM_BYTES = 1 << 22
STORE_EVERY = 10
MOST_CUTS = 255
#: Parts whose fits are handed over to a task: rows of any, and codes where there are fits for every core.
WHOLE_ROWS = 1 << 16
WHOLE_BYTES = 1 << 25

#: A row to learn from: part, key, held (left out of learning), label, weight and features.
STACK = "part int, key long, held boolean, label double, weight double, x array<double>"
_BLOCK = "part int, block long, n int, codes binary, x binary, label binary, weight binary, held binary, key binary, margins binary, leaves binary"
_SUM = "fit int, node int, block long, sums binary"
_LEARNED = "fit int, learned binary"


@dataclass
class Fit:
    """One booster on one part, and what it has learned.

    `weights` are the trees' factors, `loss` the mean losses of learning and of held rows before each
    round, and after the last.
    """

    part: int
    booster: Booster
    trees: list[Tree] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    gains: list[list[float]] = field(default_factory=list)
    covers: list[list[float]] = field(default_factory=list)
    linear: np.ndarray | None = None
    linears: list[np.ndarray] = field(default_factory=list)
    loss: list[tuple[float, float]] = field(default_factory=list)
    confusion: tuple[int, int, int, int] = (0, 0, 0, 0)

    def stopped(self) -> bool:
        """No better loss on held rows for `early_stop` rounds."""
        patience = self.booster.early_stop
        held = [h for _, h in self.loss]
        return bool(patience) and len(held) > patience and min(held[-patience:]) >= min(held[:-patience])

    def take(self, learned: Fit) -> None:
        """What a task has learned for this fit."""
        self.__dict__.update(learned.__dict__)

    def cut_to_best(self) -> None:
        """Only what was learned up to the least loss on held rows."""
        if self.booster.early_stop:
            best = int(np.argmin([h for _, h in self.loss]))
            if self.linears:
                self.linear = self.linears[best - 1] if best else np.zeros_like(self.linear)
            for own in (self.trees, self.weights, self.gains, self.covers):
                del own[best:]


def learn_cuts(stack: DataFrame, binary: dict[int, set[int]], most: int = MOST_CUTS) -> dict[int, list[np.ndarray]]:
    """Per part and feature the values between which rows are told apart.

    Up to `most` + 1 different values are all told apart; more of them are put in ranges of equal sums of
    Hessians, which at the start are in proportion to the weights. A cut lies midway between neighbours.
    Features in `binary` have one cut. Values are counted first and totals run over the counts.
    """
    widths = {r["part"]: r["n"] for r in stack.groupBy("part").agg(F.max(F.size("x")).alias("n")).collect()}
    cuts = {p: [np.array([0.5])] * n for p, n in widths.items()}
    asked = {p: [i for i in range(n) if i not in binary.get(p, ())] for p, n in widths.items()}
    for part, positions in asked.items():
        for i in positions:
            cuts[part][i] = np.zeros(0)
    listed = F.map_from_entries(
        F.array(*[F.struct(F.lit(p), F.array(*[F.lit(i) for i in ps]).cast("array<int>")) for p, ps in asked.items()])
    )
    cells = stack.where("NOT held").select(
        "part",
        "weight",
        F.explode(F.transform(listed[F.col("part")], lambda i: F.struct(i.alias("i"), F.get("x", i).alias("v")))).alias("c"),
    )
    values = (
        cells.select("part", "weight", "c.i", F.col("c.v").alias("value"))
        .where("value IS NOT NULL AND NOT isnan(value)")
        .groupBy("part", "i", "value")
        .agg((F.sum("weight") / 4).alias("hessian"), F.lit(1).alias("one"))
    )
    values = materialize(values, "feature-values")
    running = running_totals(
        values, "value", {"hessian": "upto", "one": "rank"}, by=["part", "i"], totals={"hessian": "total", "one": "number"}
    )
    ranged = F.ceil(F.col("upto") / F.col("total") * (most + 1) - 1e-9)
    slot = F.when(F.col("number") <= most + 1, F.col("rank")).otherwise(ranged)
    ends = running.groupBy("part", "i", slot.alias("slot")).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    found = defaultdict(list)
    for r in ends.collect():
        found[r["part"], r["i"]].append((r["low"], r["high"]))
    for (part, i), spans in found.items():
        spans.sort()
        cuts[part][i] = np.array([(a[1] + b[0]) / 2 for a, b in zip(spans, spans[1:])])
    release(values)
    return cuts


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in fields.split(", "))])
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _into_blocks(cuts: dict[int, list[np.ndarray]], slots: dict[int, int], keep_x: set[int], size: int):
    """Rows, which come by part, as blocks of at most `size`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def block(rows: pa.Table) -> tuple:
            part, n = rows["part"][0].as_py(), len(rows)
            lists = rows["x"].combine_chunks()
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, len(cuts[part]))
            key = rows["key"].to_numpy()
            plain = [rows[c].to_numpy().astype(t).tobytes() for c, t in (("label", "f8"), ("weight", "f8"), ("held", "?"))]
            margins = np.zeros((slots[part], n)).tobytes()
            own = np.nan_to_num(x).tobytes() if part in keep_x else None
            return (part, int(key[0]), n, kernel.code_rows(x, cuts[part]).tobytes(), own, *plain, key.tobytes(), margins, b"")

        def full(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            while waiting and (sum(b.num_rows for b in waiting) >= least or waiting[0]["part"][0] != waiting[-1]["part"][-1]):
                rows = pa.Table.from_batches(waiting)
                same = int(np.argmax(np.append(rows["part"].to_numpy() != rows["part"][0].as_py(), True)))
                take = min(same, size)
                yield _batch([block(rows.slice(0, take))], _BLOCK)
                waiting = rows.slice(take).to_batches()

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                yield from full(size)
        yield from full(1)

    return cut


class _Rows:
    """A block, read."""

    def __init__(self, row: dict, width: int):
        n = row["n"]
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.part, self.block, self.n = row["part"], row["block"], n
        self.codes = read("codes", np.uint16).reshape(n, width)
        self.x = read("x", np.float64).reshape(n, width) if row["x"] else None
        self.label, self.weight = read("label", np.float64), read("weight", np.float64)
        self.held, self.key = read("held", bool), read("key", np.int64).astype(np.uint64)
        self.margins = read("margins", np.float64).reshape(-1, n)
        self.leaves = read("leaves", np.uint32)

    def leaves_of(self, slot: int, stored: int) -> np.ndarray:
        return self.leaves.reshape(-1, stored, self.n)[slot] if stored else np.zeros((0, self.n), np.uint32)


@dataclass
class _Order:
    """What a job is to do for one fit."""

    fit: int
    slot: int
    booster: Booster
    stored: int
    recent: list[tuple[Tree, float]]
    values: list[np.ndarray]
    weights: list[float]
    linear: np.ndarray | None
    round: int
    tree: Tree | None = None
    nodes: list[int] = field(default_factory=list)
    losses: bool = False
    afresh: bool = False

    def margin(self, rows: _Rows) -> np.ndarray:
        """Margin without the trees whose weight is zero here (dropped ones)."""
        if self.booster.kind == LINEAR:
            return np.zeros(rows.n) if self.linear is None else rows.x @ self.linear[:-1] + self.linear[-1]
        if self.booster.kind == DROPPING:
            out = np.zeros(rows.n)
            for leaves, value, weight in zip(rows.leaves_of(self.slot, self.stored), self.values, self.weights):
                if weight:
                    out += weight * value[leaves]
        else:
            out = np.zeros(rows.n) if self.afresh else rows.margins[self.slot].copy()
        for tree, weight in self.recent:
            if weight:
                out += weight * tree.value[kernel.leaf_of(tree, rows.codes)]
        return out


class Trainer:
    """Fits many boosters over the parts of a stack; `fit` does all of it."""

    def __init__(self, stack: DataFrame, fits: list[Fit], binary: dict[int, set[int]] | None = None):
        self.spark, self.fits = stack.sparkSession, fits
        bound_batches(self.spark)
        self.stack = materialize(stack, "boosting-rows")
        self.cuts = learn_cuts(self.stack, binary or {})
        sizes = {p: np.array([0, *[len(c) + 2 for c in cuts]]).cumsum() for p, cuts in self.cuts.items()}
        self.offsets = sizes
        stats = self.stack.groupBy("part").agg(
            F.count(F.lit(1)).alias("n"), F.max("weight").alias("most"),
            F.sum(F.when(F.col("held"), 0).otherwise(F.col("weight"))).alias("learning"),
            F.sum(F.when(F.col("held"), F.col("weight")).otherwise(0)).alias("held"),
        ).collect()
        self.total = {r["part"]: (r["learning"] or 0.0, r["held"] or 0.0) for r in stats}
        # running sums of n rounded gradients over all features stay below 2**52, where doubles are exact
        self.scale = {}
        for r in stats:
            largest = max(1.0, r["n"] * (r["most"] or 1.0) * max(1, len(self.cuts[r["part"]])))
            self.scale[r["part"]] = 2.0 ** (52 - math.ceil(math.log2(largest)))
        self.rows_of = {r["part"]: r["n"] for r in stats}
        self.whole = self._handed_over()
        self.slots, taken = {}, defaultdict(int)
        for number, fit in enumerate(fits):
            if number in self.whole:
                continue
            kind = fit.part, fit.booster.kind == DROPPING
            self.slots[number] = taken[kind]
            taken[kind] += 1
        self.stored = 0
        self.blocks = self._keep(self._cut(taken, max([r["n"] for r in stats], default=0)))

    def _handed_over(self) -> set[int]:
        """Fits that are done in one task each."""
        bounded = {p for p, n in self.rows_of.items() if 2 * n * len(self.cuts[p]) <= WHOLE_BYTES}
        asked = {i for i, f in enumerate(self.fits) if f.part in bounded}
        if len(asked) >= self.spark.sparkContext.defaultParallelism:
            return asked
        return {i for i in asked if self.rows_of[self.fits[i].part] <= WHOLE_ROWS}

    def _cut(self, taken: dict, largest: int) -> DataFrame:
        slots = {p: taken.get((p, False), 0) for p in self.cuts}
        linear = {f.part for f in self.fits if f.booster.kind == LINEAR}
        lots = max(1, math.ceil(largest / (LOT_BLOCKS * BLOCK_ROWS)))
        tasks = lots * max(1, len(self.cuts))
        dealt = self.stack.repartition(tasks, "part", F.pmod("key", F.lit(lots))).sortWithinPartitions("part", "key")
        return dealt.mapInArrow(_into_blocks(self.cuts, slots, linear, BLOCK_ROWS), _BLOCK)

    def _keep(self, blocks: DataFrame) -> DataFrame:
        """Blocks stored, and for shared fits dealt evenly and kept: files are packed by size, which leaves cores idle."""
        self.files = materialize(blocks, "boosting-blocks")
        if not self.shared:
            return self.files
        dealt = self.files.repartitionByRange(self._partitions(), "part", "block")
        return dealt.persist(StorageLevel.MEMORY_AND_DISK)

    def _partitions(self) -> int:
        """Two a core, and as many as it takes to have no more than KEPT_BYTES in one."""
        number = sum(math.ceil(n / BLOCK_ROWS) for n in self.rows_of.values())
        size = sum(n * self._row_bytes(p) for p, n in self.rows_of.items())
        return max(1, min(number, max(2 * self.spark.sparkContext.defaultParallelism, math.ceil(size / KEPT_BYTES))))

    def _row_bytes(self, part: int) -> int:
        """Of one row in the blocks of a part, with all leaves that will be stored."""
        own = [self.fits[i].booster for i in self.shared if self.fits[i].part == part]
        linear = any(f.part == part and f.booster.kind == LINEAR for f in self.fits)
        leaves = sum(4 * b.rounds for b in own if b.kind == DROPPING)
        return (10 if linear else 2) * len(self.cuts[part]) + 25 + 8 * len(own) + leaves

    def close(self) -> None:
        self.blocks.unpersist()
        release(self.files)
        release(self.stack)

    def _order(self, number: int, round_: int, dropped: list[int] = (), afresh: bool = False) -> _Order:
        fit = self.fits[number]
        weights = [0.0 if i in dropped else w for i, w in enumerate(fit.weights)]
        stored = 0 if afresh else self.stored
        values = [t.value for t in fit.trees[:stored]] if fit.booster.kind == DROPPING else []
        return _Order(
            number, self.slots[number], fit.booster, self.stored, list(zip(fit.trees, weights))[stored:], values, weights,
            fit.linear, round_, afresh=afresh,
        )

    def _run(self, orders: list[_Order]) -> dict[tuple[int, int], bytes]:
        """One job: what was asked for, by (fit, node); losses by (fit, -1)."""
        by_part = defaultdict(list)
        for order in orders:
            by_part[self.fits[order.fit].part].append(order)
        by_part = dict(by_part)
        offsets, scale = self.offsets, self.scale
        searched = {}
        for o in orders:
            part = self.fits[o.fit].part
            b = o.booster
            columns = np.array(b.columns(o.round, len(offsets[part]) - 1))
            searched[o.fit] = (part, columns, b, b.kind == LINEAR)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    own = by_part.get(row["part"])
                    if not own:
                        continue
                    offset = offsets[row["part"]]
                    rows = _Rows(row, len(offset) - 1)
                    out = []
                    for order in own:
                        margin = order.margin(rows)
                        if order.losses:
                            both = [kernel.losses(margin[m], rows.label[m], rows.weight[m]) for m in (~rows.held, rows.held)]
                            out.append((order.fit, -1, rows.block, np.array(both).tobytes()))
                        if not order.nodes:
                            continue
                        g, h = kernel.gradients(margin, rows.label, rows.weight)
                        if order.booster.kind == LINEAR:
                            out.append((order.fit, 0, rows.block, gram(rows, g, h).tobytes()))
                            continue
                        unit = scale[row["part"]]
                        for node, found in zip(order.nodes, _histograms(order.tree, order.nodes, order, rows, g, h, offset, unit)):
                            key = order.fit, node
                            sums[key] = sums[key] + found if key in sums else found
                    yield _batch(out, _SUM)
            keys = list(sums)
            several = max(1, SUM_BYTES // max((own.nbytes for own in sums.values()), default=1))
            for at in range(0, len(keys), several):
                yield _batch([(*key, 0, sums.pop(key).tobytes()) for key in keys[at : at + several]], _SUM)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, parts = None, []

            def answer() -> tuple:
                part, columns, booster, ready = searched[key[0]]
                if len(parts) == 1 and (ready or key[1] < 0):
                    return (*key, 0, parts[0])
                total = sum(np.frombuffer(own) for own in parts)
                if key[1] >= 0 and not ready:
                    total = np.array(split_of(total.reshape(2, -1) / scale[part], offsets[part], columns, booster), float)
                return (*key, 0, total.tobytes())

            for batch in batches:
                out = []
                for fit, node, sums in zip(*[batch[c].to_pylist() for c in ("fit", "node", "sums")]):
                    if key != (fit, node):
                        if key:
                            out.append(answer())
                        key, parts = (fit, node), []
                    if len(parts) == 64:
                        parts = [sum(np.frombuffer(own) for own in parts).tobytes()]
                    parts.append(sums)
                yield _batch(out, _SUM)
            if key:
                yield _batch([answer()], _SUM)

        met = self.blocks.mapInArrow(measure, _SUM).repartition("fit", "node").sortWithinPartitions("fit", "node", "block")
        return {(r["fit"], r["node"]): bytes(r["sums"]) for r in met.mapInArrow(search, _SUM).collect()}

    def _store(self) -> None:
        """Margins, or leaves, of the trees so far go into the blocks."""
        by_part = defaultdict(list)
        for number in self.shared:
            by_part[self.fits[number].part].append(self._order(number, 0))
        by_part, width = dict(by_part), {p: len(c) for p, c in self.cuts.items()}
        trees = max(len(self.fits[i].trees) for i in self.shared)

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    rows = _Rows(row, width[row["part"]])
                    margins, leaves = rows.margins.copy(), []
                    for order in by_part.get(row["part"], []):
                        if order.booster.kind == DROPPING:
                            all_trees = np.zeros((trees, rows.n), np.uint32)
                            all_trees[: order.stored] = rows.leaves_of(order.slot, order.stored)
                            for at, (tree, _) in enumerate(order.recent, order.stored):
                                all_trees[at] = kernel.leaf_of(tree, rows.codes)
                            leaves.append(all_trees)
                        elif order.booster.kind != LINEAR:
                            margins[order.slot] = order.margin(rows)
                    row["margins"], row["leaves"] = margins.tobytes(), np.array(leaves, np.uint32).tobytes()
                    yield _batch([tuple(row[f.split()[0]] for f in _BLOCK.split(", "))], _BLOCK)

        old, files = self.blocks, self.files
        self.blocks = self._keep(old.mapInArrow(write, _BLOCK))
        old.unpersist()
        release(files)
        self.stored = trees

    def _fit_whole(self, judge: bool) -> None:
        """One job that does the fits which are handed over, each in its task."""
        fits = {i: self.fits[i] for i in self.whole}
        parts = {i: (self.offsets[f.part], self.scale[f.part], self.total[f.part]) for i, f in fits.items()}
        pairs = self.spark.createDataFrame([(i, f.part, f.booster.kind == LINEAR) for i, f in fits.items()], "fit int, part int, linear boolean")

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, blocks = None, []

            def learned() -> pa.RecordBatch:
                offset, unit, total = parts[number]
                Whole(blocks, offset, unit, total).fit(fits[number], judge)
                return _batch([(number, pickle.dumps(fits[number]))], _LEARNED)

            for batch in batches:
                for row in batch.to_pylist():
                    if row["fit"] != number:
                        if blocks:
                            yield learned()
                        number, blocks = row["fit"], []
                    blocks.append(_Rows(row, len(parts[number][0]) - 1))
            if blocks:
                yield learned()

        own = [f.split()[0] for f in _BLOCK.split(", ")]
        none = F.lit(b"")
        slim = {"x": F.when(F.col("linear"), F.col("x")), "margins": none, "leaves": none}
        dealt = (
            self.blocks.join(F.broadcast(pairs), "part")  # a row per fit
            .select("fit", *[slim.get(c, F.col(c)).alias(c) for c in own])
            .repartitionByRange(len(fits), "fit")
            .sortWithinPartitions("fit", "block")
        )
        for r in dealt.mapInArrow(learn, _LEARNED).collect():
            self.fits[r["fit"]].take(pickle.loads(r["learned"]))

    def _round(self, number: int) -> None:
        open_fits = [i for i in self.shared if number < self.fits[i].booster.rounds and not self.fits[i].stopped()]
        dropped = {i: self.fits[i].booster.dropped(number, self.fits[i].weights) for i in open_fits}
        trees = [i for i in open_fits if self.fits[i].booster.kind != LINEAR]
        growing = {i: GrowingTree(self.fits[i].booster) for i in trees}
        first = True
        while True:
            orders = []
            for i in open_fits:
                order = self._order(i, number, dropped[i])
                order.losses = first and not dropped[i]
                if i in growing:
                    order.nodes = growing[i].wanted()
                    order.tree = growing[i].on_trial()
                elif first:
                    order.nodes = [0]
                if order.nodes or order.losses:
                    orders.append(order)
            if first:  # with trees left out, the loss is that of another model
                orders += [self._loss_order(i, number) for i in open_fits if dropped[i]]
            if not orders:
                break
            for (i, node), found in self._run(orders).items():
                if node < 0:
                    self._note_loss(i, np.frombuffer(found))
                elif i in growing:
                    f, code, left, *rest = np.frombuffer(found)
                    growing[i].learn(node, Split(int(f), int(code), bool(left), *map(float, rest)))
                else:
                    linear_step(self.fits[i], np.frombuffer(found), self.total[self.fits[i].part][0])
            first = False
        for i in trees:
            add_tree(self.fits[i], dropped[i], growing[i].finished(), *growing[i].measures())

    def _loss_order(self, i: int, number: int) -> _Order:
        order = self._order(i, number)
        order.losses = True
        return order

    def _note_loss(self, i: int, found: np.ndarray) -> None:
        totals = self.total[self.fits[i].part]
        self.fits[i].loss.append(tuple(float(v / t) if t else 0.0 for v, t in zip(found, totals)))

    @property
    def shared(self) -> list[int]:
        """Fits that all tasks work on together."""
        return [i for i in range(len(self.fits)) if i not in self.whole]

    def fit(self, judge: bool = False) -> list[Fit]:
        """Learn; with `judge` also count labels against hard labels on the held rows of each fit."""
        if self.whole:
            self._fit_whole(judge)
        if self.shared:
            self._fit_shared()
            if judge:
                self.judge()
        return self.fits

    def _fit_shared(self) -> None:
        own = self.shared
        for number in range(max(self.fits[i].booster.rounds for i in own)):
            if number and number % STORE_EVERY == 0:
                self._store()
            self._round(number)
        last = [self._loss_order(i, 0) for i in own if len(self.fits[i].loss) <= self.fits[i].booster.rounds]
        for (i, _), found in self._run(last).items():
            self._note_loss(i, np.frombuffer(found))
        for i in own:
            self.fits[i].cut_to_best()

    def judge(self) -> None:
        """Counts of labels against hard labels on the held rows of each shared fit, in one more job."""
        by_part = defaultdict(list)
        for i in self.shared:
            early = self.fits[i].booster.early_stop > 0  # trees behind the best round are gone
            by_part[self.fits[i].part].append(self._order(i, 0, afresh=early))
        by_part, width = dict(by_part), {p: len(c) for p, c in self.cuts.items()}
        fields = "fit int, tn long, fp long, fn long, tp long"

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    rows = _Rows(row, width[row["part"]])
                    out = []
                    for order in by_part.get(row["part"], []):
                        cell = (2 * (rows.label > 0) + (order.margin(rows) > 0))[rows.held]
                        out.append((order.fit, *np.bincount(cell, minlength=4).tolist()))
                    yield _batch(out, fields)

        counted = self.blocks.mapInArrow(count, fields).groupBy("fit").sum("tn", "fp", "fn", "tp")
        for r in counted.collect():
            self.fits[r["fit"]].confusion = tuple(r[1:])


def _histograms(tree: Tree, nodes: list[int], order: _Order, rows: _Rows, g, h, offset: np.ndarray, unit: float) -> np.ndarray:
    """Sums of rounded gradients of the rows that the round draws, per node and code."""
    place = np.full(len(tree.feature), -1)
    place[nodes] = np.arange(len(nodes))
    place = place[kernel.leaf_of(tree, rows.codes)]
    salt = (order.booster.seed << 20) + order.round + 1
    place[rows.held | ~kernel.drawn(rows.key, salt, order.booster.subsample)] = -1
    return kernel.histogram(rows.codes, offset[:-1], int(offset[-1]), place, len(nodes), np.rint(g * unit), np.rint(h * unit))


def train(stack: DataFrame, fits: list[Fit], binary: dict[int, set[int]] | None = None, judge: bool = False) -> Trainer:
    """Fit all of `fits`; the trainer holds the cuts of each part. Rows without label or weight are left out."""
    trainer = Trainer(stack.where("label IS NOT NULL AND weight IS NOT NULL"), fits, binary)
    try:
        trainer.fit(judge)
    finally:
        trainer.close()
    return trainer

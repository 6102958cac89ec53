"""A fit whose part one task can hold: all its rounds in that task.

The same steps as level by level over the blocks of a part: losses and Gram matrices are summed block by
block in the blocks' order, sums of gradients are exact, so the models are the same.
"""

from __future__ import annotations

import numpy as np

from ebbtide.boosting import kernel
from ebbtide.boosting.growth import GrowingTree
from ebbtide.boosting.kernel import Split, Tree
from ebbtide.boosting.params import DROPPING, LINEAR, Booster


def split_of(sums: np.ndarray, offset: np.ndarray, columns: np.ndarray, booster: Booster) -> Split:
    return kernel.best_split(
        sums, offset, columns, booster.reg_lambda, booster.reg_alpha, booster.gamma, booster.min_child_weight
    )


def gram(rows, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Gradient and Gram matrix weighted by h over the rows to learn from, an intercept at the end."""
    own = ~rows.held
    x = np.column_stack([rows.x[own], np.ones(int(own.sum()))])
    return np.concatenate([x.T @ g[own], (x.T @ (x * h[own, None])).ravel()])


def linear_step(fit, found: np.ndarray, mass: float) -> None:
    """One damped step of the linear booster towards the minimum of its quadratic model."""
    width = next(w for w in range(1, len(found) + 1) if w * (w + 1) == len(found))
    w = np.zeros(width) if fit.linear is None else fit.linear
    goal = kernel.elastic_step(
        found[:width], found[width:].reshape(width, width), w, fit.booster.reg_alpha * mass, fit.booster.reg_lambda * mass
    )
    fit.linear = w + fit.booster.eta * (goal - w)
    fit.linears.append(fit.linear)


def add_tree(fit, dropped: list[int], tree: Tree, gains: list[float], covers: list[float]) -> None:
    """The round's tree, and the factors that it leaves to the dropped ones."""
    weight, factor = fit.booster.rescaled(len(dropped))
    fit.weights = [w * factor if t in dropped else w for t, w in enumerate(fit.weights)] + [weight]
    fit.trees.append(tree)
    fit.gains.append(gains)
    fit.covers.append(covers)


class Whole:
    """The blocks of a part, in their order, and the sums of weights of learning and of held rows."""

    def __init__(self, blocks: list, offset: np.ndarray, unit: float, totals: tuple[float, float]):
        self.blocks, self.offset, self.unit, self.totals = blocks, offset, unit, totals
        joined = lambda name: np.concatenate([getattr(b, name) for b in blocks])
        self.codes, self.held, self.key = joined("codes"), joined("held"), joined("key")
        self.label, self.weight = joined("label"), joined("weight")
        self.ends = np.cumsum([b.n for b in blocks])[:-1]
        for block in blocks:
            block.codes = None  # they are in memory once

    def fit(self, fit, judge: bool) -> None:
        """All rounds of a fit, and with `judge` its counts on the held rows."""
        margin = self._linear(fit) if fit.booster.kind == LINEAR else self._trees(fit)
        if len(fit.loss) <= fit.booster.rounds:
            self._note_loss(fit, margin)
        fit.cut_to_best()
        if judge:
            if fit.booster.early_stop:  # what was learned behind the best round is gone
                margin = self._margin_of(fit)
            cell = (2 * (self.label > 0) + (margin > 0))[self.held]
            fit.confusion = tuple(np.bincount(cell, minlength=4).tolist())

    def _note_loss(self, fit, margin: np.ndarray) -> None:
        both = np.zeros(2)
        for block, own in zip(self.blocks, np.split(margin, self.ends)):
            both += [kernel.losses(own[m], block.label[m], block.weight[m]) for m in (~block.held, block.held)]
        fit.loss.append(tuple(float(v / t) if t else 0.0 for v, t in zip(both, self.totals)))

    def _margin_of(self, fit) -> np.ndarray:
        if fit.booster.kind == LINEAR:
            w = fit.linear
            return np.concatenate([np.zeros(b.n) if w is None else b.x @ w[:-1] + w[-1] for b in self.blocks])
        out = np.zeros(len(self.codes))
        for tree, weight in zip(fit.trees, fit.weights):
            out += weight * tree.value[kernel.leaf_of(tree, self.codes)]
        return out

    def _linear(self, fit) -> np.ndarray:
        for _ in range(fit.booster.rounds):
            if fit.stopped():
                break
            margin = self._margin_of(fit)
            self._note_loss(fit, margin)
            found = None
            for block, own in zip(self.blocks, np.split(margin, self.ends)):
                sums = gram(block, *kernel.gradients(own, block.label, block.weight))
                found = sums if found is None else found + sums
            linear_step(fit, found, self.totals[0])
        return self._margin_of(fit)

    def _trees(self, fit) -> np.ndarray:
        margin = np.zeros(len(self.codes))
        leaves: list[np.ndarray] = []

        def without(dropped: list[int]) -> np.ndarray:
            out = np.zeros(len(self.codes))
            for t, (tree, weight, own) in enumerate(zip(fit.trees, fit.weights, leaves)):
                if weight and t not in dropped:
                    out += weight * tree.value[own]
            return out

        for number in range(fit.booster.rounds):
            if fit.stopped():
                break
            dropped = fit.booster.dropped(number, fit.weights)
            self._note_loss(fit, margin)
            tree, *measures = self._grown(fit.booster, number, without(dropped) if dropped else margin)
            add_tree(fit, dropped, tree, *measures)
            own = kernel.leaf_of(tree, self.codes)
            if fit.booster.kind == DROPPING:
                leaves.append(own.astype(np.uint16 if len(tree.feature) <= 1 << 16 else np.uint32))
            margin = without([]) if dropped else margin + fit.weights[-1] * tree.value[own]
        return margin

    def _grown(self, booster: Booster, number: int, margin: np.ndarray) -> tuple[Tree, list[float], list[float]]:
        """One tree; only rows and features that the round draws are looked at."""
        g, h = kernel.gradients(margin, self.label, self.weight)
        salt = (booster.seed << 20) + number + 1
        used = np.flatnonzero(~self.held & kernel.drawn(self.key, salt, booster.subsample))
        columns = booster.columns(number, len(self.offset) - 1)
        near = np.array(sorted({0, *columns}))  # sums of the first feature give those of a node
        codes = self.codes[np.ix_(used, near)]
        offset = np.concatenate([[0], np.diff(self.offset)[near].cumsum()])
        tried = np.flatnonzero(np.isin(near, columns))
        g, h = np.rint(g[used] * self.unit), np.rint(h[used] * self.unit)
        growing, node = GrowingTree(booster), np.zeros(len(used), np.int64)
        while wanted := growing.wanted():
            tree = growing.on_trial()
            node = kernel.descend(tree, self.codes, used, node)
            place = np.full(len(tree.feature), -1)
            place[wanted] = np.arange(len(wanted))
            for i, sums in zip(wanted, kernel.histogram(codes, offset[:-1], int(offset[-1]), place[node], len(wanted), g, h)):
                split = split_of(sums / self.unit, offset, tried, booster)
                growing.learn(i, split._replace(feature=int(near[split.feature])) if split.feature >= 0 else split)
        return growing.finished(), *growing.measures()

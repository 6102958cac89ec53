"""What tasks compute for a forest: draws, splits, and whole trees below a node whose rows are at hand.

Every draw is a hash of the seed, the tree and the way from the root, and weights are rounded so that
their sums are exact in doubles. A tree thus depends neither on partitions nor on the node at which its
rows were handed to one task.
"""

from __future__ import annotations

import math
from array import array
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np

#: Rows up to which a node's features are looked at together.
TOGETHER_ROWS = 1 << 14
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Forest:
    """`features` a node are drawn, the square root of their number by default; `max_depth` 0 is none."""

    trees: int = 100
    features: int = 0
    bootstrap: bool = True
    min_rows: int = 2
    max_depth: int = 0
    seed: int = 42

    def drawn(self, width: int) -> int:
        return min(width, self.features or max(1, math.isqrt(width)))


class Grown(NamedTuple):
    """Nodes as arrays; a leaf has feature -1. Values up to `threshold` go left, missing ones always.

    `value` is the share of class 1 among the weights, whose sum is `cover`, and `gain` the weighted loss
    of Gini impurity.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray
    depth: int


#: Types of a tree's arrays.
KINDS = (np.int32, float, np.int32, np.int32, float, float, float)


def mix(values) -> np.ndarray:
    """A hash of 64-bit numbers."""
    with np.errstate(over="ignore"):
        h = np.asarray(values, np.uint64) + _GOLDEN
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def root_name(seed: int, tree: int) -> int:
    return int(mix(mix(np.uint64(seed % 2**64)) ^ np.uint64(tree)))


def child_name(name: int, right: bool) -> int:
    """The name of a node says how it is reached; features are drawn by it."""
    return int(mix(np.uint64(name) ^ np.uint64(1 + right)))


def feature_order(name: int, width: int) -> np.ndarray:
    """The features in the order in which a node tries them."""
    return np.argsort(mix(np.uint64(name) ^ mix(np.arange(width))), kind="stable")


def times_drawn(forest: Forest, tree: int, keys: np.ndarray) -> np.ndarray:
    """How often each row is in the tree's sample: a Poisson variable of mean one by the row's key."""
    if not forest.bootstrap:
        return np.ones(len(keys), np.int64)
    u = mix(mix(keys) ^ np.uint64(root_name(forest.seed, tree))).astype(float) / 2.0**64
    upto = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
    return np.searchsorted(upto, u, side="right")


def gini_gain(left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Weighted loss of impurity for left sums (..., 2) of the weights of two classes."""
    right = total - left

    def purity(w):
        n = w.sum(axis=-1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(n > 0, (w * w).sum(axis=-1) / n, 0.0)

    return purity(left) + purity(right) - purity(total)


def _best(x: np.ndarray, rows: np.ndarray, tried: np.ndarray, weights: np.ndarray, total: np.ndarray) -> tuple[float, int, float] | None:
    """(gain, column, threshold) of the best split of rows by one of the columns tried; the first of equals.
    Of many rows one column is looked at after the other, as each takes several times its size."""
    if len(rows) <= TOGETHER_ROWS:
        return _best_of(x[np.ix_(rows, tried)], weights, total)
    best = None
    for at, column in enumerate(tried):
        found = _best_of(x[rows, column][:, None], weights, total)
        if found and (best is None or found[0] > best[0]):
            best = (found[0], at, found[2])
    return best


def _best_of(values: np.ndarray, weights: np.ndarray, total: np.ndarray) -> tuple[float, int, float] | None:
    order = np.argsort(values, axis=0, kind="stable")
    ranked = np.take_along_axis(values, order, axis=0)
    ends = ranked[1:] != ranked[:-1]
    if not ends.any():
        return None
    upto = np.cumsum(weights[order], axis=0)[:-1]
    gains = np.where(ends, gini_gain(upto, total), -np.inf)
    column, at = divmod(int(np.argmax(gains.T)), len(gains))
    low, high = ranked[at, column], ranked[at + 1, column]
    middle = low + (high - low) / 2 if np.isfinite(low) else low
    return float(gains[at, column]), column, float(middle if middle < high else low)


def grow(forest: Forest, name: int, depth: int, x: np.ndarray, weights: np.ndarray) -> Grown:
    """The tree below a node, down to pure leaves. `weights` has a column a class."""
    width = x.shape[1]
    most = forest.drawn(width)
    nodes = [array(kind) for kind in "idiiddd"]  # numbers, not objects: there may be a node a row
    deepest = 0
    waiting = [(name, depth, np.arange(len(x)), -1, 0)]
    while waiting:
        own, level, rows, parent, side = waiting.pop()
        number = len(nodes[0])
        if parent >= 0:
            nodes[side][parent] = number
        w = weights[rows]
        total = w.sum(axis=0)
        share = total[1] / total.sum() if total.sum() > 0 else 0.0
        for column, value in zip(nodes, (-1, 0.0, 0, 0, share, 0.0, total.sum())):
            column.append(value)
        deepest = max(deepest, level - depth)
        if len(rows) < forest.min_rows or not total.all() or level == forest.max_depth > 0:
            continue
        order = feature_order(own, width)
        for start in range(0, width, most):
            tried = order[start : start + most]
            found = _best(x, rows, tried, w, total)
            if found:
                break
        else:
            continue
        gain, column, threshold = found
        nodes[0][number], nodes[1][number], nodes[5][number] = int(tried[column]), threshold, gain
        left = x[rows, tried[column]] <= threshold
        waiting.append((child_name(own, True), level + 1, rows[~left], number, 3))
        waiting.append((child_name(own, False), level + 1, rows[left], number, 2))
    return Grown(*[np.array(c, k) for c, k in zip(nodes, KINDS)], deepest)


def leaf_of(tree: Grown, x: np.ndarray) -> np.ndarray:
    """The leaf that each row comes to; rows that have arrived are not looked at again."""
    node = np.zeros(len(x), np.int64)
    moving = np.arange(len(x)) if tree.feature[0] >= 0 else np.zeros(0, np.int64)
    while len(moving):
        at = node[moving]
        left = x[moving, tree.feature[at]] <= tree.threshold[at]
        node[moving] = np.where(left, tree.left[at], tree.right[at])
        moving = moving[tree.feature[node[moving]] >= 0]
    return node

"""What tasks compute on a block of rows: margins, gradients, histograms; and splits from histograms.

Rows are coded: 0 for a missing value, else one more than the number of cuts below the value. Gradients
are rounded to multiples of a power of two small enough that their sums are exact in doubles, so a
model depends neither on the partitions of the rows nor on the order in which tasks end.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Rows whose cells are counted at once.
CHUNK_ROWS = 1 << 15


class Tree(NamedTuple):
    """Nodes as arrays; a leaf has feature -1. Codes up to `code` go left, missing ones if it says so."""

    feature: np.ndarray
    code: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int


def leaf_of(tree: Tree, codes: np.ndarray) -> np.ndarray:
    """The node without children that each row comes to."""
    nodes, ends = np.arange(len(tree.feature)), tree.feature < 0
    column = np.where(ends, 0, tree.feature)
    # where a node's rows go, right and then left; a leaf keeps its rows
    child = np.concatenate([np.where(ends, nodes, tree.right), np.where(ends, nodes, tree.left)])
    flat, start = codes.ravel(), np.arange(len(codes)) * codes.shape[1]
    node = np.zeros(len(codes), np.int64)
    for _ in range(tree.depth):
        code = flat.take(start + column.take(node))
        left, missing = code <= tree.code.take(node), code == 0
        if missing.any():
            left = np.where(missing, tree.missing_left.take(node), left)
        node = child.take(node + len(nodes) * left)
    return node


def descend(tree: Tree, codes: np.ndarray, rows: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The node without children that each of `rows` comes to from the `node` it has reached."""
    moving, node = np.arange(len(rows)), node.copy()
    while len(moving := moving[tree.feature[node[moving]] >= 0]):
        at = node[moving]
        code = codes[rows[moving], tree.feature[at]]
        left = np.where(code == 0, tree.missing_left[at], code <= tree.code[at])
        node[moving] = np.where(left, tree.left[at], tree.right[at])
    return node


def code_rows(x: np.ndarray, cuts: list[np.ndarray], kind=np.uint16) -> np.ndarray:
    codes = np.empty(x.shape, kind)
    for i, own in enumerate(cuts):
        codes[:, i] = np.where(np.isnan(x[:, i]), 0, 1 + np.searchsorted(own, x[:, i], side="left"))
    return codes


def drawn(keys: np.ndarray, salt: int, share: float) -> np.ndarray:
    """Rows taken into a sample: a hash of their key and the salt is below the share."""
    if share >= 1:
        return np.ones(len(keys), bool)
    with np.errstate(over="ignore"):
        h = keys + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h = (h ^ (h >> np.uint64(31))) & _MASK
    return h < np.uint64(min(int(share * 2.0**64), 2**64 - 1))


def gradients(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the weighted logistic loss."""
    p = 1 / (1 + np.exp(-margin))
    return weight * (p - label), weight * p * (1 - p)


def losses(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    return float((weight * np.logaddexp(0, np.where(label > 0, -margin, margin))).sum())


def histogram(
    codes: np.ndarray, offsets: np.ndarray, width: int, place: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray
) -> np.ndarray:
    """(nodes, 2, width): sums of g and h per node and code; `place` is a row's node, or -1."""
    each, sums = codes.shape[1], np.zeros((2, nodes * width))
    for at in range(0, len(codes), CHUNK_ROWS):  # g and h are whole numbers, so their sums are exact
        rows = slice(at, at + CHUNK_ROWS)
        used = place[rows] >= 0
        cells = (place[rows][used, None] * width + offsets + codes[rows][used]).ravel()
        for total, v in zip(sums, (g, h)):
            total += np.bincount(cells, np.repeat(v[rows][used], each), nodes * width)
    return sums.reshape(2, nodes, width).swapaxes(0, 1)


class Split(NamedTuple):
    """The best split of a node, and its sums; feature -1 where none gains."""

    feature: int
    code: int
    missing_left: bool
    gain: float
    g: float
    h: float
    left_g: float
    left_h: float


def soft(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def _soft1(g: float, alpha: float) -> float:
    return g - alpha if g > alpha else g + alpha if g < -alpha else 0.0


def leaf_value(g: float, h: float, reg_lambda: float, reg_alpha: float) -> float:
    """The Newton step of a leaf."""
    return float(-soft(g, reg_alpha) / (h + reg_lambda)) if h + reg_lambda > 0 else 0.0


def best_split(
    sums: np.ndarray, offsets: np.ndarray, columns: np.ndarray, reg_lambda: float, reg_alpha: float, gamma: float, least: float
) -> Split:
    """Best split of one node by its histogram (2, width); `offsets` has the width behind the last one.

    Of equal gains the first feature, then the lowest code wins; missing values go right where both
    sides are as good.
    """
    g, h = float(sums[0, : offsets[1]].sum()), float(sums[1, : offsets[1]].sum())
    upto = np.cumsum(sums, axis=1)
    sizes = np.diff(offsets)
    start = np.repeat(offsets[:-1], sizes)
    present = upto - upto[:, start]  # a feature's first cell is that of missing values
    missing = sums[:, start]

    def score(g, h):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(h + reg_lambda > 0, soft(g, reg_alpha) ** 2 / (h + reg_lambda), 0)

    allowed = np.zeros(len(sizes), bool)
    allowed[columns] = True
    allowed = np.repeat(allowed, sizes)
    allowed[offsets[:-1]] = False
    gains = []
    for left in (present, present + missing):
        right_g, right_h = g - left[0], h - left[1]
        enough = allowed & (left[1] > 0) & (right_h > 0) & (left[1] >= least) & (right_h >= least)
        gain = (score(*left) + score(right_g, right_h) - score(g, h)) / 2 - gamma
        gains.append(np.where(enough, gain, -np.inf))
    cell = int(np.argmax(np.maximum(*gains)))
    missing_left = bool(gains[1][cell] > gains[0][cell])
    gain = float(gains[missing_left][cell])
    if not gain > 0:
        return Split(-1, 0, False, 0.0, g, h, 0.0, 0.0)
    feature = int(np.searchsorted(offsets, cell, side="right") - 1)
    left = present[:, cell] + (missing[:, cell] if missing_left else 0)
    return Split(feature, cell - int(offsets[feature]), missing_left, gain, g, h, float(left[0]), float(left[1]))


def elastic_step(
    gradient: np.ndarray, gram: np.ndarray, w: np.ndarray, l1: float, l2: float, sweeps: int = 5
) -> np.ndarray:
    """Towards the minimum of the loss's quadratic model around `w` with both penalties, by sweeps of
    cyclic coordinate descent with soft thresholds. The last coordinate is the intercept, which is not
    penalised. The model changes with each round, so a few sweeps a round are enough."""
    new, slope = w.copy(), gradient.copy()
    last = len(w) - 1
    for _ in range(sweeps):
        for j in range(len(w)):
            curve = gram[j, j]
            if j == last:
                goal = new[j] - slope[j] / curve if curve > 0 else new[j]
            elif curve + l2 > 0:
                goal = _soft1(curve * new[j] - slope[j], l1) / (curve + l2)
            else:
                goal = 0.0
            step = goal - new[j]
            if step:
                slope += gram[:, j] * step
                new[j] = goal
    return new

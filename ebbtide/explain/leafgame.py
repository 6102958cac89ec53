"""Shapley values of single leaves; the only Python that runs inside tasks.

The value of a set of features is the expectation over the tree when the other features are
left to the training shares (path-dependent tree SHAP). Each leaf is a game of its own: a
product over the features of its path. The weights of coalitions are Beta integrals, so the
sum over coalitions is the integral of a polynomial of degree d - 1, which Gauss-Legendre
quadrature with d / 2 points gives exactly.
"""

from __future__ import annotations

import numpy as np

TABLE_DEPTH = 8  # paths of up to this many features are looked up in a table of all patterns


def contributions(satisfied: np.ndarray, cover: np.ndarray, value: float) -> np.ndarray:
    """Shapley values (rows x features) of a leaf for 0/1 patterns of satisfied tests."""
    depth = len(cover)
    points, weights = np.polynomial.legendre.leggauss((depth + 1) // 2)
    t, w = (points + 1) / 2, weights / 2
    o = satisfied.astype(float)
    factors = o[:, :, None] * t + cover[None, :, None] * (1 - t)
    before = np.ones_like(factors)
    after = np.ones_like(factors)
    for i in range(1, depth):
        before[:, i] = before[:, i - 1] * factors[:, i - 1]
        after[:, -i - 1] = after[:, -i] * factors[:, -i]
    others = ((before * after) * w).sum(axis=2)
    return value * (o - cover) * others


def patterns(codes: np.ndarray, depth: int) -> np.ndarray:
    return (codes[:, None] >> np.arange(depth)) & 1


def prepare(features, low, high, cover, value: float, missing=()) -> tuple:
    """Arrays of a leaf, with the table of all patterns if its path is short. `missing` tells which
    tests let missing values through; none of them if it is empty."""
    cover = np.array(cover, dtype=float)
    depth = len(cover)
    table = None
    if 0 < depth <= TABLE_DEPTH:
        table = contributions(patterns(np.arange(2**depth), depth), cover, value)
    takes = np.array(missing or [False] * depth, dtype=bool)
    return np.array(features, dtype=int), np.array(low), np.array(high), takes, cover, value, table


def explain_rows(rows: np.ndarray, leaves: list[tuple]) -> np.ndarray:
    """Shapley values (rows x features) summed over all leaves."""
    out = np.zeros_like(rows)
    for features, low, high, takes, cover, value, table in leaves:
        depth = len(features)
        if depth == 0:
            continue
        x = rows[:, features]
        codes = ((x > low) & (x <= high) | np.isnan(x) & takes) @ (1 << np.arange(depth, dtype=np.int64))
        if table is not None:
            out[:, features] += table[codes]
        else:
            distinct, position = np.unique(codes, return_inverse=True)
            values = contributions(patterns(distinct, depth), cover, value)
            out[:, features] += values[position]
    return out

"""Leaves of a fitted tree model as arrays, read from the model's saved node table."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ebbtide.boosting.model import BoostedModel
from ebbtide.forest.model import ForestModel, read_trees
from ebbtide.session import shared_dir


@dataclass(frozen=True)
class Leaf:
    """A leaf and the distinct features tested on its path.

    A row satisfies feature `i` if `low[i] < x <= high[i]`, or if x is missing and `missing[i]`.
    `cover[i]` is the share of training rows (of their Hessians, where the model sums these) that the
    tests of this feature let through.
    """

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    cover: tuple[float, ...]
    missing: tuple[bool, ...] = ()


def node_table(spark: SparkSession, model) -> DataFrame:
    """(treeID, id, prediction, impurityStats, rawCount, leftChild, rightChild, split)."""
    path = shared_dir(spark, "tree-model")
    model.write().save(path)
    return spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")


def _goes_left(split) -> tuple[float, float, float, float]:
    """(low, high) of the left child, then of the right child."""
    values = split["leftCategoriesOrThreshold"]
    if split["numCategories"] == -1:
        return -math.inf, values[0], values[0], math.inf
    if split["numCategories"] != 2:
        raise ValueError("only continuous and 0/1 features can be explained")
    if values == [0.0]:
        return -math.inf, 0.5, 0.5, math.inf
    return 0.5, math.inf, -math.inf, 0.5


def _boosted_leaves(model: BoostedModel) -> list[Leaf]:
    """Leaves of a second-order booster, from its arrays."""
    cuts = [np.append(c, math.inf) for c in model.cuts]
    found: list[Leaf] = []
    for (tree, weight), cover in zip(model.trees, model.covers):
        stack = [(0, {})]
        while stack:
            node, tests = stack.pop()
            feature = int(tree.feature[node])
            if feature < 0:
                order = sorted(tests)
                columns = zip(*[tests[f] for f in order]) if order else [()] * 4
                low, high, share, missing = map(tuple, columns)
                found.append(Leaf(weight * float(tree.value[node]), tuple(order), low, high, share, missing))
                continue
            threshold = float(cuts[feature][tree.code[node] - 1])
            low, high, share, missing = tests.get(feature, (-math.inf, math.inf, 1.0, True))
            for child, is_left in ((int(tree.left[node]), True), (int(tree.right[node]), False)):
                bounds = (low, min(high, threshold)) if is_left else (max(low, threshold), high)
                takes = missing and bool(tree.missing_left[node]) == is_left
                own = share * float(cover[child] / cover[node])
                stack.append((child, {**tests, feature: (*bounds, own, takes)}))
    return found


def _forest_leaves(model: ForestModel) -> list[Leaf]:
    """Leaves of an unlimited forest; below a top the paths go on in the tree that hangs there."""
    trees = read_trees(model.trees)
    found: list[Leaf] = []
    for own in trees.values():
        stack = [(-1, 0, {})]
        while stack:
            part, node, tests = stack.pop()
            if part == -1 and node in own and own[-1].feature[node] < 0:
                part, node = node, 0
            tree = own[part]
            feature = int(tree.feature[node])
            if feature < 0:
                order = sorted(tests)
                columns = zip(*[tests[f] for f in order]) if order else [()] * 4
                found.append(Leaf(float(tree.value[node]) / len(trees), tuple(order), *map(tuple, columns)))
                continue
            low, high, share, missing = tests.get(feature, (-math.inf, math.inf, 1.0, True))
            threshold = float(tree.threshold[node])
            for child, is_left in ((int(tree.left[node]), True), (int(tree.right[node]), False)):
                bounds = (low, min(high, threshold)) if is_left else (max(low, threshold), high)
                own_share = share * float(tree.cover[child] / tree.cover[node])
                stack.append((part, child, {**tests, feature: (*bounds, own_share, missing and is_left)}))
    return found


def leaves(spark: SparkSession, model) -> list[Leaf]:
    """All leaves of a boosted or bagged model; as large as the model the driver holds.

    Boosting: leaf values are weighted predictions and add up to the margin. Forest: they
    are shares of class 1 over the number of trees and add up to the probability.
    """
    if isinstance(model, BoostedModel):
        return _boosted_leaves(model)
    if isinstance(model, ForestModel):
        return _forest_leaves(model)
    weights = list(model.treeWeights)
    is_forest = "RandomForest" in type(model).__name__
    trees: dict[int, dict[int, object]] = {}
    for node in node_table(spark, model).collect():
        trees.setdefault(node["treeID"], {})[node["id"]] = node
    found: list[Leaf] = []
    for tree_id, nodes in trees.items():

        def leaf_value(node) -> float:
            if is_forest:
                stats = node["impurityStats"]
                return stats[1] / sum(stats) / len(trees)
            return weights[tree_id] * node["prediction"]

        stack = [(nodes[0], {})]
        while stack:
            node, tests = stack.pop()
            if node["leftChild"] < 0:
                order = sorted(tests)
                found.append(
                    Leaf(
                        leaf_value(node),
                        tuple(order),
                        tuple(tests[f][0] for f in order),
                        tuple(tests[f][1] for f in order),
                        tuple(tests[f][2] for f in order),
                    )
                )
                continue
            feature = node["split"]["featureIndex"]
            bounds = _goes_left(node["split"])
            children = (nodes[node["leftChild"]], nodes[node["rightChild"]])
            for child, (low, high) in zip(children, (bounds[:2], bounds[2:])):
                old_low, old_high, old_cover = tests.get(feature, (-math.inf, math.inf, 1.0))
                share = child["rawCount"] / node["rawCount"]
                narrowed = (max(low, old_low), min(high, old_high), old_cover * share)
                stack.append((child, {**tests, feature: narrowed}))
    return found

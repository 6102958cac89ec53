"""The tree that a round grows, level by level or leaf by leaf, as the driver sees it."""

from __future__ import annotations

import heapq

import numpy as np

from ebbtide.boosting.kernel import Split, Tree, leaf_value
from ebbtide.boosting.params import LEVEL_WISE, Booster


class _Node:
    def __init__(self, depth: int, g: float = 0.0, h: float = 0.0):
        self.depth, self.g, self.h = depth, g, h
        self.split: Split | None = None
        self.children: tuple[int, int] | None = None


class GrowingTree:
    """Nodes with the best split of each whose histogram is known.

    Best-first growth opens the leaf of greatest gain next, so which leaves are opened depends on the
    gains of children not yet seen. `wanted` therefore opens on trial all leaves that can still come to
    their turn, and asks for their children in one job; `finished` keeps what best-first takes. A tree
    thus needs as many jobs as it is deep, however many leaves it has.
    """

    def __init__(self, booster: Booster):
        self.booster = booster
        self.nodes = [_Node(0)]

    def _splits(self, i: int) -> bool:
        node = self.nodes[i]
        return node.split is not None and node.split.feature >= 0

    def _known(self, i: int) -> bool:
        """Whether it is known if and how the node splits; at the greatest depth it does not."""
        node = self.nodes[i]
        return node.split is not None or node.depth == self.booster.max_depth > 0

    def _taken(self) -> tuple[list[int], list[int]]:
        """Nodes split in the order of growth, and those among them whose children are not known."""
        def turn(i: int):
            node = self.nodes[i]
            return (node.depth, i) if self.booster.growth == LEVEL_WISE else (-node.split.gain, i)

        taken, unknown = [], []
        heap = [(turn(0), 0)] if self._splits(0) else []
        while heap and (not self.booster.max_leaves or len(taken) + 1 < self.booster.max_leaves):
            _, i = heapq.heappop(heap)
            taken.append(i)
            children = self.nodes[i].children
            if children is None or not all(map(self._known, children)):
                unknown.append(i)
                continue
            for child in children:
                if self._splits(child):
                    heapq.heappush(heap, (turn(child), child))
        return taken, unknown

    def wanted(self) -> list[int]:
        """Nodes whose histograms are asked for next; none if the tree is grown."""
        if self.nodes[0].split is None:
            return [0]
        out = []
        while True:
            _, unknown = self._taken()
            fresh = [i for i in unknown if self.nodes[i].children is None]
            for i in fresh:
                self._open(i)
            # children at the greatest depth are known at once, and others may come to their turn
            if not fresh:
                return [c for i in unknown for c in self.nodes[i].children if not self._known(c)]

    def _open(self, i: int) -> None:
        node = self.nodes[i]
        s = node.split
        node.children = len(self.nodes), len(self.nodes) + 1
        self.nodes.append(_Node(node.depth + 1, s.left_g, s.left_h))
        self.nodes.append(_Node(node.depth + 1, s.g - s.left_g, s.h - s.left_h))

    def learn(self, i: int, split: Split) -> None:
        self.nodes[i].split, self.nodes[i].g, self.nodes[i].h = split, split.g, split.h

    def on_trial(self) -> Tree:
        """All nodes there are, to find the rows of each."""
        return self._tree({i for i, n in enumerate(self.nodes) if n.children})

    def finished(self) -> Tree:
        return self._tree(set(self._taken()[0]))

    def _tree(self, split: set[int]) -> Tree:
        n = len(self.nodes)
        feature, code, missing = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool)
        left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        value = np.array([leaf_value(m.g, m.h, self.booster.reg_lambda, self.booster.reg_alpha) for m in self.nodes])
        for i in split:
            s = self.nodes[i].split
            feature[i], code[i], missing[i] = s.feature, s.code, s.missing_left
            left[i], right[i] = self.nodes[i].children
        depth = max((self.nodes[i].depth + 1 for i in split), default=0)
        return Tree(feature, code, missing, left, right, value, depth)

    def measures(self) -> tuple[list[float], list[float]]:
        """Gain and sum of Hessians of each node."""
        return [n.split.gain if n.split else 0.0 for n in self.nodes], [n.h for n in self.nodes]

"""Parameters of one booster."""

from __future__ import annotations

import random
from dataclasses import dataclass

TREES, DROPPING, LINEAR = "trees", "dropping", "linear"
LEVEL_WISE, LEAF_WISE = "level", "leaf"


@dataclass(frozen=True)
class Booster:
    """`kind`: trees; trees of which some are dropped while the next is learned; or a linear model.

    Trees: a split gains (s(left) + s(right) - s(both)) / 2 - gamma with s = T(G)^2 / (H + reg_lambda),
    G and H being sums of gradients and Hessians and T the soft threshold at reg_alpha; both sides need
    min_child_weight of H. `growth` opens leaves level by level or by gain; `max_leaves` 0 and
    `max_depth` 0 set no limit. `early_stop` rounds without a better loss on held-out rows end a fit.
    Linear: the penalties hold for the mean loss.
    """

    kind: str = TREES
    rounds: int = 100
    eta: float = 0.3
    max_depth: int = 6
    max_leaves: int = 0
    growth: str = LEVEL_WISE
    min_child_weight: float = 1.0
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    gamma: float = 0.0
    subsample: float = 1.0
    colsample: float = 1.0
    rate_drop: float = 0.0
    skip_drop: float = 0.0
    drop_by_weight: bool = False
    normalise_forest: bool = False
    early_stop: int = 0
    seed: int = 42

    def draw(self, purpose: str, number: int) -> random.Random:
        """A generator of its own for each purpose and round, whatever else is fitted beside it."""
        return random.Random(f"{purpose}:{self.seed}:{number}")

    def columns(self, number: int, width: int) -> list[int]:
        """The features that tree `number` may split on."""
        if self.colsample >= 1:
            return list(range(width))
        return sorted(self.draw("columns", number).sample(range(width), max(1, round(self.colsample * width))))

    def dropped(self, number: int, weights: list[float]) -> list[int]:
        """Trees left out while tree `number` is learned."""
        if self.kind != DROPPING or not weights:
            return []
        draw = self.draw("drop", number)
        if draw.random() < self.skip_drop:
            return []
        if self.drop_by_weight:
            mean = sum(weights) / len(weights)
            odds = [self.rate_drop * w / mean for w in weights]
        else:
            odds = [self.rate_drop] * len(weights)
        return [i for i, p in enumerate(odds) if draw.random() < p]

    def rescaled(self, dropped: int) -> tuple[float, float]:
        """Weight of the new tree, and the factor on each of the dropped ones."""
        if not dropped:
            return self.eta, 1.0
        if self.normalise_forest:
            return self.eta / (1 + self.eta), 1 / (1 + self.eta)
        return self.eta / (dropped + self.eta), dropped / (dropped + self.eta)

"""Shapley values: against the definition, and additive on fitted models."""

import itertools
import math

import numpy as np
import pytest

from ebbtide.explain import leafgame, shapley, views
from ebbtide.models.recipes import RECIPES, fit_recipe
from ebbtide.models.storage import split_model
from ebbtide.schema import USER


def by_definition(o, r, value):
    d = len(r)

    def game(s):
        return value * math.prod(o[i] if i in s else r[i] for i in range(d))

    phi = []
    for j in range(d):
        others = [i for i in range(d) if i != j]
        total = 0.0
        for k in range(d):
            weight = math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)
            for s in itertools.combinations(others, k):
                total += weight * (game({*s, j}) - game(set(s)))
        phi.append(total)
    return phi


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 9, 10])
def test_leaf_values_follow_the_definition(depth):
    rng = np.random.default_rng(depth)
    cover = rng.random(depth)
    pattern = rng.integers(0, 2, (3, depth))
    got = leafgame.contributions(pattern, cover, 1.7)
    for row, o in zip(got, pattern):
        assert row == pytest.approx(by_definition(o, cover, 1.7), abs=1e-12)


def test_long_paths_without_table_equal_short_ones_with_it(monkeypatch):
    rng = np.random.default_rng(0)
    leaf = ([0, 1, 2], [-1.0, 0.0, -np.inf], [0.5, 1.0, 0.2], [0.3, 0.6, 0.5], 2.0)
    rows = rng.normal(size=(20, 3))
    with_table = leafgame.explain_rows(rows, [leafgame.prepare(*leaf)])
    monkeypatch.setattr(leafgame, "TABLE_DEPTH", 0)
    assert leafgame.explain_rows(rows, [leafgame.prepare(*leaf)]) == pytest.approx(with_table)


@pytest.fixture(scope="module")
def boosted(train):
    return fit_recipe(RECIPES["boosting_full"].with_params(maxIter=4, maxDepth=4), train)


def test_boosting_values_add_up_to_the_margin(train, boosted):
    shap = {r[USER]: sum(r["shap"]) + r["base"] for r in shapley.tree_shap(boosted, train).collect()}
    margins = {r[USER]: r["rawPrediction"][1] for r in boosted.transform(train).collect()}
    assert shap == pytest.approx(margins)


def test_deep_forest_values_add_up_to_the_probability(train):
    forest = fit_recipe(RECIPES["forest_full"].with_params(numTrees=4, maxDepth=14), train)
    shap = {r[USER]: sum(r["shap"]) + r["base"] for r in shapley.tree_shap(forest, train).collect()}
    p = {r[USER]: r["probability"][1] for r in forest.transform(train).collect()}
    assert shap == pytest.approx(p)


def test_linear_values_add_up_to_the_margin(train):
    model = fit_recipe("logreg_full", train)
    rows = shapley.linear_shap(model, train, train).collect()
    margins = {r[USER]: r["rawPrediction"][1] for r in model.transform(train).collect()}
    assert {r[USER]: sum(r["shap"]) + r["base"] for r in rows} == pytest.approx(margins)


def test_views(spark, train, boosted):
    names = shapley.vector_names(boosted, train)
    long = shapley.shap_long(shapley.tree_shap(boosted, train), names).persist()
    n = train.count()
    summary = views.shap_summary(long).collect()
    assert {r["feature"] for r in summary} == set(names) and all(r["n"] == n for r in summary)
    bins = views.shap_distribution(long, 10).collect()
    assert sum(r["cnt"] for r in bins) == n * len(names)
    user = train.first()[USER]
    rows = sorted(views.shap_one_row(long.where(f"{USER} = '{user}'")).collect(), key=lambda r: r["rank"])
    margin = boosted.transform(train.where(f"{USER} = '{user}'")).first()["rawPrediction"][1]
    assert rows[-1]["running"] == pytest.approx(margin)
    assert [abs(r["shap"]) for r in rows] == sorted((abs(r["shap"]) for r in rows), reverse=True)
    long.unpersist()


def test_importance_and_observations(train, boosted):
    top = views.feature_importance(boosted, train).collect()
    values = split_model(boosted)[1].featureImportances.toArray()
    assert [r["importance"] for r in top] == pytest.approx(sorted(values, reverse=True)[:10])
    table = views.observations_table(boosted, train)
    assert table.columns[1] == "cnt_user_engagement" and table.count() == train.count()

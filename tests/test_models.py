"""Recipes, scores, tuning and the scoring stream."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from ebbtide.boosting.params import DROPPING, LINEAR, TREES
from ebbtide.evaluation.confusion import roc_auc_hard
from ebbtide.evaluation.curves import roc_auc
from ebbtide.models import recipes, scoring, storage
from ebbtide.models.recipes import RECIPES, booster_of, fit_recipe
from ebbtide.operators.splitting import kfold_assign
from ebbtide.registry import common
from ebbtide.schema import COUNTERS
from ebbtide.streaming.score import arriving_users, score_stream
from ebbtide.tuning import search
from ebbtide.tuning.space import draws, trial_recipe

SMALL = {"boosting": {"maxIter": 3}, "second_order": {"rounds": 3}, "forest": {"numTrees": 3, "maxDepth": 4}, "network": {"epochs": 8, "hidden": (8,), "learn_rate": 0.05}}


@pytest.fixture(scope="module")
def logreg(train):
    return fit_recipe("logreg_numeric", train)


def test_logistic_regression_minimises_the_penalised_loss(train, logreg):
    """At the solution the gradient of summed weighted loss plus half the squared norm is zero."""
    stages, linear = storage.split_model(logreg)
    rows = stages.transform(train).select(vector_to_array("features"), "churned", "_weight").collect()
    x, y, w = (np.array([r[i] for r in rows], dtype=float) for i in range(3))
    beta, b = linear.coefficients.toArray(), linear.intercept
    p = 1 / (1 + np.exp(-(x @ beta + b)))
    assert x.T @ (w * (p - y)) + beta == pytest.approx(np.zeros(11), abs=1e-2)
    assert (w * (p - y)).sum() == pytest.approx(0, abs=1e-2)


@pytest.mark.parametrize("name", sorted(RECIPES))
def test_every_recipe_learns_and_gives_probabilities(train, name):
    recipe = RECIPES[name].with_params(**SMALL.get(RECIPES[name].family, {}))
    scored = scoring.predict_proba(fit_recipe(recipe, train), train)
    p = np.array([(r["probability_0"], r["probability_1"]) for r in scored.collect()])
    assert len(p) == train.count()
    assert ((p >= 0) & (p <= 1)).all() and p.sum(axis=1) == pytest.approx(np.ones(len(p)))
    assert roc_auc(scored, score="probability_1").first()[0] > 0.6


def test_same_seed_same_model(train):
    recipe = RECIPES["forest_numeric"].with_params(**SMALL["forest"])
    a, b = (scoring.predict_proba(fit_recipe(recipe, train), train).collect() for _ in range(2))
    assert sorted(a) == sorted(b)


def test_saved_model_gives_the_same_scores(train, logreg, tmp_path):
    path = storage.save_model(logreg, f"{tmp_path}/m")
    loaded = storage.load_model(path)
    assert sorted(scoring.predict(loaded, train).collect()) == sorted(scoring.predict(logreg, train).collect())
    assert type(storage.stage_of(loaded, "LogisticRegressionModel")).__name__ == "LogisticRegressionModel"
    with pytest.raises(KeyError):
        storage.stage_of(loaded, "GBTClassificationModel")


def test_threshold_is_strict(train, logreg):
    rows = scoring.predict_threshold(logreg, train, 0.7).collect()
    assert all(r["churned_by_threshold"] == (r["probability"] > 0.7) for r in rows)


def test_users_without_label_can_be_scored(train, logreg):
    assert "churned" not in scoring.predict(logreg, train.drop("churned")).columns


def test_stream_scores_equal_batch_scores(spark, folder, logreg, tmp_path):
    source = common.users_folder(spark, folder)
    for _ in range(2):  # the second run finds nothing new
        running = score_stream(arriving_users(spark, source, 1), logreg, f"{tmp_path}/o", f"{tmp_path}/c")
        running.awaitTermination()
    streamed = spark.read.parquet(f"{tmp_path}/o").drop("model_version")
    batch = scoring.predict_proba(logreg, common.users(spark, folder))
    assert sorted(streamed.collect(), key=str) == sorted(batch.collect(), key=str)


def test_draws_are_stable_and_conditional():
    assert draws(20, 7) == draws(20, 7) and draws(20, 7) != draws(20, 8)
    kinds = set()
    for trial in draws(50):
        kinds.add(trial["kind"])
        assert ("max_depth" in trial) == ("growth" in trial) == (trial["kind"] != LINEAR)
        assert ("rate_drop" in trial) == ("normalise_forest" in trial) == (trial["kind"] == DROPPING)
        if "max_depth" in trial:
            assert 3 <= trial["max_depth"] <= 7 and 2 <= trial["min_child_weight"] <= 10
        assert all(1e-8 <= trial.get(name, 1) <= 1 for name in ("reg_lambda", "reg_alpha", "eta", "gamma", "rate_drop", "skip_drop"))
        assert 0.2 <= trial["subsample"] <= 1 and 0.2 <= trial["colsample"] <= 1
    assert kinds == {TREES, LINEAR, DROPPING}
    assert trial_recipe(draws(1)[0], 5).weighting == "base_rate"
    assert booster_of(trial_recipe(draws(1)[0], 5)).rounds == 5


def test_search_history_and_time_limit(spark, train):
    trials = search.search(train, trials=2, folds=2, trees=2, timeout=0.0)
    assert len(trials) == 1 and len(trials[0].fold_scores) == 2
    assert trials[0].value == pytest.approx(sum(trials[0].fold_scores) / 2)
    later = [*trials, search.Trial(1, {"kind": LINEAR}, (0.99,)), search.Trial(2, {"kind": LINEAR}, (0.1,))]
    assert search.best_trial(later).number == 1
    best = {r["trial"]: r["best_so_far"] for r in search.trials_frame(spark, later).collect()}
    assert best[1] == best[2] == 0.99


def test_folds_together_equal_single_fits(train):
    """Each fold's score is that of a recipe fitted to the other folds and scored on it."""
    recipes = [trial_recipe(t, 3) for t in draws(30) if t["kind"] in (TREES, DROPPING)][:2]
    folded = kfold_assign(train, 3, name=search.FOLD)
    together = search.cross_validate(recipes, folded, 3)
    for recipe, areas in zip(recipes, together):
        for fold in (0, 2):
            model = fit_recipe(recipe, folded.where(f"{search.FOLD} <> {fold}"))
            scored = scoring.predict(model, folded.where(f"{search.FOLD} = {fold}"))
            assert areas[fold] == roc_auc_hard(scored).first()["roc_auc"]


def test_tuning_queries_run_the_whole_search_once(spark, folder, monkeypatch):
    """All trials, folds and trees, uncut, in one search for all queries."""
    from ebbtide.registry import modeling

    fitted = []
    boost = search.boost

    def counted(rows, fits, *args, **more):
        fitted.append([(f.part, f.booster) for f in fits])
        return boost(rows, fits, *args, **more)

    monkeypatch.setattr(modeling, "_searches", {})
    monkeypatch.setattr(search, "boost", counted)
    scores = modeling.tune_cv(spark, folder).collect()
    assert sorted((r["trial"], r["fold"]) for r in scores) == [(t, f) for t in range(5) for f in range(10)]
    assert fitted == [[(fold, booster_of(trial_recipe(params))) for params in draws(5) for fold in range(10)]]
    assert all(b.rounds == 100 for _, b in fitted[0])
    trials = {r["trial"]: r["metric"] for r in modeling.tune_trials(spark, folder).collect()}
    assert set(trials) == set(range(5))
    best = modeling.tune_search(spark, folder).first()
    assert best["metric"] == max(v for v in trials.values() if v is not None)
    assert modeling.refit_best(spark, folder).count() == common.halves(spark, folder)[1].count()
    assert len(fitted) == 1


def test_spark_learners_run_on_partitions_by_rows(spark, monkeypatch):
    """Hundreds of short jobs over 37 nearly empty partitions take far longer than over one."""
    seen = {}

    class Watching:
        def __init__(self, family):
            self.family = family

        def fit(self, featured):
            seen[self.family] = featured.rdd.getNumPartitions(), featured.count()
            return None

    monkeypatch.setattr(recipes, "classifier", lambda recipe, rows: Watching(recipe.family))
    monkeypatch.setattr(recipes, "PipelineModel", lambda stages: stages)
    columns = ", ".join(f"cast(id % {i + 2} as long) as {c}" for i, c in enumerate(COUNTERS))
    rows = spark.range(0, 200, 1, 37).selectExpr(
        "cast(id as string) as user_pseudo_id", "cast(id % 2 as int) as churned", *columns.split(", ")
    )
    for name in ("logreg_numeric", "boosting_numeric"):
        recipes.fit_recipe(name, rows)
    assert seen == {"logreg": (1, 200), "boosting": (1, 200)}


def test_a_search_learns_on_partitions_by_rows(spark, monkeypatch):
    """Features are learned per fold, by many short jobs over the same persisted rows."""
    seen = []

    def watching(own, folded, folds):
        seen.append((folded.rdd.getNumPartitions(), folded.count()))
        return [(0.5,) * folds for _ in own]

    monkeypatch.setattr(search, "cross_validate", watching)
    rows = spark.range(0, 200, 1, 37).selectExpr("cast(id as string) as user_pseudo_id", "cast(id % 2 as int) as churned")
    search.search(rows, trials=2, folds=2)
    assert seen == [(1, 200)]


def test_features_of_other_learners_come_on_partitions_by_rows(spark, monkeypatch):
    seen = []

    class Watching:
        def fit(self, featured):
            seen.append((featured.rdd.getNumPartitions(), featured.count()))

    monkeypatch.setattr(recipes, "classifier", lambda recipe, rows: Watching())
    monkeypatch.setattr(recipes, "PipelineModel", lambda stages: stages)
    monkeypatch.setattr(recipes, "TASK_ROWS", 50)
    columns = [f"cast(id % {i + 2} as long) as {c}" for i, c in enumerate(COUNTERS)]
    rows = spark.range(0, 200, 1, 37).selectExpr(
        "cast(id as string) as user_pseudo_id", "cast(id % 2 as int) as churned", *columns
    )
    for name in ("forest_numeric", "weighted_boosting_numeric"):
        recipes.fit_recipe(name, rows)
    assert seen == [(4, 200), (4, 200)]


def test_recipes_share_one_stored_split(spark, folder, monkeypatch):
    """Eleven recipes that are fitted and scored would else split all users 22 times."""
    made = []
    split = common.stratified_split

    def counted(known):
        made.append(known)
        return split(known)

    monkeypatch.setattr(common, "_paths", {})
    monkeypatch.setattr(common, "stratified_split", counted)
    for recipe in ("logreg_numeric", "forest_full", "boosting_full"):
        learn, test = common.parts(spark, folder, recipe)
        assert learn.unionAll(test).exceptAll(common.train(spark, folder)).isEmpty()
        assert learn.count() + test.count() == common.train(spark, folder).count()
    assert len(made) == 1

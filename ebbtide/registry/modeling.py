"""Queries on models: fits, scores, tuning, explanations, the scoring stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.explain import shapley, views
from ebbtide.models import scoring, storage
from ebbtide.registry import common
from ebbtide.schema import USER
from ebbtide.session import materialize, shared_dir
from ebbtide.streaming.score import arriving_users, score_stream as start_scoring
from ebbtide.tuning import search

TRIALS, FOLDS = 5, 10


def held_out(recipe: str):
    """Scores of a recipe on the 10 % part it has not seen."""

    def query(spark, folder):
        _, test = common.parts(spark, folder, recipe)
        return scoring.predict_proba(common.model(spark, folder, recipe), test)

    return query


def predict(spark, folder):
    return scoring.predict(common.model(spark, folder, "logreg_full"), common.train(spark, folder))


def predict_proba(spark, folder):
    return scoring.predict_proba(
        common.model(spark, folder, "logreg_full"), common.train(spark, folder)
    )


def predict_threshold(spark, folder):
    return scoring.predict_threshold(
        common.model(spark, folder, "boosting_sql"),
        common.train(spark, folder),
    )


def score_not_yet(spark, folder):
    return scoring.predict_proba(common.boosted(spark, folder), common.not_yet(spark, folder))


def save_load_model(spark, folder):
    """Scores of the live and of the saved and loaded model side by side."""
    model = common.model(spark, folder, "logreg_full")
    path = storage.save_model(model, shared_dir(spark, "model"))
    users = common.train(spark, folder)
    live = scoring.predict_proba(model, users).select(USER, F.col("probability_1").alias("live"))
    loaded = scoring.predict_proba(storage.load_model(path), users)
    return live.join(loaded.select(USER, F.col("probability_1").alias("loaded")), USER)


_searches: dict = {}


def _trials(spark, folder):
    """The whole search with the recipes' own trees, run once for all queries on it."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _searches:
        learn, _ = common.halves(spark, folder)
        _searches[key] = search.search(learn, trials=TRIALS, folds=FOLDS)
    return _searches[key]


def tune_cv(spark, folder):
    """Score of each fold of each trial."""
    return search.folds_frame(spark, _trials(spark, folder))


def tune_search(spark, folder):
    """The best trial of the search."""
    return search.trials_frame(spark, [search.best_trial(_trials(spark, folder))])


def tune_trials(spark, folder):
    return search.trials_frame(spark, _trials(spark, folder))


def refit_best(spark, folder):
    learn, test = common.halves(spark, folder)
    model = search.refit_best(learn, _trials(spark, folder))
    return scoring.predict_proba(model, test)


def observations_table(spark, folder):
    return views.observations_table(common.boosted(spark, folder), common.train(spark, folder))


def top_feature_importance(spark, folder):
    return views.feature_importance(common.boosted(spark, folder), common.train(spark, folder))


def _shap(spark, folder):
    model, users = common.boosted(spark, folder), common.train(spark, folder)
    return shapley.shap_long(shapley.tree_shap(model, users), shapley.vector_names(model, users))


def shap_values(spark, folder):
    return _shap(spark, folder)


def shap_values_linear(spark, folder):
    model, users = common.model(spark, folder, "logreg_full"), common.train(spark, folder)
    shap = shapley.linear_shap(model, users, common.halves(spark, folder)[0])
    return shapley.shap_long(shap, shapley.vector_names(model, users))


def shap_summary(spark, folder):
    return views.shap_summary(_shap(spark, folder))


def shap_distribution(spark, folder):
    # limits and bins read the contributions twice: they are written once
    return views.shap_distribution(materialize(_shap(spark, folder), "shap"))


def shap_one_row(spark, folder):
    """The first user's score taken apart; only this user is explained."""
    model, users = common.boosted(spark, folder), common.train(spark, folder)
    first = users.agg(F.min(USER).alias(USER))
    one = users.join(F.broadcast(first), USER, "left_semi")
    names = shapley.vector_names(model, users)
    return views.shap_one_row(shapley.shap_long(shapley.tree_shap(model, one), names))


#: Recipes whose training looks at held-out rows.
WATCHED = ("logreg_sql", "boosting_sql", "perceptron_sql")


def training_loss(spark, folder):
    """Mean loss per iteration of the SQL family, on the rows learned from and on those held out when
    training began, and which iteration was kept."""
    rows = []
    for name in WATCHED:
        losses = common.model(spark, folder, name).stages[-1].loss
        kept = min(range(len(losses)), key=lambda i: losses[i][1])
        rows += [(name, i, own, held, i == kept) for i, (own, held) in enumerate(losses)]
    return spark.createDataFrame(rows, "recipe string, iteration int, loss double, held_loss double, kept boolean")


def score_stream(spark, folder):
    """All users arrive as files and are scored by a saved model until none is left."""
    model = common.model(spark, folder, "boosting_full")
    saved = storage.save_model(model, shared_dir(spark, "stream-model"))
    out = shared_dir(spark, "stream-out")
    arriving = arriving_users(spark, common.users_folder(spark, folder))
    running = start_scoring(arriving, saved, out, shared_dir(spark, "stream-checkpoint"))
    running.awaitTermination()
    return spark.read.parquet(out)


QUERIES = {
    "model_logreg_numeric": held_out("logreg_numeric"),
    "model_logreg_full": held_out("logreg_full"),
    "model_random_forest_numeric": held_out("forest_numeric"),
    "model_random_forest": held_out("forest_full"),
    "model_gbt_numeric": held_out("boosting_numeric"),
    "model_gbt": held_out("boosting_full"),
    "model_gbt_weighted_numeric": held_out("weighted_boosting_numeric"),
    "model_gbt_weighted": held_out("weighted_boosting_full"),
    "model_logreg_sql": held_out("logreg_sql"),
    "model_gbt_sql": held_out("boosting_sql"),
    "model_mlp_sql": held_out("perceptron_sql"),
    **{
        name: globals()[name]
        for name in (
            "predict", "predict_proba", "predict_threshold", "score_not_yet", "save_load_model",
            "tune_cv", "tune_search", "tune_trials", "refit_best", "observations_table",
            "top_feature_importance", "shap_values", "shap_values_linear", "shap_summary",
            "shap_distribution", "shap_one_row", "score_stream", "training_loss",
        )
    },
}

ORACLE: dict[str, str] = {}

"""What must hold of models, scores and the scoring stream whatever was learned, as rows that SQL
can state: who is scored, that probabilities are probabilities, that labels add up."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.evaluation import confusion, curves
from ebbtide.models import scoring
from ebbtide.registry import common, modeling
from ebbtide.registry.exploration import union_all
from ebbtide.registry.oracle import TRAIN, bucket_sql, q
from ebbtide.registry.preparation import SPLIT
from ebbtide.schema import LABEL, USER

RECIPES = [
    "logreg_numeric", "logreg_full", "forest_numeric", "forest_full", "boosting_numeric",
    "boosting_full", "weighted_boosting_numeric", "weighted_boosting_full", "logreg_sql",
    "boosting_sql", "perceptron_sql",
]


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _held_out(spark, folder, recipe: str) -> DataFrame:
    _, test = common.parts(spark, folder, recipe)
    return scoring.predict_proba(common.model(spark, folder, recipe), test)


def _each_recipe(spark, folder, measure) -> DataFrame:
    common.fit_models(spark, folder, RECIPES)

    def one(recipe: str) -> DataFrame:
        return measure(_held_out(spark, folder, recipe)).withColumn("recipe", F.lit(recipe))

    return _stack(common.side_by_side(one, RECIPES))  # curves store their ranges when they are asked for


def model_invariants(spark, folder):
    """Per recipe: held-out users, and of how many the probabilities and the label are sound."""
    p0, p1 = F.col("probability_0"), F.col("probability_1")
    sound = p0.between(0, 1) & p1.between(0, 1) & (F.abs(p0 + p1 - 1) < 1e-9)
    agrees = F.col("prediction") == (p1 > p0).cast("int")
    return _each_recipe(
        spark,
        folder,
        lambda scored: scored.agg(
            F.countDistinct(USER).alias("users"),
            F.sum(LABEL).cast("long").alias("churned_users"),
            F.count_if(sound).alias("sound"),
            F.count_if(agrees | (p0 == p1)).alias("agreeing"),
        ),
    )


def model_supports(spark, folder):
    """Per recipe and label: the rows of the confusion matrix on the held-out users, summed."""
    return _each_recipe(
        spark,
        folder,
        lambda scored: confusion.confusion_matrix(scored).select(
            "expected_label", (F.col("predicted_0") + F.col("predicted_1")).alias("support")
        ),
    )


def model_confusion(spark, folder):
    """Per recipe the confusion matrix on the held-out users."""
    return _each_recipe(spark, folder, confusion.confusion_matrix)


def model_metrics(spark, folder):
    """Per recipe the one-row evaluation on the held-out users."""
    return _each_recipe(
        spark, folder, lambda scored: curves.evaluate_model(scored.withColumn("score", F.col("probability_1")))
    )


def model_roc_points(spark, folder):
    """Per recipe the corners of the ROC curve on the held-out users."""
    return _each_recipe(
        spark,
        folder,
        lambda scored: curves.roc_points(scored.withColumn("score", F.col("probability_1")), corners_only=True),
    )


def saved_model_invariants(spark, folder):
    """Users scored alike by the live and by the saved and loaded model."""
    both = modeling.save_load_model(spark, folder)
    return both.agg(F.count(F.lit(1)).alias("users"), F.count_if(F.col("live") == F.col("loaded")).alias("alike"))


def tuning_invariants(spark, folder):
    """Per trial of the search: its folds, how many are in range, whether its value is their mean, and
    whether the best trial is at least as good."""
    folds = modeling.tune_cv(spark, folder).groupBy("trial").agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.countDistinct("fold").alias("different_folds"),
        F.count_if(F.col("metric").isNull() | F.col("metric").between(0, 1)).alias("in_range"),
        F.avg("metric").alias("mean"),
    )
    values = modeling.tune_trials(spark, folder).groupBy("trial").agg(F.first("metric").alias("metric"))
    best = modeling.tune_search(spark, folder).agg(F.max("metric").alias("best"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) < 1e-9
    return (
        folds.join(values, "trial")
        .crossJoin(F.broadcast(best))  # one row
        .select("trial", "n_folds", "different_folds", "in_range", near("mean", "metric").alias("value_is_mean"),
                (F.col("metric") <= F.col("best")).alias("best_is_greatest"))
    )


def refit_invariants(spark, folder):
    """Held-out users, and how many of them the refitted best trial scores soundly."""
    p = F.col("probability_1")
    return modeling.refit_best(spark, folder).agg(
        F.countDistinct(USER).alias("users"),
        F.count_if(p.between(0, 1) & (F.abs(p + F.col("probability_0") - 1) < 1e-9)).alias("sound"),
    )


def loss_invariants(spark, folder):
    """Per recipe of the SQL family: kept iterations, whether one of least held-out loss is kept, and whether
    both losses are below those of the first iteration then."""
    losses = modeling.training_loss(spark, folder)
    first = losses.where("iteration = 0").select("recipe", F.col("loss").alias("loss_0"), F.col("held_loss").alias("held_0"))
    least = losses.groupBy("recipe").agg(F.min("held_loss").alias("least"))
    return (
        losses.where("kept")
        .join(first, "recipe")
        .join(least, "recipe")
        .groupBy("recipe")
        .agg(
            F.count(F.lit(1)).alias("kept"),
            F.bool_and(F.col("held_loss") == F.col("least")).alias("kept_is_least"),
            F.bool_and((F.col("loss") < F.col("loss_0")) & (F.col("held_loss") < F.col("held_0"))).alias("learned"),
        )
    )


def shap_additivity(spark, folder):
    """Users for whom contributions and base value add up to the model's margin."""
    model, users = common.boosted(spark, folder), common.train(spark, folder)
    margin = vector_to_array("rawPrediction")[1].alias("margin")
    sums = modeling.shap_values(spark, folder).groupBy(USER).agg((F.sum("shap") + F.first("base")).alias("total"))
    both = model.transform(users).select(USER, margin).join(sums, USER)
    return both.agg(
        F.count(F.lit(1)).alias("users"), F.count_if(F.abs(F.col("margin") - F.col("total")) < 1e-6).alias("additive")
    )


def score_invariants(spark, folder):
    """Per query on scores: rows, users and how many values are in range."""
    shapes = {
        "predict": F.col("prediction").isin(0, 1),
        "predict_proba": F.col("probability_1").between(0, 1),
        "predict_threshold": F.col("churned_by_threshold") == (F.col("probability") > 0.5).cast("int"),
        "score_not_yet": F.col("probability_1").between(0, 1),
        "score_stream": F.col("probability_1").between(0, 1),
    }
    common.fit_models(spark, folder, ["boosting_full", "weighted_boosting_full", "logreg_full", "boosting_sql"])
    return _stack(
        [
            modeling.QUERIES[name](spark, folder)
            .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(USER).alias("users"), F.count_if(good).alias("in_range"))
            .withColumn("query", F.lit(name))
            for name, good in shapes.items()
        ]
    )


QUERIES = {
    name: globals()[name]
    for name in (
        "model_invariants", "model_supports", "model_confusion", "model_metrics", "model_roc_points",
        "saved_model_invariants", "score_invariants", "tuning_invariants", "refit_invariants", "loss_invariants",
        "shap_additivity",
    )
}

_OUT = f"""{SPLIT},
held AS (SELECT 'label' AS family, user_pseudo_id, churned FROM split WHERE split = 'test'
  UNION ALL SELECT 'hash', user_pseudo_id, churned FROM train WHERE {bucket_sql('user_pseudo_id', 10)} = 9),
recipes AS ({union_all(
    f"SELECT '{r}' AS recipe, '{'hash' if r.endswith('_sql') else 'label'}' AS family" for r in RECIPES
)})"""
_COUNTS = "CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS users, CAST(count(*) AS BIGINT) AS in_range"

ORACLE = {
    "model_invariants": q(
        _OUT,
        """SELECT recipe, CAST(count(*) AS BIGINT) AS users, CAST(sum(churned) AS BIGINT) AS churned_users,
          CAST(count(*) AS BIGINT) AS sound, CAST(count(*) AS BIGINT) AS agreeing
        FROM recipes JOIN held USING (family) GROUP BY recipe""",
    ),
    "model_supports": q(
        _OUT,
        """SELECT recipe, expected_label, CAST(count(*) FILTER (churned = expected_label) AS BIGINT) AS support
        FROM recipes JOIN held USING (family) CROSS JOIN (SELECT unnest([0, 1]) AS expected_label)
        GROUP BY recipe, expected_label""",
    ),
    "saved_model_invariants": q(
        TRAIN, "SELECT CAST(count(*) AS BIGINT) AS users, CAST(count(*) AS BIGINT) AS alike FROM train"
    ),
    "tuning_invariants": """SELECT CAST(trial AS INTEGER) AS trial, 10::BIGINT AS n_folds, 10::BIGINT AS different_folds,
        10::BIGINT AS in_range, true AS value_is_mean, true AS best_is_greatest FROM range(5) t(trial)""",
    "refit_invariants": q(
        SPLIT,
        """SELECT CAST(count(*) AS BIGINT) AS users, CAST(count(*) AS BIGINT) AS sound FROM split WHERE split = 'test'""",
    ),
    "loss_invariants": """SELECT unnest(['logreg_sql', 'boosting_sql', 'perceptron_sql']) AS recipe,
        1::BIGINT AS kept, true AS kept_is_least, true AS learned""",
    "shap_additivity": q(
        TRAIN, "SELECT CAST(count(*) AS BIGINT) AS users, CAST(count(*) AS BIGINT) AS additive FROM train"
    ),
    "score_invariants": q(
        TRAIN,
        union_all(
            [
                *[f"SELECT '{n}' AS query, {_COUNTS} FROM train" for n in ("predict", "predict_proba", "predict_threshold")],
                f"SELECT 'score_not_yet', {_COUNTS} FROM users WHERE is_enable = 0 AND bounced = 0",
                f"SELECT 'score_stream', {_COUNTS} FROM users",
            ]
        ),
    ),
}

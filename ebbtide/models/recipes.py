"""Model recipes: feature stages, weights and a Spark ML classifier, fitted as one model.

The training frame is kept in memory or on disk while the iterations run. Only learned
parameters reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame

from ebbtide.boosting.model import BoostingClassifier
from ebbtide.boosting.params import LINEAR, Booster
from ebbtide.features.buckets import bucket_clause, transform_clause
from ebbtide.features.builder import FEATURES, feature_stages
from ebbtide.features.categories import onehot_stages
from ebbtide.features.weights import LabelWeighter
from ebbtide.forest.kernel import Forest
from ebbtide.forest.model import ForestClassifier
from ebbtide.functions.hashing import bucket
from ebbtide.models.network import Network, NetworkClassifier
from ebbtide.schema import COUNTERS, FIRST_SEEN, USER, ColumnRoles
from ebbtide.session import ensure_checkpoint_dir

SEED = 42
#: Rows a task holds while features and classifiers are learned: the jobs have as many tasks as the rows fill.
TASK_ROWS = 1 << 15
WEIGHT, HELD = "_weight", "_held"


@dataclass(frozen=True)
class Recipe:
    """`family` picks the classifier, `features` the stages in front of it. `held` of ten hash buckets of
    the training rows are held out, and training ends by the loss on them."""

    family: str
    features: str = "full"
    weighting: str | None = None
    params: dict = field(default_factory=dict)
    roles: ColumnRoles = ColumnRoles()
    most_common: float | None = None
    held: int = 0

    def with_params(self, **params) -> "Recipe":
        return replace(self, params={**self.params, **params})


RECIPES = {
    "logreg_numeric": Recipe("logreg", "numeric", "balanced"),
    "logreg_full": Recipe("logreg", "full", "balanced"),
    "forest_numeric": Recipe("forest", "numeric", "balanced"),
    "forest_full": Recipe("forest", "full", "balanced"),
    "boosting_numeric": Recipe("boosting", "numeric"),
    "boosting_full": Recipe("boosting", "full"),
    "weighted_boosting_numeric": Recipe("second_order", "numeric", "base_rate"),
    "weighted_boosting_full": Recipe("second_order", "full", "base_rate"),
    "logreg_sql": Recipe(
        "second_order", "bins", None, {"kind": LINEAR, "eta": 0.5, "reg_lambda": 0.0, "early_stop": 5}, held=2
    ),
    "boosting_sql": Recipe("second_order", "bins", "balanced", {"early_stop": 5}, held=2),
    "perceptron_sql": Recipe("network", "all_but_ids", None, {"learn_rate": 0.01, "early_stop": 5}, held=2),
}


def recipe_stages(recipe: Recipe) -> list:
    """Feature stages of a recipe, ending with the vector, and the weights if it has any."""
    roles = recipe.roles
    if recipe.features == "numeric":
        stages = feature_stages(categorical=False, roles=roles)
    elif recipe.features == "full":
        stages = feature_stages(most_common=recipe.most_common, roles=roles)
    elif recipe.features == "bins":
        # the clause lets nothing through but bins, label and id: categories are not used
        onehots = onehot_stages(list(COUNTERS))
        stages = [
            transform_clause(bucket_clause(), keep=(USER,)),
            *onehots,
            VectorAssembler(inputCols=onehots[-1].getOutputCols(), outputCol=FEATURES),
        ]
    elif recipe.features == "all_but_ids":
        wide = replace(roles, numeric=("is_enable", "bounced", *roles.numeric), ignored=(USER,))
        stages = [transform_clause(f"* EXCEPT ({FIRST_SEEN})"), *feature_stages(roles=wide)]
    else:
        raise ValueError(f"unknown features {recipe.features!r}")
    if recipe.weighting:
        stages.append(
            LabelWeighter(labelCol=roles.label, weightCol=WEIGHT, scheme=recipe.weighting)
        )
    return stages


def booster_of(recipe: Recipe) -> Booster:
    """The booster of a second-order recipe."""
    return Booster(**{"seed": SEED, **recipe.params})


def forest_of(recipe: Recipe) -> Forest:
    """The forest of a recipe, whose parameters may have the names that Spark ML gives them."""
    names = {"numTrees": "trees", "maxDepth": "max_depth"}
    return Forest(**{"seed": SEED, **{names.get(k, k): v for k, v in recipe.params.items()}})


def classifier(recipe: Recipe, rows: int):
    """The classifier of a recipe for `rows` training rows."""
    held = HELD if recipe.held else None
    common = {"featuresCol": FEATURES, "labelCol": recipe.roles.label}
    if recipe.weighting:
        common["weightCol"] = WEIGHT
    if recipe.family == "logreg":
        # 1/n turns the mean loss into the summed loss of an L2 penalty of strength one
        defaults = {
            "maxIter": 1000,
            "regParam": 1.0 / rows,
            "elasticNetParam": 0.0,
            "standardization": False,
        }
        return LogisticRegression(**common, **{**defaults, **recipe.params})
    if recipe.family == "forest":
        return ForestClassifier(**common, forest=forest_of(recipe), keyCol=USER)
    if recipe.family == "boosting":
        defaults = {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, "seed": SEED}
        return GBTClassifier(**common, **{**defaults, **recipe.params})
    if recipe.family == "second_order":
        return BoostingClassifier(**common, booster=booster_of(recipe), keyCol=USER, heldCol=held)
    if recipe.family == "network":
        return NetworkClassifier(**common, network=Network(**{"seed": SEED, **recipe.params}), keyCol=USER, heldCol=held)
    raise ValueError(f"unknown family {recipe.family!r}")


def training_columns(recipe: Recipe, df: DataFrame, *more: str) -> DataFrame:
    """Only what the recipe reads, and `more`; the id stays for joins with the scores."""
    roles = recipe.roles
    wanted = [*roles.ignored, *roles.categorical, *roles.numeric, roles.label, *more]
    return df.select(*[c for c in wanted if c in df.columns])


def by_rows(kept: DataFrame, rows: int) -> DataFrame:
    """A persisted frame of `rows` rows on as many partitions as they fill: what learns from it runs many
    short jobs, and a split leaves hundreds of nearly empty partitions."""
    return kept.coalesce(max(1, math.ceil(rows / TASK_ROWS)))


def fit_recipe(recipe: Recipe | str, train: DataFrame) -> PipelineModel:
    """Fit features and classifier. The model holds all stages and scores raw user rows."""
    recipe = RECIPES[recipe] if isinstance(recipe, str) else recipe
    ensure_checkpoint_dir(train.sparkSession)  # boosting cuts its lineage there
    kept = training_columns(recipe, train).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = kept.count()
        learning = by_rows(kept, rows)
        prepared = Pipeline(stages=recipe_stages(recipe)).fit(learning)
        featured = prepared.transform(learning)
        if recipe.held:
            featured = featured.withColumn(HELD, bucket(USER, 10, recipe.params.get("seed", SEED)) < recipe.held)
        learned = classifier(recipe, rows).fit(featured)
    finally:
        kept.unpersist()
    return PipelineModel(stages=[*prepared.stages, learned])

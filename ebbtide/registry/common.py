"""Frames and fitted models the registered queries share.

The per-user dataset is written once per application and folder, as a product team would
keep it as a table; the queries on it read that table. Models are fitted once likewise.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ebbtide.functions.timing import wall_clock
from ebbtide.models.recipes import RECIPES, fit_recipe
from ebbtide.operators.splitting import hash_held_out, hash_split, stratified_split
from ebbtide.plans.user_dataset import trainable, undecided, user_dataset
from ebbtide.schema import EVENT_SCHEMA, FIRST_SEEN, USER_SCHEMA
from ebbtide.session import ensure_checkpoint_dir, pin_utc, shared_dir
from ebbtide.sources.event_log import write_event_log
from ebbtide.sources.star_tables import event_log

Query = Callable[[SparkSession, str], DataFrame]

_paths: dict[tuple, str] = {}
_models: dict[tuple, PipelineModel] = {}


def log(spark: SparkSession, folder: str) -> DataFrame:
    return event_log(pin_utc(spark), folder)


def _once(spark: SparkSession, folder: str, name: str, write: Callable[[str], object]) -> str:
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _paths:
        path = shared_dir(spark, name)
        write(path)
        _paths[key] = path
    return _paths[key]


def log_folder(spark: SparkSession, folder: str) -> str:
    """The event log written by day."""
    return _once(spark, folder, "event-log", lambda path: write_event_log(log(spark, folder), path))


def users_folder(spark: SparkSession, folder: str) -> str:
    return _once(
        spark,
        folder,
        "users",
        lambda path: user_dataset(log(spark, folder)).write.parquet(path),
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    path = users_folder(pin_utc(spark), folder)
    return spark.read.schema(USER_SCHEMA).parquet(path)


def train(spark: SparkSession, folder: str) -> DataFrame:
    """All users with a final label."""
    return trainable(users(spark, folder))


def not_yet(spark: SparkSession, folder: str) -> DataFrame:
    return undecided(users(spark, folder))


def split_folder(spark: SparkSession, folder: str) -> str:
    """The stratified split of the users with a final label: each recipe learns from it and is scored on it."""
    return _once(
        spark,
        folder,
        "split",
        lambda path: stratified_split(train(spark, folder)).write.parquet(path),
    )


def halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """90 % of the users with a final label to learn from, 10 % to look at."""
    columns = StructType([*train(spark, folder).schema, StructField("split", StringType())])
    split = spark.read.schema(columns).parquet(split_folder(spark, folder))
    return (
        split.where(F.col("split") == "train").drop("split"),
        split.where(F.col("split") == "test").drop("split"),
    )


def parts(spark: SparkSession, folder: str, recipe: str) -> tuple[DataFrame, DataFrame]:
    """The rows a recipe learns from and those held out: the recipes of the SQL family split by
    hash bucket, all others by label."""
    if recipe.endswith("_sql"):
        known = train(spark, folder)
        return hash_split(known), hash_held_out(known)
    return halves(spark, folder)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """A formula as score and a hard label from it: metrics that another engine can check."""
    activity = F.col("cnt_user_engagement") + F.col("cnt_post_score")
    score = F.lit(1.0) / (F.lit(1.0) + activity)
    return train(spark, folder).select(
        "user_pseudo_id",
        "churned",
        score.alias("score"),
        (score > 0.2).cast("int").alias("prediction"),
    )


def model(spark: SparkSession, folder: str, name: str, **params) -> PipelineModel:
    """A recipe fitted once on its 90 % part; every query on it shares the fit."""
    key = (spark.sparkContext.applicationId, folder, name, tuple(sorted(params.items())))
    if key not in _models:
        learn, _ = parts(spark, folder, name)
        _models[key] = fit_recipe(RECIPES[name].with_params(**params), learn)
    return _models[key]


def fit_models(spark: SparkSession, folder: str, names: list[str], together: int = 4) -> None:
    """Fit several recipes side by side: the jobs of one leave cores free while its driver waits."""
    for name in names:
        parts(spark, folder, name)  # users and their split are stored once, before all
    ensure_checkpoint_dir(spark)
    longest_first = sorted(names, key=lambda name: RECIPES[name].family not in ("boosting", "network"))
    side_by_side(lambda name: model(spark, folder, name), longest_first, together)


def side_by_side(work: Callable[[str], object], names: list[str], together: int = 4) -> list:
    """What `work` gives for each name, several at a time."""
    with ThreadPoolExecutor(together) as pool:
        return list(pool.map(work, names))


def boosted(spark: SparkSession, folder: str) -> PipelineModel:
    return model(spark, folder, "weighted_boosting_full")


def shown(df: DataFrame) -> DataFrame:
    """Engagement time without zone, as other engines print it."""
    return df.withColumn(FIRST_SEEN, wall_clock(FIRST_SEEN)) if FIRST_SEEN in df.columns else df


EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()

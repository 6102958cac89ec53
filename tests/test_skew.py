"""A user with a third of all rows is spread and changes nothing in the result."""

import pytest
from events import HOUR, MINUTE, log
from pyspark.sql import functions as F

from ebbtide.functions import skew
from ebbtide.operators import activity, engagement
from ebbtide.plans.user_dataset import user_dataset
from ebbtide.schema import USER


@pytest.fixture(scope="module")
def events(spark):
    hot = [("hot", i * MINUTE, "post_score" if i % 3 else "user_engagement") for i in range(600)]
    cold = [
        (f"u{i % 60}", i * MINUTE, "ad_reward" if i % 2 else "user_engagement") for i in range(1200)
    ]
    return log(spark, hot + cold + [(None, HOUR), (None, 2 * HOUR)])


def test_heavy_keys_finds_the_hot_user(events):
    found = skew.heavy_keys(events, USER, rows_per_task=100)
    assert [(r[USER], r["_fanout"]) for r in found.collect()] == [("hot", 6)]
    assert skew.heavy_keys(events, USER).count() == 0


def test_heavy_keys_never_exceed_their_bound(monkeypatch, events):
    monkeypatch.setattr(skew, "MOST_HEAVY", 10)
    assert skew.heavy_keys(events, USER, rows_per_task=1).count() <= 10


def test_salted_join_keeps_all_rows(spark, events):
    dims = events.where(F.col(USER).isNotNull()).groupBy(USER).agg(F.min("event_timestamp").alias("first_us"))
    heavy = skew.heavy_keys(events, USER, rows_per_task=75)
    facts = events.select(USER, "event_id", "event_timestamp")
    salted = skew.salted_join(facts, dims, USER, heavy, ["event_id"])
    plain = facts.join(dims, USER)
    assert sorted(salted.select(*plain.columns).collect()) == sorted(plain.collect())


def test_hot_rows_are_spread(spark, events):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dims = events.where(F.col(USER).isNotNull()).groupBy(USER).agg(F.min("event_timestamp").alias("first_us"))
        heavy = skew.heavy_keys(events, USER, rows_per_task=20)
        salted = skew.salted_join(
            events.select(USER, "event_id"), dims, USER, heavy, ["event_id"]
        )
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        parts = (
            salted.where(F.col(USER) == "hot").groupBy(F.spark_partition_id().alias("p")).count().collect()
        )
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(parts) == 4


def test_user_dataset_is_the_same_with_salting(monkeypatch, events):
    plain = sorted(user_dataset(events).collect(), key=str)
    unsalted = sorted(engagement.engagement_bounds_window(events).collect(), key=str)
    monkeypatch.setattr(engagement, "heavy_keys", lambda df, key: skew.heavy_keys(df, key, 100))
    assert engagement.heavy_users(events).count() == 1
    assert sorted(engagement.engagement_bounds_window(events).collect(), key=str) == unsalted
    assert sum(r[1] is None for r in unsalted) == 2
    assert sorted(user_dataset(events).collect(), key=str) == plain
    assert activity.behavior_counts(events).count() == 31  # users of odd numbers never engage


def test_neither_side_of_a_salted_join_is_broadcast(spark, tmp_path):
    """A small file may hold many rows: estimates of its size must not send them through the driver."""
    spark.range(2000).selectExpr("cast(id % 50 as string) AS k", "id").write.parquet(f"{tmp_path}/facts")
    spark.range(50).selectExpr("cast(id as string) AS k", "id AS d").write.parquet(f"{tmp_path}/dims")
    facts, dims = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("facts", "dims"))
    joined = skew.salted_join(facts, dims, "k", skew.heavy_keys(facts, "k"), ["id"])
    assert joined.count() == 2000
    joined.collect()
    text = joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    joins = [line for line in text.splitlines() if "Join [" in line and "_salt" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)

"""Splits are exact, disjoint and reproducible."""

import math

import pytest
from pyspark.sql import functions as F

from ebbtide.operators.splitting import hash_split, kfold_assign, stratified_split
from ebbtide.operators.weighting import balanced_weights, base_rate_weights


def labelled(spark, n, positives):
    return spark.range(n).select(
        F.concat(F.lit("u"), "id").alias("user_pseudo_id"),
        (F.col("id") < positives).cast("int").alias("churned"),
    )


def test_stratified_split_takes_exact_shares(spark):
    for n, positives in ((1000, 90), (483, 46), (30, 3), (11, 1), (10, 0)):
        split = stratified_split(labelled(spark, n, positives), cells=16)
        rows = split.groupBy("split").agg(F.count("*").alias("n"), F.sum("churned").alias("p")).collect()
        found = {r["split"]: r for r in rows}
        assert found["test"]["n"] == math.ceil(n / 10)
        assert sum(r["n"] for r in rows) == n
        assert abs(found["test"]["p"] - positives / n * math.ceil(n / 10)) < 1


def test_stratified_split_does_not_depend_on_the_cells(spark):
    df = labelled(spark, 700, 80)

    def test_users(cells):
        split = stratified_split(df, cells=cells).where("split = 'test'")
        return {r["user_pseudo_id"] for r in split.collect()}

    assert test_users(1) == test_users(64) == test_users(4096)


def test_seed_changes_the_split(spark):
    df = labelled(spark, 500, 50)
    a = {r[0] for r in stratified_split(df, seed=1).where("split = 'test'").collect()}
    b = {r[0] for r in stratified_split(df, seed=2).where("split = 'test'").collect()}
    assert a != b


def test_folds_are_a_partition_of_about_equal_size(spark):
    sizes = kfold_assign(labelled(spark, 5000, 10)).groupBy("fold").count().collect()
    assert {r["fold"] for r in sizes} == set(range(10))
    assert sum(r["count"] for r in sizes) == 5000
    assert all(400 < r["count"] < 600 for r in sizes)


def test_hash_split_keeps_nine_tenths(spark):
    kept = hash_split(labelled(spark, 5000, 10)).count()
    assert 4400 < kept < 4600


def test_balanced_weights_add_up_to_the_rows(spark):
    weighted = balanced_weights(labelled(spark, 200, 20))
    sums = {r["churned"]: r["s"] for r in weighted.groupBy("churned").agg(F.sum("weight").alias("s")).collect()}
    assert sums == pytest.approx({0: 100.0, 1: 100.0})


def test_one_class_only(spark):
    assert balanced_weights(labelled(spark, 20, 0)).agg(F.sum("weight")).first()[0] == 20.0
    assert base_rate_weights(labelled(spark, 20, 0)).agg(F.sum("weight")).first()[0] == 20.0

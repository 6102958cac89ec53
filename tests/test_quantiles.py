"""Exact quantiles from frequency tables equal interpolation over all values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators.distributions import boxplot_stats
from ebbtide.operators.frequencies import exact_quantiles

POINTS = (0.0, 0.05, 0.25, 0.5, 0.9, 1.0)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    groups = {"many": rng.normal(size=501), "ties": rng.integers(0, 4, 200) * 1.0, "one": np.array([7.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    freq = spark.createDataFrame(rows, "g string, value double").groupBy("g", "value").agg(
        F.count("*").alias("cnt")
    )
    got = {r["g"]: r["quantiles"] for r in exact_quantiles(freq, ["g"], POINTS).collect()}
    for g, values in groups.items():
        assert got[g] == pytest.approx(list(np.quantile(values, POINTS)))


def test_approximate_boxes_are_close(spark, train):
    exact = boxplot_stats(train, ["cnt_post_score"]).collect()
    close = boxplot_stats(train, ["cnt_post_score"], exact=False).collect()
    for a, b in zip(sorted(exact), sorted(close)):
        assert abs(a["median"] - b["median"]) <= 1

"""Distributed running totals equal a plain cumulative sum."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide.functions.running import running_totals, with_ranges


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("ranges", [None, 2, 40])
def test_running_totals(spark, descending, ranges):
    rng = np.random.default_rng(3)
    table = pd.DataFrame({"k": rng.permutation(500) / 7.0, "a": rng.integers(0, 9, 500), "b": 1})
    table.loc[:150, "k"] = 3.0 + table.loc[:150, "k"] / 1e6  # a crowded stretch
    out = running_totals(
        spark.createDataFrame(table), "k", {"a": "ca", "b": "cb"}, descending=descending, ranges=ranges
    ).toPandas()
    expected = table.sort_values("k", ascending=not descending)
    out = out.sort_values("k", ascending=not descending)
    assert list(out["ca"]) == list(expected["a"].cumsum())
    assert list(out["cb"]) == list(range(1, 501))


def test_groups_and_ties(spark):
    rows = [("x", "b", 1), ("x", "a", 2), ("y", "c", 4), ("x", "c", 8), ("y", "a", 16)]
    df = spark.createDataFrame(rows, "g string, v string, n int")
    keyed = df.selectExpr("*", "0 AS key")  # all keys equal: ties decide
    out = running_totals(keyed, "key", {"n": "c"}, by=["g"], ties=["v"], ranges=3, totals={"n": "t"})
    assert {(r["g"], r["v"]): r["c"] for r in out.collect()} == {
        ("x", "a"): 2, ("x", "b"): 3, ("x", "c"): 11, ("y", "a"): 16, ("y", "c"): 20,
    }
    assert {(r["g"], r["t"]) for r in out.collect()} == {("x", 11), ("y", 20)}


@pytest.mark.parametrize("descending", [False, True])
def test_texts_with_a_long_common_start_are_spread(spark, descending):
    """Values of one 20-byte start, all counted once: the value itself decides the range."""
    words = [f"{'common start of it'}{i:03d}é" for i in range(300)]
    df = spark.createDataFrame([(w, 1) for w in words], "w string, n int")
    for key, ties in (("w", []), ("n", ["w"])):
        out = running_totals(df, key, {"n": "c"}, ties=ties, descending=descending, ranges=8).collect()
        order = sorted(words, reverse=descending and key == "w")
        assert {r["w"]: r["c"] for r in out} == {w: i + 1 for i, w in enumerate(order)}
    sizes = [r["count"] for r in with_ranges(df, F.col("n"), F.col("w"), ranges=8).groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 150

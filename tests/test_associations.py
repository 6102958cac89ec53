"""Associations and densities against pandas, numpy and direct sums."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from ebbtide.operators import associations as assoc
from ebbtide.operators.distributions import density_by_label, scaled_histogram


def table(seed=0, n=300):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 6, n).astype(float)
    b = a + rng.normal(size=n).round(1)
    c = rng.normal(size=n)
    d = -a
    out = pd.DataFrame({"a": a, "b": b, "c": c, "d": d, "one": 1.0})
    out.loc[rng.random(n) < 0.2, "b"] = np.nan
    out.loc[rng.random(n) < 0.1, "c"] = np.nan
    return out


def frame(spark, pandas):
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in pandas.itertuples(index=False)]
    kinds = {"float64": "double", "int64": "long"}
    return spark.createDataFrame(rows, ", ".join(f"{c} {kinds.get(str(t), 'string')}" for c, t in pandas.dtypes.items()))


def tau(x, y):
    signs = [(np.sign(p - q), np.sign(r - s)) for (p, r), (q, s) in itertools.combinations(zip(x, y), 2)]
    top = sum(a * b for a, b in signs)
    bottom = sum(a != 0 for a, _ in signs) * sum(b != 0 for _, b in signs)
    return top / math.sqrt(bottom) if bottom else None


@pytest.mark.parametrize("strip", [assoc.STRIP_CELLS, 7])
def test_rank_correlations(spark, strip):
    """Small strips send cells over several rounds of strips of strips."""
    pandas = table(n=120)
    columns = list(pandas.columns)
    got = {(r["x"], r["y"]): r for r in assoc.rank_correlations(frame(spark, pandas), columns, strip).collect()}
    assert set(got) == set(itertools.combinations(columns, 2))
    for (x, y), r in got.items():
        both = pandas[[x, y]].dropna()
        assert r["n"] == len(both)
        ranks = both.rank()
        expected = ranks[x].corr(ranks[y]) if x != "one" and y != "one" else None
        assert r["spearman"] == (pytest.approx(expected) if expected is not None else None)
        own = tau(both[x], both[y])
        assert r["kendall"] == (pytest.approx(own) if own is not None else None)


def test_concordance_counts_every_pair():
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 17, 200):
        x, y, n = rng.integers(0, 9, size), rng.integers(0, 9, size), rng.integers(1, 5, size)
        brute = sum(
            int(n[i] * n[j]) * int(np.sign(x[j] - x[i]) * np.sign(y[j] - y[i])) for i, j in itertools.combinations(range(size), 2)
        )
        assert assoc.concordance(x, y, n) == brute


def test_nominal_associations(spark):
    rng = np.random.default_rng(2)
    a = rng.choice(list("xyz"), 200)
    b = np.where(rng.random(200) < 0.7, a, rng.choice(list("pq"), 200))
    pandas = pd.DataFrame({"a": a, "b": b, "c": rng.choice(["m", None], 200), "e": "same"})
    got = {(r["x"], r["y"]): r for r in assoc.nominal_associations(frame(spark, pandas), list(pandas.columns)).collect()}
    counts = pd.crosstab(a, b)
    n = len(a)
    expected = np.outer(counts.sum(axis=1), counts.sum(axis=0)) / n
    chi = ((counts - expected) ** 2 / expected).to_numpy().sum()
    r, k = counts.shape
    phi = max(0, chi / n - (k - 1) * (r - 1) / (n - 1))
    v = math.sqrt(phi / min(k - (k - 1) ** 2 / (n - 1) - 1, r - (r - 1) ** 2 / (n - 1) - 1))
    assert got["a", "b"]["cramers_v"] == pytest.approx(v) and got["a", "b"]["categories_y"] == k
    assert got["a", "c"]["n"] == int(pandas["c"].notna().sum()) and got["a", "c"]["cramers_v"] is None
    assert got["a", "e"]["cramers_v"] is None


def test_missing_correlations(spark):
    pandas = table(3)
    got = assoc.missing_correlations(frame(spark, pandas), list(pandas.columns)).collect()
    assert [(r["x"], r["y"]) for r in got] == [("b", "c")]
    empty = pandas[["b", "c"]].isna().astype(int)
    assert got[0]["corr"] == pytest.approx(empty["b"].corr(empty["c"]))
    assert got[0]["both"] == int((empty["b"] * empty["c"]).sum())


def test_associations_of_nothing(spark):
    empty = frame(spark, table()).limit(0)
    assert assoc.rank_correlations(empty, ["a", "b"]).count() == 0
    assert assoc.nominal_associations(empty, ["a", "b"]).count() == 0
    assert assoc.missing_correlations(empty, ["a", "b"]).count() == 0


def test_densities_equal_direct_sums(spark):
    rng = np.random.default_rng(5)
    values = {0: np.concatenate([rng.normal(size=400), [60.0]]), 1: rng.integers(0, 8, 90).astype(float), 2: np.full(5, 3.0)}
    rows = [(k, float(v)) for k, own in values.items() for v in own] + [(1, None)]
    df = spark.createDataFrame(rows, "churned int, v double")
    got = density_by_label(df, ["v"]).collect()
    assert {r["churned"] for r in got} == {0, 1} and len(got) == 400
    for label in (0, 1):
        own = values[label]
        width = own.std(ddof=1) * len(own) ** -0.2
        at = np.linspace(own.min() - 3 * width, own.max() + 3 * width, 200)
        direct = np.exp(-(((at[:, None] - own) / width) ** 2) / 2).sum(axis=1) / (width * math.sqrt(2 * math.pi) * 496)
        found = sorted((r["point"], r["value"], r["density"]) for r in got if r["churned"] == label)
        assert [f[1] for f in found] == pytest.approx(at)
        assert [f[2] for f in found] == pytest.approx(direct, abs=1e-6)


def test_scaled_histogram(spark):
    pandas = table()
    rows = scaled_histogram(frame(spark, pandas), "a", 5).collect()
    z = (pandas["a"] - pandas["a"].mean()) / pandas["a"].std(ddof=0)
    counts, edges = np.histogram(z, 5)
    own = sorted((r["bin"], r["lower"], r["cnt"]) for r in rows if r["scale"] == "scaled")
    assert [r[1] for r in own] == pytest.approx(edges[:-1]) and sum(r[2] for r in own) == counts.sum()
    assert [r["cnt"] for r in rows if r["scale"] == "raw"] == [r["cnt"] for r in rows if r["scale"] == "scaled"]

"""Forests without a depth limit: against plain trees, handed over early or late, on any partitions."""

import tracemalloc

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ebbtide.forest import kernel, model as stages
from ebbtide.forest.kernel import Forest
from ebbtide.forest.model import ForestClassifier, ForestModel


def made_up(seed, n=240):
    """Features with ties, a 0/1 column, missing values; labels with noise, so that trees get deep."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, n), rng.normal(size=n).round(1), rng.random(n).round(2), rng.integers(0, 2, n)])
    x[rng.random(n) < 0.1, 1] = np.nan
    y = ((x[:, 0] > 4) ^ (x[:, 2] > 0.5) ^ (rng.random(n) < 0.2)).astype(float)
    return x, y, np.where(y > 0, 2.5, 1.0)


def frame(spark, data, parts=3):
    x, y, w = data
    rows = [(i, [float(v) for v in a], float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w))]
    df = spark.createDataFrame(rows, "id long, x array<double>, label double, weight double")
    return df.repartition(parts).withColumn("features", array_to_vector("x"))


def fitted(spark, data, parts=3, task_bytes=1 << 26, **forest):
    stage = ForestClassifier(weightCol="weight", forest=Forest(**forest), keyCol="id", taskBytes=task_bytes)
    return stage.fit(frame(spark, data, parts))


def shares(spark, model, data):
    scored = model.transform(frame(spark, data)).select("id", "probability", "prediction").orderBy("id").collect()
    assert all((r.probability[1] > 0.5) == (r.prediction == 1) for r in scored)
    return np.array([r.probability[1] for r in scored])


def plain_shares(x, y, w, forest, tree, name):
    """Every row's share by the definition: each drawn feature, each threshold, pure leaves."""
    x = np.where(np.isnan(x), -np.inf, x)
    out = np.empty(len(x))

    def impurity(rows):
        n = w[rows].sum()
        p = w[rows][y[rows] > 0].sum() / n
        return n * 2 * p * (1 - p)

    def go(rows, name):
        if len(set(y[rows])) > 1:
            order = kernel.feature_order(name, x.shape[1])
            most = forest.drawn(x.shape[1])
            for start in range(0, len(order), most):
                best = None
                for f in order[start : start + most]:
                    for cut in np.unique(x[rows, f])[:-1]:
                        left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                        gain = impurity(rows) - impurity(left) - impurity(right)
                        if best is None or gain > best[0] + 1e-9:
                            best = gain, left, right
                if best:
                    go(best[1], kernel.child_name(name, False))
                    go(best[2], kernel.child_name(name, True))
                    return
        out[rows] = w[rows][y[rows] > 0].sum() / w[rows].sum()

    go(np.arange(len(x)), name)
    return out


def test_trees_equal_plain_ones(spark):
    x, y, w = made_up(1, 150)
    forest = Forest(trees=3, bootstrap=False)
    expected = sum(plain_shares(x, y, w, forest, t, kernel.root_name(42, t)) for t in range(3)) / 3
    got = shares(spark, fitted(spark, (x, y, w), trees=3, bootstrap=False), (x, y, w))
    assert np.allclose(got, expected)


@pytest.mark.parametrize("bootstrap", [True, False])
def test_trees_do_not_depend_on_where_rows_are_handed_over(spark, bootstrap):
    """Rows told apart by cuts: levels of jobs, or one task from the root, give the same trees."""
    data = made_up(2)
    late = fitted(spark, data, trees=4, bootstrap=bootstrap)
    early = fitted(spark, data, parts=5, task_bytes=8 * 4 * 30, trees=4, bootstrap=bootstrap)
    assert late.trees.where("node >= 0").count() == 4
    assert early.trees.where("node >= 0").count() > 12
    assert late.size() == early.size()
    if not bootstrap:  # rows out of the sample may lie between two thresholds
        assert (shares(spark, late, data) == shares(spark, early, data)).all()
    assert np.allclose(late.featureImportances.toArray(), early.featureImportances.toArray())


def test_depth_has_no_end(spark):
    """Labels that take turns along one feature: one row a leaf, far beyond thirty levels."""
    n = 400
    data = np.arange(n, dtype=float)[:, None], (np.arange(n) % 2).astype(float), np.ones(n)
    deep = fitted(spark, data, trees=1, bootstrap=False)
    assert deep.size()["nodes"] >= 2 * n - 1 and deep.size()["depth"] > 30
    assert (shares(spark, deep, data) == data[1]).all()
    flat = fitted(spark, data, trees=1, bootstrap=False, max_depth=3)
    assert flat.size()["depth"] <= 3
    short = fitted(spark, data, task_bytes=8 * 50, trees=1, bootstrap=False, max_depth=3)
    assert short.size()["depth"] <= 3


def test_join_gives_the_scores_of_the_broadcast(spark, monkeypatch):
    data = made_up(3)
    own = fitted(spark, data, task_bytes=8 * 4 * 30, trees=5)
    whole = shares(spark, own, data)
    monkeypatch.setattr(stages, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(stages, "TASK_BYTES", 8 * 4 * 10)  # a node's rows are dealt to several tasks
    assert (shares(spark, own, data) == whole).all()


def test_sample_is_poisson():
    keys = np.arange(200_000).astype(np.uint64)
    times = kernel.times_drawn(Forest(), 3, keys)
    assert abs(times.mean() - 1) < 0.01 and abs(times.var() - 1) < 0.02 and abs((times == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(times, kernel.times_drawn(Forest(), 4, keys))[0, 1]) < 0.01


def test_learns_and_survives_saving(spark, tmp_path):
    learn, test = made_up(4, 800), made_up(5, 400)
    own = fitted(spark, learn, trees=60)
    got = shares(spark, own, test)
    assert ((got > 0.5) == (test[1] > 0)).mean() > 0.7  # a fifth of the labels is noise
    importance = own.featureImportances.toArray()
    assert np.isclose(importance.sum(), 1) and importance[3] < importance[0] and importance[3] < importance[2]
    path = str(tmp_path / "forest")
    own.write().overwrite().save(path)
    again = ForestModel.load(path)
    assert again.numFeatures == 4 and (shares(spark, again, test) == got).all()


def test_edge_rows(spark):
    x, y, w = made_up(6, 40)
    same = np.ones_like(x), y, w  # nothing tells rows apart
    own = fitted(spark, same, trees=2, bootstrap=False)
    assert np.allclose(shares(spark, own, same), w[y > 0].sum() / w.sum())
    large = fitted(spark, same, task_bytes=8 * 4 * 5, trees=2, bootstrap=False)
    assert np.allclose(shares(spark, large, same), w[y > 0].sum() / w.sum())
    one_class = fitted(spark, (x, np.ones_like(y), w), trees=2)
    assert (shares(spark, one_class, (x, y, w)) == 1).all()
    df = frame(spark, (x, y, w))
    empty = ForestClassifier(forest=Forest(trees=2)).fit(df.limit(0))
    assert empty.transform(df).where("prediction = 0").count() == 40
    assert own.transform(df.limit(0)).count() == 0
    clash = df.withColumn("tree", F.lit(1)).withColumn("node", F.lit("a"))
    assert own.transform(clash).select("tree", "node", "prediction").count() == 40


def test_features_of_many_rows_are_looked_at_one_by_one(monkeypatch):
    """The same trees, and at the root a fraction of the memory."""
    x, y, w = made_up(21, 600)
    x, weights = np.where(np.isnan(x), -np.inf, x), np.column_stack([w * (y == 0), w * (y > 0)])
    ways = []
    for most in (0, 1 << 14):
        monkeypatch.setattr(kernel, "TOGETHER_ROWS", most)
        ways.append([kernel.grow(Forest(features=f), kernel.root_name(1, t), 0, x, weights) for f in (1, 2, 4) for t in range(3)])
    for a, b in zip(*ways):
        assert a.depth == b.depth and all(np.array_equal(u, v) for u, v in zip(a[:-1], b[:-1]))

    rng = np.random.default_rng(2)
    large, labels = rng.random((1 << 16, 9)), rng.integers(0, 2, 1 << 16)
    tracemalloc.start()
    kernel.grow(Forest(features=9, max_depth=1), 7, 0, large, np.column_stack([labels == 0, labels == 1]).astype(float))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * large.nbytes

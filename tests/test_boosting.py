"""Second-order boosting: against plain numpy, together against one by one, on any partitions."""

import heapq
import math
import tracemalloc

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ebbtide.boosting import kernel, train as jobs
from ebbtide.boosting.growth import GrowingTree
from ebbtide.boosting.model import BoostedModel, BoostingClassifier
from ebbtide.boosting.params import DROPPING, LEAF_WISE, LINEAR, Booster
from ebbtide.boosting.train import Fit, train
from ebbtide.explain import leafgame
from ebbtide.explain.trees import leaves
from ebbtide.session import ARROW_BYTES, ARROW_BYTES_CONF, bound_batches

WIDTH = 4


def made_up(seed, n=300, missing=0.1):
    """Features with ties, a 0/1 column and missing values; labels that depend on them; weights."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, n), rng.normal(size=n).round(2), rng.random(n), rng.integers(0, 2, n)])
    score = x[:, 0] - 4 + 2 * np.sin(3 * x[:, 1]) + 3 * x[:, 3] * (x[:, 2] > 0.5)
    y = (score + rng.normal(size=n) > 0).astype(float)
    x[rng.random((n, WIDTH)) < missing] = np.nan
    x[:, 3] = np.nan_to_num(x[:, 3])
    return x, y, np.where(y > 0, 2.5, 1.0)


def stack(spark, data, part=0, held=None):
    x, y, w = data
    held = np.zeros(len(y), bool) if held is None else held
    rows = [
        (part, i, bool(h), float(b), float(c), [None if math.isnan(v) else float(v) for v in a])
        for i, (a, b, c, h) in enumerate(zip(x, y, w, held))
    ]
    return spark.createDataFrame(rows, jobs.STACK)


def score(g, h, b):
    return max(abs(g) - b.reg_alpha, 0) ** 2 / (h + b.reg_lambda)


def plain_tree(x, g, h, b):
    """The tree by its definition: every threshold, both ways for missing values, best-first or by level."""

    def split_of(rows):
        best = (0.0, None)
        for f in range(x.shape[1]):
            v = x[rows, f]
            values = np.unique(v[~np.isnan(v)])
            for cut in [*(values[:-1] + values[1:]) / 2, np.inf]:
                for left_too in (False, True):
                    left = (v <= cut) | (np.isnan(v) & left_too)
                    l, r = rows[left], rows[~left]
                    if not len(l) or not len(r) or h[l].sum() < b.min_child_weight or h[r].sum() < b.min_child_weight:
                        continue
                    both = score(g[rows].sum(), h[rows].sum(), b)
                    gain = (score(g[l].sum(), h[l].sum(), b) + score(g[r].sum(), h[r].sum(), b) - both) / 2 - b.gamma
                    if gain > best[0] + 1e-9:
                        best = (gain, (l, r))
        return best

    out = np.zeros(len(g))
    start = np.arange(len(g))
    gain, parts = split_of(start)
    order = (lambda d, i, gain: (d, i)) if b.growth != LEAF_WISE else (lambda d, i, gain: (-gain, i))
    open_, done, count, made = [], [], 1, 1
    (heapq.heappush(open_, (order(0, 0, gain), 0, parts)) if parts else done.append(start))
    rest = {}
    while open_:
        _, depth, (l, r) = heapq.heappop(open_)
        if b.max_leaves and count >= b.max_leaves:
            done.append(np.concatenate([l, r]))
            continue
        count += 1
        for rows in (l, r):
            gain, parts = split_of(rows) if depth + 1 != b.max_depth else (0, None)
            made += 1
            if parts:
                heapq.heappush(open_, (order(depth + 1, made, gain), depth + 1, parts))
            else:
                done.append(rows)
    assert sum(map(len, done)) == len(g) and not rest
    for rows in done:
        out[rows] = kernel.leaf_value(g[rows].sum(), h[rows].sum(), b.reg_lambda, b.reg_alpha)
    return out, len(done)


def plain_boosting(x, y, w, b):
    margin = np.zeros(len(y))
    for _ in range(b.rounds):
        g, h = kernel.gradients(margin, y, w)
        margin += b.eta * plain_tree(x, g, h, b)[0]
    return margin


def margins(fit, cuts, x):
    codes = kernel.code_rows(x, cuts)
    return sum(w * t.value[kernel.leaf_of(t, codes)] for t, w in zip(fit.trees, fit.weights))


BOOSTERS = {
    "plain": Booster(rounds=5, max_depth=3),
    "penalties": Booster(rounds=4, max_depth=4, reg_lambda=0.3, reg_alpha=1.5, gamma=0.4, min_child_weight=4.0),
    "no depth limit": Booster(rounds=3, max_depth=0, min_child_weight=3.0),
    "leaves": Booster(rounds=4, max_depth=0, max_leaves=7, growth=LEAF_WISE, min_child_weight=0.5),
    "leaves of levels": Booster(rounds=3, max_depth=4, max_leaves=6),
}


@pytest.mark.parametrize(
    ("name", "block"), [*[(name, 1 << 14) for name in BOOSTERS], ("penalties", 90), ("leaves", 90)]
)
def test_margins_equal_plain_boosting(spark, monkeypatch, name, block):
    """Grown in one task, and level by level over several blocks."""
    monkeypatch.setattr(jobs, "BLOCK_ROWS", block)
    data = made_up(1)
    fit = Fit(0, BOOSTERS[name])
    trainer = train(stack(spark, data), [fit], {0: {3}})
    assert margins(fit, trainer.cuts[0], data[0]) == pytest.approx(plain_boosting(*data, BOOSTERS[name]), abs=1e-6)
    assert fit.loss[0][0] == pytest.approx(math.log(2)) and fit.loss[-1][0] < fit.loss[0][0]
    if BOOSTERS[name].max_leaves:
        assert all((t.feature >= 0).sum() + 1 <= BOOSTERS[name].max_leaves for t in fit.trees)


def test_leaf_wise_differs_from_level_wise(spark):
    data = made_up(4)
    fits = [Fit(0, Booster(rounds=1, max_depth=0, max_leaves=6, growth=g, min_child_weight=0.1)) for g in (LEAF_WISE, "level")]
    train(stack(spark, data), fits)
    deep, wide = (f.trees[0].depth for f in fits)
    assert deep > wide


def test_best_first_needs_as_many_jobs_as_levels():
    """Children are asked for on trial, for all leaves that may come to their turn."""
    rng = np.random.default_rng(0)
    tree = GrowingTree(Booster(max_depth=0, max_leaves=20, growth=LEAF_WISE))
    asked = []
    while wanted := tree.wanted():
        asked.append(len(wanted))
        for i in wanted:
            depth = tree.nodes[i].depth
            feature = 0 if depth < 9 else -1
            tree.learn(i, kernel.Split(feature, 1, False, float(rng.random()) if feature == 0 else 0.0, 0.0, 1.0, 0.0, 0.5))
    done = tree.finished()
    assert (done.feature >= 0).sum() == 19
    assert len(asked) <= 10 and max(asked) <= 2 * 20


KINDS = [
    Booster(rounds=3, max_depth=3, subsample=0.6, colsample=0.5, seed=1),
    Booster(rounds=4, max_depth=2, kind=DROPPING, rate_drop=0.4, skip_drop=0.1, seed=2),
    Booster(rounds=4, max_depth=2, kind=DROPPING, rate_drop=0.5, drop_by_weight=True, normalise_forest=True, seed=3),
    Booster(rounds=3, max_leaves=4, growth=LEAF_WISE, max_depth=0, seed=4),
    Booster(rounds=4, kind=LINEAR, eta=0.5, reg_alpha=0.01, reg_lambda=0.1),
]


@pytest.fixture(scope="module")
def folds(spark):
    """Two folds of the same rows, and every kind fitted to each by itself."""
    data = made_up(2, 200)
    held = [np.arange(200) % 3 == k for k in range(2)]
    frames = [stack(spark, data, k, held[k]) for k in range(2)]
    alone = []
    for k in range(2):
        for b in KINDS:
            fit = Fit(k, b)
            trainer = train(frames[k], [fit], {k: {3}}, judge=True)
            alone.append((fit, trainer.cuts[k]))
    return data, held, frames, alone


@pytest.mark.parametrize("blocks", [(1 << 14, 10, 3), (120, 2, 9)])
def test_many_fits_equal_one_by_one(folds, monkeypatch, blocks):
    """Folds and boosters of all kinds side by side, in other blocks and partitions, stored at other rounds."""
    size, every, tasks = blocks
    data, held, frames, alone = folds
    monkeypatch.setattr(jobs, "BLOCK_ROWS", size)
    monkeypatch.setattr(jobs, "STORE_EVERY", every)
    together = [Fit(k, b) for k in range(2) for b in KINDS]
    both = frames[0].unionAll(frames[1]).repartition(tasks)
    trainer = train(both, together, {0: {3}, 1: {3}}, judge=True)
    for (one, cuts), fit in zip(alone, together):
        assert all(np.array_equal(a, b) for a, b in zip(cuts, trainer.cuts[fit.part]))
        assert fit.weights == one.weights and fit.confusion == one.confusion
        assert fit.loss == [pytest.approx(pair, rel=1e-9) for pair in one.loss]
        for a, b in zip(fit.trees, one.trees):
            assert all(np.array_equal(u, v) for u, v in zip(a, b))
        if fit.booster.kind == LINEAR:
            assert fit.linear == pytest.approx(one.linear, rel=1e-9)
    fit = together[0]
    x, y, w = data
    m = margins(fit, trainer.cuts[0], x)
    own = held[0]
    assert fit.loss[-1][1] == pytest.approx(kernel.losses(m[own], y[own], w[own]) / w[own].sum())
    cells = np.bincount((2 * y + (m > 0)).astype(int)[own], minlength=4)
    assert fit.confusion == tuple(cells)


@pytest.mark.parametrize("block", [1 << 14, 70])
def test_a_part_in_one_task_equals_level_by_level(spark, monkeypatch, block):
    """Models, losses and counts of all kinds; the one way runs one job for all rounds."""
    monkeypatch.setattr(jobs, "BLOCK_ROWS", block)
    data = made_up(12, 200)
    frame = stack(spark, data, held=np.arange(200) % 4 == 0)
    kinds = [*KINDS, Booster(rounds=12, eta=0.9, max_depth=3, early_stop=2, min_child_weight=0.1)]
    ways = []
    for most in (1 << 26, -1):
        monkeypatch.setattr(jobs, "WHOLE_BYTES", most)
        own = [Fit(0, b) for b in kinds]
        trainer = jobs.Trainer(frame, own, {0: {3}})
        assert trainer.shared == ([] if most > 0 else list(range(len(kinds))))
        trainer.fit(judge=True)
        trainer.close()
        ways.append(own)
    for a, b in zip(*ways):
        assert a.weights == b.weights and a.confusion == b.confusion and len(a.loss) == len(b.loss)
        assert a.loss == [pytest.approx(pair, rel=1e-12) for pair in b.loss]
        assert a.gains == b.gains and a.covers == b.covers and len(a.trees) == len(b.trees)
        for s, t in zip(a.trees, b.trees):
            assert all(np.array_equal(u, v) for u, v in zip(s, t))
        if a.booster.kind == LINEAR:
            assert np.array_equal(a.linear, b.linear)


def test_parts_too_large_for_a_task_are_shared_out(spark, monkeypatch):
    monkeypatch.setattr(jobs, "WHOLE_ROWS", 100)
    frame = stack(spark, made_up(13, 150))
    for number, shared in ((1, 1), (spark.sparkContext.defaultParallelism, 0)):
        trainer = jobs.Trainer(frame, [Fit(0, Booster(rounds=1)) for _ in range(number)])
        assert len(trainer.shared) == shared
        trainer.close()


def test_dropped_trees_are_rescaled(spark):
    """Factors by the published rule, and the loss is that of the whole model."""
    data = made_up(7, 150)
    b = Booster(rounds=8, max_depth=2, kind=DROPPING, rate_drop=0.5, skip_drop=0.2, seed=9)
    fit = Fit(0, b)
    trainer = train(stack(spark, data), [fit])
    weights = []
    for number in range(b.rounds):
        gone = b.dropped(number, weights)
        k = len(gone)
        weights = [w * k / (k + b.eta) if i in gone else w for i, w in enumerate(weights)]
        weights.append(b.eta / (k + b.eta) if k else b.eta)
    assert fit.weights == pytest.approx(weights) and any(w != b.eta for w in weights)
    m = margins(fit, trainer.cuts[0], data[0])
    assert fit.loss[-1][0] == pytest.approx(kernel.losses(m, *data[1:]) / data[2].sum())


def test_dropped_trees_are_left_out_of_the_gradients(spark):
    data = made_up(8, 150)
    b = Booster(rounds=2, max_depth=2, kind=DROPPING, rate_drop=1.0, skip_drop=0.0)
    fit = Fit(0, b)
    train(stack(spark, data), [fit])
    first, second = fit.trees  # with the first tree dropped the second one learns the same
    assert all(np.array_equal(u, v) for u, v in zip(first, second))


def test_linear_booster_meets_the_elastic_net_conditions(spark):
    x, y, w = made_up(3, missing=0.0)
    l1, l2 = 0.03, 0.2
    fit = Fit(0, Booster(rounds=60, kind=LINEAR, eta=0.5, reg_alpha=l1, reg_lambda=l2))
    train(stack(spark, (x, y, w)), [fit])
    beta, b = fit.linear[:-1], fit.linear[-1]
    g, _ = kernel.gradients(x @ beta + b, y, w)
    slope = x.T @ g / w.sum() + l2 * beta
    assert g.sum() == pytest.approx(0, abs=1e-6)
    for s, v in zip(slope, beta):
        assert s == pytest.approx(-l1 * np.sign(v), abs=1e-6) if v else abs(s) <= l1 + 1e-9
    assert (beta == 0).any() and (beta != 0).any()


def test_a_weight_of_two_is_a_row_twice(spark):
    x, y, _ = made_up(5, 150)
    twice = (np.concatenate([x, x[y > 0]]), np.concatenate([y, y[y > 0]]), np.ones(len(y) + int(y.sum())))
    fits = []
    for data in ((x, y, np.where(y > 0, 2.0, 1.0)), twice):
        fit = Fit(0, Booster(rounds=3, max_depth=3))
        trainer = train(stack(spark, data), [fit])
        fits.append(margins(fit, trainer.cuts[0], x))
    assert fits[0] == pytest.approx(fits[1], abs=1e-6)


def test_many_values_are_cut_into_ranges_of_equal_weight(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 1))
    w = rng.random(900) + 0.1
    frame = spark.createDataFrame([(0, i, False, 0.0, float(b), [float(a)]) for i, ((a,), b) in enumerate(zip(x, w))], jobs.STACK)
    cuts = jobs.learn_cuts(frame, {}, 19)[0][0]
    assert len(cuts) == 19
    sums = np.bincount(np.searchsorted(cuts, x[:, 0]), w, 20)
    assert sums == pytest.approx(np.full(20, w.sum() / 20), abs=1.2)
    few = stack(spark, made_up(1))
    assert len(jobs.learn_cuts(few, {})[0][0]) == 8


@pytest.fixture(scope="module")
def vectors(spark):
    x, y, w = made_up(6)
    rows = [([float(v) for v in a], float(b), float(c), i % 4 == 0) for i, (a, b, c) in enumerate(zip(x, y, w))]
    frame = spark.createDataFrame(rows, "x array<double>, label double, weight double, held boolean")
    return frame.withColumn("features", array_to_vector("x"))


def test_model_scores_saves_and_explains(spark, vectors, tmp_path):
    model = BoostingClassifier(weightCol="weight", booster=Booster(rounds=5, max_depth=3)).fit(vectors)
    scored = model.transform(vectors).select("x", "rawPrediction", "probability", "prediction", "label").collect()
    margin = np.array([r["rawPrediction"][1] for r in scored])
    assert [r["probability"][1] for r in scored] == pytest.approx(1 / (1 + np.exp(-margin)))
    assert [r["prediction"] for r in scored] == [float(m > 0) for m in margin]
    assert np.mean([r["prediction"] == r["label"] for r in scored]) > 0.8
    model.write().overwrite().save(f"{tmp_path}/m")
    again = BoostedModel.load(f"{tmp_path}/m").transform(vectors).collect()
    assert sorted(r["rawPrediction"][1] for r in again) == sorted(margin)
    assert sum(model.featureImportances.toArray()) == pytest.approx(1)
    found = leaves(spark, model)
    games = [leafgame.prepare(l.features, l.low, l.high, l.cover, l.value, l.missing) for l in found]
    x = np.array([r["x"] for r in scored])
    assert np.isnan(x).any()
    base = sum(l.value * math.prod(l.cover) for l in found)
    assert leafgame.explain_rows(x, games).sum(axis=1) + base == pytest.approx(margin)


def test_early_stop_keeps_the_best_round(vectors):
    learner = BoostingClassifier(heldCol="held", booster=Booster(rounds=60, eta=0.8, max_depth=6, early_stop=3, min_child_weight=0.1))
    model = learner.fit(vectors)
    held = [h for _, h in model.loss]
    assert len(held) < 61
    assert len(model.trees) == int(np.argmin(held))
    assert len(held) == int(np.argmin(held)) + 3 + 2  # a round is under way when its loss is known


def test_rows_that_cannot_be_learned_from(spark):
    """Null labels are left out; a single class, a constant feature and no rows at all give a model."""
    x = [[1.0, None], [1.0, None], [1.0, None]]
    rows = [(0, i, False, label, 1.0, v) for i, (label, v) in enumerate(zip((1.0, None, 1.0), x))]
    fit = Fit(0, Booster(rounds=2))
    train(spark.createDataFrame(rows, jobs.STACK), [fit])
    assert all(len(t.feature) == 1 and t.value[0] > 0 for t in fit.trees)


def test_blocks_of_shared_fits_are_dealt_evenly(spark, monkeypatch):
    """A few small files would be packed into fewer tasks than there are cores."""
    from ebbtide.boosting import train as module

    monkeypatch.setattr(module, "BLOCK_ROWS", 50)
    monkeypatch.setattr(module, "WHOLE_ROWS", 0)
    stack = spark.range(0, 800, 1, 2).selectExpr(
        "0 as part", "xxhash64(id) as key", "false as held", "cast(id % 3 = 0 as double) as label", "1d as weight",
        "array(cast(id % 7 as double), cast(id % 3 as double)) as x",
    )
    trainer = module.Trainer(stack, [module.Fit(0, module.Booster(rounds=2))])
    sizes = trainer.blocks.rdd.glom().map(lambda rows: sum(r["n"] for r in rows)).collect()
    assert sum(sizes) == 800 and len([n for n in sizes if n]) >= spark.sparkContext.defaultParallelism
    assert max(sizes) <= 300
    trainer.close()


def test_leaves_by_flat_lookup_equal_walks():
    """Missing codes go where the node sends them; leaves above the greatest depth keep their rows."""
    from ebbtide.boosting import kernel

    tree = kernel.Tree(
        np.array([0, 1, -1, -1, -1]), np.array([2, 1, 0, 0, 0]), np.array([False, True, False, False, False]),
        np.array([1, 3, 0, 0, 0]), np.array([2, 4, 0, 0, 0]), np.zeros(5), 2,
    )
    codes = np.array([[a, b] for a in range(5) for b in range(4)], np.uint16)
    walked = kernel.descend(tree, codes, np.arange(len(codes)), np.zeros(len(codes), np.int64))
    assert (kernel.leaf_of(tree, codes) == walked).all()
    assert set(walked) == {2, 3, 4}


def peak_of(work):
    """Bytes at once that `work` takes, and what it gives."""
    tracemalloc.start()
    try:
        given = work()
        return tracemalloc.get_traced_memory()[1], given
    finally:
        tracemalloc.stop()


def test_a_histogram_of_many_rows_takes_little_memory():
    rng = np.random.default_rng(3)
    n, each = 1 << 18, 16
    codes, place = rng.integers(0, 8, (n, each)).astype(np.uint16), rng.integers(-1, 3, n)
    g, h = rng.integers(-9, 9, n).astype(float), rng.integers(0, 9, n).astype(float)
    offsets = np.arange(each) * 8
    peak, found = peak_of(lambda: kernel.histogram(codes, offsets, 8 * each, place, 3, g, h))
    assert peak < n * each * 8  # the cells of all rows would take that much alone
    expected = np.zeros((3, 2, 8 * each))
    for s, v in enumerate((g, h)):
        for i in range(each):
            np.add.at(expected, (place[place >= 0], s, offsets[i] + codes[place >= 0, i]), v[place >= 0])
    assert np.array_equal(found, expected)


def test_blocks_that_are_kept_lie_in_small_partitions(spark, monkeypatch):
    """However many rows there are for a core: a task has a partition in memory, and a batch of it in Python."""
    for name, value in (("BLOCK_ROWS", 4), ("KEPT_BYTES", 4 * 60), ("WHOLE_ROWS", 0), ("WHOLE_BYTES", -1)):
        monkeypatch.setattr(jobs, name, value)
    trainer = jobs.Trainer(stack(spark, made_up(14, 240)), [Fit(0, Booster(rounds=1)), Fit(0, Booster(kind=LINEAR, rounds=1))])
    assert trainer.blocks.rdd.getNumPartitions() == 60 > 2 * spark.sparkContext.defaultParallelism
    assert max(len(p) for p in trainer.blocks.rdd.glom().collect()) <= 4
    trainer.close()
    assert spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= ARROW_BYTES


def test_a_smaller_limit_of_batches_is_left_alone(spark):
    before = spark.conf.get(ARROW_BYTES_CONF)
    try:
        for given, then in (("1m", 1 << 20), ("64m", ARROW_BYTES)):
            spark.conf.set(ARROW_BYTES_CONF, given)
            bound_batches(spark)
            assert spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() == then
    finally:
        spark.conf.set(ARROW_BYTES_CONF, before)

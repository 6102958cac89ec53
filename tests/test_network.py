"""The network: gradients by differences, seeds, batches, held-out loss, scores."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from ebbtide import session
from ebbtide.boosting.kernel import losses
from ebbtide.models import network as net
from ebbtide.models.network import Network, NetworkClassifier, NetworkModel
from ebbtide.session import materialize


def made_up(seed=0, n=400):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(n) < 0.05)).astype(float)  # no line tells these apart
    return x, y, np.where(y > 0, 2.0, 1.0)


@pytest.mark.parametrize("hidden", [(), (4,), (5, 3)])
def test_gradient_equals_differences(hidden):
    x, y, w = made_up(n=30)
    weights = net.first_weights(3, Network(hidden=hidden)) + 0.01
    loss, slope = net.gradient(net.layers(weights, 3, hidden), x, y, w)
    margin = net.forward(net.layers(weights, 3, hidden), x)[-1][:, 0]
    assert loss == pytest.approx(losses(margin, y, w))
    for i in range(len(weights)):
        step = np.zeros_like(weights)
        step[i] = 1e-6
        up, down = (net.gradient(net.layers(weights + s, 3, hidden), x, y, w)[0] for s in (step, -step))
        assert slope[i] == pytest.approx((up - down) / 2e-6, abs=1e-4)


@pytest.fixture(scope="module")
def rows(spark):
    x, y, w = made_up()
    data = [(i, [float(v) for v in a], float(b), float(c), i % 4 == 0) for i, (a, b, c) in enumerate(zip(x, y, w))]
    data.append((900, [0.0, 0.0, 0.0], None, 1.0, False))  # no label: not learned from
    frame = spark.createDataFrame(data, "id long, x array<double>, label double, weight double, held boolean")
    return frame.withColumn("features", array_to_vector("x"))


def fit(rows, **params):
    return NetworkClassifier(weightCol="weight", keyCol="id", heldCol="held", network=Network(**params)).fit(rows)


def test_steps_equal_plain_adam(rows):
    """One batch an epoch: the same weights as by hand, on the same rows."""
    model = fit(rows, hidden=(4,), epochs=3, batches=1, learn_rate=0.1)
    x, y, w = made_up()
    own = np.arange(400) % 4 != 0
    weights = net.first_weights(3, Network(hidden=(4,)))
    slow = fast = np.zeros_like(weights)
    for step in range(1, 4):
        loss, slope = net.gradient(net.layers(weights, 3, (4,)), x[own], y[own], w[own])
        assert model.loss[step - 1][0] == pytest.approx(loss / w[own].sum())
        slope /= w[own].sum()
        slow, fast = 0.9 * slow + 0.1 * slope, 0.999 * fast + 0.001 * slope**2
        weights = weights - 0.1 * slow / (1 - 0.9**step) / (np.sqrt(fast / (1 - 0.999**step)) + 1e-8)
    margin = net.forward(net.layers(weights, 3, (4,)), x)[-1][:, 0]
    got = {r["id"]: r["rawPrediction"][1] for r in model.transform(rows).collect()}
    assert [got[i] for i in range(400)] == pytest.approx(margin)
    assert model.loss[3][1] == pytest.approx(losses(margin[~own], y[~own], w[~own]) / w[~own].sum())


def test_learns_what_no_line_tells_apart(rows, tmp_path):
    model = fit(rows, hidden=(12,), epochs=25, batches=3, learn_rate=0.05, early_stop=6)
    held = [h for _, h in model.loss]
    assert min(held) < 0.8 * held[0]
    again = fit(rows, hidden=(12,), epochs=25, batches=3, learn_rate=0.05, early_stop=6)
    assert again.loss == model.loss and again.getOrDefault("content") == model.getOrDefault("content")
    assert fit(rows, hidden=(12,), epochs=1, seed=7).loss[0] != model.loss[0]
    scored = model.transform(rows.where("label IS NOT NULL")).collect()
    assert np.mean([r["prediction"] == r["label"] for r in scored]) > 0.8
    x, y, w = (np.array([r[c] for r in scored if r["held"]]) for c in ("x", "label", "weight"))
    margin = np.array([r["rawPrediction"][1] for r in scored if r["held"]])
    assert losses(margin, y, w) / w.sum() == pytest.approx(min(held))  # the weights of the least loss
    model.write().overwrite().save(f"{tmp_path}/m")
    loaded = NetworkModel.load(f"{tmp_path}/m").transform(rows).collect()
    assert sorted(r["probability"][1] for r in loaded) == sorted(r["probability"][1] for r in model.transform(rows).collect())


def test_batches_share_out_all_rows(spark, rows):
    """The batches of an epoch are disjoint and cover the rows to learn from, in another way each epoch."""
    keys = np.arange(1000).astype(np.uint64)
    seen = []
    for epoch in range(2):
        ends = [net.drawn(keys, epoch + 1, (b + 1) / 4) & ~(net.drawn(keys, epoch + 1, b / 4) if b else np.zeros(1000, bool)) for b in range(4)]
        assert (sum(e.astype(int) for e in ends) == 1).all()
        seen.append(ends[0])
    assert (seen[0] != seen[1]).any()


def test_one_block_takes_all_steps_in_its_task(spark, rows, monkeypatch):
    """The same steps as by a job each over several blocks, but for the order of the sums."""
    own = dict(hidden=(4,), epochs=6, batches=2, learn_rate=0.05)
    steps = []
    by_jobs = net._steps
    monkeypatch.setattr(net, "_steps", lambda *a: steps.append(a) or by_jobs(*a))
    whole = fit(rows, **own)
    assert not steps  # no job per step
    monkeypatch.setattr(net, "BLOCK_ROWS", 150)
    shared = fit(rows, **own)
    assert len(steps) == 1
    assert [a for a, _ in whole.loss] == pytest.approx([a for a, _ in shared.loss], rel=1e-9)
    assert [b for _, b in whole.loss] == pytest.approx([b for _, b in shared.loss], rel=1e-9)


def test_blocks_lie_in_small_partitions(spark, rows, monkeypatch):
    """More rows for a core are more partitions, not larger ones; and nothing is left in the shared folder."""
    kept = []
    monkeypatch.setattr(net, "materialize", lambda df, name: kept.append(materialize(df, name)) or kept[-1])
    monkeypatch.setattr(net, "BLOCK_ROWS", 5)
    monkeypatch.setattr(net, "KEPT_BYTES", 10 * (3 * 8 + 25))
    NetworkClassifier(labelCol="label", network=Network(hidden=(2,), epochs=1), keyCol="id").fit(rows)
    (stored,) = kept
    assert stored not in session._stage_paths
    found = NetworkClassifier(labelCol="label", keyCol="id")._blocks(rows, 3)
    assert found.rdd.getNumPartitions() == 40 > spark.sparkContext.defaultParallelism

"""Synchronous nets: the same for any number of tasks, and equal to Adam in one process."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewright.operators import net as nets
from tablewright.operators.net import Autoencoder, Net, NetClassifier, NetRegressor

CFG = {"epochs": 5, "batch_size": 64, "learning_rate": 0.02, "alpha": 0.01, "noise_std": 0.0, "tol": None}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float) + (x[:, 2] > 1)
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))],
                               "id long, x array<double>, y double").persist()
    return df, x, y


def plain_adam(net, groups, x, y, cfg, seed):
    """Adam with written-out derivatives of a net of one hidden layer; y one-hot or values."""
    flat, m, v, t = net.flat.copy(), 0.0, 0.0, 0
    for epoch in range(cfg["epochs"]):
        for some in nets.batches_of(nets.batch_count(len(x), cfg["batch_size"]), seed, epoch):
            rows = np.flatnonzero(np.isin(groups, some))
            if not len(rows):
                continue
            (w1, b1), (w2, b2) = net.layers(flat)
            inp = x[rows]
            hidden = np.maximum(inp @ w1 + b1, 0)
            out = hidden @ w2 + b2
            if net.loss == "softmax":
                p = np.exp(out) / np.exp(out).sum(axis=1, keepdims=True)
                delta = (p - y[rows]) / len(rows)
            else:
                delta = 2 * (out - y[rows]) / out.size
            back = (delta @ w2.T) * (hidden > 0)
            g = np.concatenate([(inp.T @ back + cfg["alpha"] * w1 / len(rows)).ravel(), back.sum(axis=0),
                                (hidden.T @ delta + cfg["alpha"] * w2 / len(rows)).ravel(), delta.sum(axis=0)])
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            flat = flat - cfg["learning_rate"] * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return flat


@pytest.mark.parametrize("loss", ["softmax", "mse"])
def test_same_weights_for_any_number_of_tasks(spark, data, loss):
    df, x, y = data
    rows = df.select(F.xxhash64("id").alias("key"), "x", "y")
    count = nets.batch_count(400, 64) * nets.GROUPS
    groups = np.array([r.g for r in rows.select(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(count)).alias("g")).collect()])
    start = Net([3, 6, 3 if loss == "softmax" else 1], loss, seed=1)
    cfg = {**CFG, "mean": [0.1, 0.0, 0.0], "std": [1.0, 2.0, 1.0]}
    scaled = (x - np.array(cfg["mean"])) / np.array(cfg["std"])
    target = np.eye(3)[y.astype(int)] if loss == "softmax" else y.reshape(-1, 1)
    want = plain_adam(start, groups, scaled, target, CFG, 7)
    assert np.abs(want - start.flat).max() > 0.05
    for tasks in (1, 3, 8):
        got, value = nets.train(rows.repartition(5), 400, start, cfg, 7, "class" if loss == "softmax" else "value", tasks)
        assert np.allclose(got.flat, want, rtol=0, atol=1e-9) and np.isfinite(value)


def test_noise_and_empty_tasks(spark, data):
    """Denoising draws noise by key, wherever a row is; some tasks have no rows."""
    df, x, _ = data
    rows = df.limit(5).select(F.xxhash64("id").alias("key"), "x").persist()
    cfg = {**CFG, "noise_std": 0.3, "mean": [0.0] * 3, "std": [1.0] * 3}
    start = Net([3, 4, 2, 4, 3], "mse", 1, seed=2)
    one, many = (nets.train(rows, 5, start, cfg, 3, "input", tasks)[0].flat for tasks in (1, 6))
    assert np.allclose(one, many, rtol=0, atol=1e-9) and not np.allclose(one, start.flat)


def test_batches_are_dealt_anew():
    first, second = (nets.batches_of(50, 42, e) for e in (0, 1))
    assert np.array_equal(first, nets.batches_of(50, 42, 0)) and not np.array_equal(first, second)
    assert sorted(first.ravel()) == sorted(second.ravel()) == list(range(50 * nets.GROUPS))
    assert nets.batch_count(10, 64) == 1 and nets.batch_count(10**9, 64) == nets.MOST_STEPS


def test_sums_of_many_tasks_meet_in_slots(data, monkeypatch):
    df, _, _ = data
    rows = df.select(F.xxhash64("id").alias("key"), "x", "y")
    cfg = {**CFG, "epochs": 1, "mean": [0.0] * 3, "std": [1.0] * 3}
    start = Net([3, 4, 1], "mse", seed=2)
    want = nets.train(rows, 400, start, cfg, 3, "value", 1)[0].flat
    monkeypatch.setattr(nets, "SLOTS", 2)
    assert np.allclose(nets.train(rows, 400, start, cfg, 3, "value", 5)[0].flat, want, rtol=0, atol=1e-9)


def test_training_ends_without_improvement(data):
    df, _, _ = data
    v = df.select("id", array_to_vector("x").alias("features"), F.col("y").alias("label"))
    options = dict(max_iter=10_000, tol=10.0, batch_size=100)
    assert NetClassifier.of("id", n_classes=3, **options).fit(v).transform(v).count() == 400
    assert NetRegressor.of(**options).fit(v).fitted["train_loss"] > 0


def test_nets_learn(data):
    df, _, _ = data
    v = df.select("id", array_to_vector("x").alias("features"), (F.get("x", F.lit(0)) * F.get("x", F.lit(1)) > 0).cast("double").alias("label"))
    model = NetClassifier.of("id", learning_rate_init=0.01).fit(v)
    assert model.transform(v).filter("prediction = label").count() > 380
    auto = Autoencoder.of("id", epochs=40, learning_rate=0.01, latent_dim=3).fit(v)
    assert auto.transform(v).agg(F.avg("score")).first()[0] < 0.2


def test_an_epoch_is_one_job_beyond_one_task(spark, data, monkeypatch):
    """Jobs grow with epochs and not with mini-batches; the net does not depend on partitions, and every row counts."""
    df, x, y = data
    monkeypatch.setattr(nets, "ROWS_PER_TASK", 100)
    rows = df.select(F.xxhash64("id").alias("key"), "x", "y")
    cfg = {**CFG, "epochs": 12, "batch_size": 10, "mean": [0.0] * 3, "std": [1.0] * 3}
    start = Net([3, 16, 3], "softmax", seed=2)
    spark.sparkContext.setJobGroup("shards", "")
    try:
        first, loss = nets.train(rows.repartition(5), 400, start, cfg, 3, "class")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("shards")) <= 2 * 12 + 4
    again, _ = nets.train(rows.repartition(2), 400, start, cfg, 3, "class")
    assert np.allclose(first.flat, again.flat, rtol=0, atol=1e-9)
    assert (first.forward(x)[-1].argmax(axis=1) == y).mean() > 0.8 and loss < 0.5


def test_noise_is_normal_and_goes_by_key():
    keys = np.arange(-20_000, 20_000)
    found = nets._hashed_noise(keys, 5, 2, 3, 0.5)
    assert found.shape == (40_000, 3) and np.array_equal(found[7:9], nets._hashed_noise(keys[7:9], 5, 2, 3, 0.5))
    assert np.abs(found.mean(axis=0)).max() < 0.01 and np.abs(found.std(axis=0) - 0.5).max() < 0.01
    assert np.abs(np.corrcoef(found.T) - np.eye(3)).max() < 0.02
    assert abs((np.abs(found) < 0.5).mean() - 0.6827) < 0.01 and not np.allclose(found, nets._hashed_noise(keys, 5, 3, 3, 0.5))


def test_larger_tables_draw_test_noise_at_once(spark, data, monkeypatch):
    """A generator for each row took 19 microseconds a row; beyond one task all rows of a batch are drawn by hashes."""
    df, _, _ = data
    monkeypatch.setattr(nets, "ROWS_PER_TASK", 100)
    v = df.select("id", array_to_vector("x").alias("features"))
    auto = Autoencoder.of("id", epochs=2, denoising=True).fit(v)
    keys = np.array([r.k for r in v.select(F.xxhash64("id").alias("k")).collect()])
    draws = nets._hashed_noise(keys, 7, nets.TEST_NOISE, 3, 0.1)
    found = [r.noisy for r in auto.denoise(v, 0.1, 7).collect()]
    assert np.allclose(sorted(found), sorted((draws ** 2).mean(axis=1)))


def test_gradients_in_single_precision(data):
    _, x, y = data
    for loss, target in (("softmax", np.eye(3)[y.astype(int)]), ("mse", x)):
        net = Net([3, 16, 3], loss, seed=2)
        whole, half = (nets.batch_sums(net, net.flat, np.arange(400), x.astype(t), target.astype(t), CFG, 1, 0)
                       for t in (np.float64, np.float32))
        assert np.allclose(whole, half, rtol=1e-4, atol=1e-3) and half.dtype == np.float64
    sure = Net([1, 2], "softmax", flat=[200.0, -200.0, 0.0, 0.0])
    one = nets.batch_sums(sure, sure.flat, np.arange(1), np.ones((1, 1), np.float32), np.array([[0, 1]], np.float32), CFG, 1, 0)
    assert np.isfinite(one).all()

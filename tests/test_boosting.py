"""Leaf-wise boosting against a plain one: every cut tried on raw values, one leaf after the other."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewright.operators import boosting
from tablewright.operators.boosting import HistBoosting


def plain_tree(x, g, h, leaves, least, rate, l2):
    """[(rows, value)] of a tree grown by always cutting the leaf of largest gain; thresholds are midpoints."""
    def best(rows):
        found = (1e-12, None)
        total = (g[rows].sum(), h[rows].sum())
        for j in range(x.shape[1]):
            v = x[rows, j]
            known, missing = np.unique(v[~np.isnan(v)]), np.isnan(v)
            cuts = [((a + b) / 2, gone_left) for a, b in zip(known, known[1:]) for gone_left in (False, True)[:1 + missing.any()]]
            for cut, gone_left in cuts + [(np.inf, False)] * bool(missing.any() and len(known)):
                left = (v <= cut) | (missing & gone_left)
                lo, hi = rows[left], rows[~left]
                if min(len(lo), len(hi)) < least or min(h[lo].sum(), h[hi].sum()) < 1e-3:
                    continue
                gain = sum(g[r].sum() ** 2 / (h[r].sum() + l2) for r in (lo, hi)) - total[0] ** 2 / (total[1] + l2)
                if gain > found[0] + 1e-9:
                    found = (gain, (lo, hi))
        return found

    open_leaves, done = [(best(np.arange(len(x))), np.arange(len(x)))], []
    while open_leaves and len(open_leaves) + len(done) < leaves:
        open_leaves.sort(key=lambda leaf: -leaf[0][0])
        (_, sides), rows = open_leaves.pop(0)
        if sides is None:
            done.append(rows)
            continue
        open_leaves += [(best(side), side) for side in sides]
    return [(r, -rate * g[r].sum() / (h[r].sum() + l2)) for r in done + [rows for _, rows in open_leaves]]


def plain_boosting(x, y, n_classes, iterations, **options):
    if not n_classes:
        score = np.full((len(y), 1), y.mean())
    elif n_classes == 2:
        score = np.full((len(y), 1), np.log(y.mean() / (1 - y.mean())))
    else:
        score = np.tile(np.log([np.mean(y == c) for c in range(n_classes)]), (len(y), 1))
    for _ in range(iterations):
        if not n_classes:
            g, h = score - y[:, None], np.ones_like(score)
        elif n_classes == 2:
            p = 1 / (1 + np.exp(-score))
            g, h = p - y[:, None], p * (1 - p)
        else:
            p = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
            g, h = p - (y[:, None] == np.arange(n_classes)), p * (1 - p)
        for k in range(score.shape[1]):
            for rows, value in plain_tree(x, g[:, k], h[:, k], **options):
                score[rows, k] += value
    return score


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = np.column_stack((rng.normal(size=2000).round(1), rng.integers(0, 5, 2000), rng.normal(size=2000).round(1)))
    x[rng.random(x.shape) < 0.08] = np.nan
    base = np.nan_to_num(x[:, 0], nan=2.0) + np.where(np.isnan(x[:, 2]), 1.5, x[:, 2]) * (x[:, 1] > 2)
    return x, base + 0.3 * rng.normal(size=2000)


@pytest.mark.parametrize("n_classes", [0, 2, 3])
@pytest.mark.parametrize("cells", [10_000, 2_000])
def test_equals_plain_boosting(spark, data, n_classes, cells):
    """cells: 2,000 rows of 3 features in one task, or in three tasks with a job for each level."""
    x, value = data
    y = value if not n_classes else (value > 0.5).astype(float) if n_classes == 2 else np.digitize(value, [0, 1.2]).astype(float)
    want = plain_boosting(x, y, n_classes, 2 if cells < 6000 else 4, leaves=7, least=20, rate=0.3, l2=0.7)
    df = spark.createDataFrame([(i, r.tolist(), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "key long, x array<double>, label double").withColumn("features", array_to_vector("x"))
    model = HistBoosting.of(n_classes=n_classes, max_iter=2 if cells < 6000 else 4, max_leaf_nodes=7, learning_rate=0.3,
                            l2_regularization=0.7, one_task_cells=cells).fit(df)
    got = model.transform(df).orderBy("key").toPandas()
    if not n_classes:
        assert np.allclose(got["prediction"], want[:, 0], atol=1e-9)
    else:
        p = 1 / (1 + np.exp(-want[:, 0])) if n_classes == 2 else (np.exp(want) / np.exp(want).sum(axis=1, keepdims=True))
        found = np.vstack([v.toArray() for v in got["probability"]])
        assert np.allclose(found[:, 1] if n_classes == 2 else found, p, atol=1e-9)
    assert all(sum(f < 0 for f in tree["feature"]) <= 7 for outputs in model.fitted["trees"] for tree in outputs)


def test_many_values_and_depth(spark):
    """More distinct values than bins, written scores after ten trees, a limit on depth, one class of rows only."""
    rows = spark.range(3000).select("id", (F.rand(1) * 10).alias("v")).withColumn("label", F.sin("v")).withColumn(
        "features", array_to_vector(F.array("v", F.lit(1.0))))
    model = HistBoosting.of(max_iter=12, max_depth=3, learning_rate=0.3, one_task_cells=3000).fit(rows)
    error = model.transform(rows).agg(F.avg(F.pow(F.col("prediction") - F.col("label"), 2))).first()[0]
    assert error < 0.05
    assert all(sum(f < 0 for f in tree["feature"]) <= 8 for outputs in model.fitted["trees"] for tree in outputs)
    flat = HistBoosting.of(max_iter=2).fit(rows.withColumn("label", F.lit(3.0))).transform(rows)
    assert flat.filter("abs(prediction - 3) > 1e-9").isEmpty()
    with pytest.raises(ValueError):
        HistBoosting.of(max_bins=400).fit(rows)


def test_rows_are_packed_into_blocks(monkeypatch):
    """A few rows for Spark instead of one for each row of the table, whatever the batches; missing values keep their bin."""
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(250, 2)), rng.normal(size=250)
    x[3, 1] = np.nan
    batches = [pa.RecordBatch.from_arrays([pa.array(x[a:b].tolist(), pa.list_(pa.float64())), pa.array(y[a:b])], names=["x", "y"])
               for a, b in ((0, 30), (30, 30), (30, 180), (180, 250))]
    edges = [[-0.5, 0.5], [0.0]]
    blocks = [b for batch in boosting._bin_rows(edges, [0.5, 1.5])(iter(batches)) for b in boosting._unpacked(batch)]
    assert len(blocks) <= 4 and max(len(y) for _, y, _ in blocks) <= 100
    bins, labels, score = (np.concatenate([b[i] for b in blocks], axis=-1) for i in range(3))
    assert np.array_equal(bins.T, boosting.binned(x, [np.asarray(e) for e in edges])) and bins[1, 3] == boosting.MAX_BINS
    assert np.array_equal(labels, y) and np.array_equal(score, np.repeat([[0.5], [1.5]], 250, axis=1))


def test_histograms_meet_on_the_driver_or_in_the_shuffle(spark, data, monkeypatch):
    x, value = data
    df = spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(x, value)], "x array<double>, label double").select(
        array_to_vector("x").alias("features"), "label")
    found = []
    for most in (0, 16 << 20):
        monkeypatch.setattr(boosting, "MEETING_BYTES", most)
        model = HistBoosting.of(max_iter=2, max_leaf_nodes=7, one_task_cells=2000).fit(df)
        found.append([r["prediction"] for r in model.transform(df).collect()])
    assert np.allclose(*found, rtol=0, atol=1e-9)

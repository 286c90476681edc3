"""Support vector fits against accelerated projected gradients on the dense dual."""

import json

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewright.operators import dual
from tablewright.operators.dual import DualSVM, LandmarkMap


def climbed(q, linear, project, steps=6000):
    """Least 1/2 a'Qa - linear'a over the set that `project` maps to, with an L1 part inside `project`."""
    rate = 1.0 / np.linalg.eigvalsh(q)[-1]
    a = z = project(np.zeros(len(q)), rate)
    t = 1.0
    for _ in range(steps):
        new = project(z - rate * (q @ z - linear), rate)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, a, t = new + (t - 1) / t_new * (new - a), new, t_new
    return a


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4))
    side = np.where(x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.4 * rng.normal(size=600) > 0.3, 1.0, 0.0)
    value = np.sin(x[:, 0]) + 0.3 * x[:, 2] + 0.1 * rng.normal(size=600)
    df = spark.createDataFrame([(i, r.tolist(), float(s), float(v)) for i, (r, s, v) in enumerate(zip(x, side, value))],
                               "id long, x array<double>, side double, value double")
    return df.withColumn("features", array_to_vector("x")).persist(), x, side, value


@pytest.mark.parametrize("per_task,tol", [(20_000, 1e-3), (300, 1e-2)])
def test_hinge_and_epsilon(data, per_task, tol):
    """The primal value is within 1 % of the dense one, in one task and in two."""
    df, x, side, value = data
    z = np.column_stack((x, np.ones(len(x))))
    y, c, epsilon = 2 * side - 1, 0.7, 0.2
    a = climbed((y[:, None] * z) @ (y[:, None] * z).T, np.ones(600), lambda v, _: np.clip(v, 0, c))
    w = (a * y) @ z
    want = 0.5 * w @ w + c * np.maximum(1 - y * (z @ w), 0).sum()
    model = DualSVM(options=json.dumps({"C": c, "one_task_rows": per_task, "tol": tol})).fit(df.withColumn("label", F.col("side")))
    fit = model.fitted["fits"][0]
    assert fit["gap"] <= tol and abs(fit["primal"] - want) <= 0.01 * want
    assert model.transform(df).filter("prediction = side").count() > 450

    shrink = lambda v, rate: np.clip(np.sign(v) * np.maximum(np.abs(v) - rate * epsilon, 0), -c, c)
    b = climbed(z @ z.T, value, shrink)
    w = b @ z
    want = 0.5 * w @ w + c * np.maximum(np.abs(value - z @ w) - epsilon, 0).sum()
    model = DualSVM(options=json.dumps({"objective": "epsilon", "C": c, "epsilon": epsilon, "one_task_rows": per_task, "tol": tol})
                    ).fit(df.withColumn("label", F.col("value")))
    fit = model.fitted["fits"][0]
    assert fit["gap"] <= tol and abs(fit["primal"] - want) <= 0.01 * want


@pytest.mark.parametrize("per_task,tol", [(20_000, 1e-3), (300, 2e-2)])
def test_one_class(data, per_task, tol):
    df, x, *_ = data
    shifted = df.withColumn("features", array_to_vector(F.transform("x", lambda v: v + 2.0)))
    z, nu = x + 2.0, 0.2
    bound = 1 / (nu * 600)

    def project(v, _):
        low, high = v.min() - 1, v.max()
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if np.clip(v - mid, 0, bound).sum() > 1 else (low, mid)
        return np.clip(v - (low + high) / 2, 0, bound)

    a = climbed(z @ z.T, np.zeros(600), project)
    w = a @ z
    rho = np.quantile(z @ w, nu)
    want = 0.5 * w @ w - rho + bound * np.maximum(rho - z @ w, 0).sum()
    model = DualSVM(options=json.dumps({"objective": "one_class", "nu": nu, "one_task_rows": per_task, "tol": tol})).fit(shifted)
    fit = model.fitted["fits"][0]
    got_w, got_rho = np.array(fit["w"]), fit["rho"]
    got = 0.5 * got_w @ got_w - got_rho + bound * np.maximum(got_rho - z @ got_w, 0).sum()
    assert fit["gap"] <= tol and abs(got - want) <= 10 * tol * abs(want)
    share = model.transform(shifted).filter("prediction = 1").count() / 600
    assert abs(share - nu) < 0.05


def test_landmarks_give_the_kernel(data):
    df, x, *_ = data
    model = LandmarkMap.of(size=600).fit(df)
    rows = model.transform(df).orderBy("id").select("mapped").collect()
    z = np.vstack([r.mapped.toArray() for r in rows])
    assert np.abs(z @ z.T - dual.rbf(x, x, model.fitted["gamma"])).max() < 1e-6


def test_classes_and_errors(data):
    df, *_ = data
    three = df.withColumn("label", F.when(F.get("x", F.lit(0)) > 0.5, 2.0).otherwise(F.col("side")))
    mapped = LandmarkMap.of(size=80).fit(three).transform(three)
    model = DualSVM(featuresCol="mapped", options=json.dumps({"n_classes": 3, "C": 10.0})).fit(mapped)
    assert len(model.fitted["fits"]) == 3 and model.transform(mapped).filter("prediction = label").count() > 450
    for bad in ({"C": -1.0}, {"nu": 0.0}):
        with pytest.raises(ValueError):
            DualSVM(options=json.dumps(bad)).fit(df.withColumn("label", F.col("side")))


@pytest.mark.parametrize("objective", ["hinge", "one_class"])
def test_many_tasks_need_few_passes(data, objective, monkeypatch):
    """Six tasks reach the gap of one, in passes that a table of any size can afford."""
    df, *_ = data
    passes, sums = [], dual._ManyTasks.sums
    monkeypatch.setattr(dual._ManyTasks, "sums", lambda self, of: passes.append(1) or sums(self, of))
    mapped = LandmarkMap.of(size=60).fit(df).transform(df).withColumn("label", F.col("side"))
    fits = [DualSVM(featuresCol="mapped", options=json.dumps({"objective": objective, "one_task_rows": rows})).fit(mapped).fitted["fits"][0]
            for rows in (100, 20_000)]
    assert all(f["gap"] <= 1e-3 for f in fits) and 0 < len(passes) <= 100
    assert fits[0]["primal"] == pytest.approx(fits[1]["primal"], rel=2e-2 if objective == "one_class" else 2e-3)
    assert fits[0]["rho"] == pytest.approx(fits[1]["rho"], rel=2e-2)

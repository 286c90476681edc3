"""Budgets stop running fits, and nothing else."""

import threading
import time

import numpy as np
import pytest
from pyspark.ml import Estimator
from pyspark.sql import functions as F

from tablewright.operators import features, folds
from tablewright.plans import search, training, zoo
from tablewright.plans.budget import BudgetSpent, side_by_side, within


class Slow(Estimator):
    """A fit that takes a minute: one long Python task, or many short jobs."""

    def __init__(self, many: bool):
        super().__init__()
        self.many = many

    def _fit(self, dataset):
        spark = dataset.sparkSession
        if self.many:
            for _ in range(600):
                spark.range(2).count()
                time.sleep(0.1)

        def wait(batches):
            for pdf in batches:
                time.sleep(60)
                yield pdf
        spark.range(2).repartition(2).mapInPandas(wait, "id long").collect()


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), int(a > 0)) for i, a in enumerate(rng.normal(size=90))]
    return spark.createDataFrame(rows, "key long, x double, label int").persist()


@pytest.mark.parametrize("many", [False, True])
def test_a_running_fit_is_stopped_and_listed(signal, tmp_path, many):
    split = folds.assign_folds(signal, "key", task_type="classification", target="label", n_splits=2)
    models = {"naive_bayes": zoo.CATALOGUE["classification"]["naive_bayes"], "slow": zoo.Entry(lambda p, s: Slow(many), "none")}
    began = time.monotonic()
    found = training.cross_train(signal, split, models, features.feature_encoder(signal, "label"), "classification", "label",
                                 str(tmp_path), time_budget_seconds=12)
    assert time.monotonic() - began < 12 + 5 + 10  # the metrics of what was trained come after the budget
    assert ("slow", "time budget spent") in found.skipped
    state = {(r["model"], r["fold"]): r["status"] for r in found.results.collect()}
    assert state[("naive_bayes", 0)] == "ok" and not any(m == "slow" for m, _ in state)
    assert found.oof.filter("model = 'slow'").isEmpty()


def test_within(spark):
    def long_job():
        spark.range(1).select(F.udf(lambda x: time.sleep(60) or x, "long")("id")).collect()

    began = time.monotonic()
    with pytest.raises(BudgetSpent):
        within(spark, 2, long_job)
    assert time.monotonic() - began < 7
    assert within(spark, 30, lambda: spark.range(5).count()) == 5 and within(spark, None, lambda: 1) == 1
    with pytest.raises(BudgetSpent):
        within(spark, 0, long_job)
    with pytest.raises(ZeroDivisionError):
        within(spark, 30, lambda: 1 // 0)


def test_other_work_goes_on(spark):
    """A job of another thread outlives the budget of this one."""
    got = []

    def calm():
        got.append(spark.range(1).select(F.udf(lambda x: time.sleep(6) or x, "long")("id")).count())
        got.append(spark.range(4).count())

    other = threading.Thread(target=calm)
    other.start()
    time.sleep(0.5)
    with pytest.raises(BudgetSpent):
        within(spark, 1, lambda: spark.range(1).select(F.udf(lambda x: time.sleep(30) or x, "long")("id")).collect())
    other.join()
    assert got == [1, 4]


def test_side_by_side(spark):
    assert side_by_side(spark, [lambda k=k: (k, spark.range(k).count()) for k in range(5)], 3) == [(k, k) for k in range(5)]
    with pytest.raises(KeyError):
        side_by_side(spark, [lambda: {}["x"]], 2)


def test_search_stops_a_trial(signal, tmp_path):
    split = folds.assign_folds(signal, "key", "stratified_kfold", target="label", n_splits=2)
    models = {"slow": zoo.Entry(lambda p, s: Slow(False), "none", space={"a": {"type": "int", "low": 1, "high": 9}})}
    began = time.monotonic()
    trials, skipped = search.tune(signal, split, models, features.feature_encoder(signal, "label"), "classification", "label",
                                  "accuracy", str(tmp_path), n_trials=3, timeout_seconds=15)
    assert time.monotonic() - began < 30 and trials.count() == 0

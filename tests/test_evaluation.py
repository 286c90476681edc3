import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from tablewright.functions import order as O
from tablewright.operators import drift as D
from tablewright.operators import metrics as E
from tablewright.operators import ranking as R
from tests.conftest import by, rows


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([
        ("m", int(i % 2), int(i), float(y), float(np.round(np.clip(0.3 * y + rng.normal(0.4, 0.2), 0, 1), 2)))
        for i, y in enumerate(rng.integers(0, 2, 2000))], "model string, fold int, key long, label double, score double").persist()


@pytest.mark.parametrize("bucket", [10**6, 20])
def test_auc_is_exact(scored, monkeypatch, bucket):
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", bucket)
    got = {r["fold"]: r["roc_auc"] for r in E.ranking_metrics(scored, n_rows=2000).collect()}
    judge = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    for i in (0, 1):
        assert got[i] == pytest.approx(judge.evaluate(scored.filter(f"fold = {i}")), abs=1e-9)


def test_one_class_has_no_auc(scored):
    row = E.ranking_metrics(scored.filter("label = 1"), by=["model"]).first()
    assert row["roc_auc"] is None and row["average_precision"] is None


def test_regression_edges(spark):
    df = spark.createDataFrame([("m", 0, 1.0, 1.0), ("m", 0, 1.0, 1.0), ("z", 0, 0.0, 1.0), ("z", 0, 2.0, 1.0)],
                               "model string, fold int, label double, prediction double")
    got = {(r["model"], r["metric"]): r["value"] for r in E.evaluate(df, "regression").collect()}
    assert got[("m", "r2")] == 1.0 and got[("m", "rmse")] == 0.0 and ("z", "mape") not in got
    assert got[("z", "medae")] == 1.0


def test_anomaly_positive(spark):
    def positive(values, kind):
        return E.anomaly_positive(spark.createDataFrame([(v,) for v in values], f"label {kind}"))
    assert positive([0, 1, 1], "int") == 1 and positive([True, False], "boolean") is True
    assert positive(["ok", "ok", "bad"], "string") == "bad"


@pytest.fixture(scope="module")
def results(spark):
    data = {"weak": (0.60, 0.62, 0.61), "strong": (0.80, 0.82, 0.81), "fast": (0.80, 0.815, 0.80)}
    return spark.createDataFrame(
        [(m, i, {"macro_f1": v}, 0.1 if m == "fast" else 1.0, "ok") for m, vs in data.items() for i, v in enumerate(vs)]
        + [("broken", 0, None, 0.0, "failed")],
        "model string, fold int, metrics map<string,double>, fit_seconds double, status string").persist()


def test_summary_and_selection(results):
    summary = R.model_summary(results, "macro_f1")
    table = by(summary, "model")
    assert [r["model"] for r in summary.orderBy("rank").collect()] == ["strong", "fast", "weak"]
    s = table["strong"]
    assert (s["primary_mean"], s["primary_std"]) == (0.81, 0.01)
    assert s["ci_low"] == pytest.approx(0.81 - 4.302653 * 0.01 / 3**0.5, abs=1e-5)
    assert R.select_model(summary, "macro_f1").first()["model"] == "strong"
    assert R.select_model(summary, "macro_f1", "one_se").first()["model"] in ("strong", "fast")
    assert R.significance(summary).first()["overlap"] is True
    assert R.meets_threshold(R.select_model(summary, "macro_f1"), "macro_f1", 0.9).first()["meets_success_threshold"] is False
    assert R.meets_threshold(R.select_model(summary, "macro_f1"), "macro_f1", None).first()["meets_success_threshold"] is None
    assert {r["model"] for r in rows(R.left_out(results, "macro_f1"))} == {"broken"}
    with pytest.raises(ValueError):
        R.select_model(summary, "macro_f1", "coin")


def test_means_only_and_one_fold(spark, results):
    means = spark.createDataFrame([("bare", {"macro_f1": 0.95})], "model string, metrics map<string,double>")
    table = by(R.model_summary(results, "macro_f1", means=means), "model")
    assert table["bare"]["rank"] == 1 and table["bare"]["ci_low"] is None and table["bare"]["n_folds"] == 0
    one = R.model_summary(results.filter("fold = 0"), "macro_f1").filter("model = 'weak'").first()
    assert one["primary_std"] == 0.0 and one["ci_low"] == one["ci_high"] == 0.6


def test_stored_ranking(spark):
    stored = spark.createDataFrame([
        ("r", "rf", 0, '{"f1": 0.9}', 1.0), ("r", "rf", 1, '{"f1": 0.8}', 3.0), ("r", "logreg", 0, '{"f1": 0.7}', 0.5),
        ("r", "logreg", 1, '{"f1": 0.6}', 0.5), ("r", "rf", None, '{"f1": 0.1}', 9.0)],
        "run_id string, model_name string, fold int, metrics_json string, fit_seconds double")
    first = R.stored_ranking(stored, "f1", "r").orderBy("rank").first()
    assert (first["model_name"], round(first["mean"], 6), round(first["std"], 6), first["mean_fit_seconds"]) == ("rf", 0.85, 0.05, 2.0)


def test_drift(spark):
    rng = np.random.default_rng(0)

    def batch(n, shift, cities):
        return spark.createDataFrame([(float(rng.normal() + shift), str(rng.choice(cities)), 1.0) for _ in range(n)],
                                     "x double, city string, same double")
    reference = D.drift_reference(batch(500, 0, ["SP", "RJ"]))
    assert reference.filter("column = 'same'").count() == 0
    calm = D.drift_report(reference, batch(500, 0, ["SP", "RJ"])).first()
    moved = D.drift_report(reference, batch(100, 8, ["SP"])).first()
    assert not calm["drift_detected"] and moved["drift_detected"] and moved["n_drifted"] == 2
    partial = D.drift_columns(reference, batch(100, 8, ["SP"]).select("x"))
    assert [r["column"] for r in rows(partial)] == ["x"]


def test_two_valued_numbers(spark):
    df = spark.createDataFrame([(float(i % 4 == 0),) for i in range(100)], "flag double")
    later = spark.createDataFrame([(1.0,)] * 50, "flag double")
    assert D.psi(D.drift_reference(df), later).first()["psi"] == pytest.approx(0.0)
    assert D.psi(D.drift_reference(df, discrete_max=10), later).first()["psi"] > 0.2

"""Learning sanity by threshold, neighbours against brute force, whole runs."""

import dataclasses
import datetime as dt
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewright.functions import fixed
from tablewright.operators import explain, features, folds, metrics, neighbors
from tablewright.operators.drift import drift_reference
from tablewright.operators.forest import IsolationForest
from tablewright.operators.kernels import GaussianBayes
from tablewright.operators.net import Autoencoder
from tablewright.plans import search, training, zoo
from tablewright.plans.experiment import run_experiment
from tablewright.plans.latent import run_latent
from tablewright.plans.task import resolve_task
from tablewright.queries import modelling
from tablewright.sources.records import RecordStore
from tablewright.streaming.monitor import drift_stream, stream_drift


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(0)
    data = []
    for i in range(120):
        a, b = rng.normal(size=2)
        data.append((i, float(a), float(b), "SP" if i % 2 else "RJ", int(a + 0.3 * rng.normal() > 0),
                     float(3 * a + 0.5 * rng.normal())))
    return spark.createDataFrame(data, "key long, x1 double, x2 double, city string, label int, price double").persist()


@pytest.fixture(scope="module")
def blob(spark):
    rng = np.random.default_rng(1)
    data = [(i, *map(float, rng.normal(0 if i < 110 else 6, 1, 3)), int(i >= 110)) for i in range(120)]
    return spark.createDataFrame(data, "key long, a double, b double, c double, odd int").persist()


def cross(df, task, target, include, tmp_path, **more):
    split = folds.assign_folds(df, "key", task_type=task, target=target, n_splits=3)
    models, _ = zoo.select_models(task, include)
    return training.cross_train(df, split, models, features.feature_encoder(df, target), task, target, str(tmp_path), **more)


def means(result, metric):
    return {r["model"]: r["v"] for r in result.results.groupBy("model").agg(F.avg(F.col("metrics")[metric]).alias("v")).collect()}


@pytest.mark.parametrize("hot", [False, True])
def test_neighbours_equal_brute_force(spark, monkeypatch, hot):
    """``hot``: a third of the rows are copies of one point, far over one block."""
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 3))
    if hot:
        x[:50] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, x array<double>").persist()
    got = {}
    for r in neighbors.nearest(df, df, 4, skip_same=True).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["ref"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert got == {i: np.lexsort((np.arange(150), d[i]))[:4].tolist() for i in range(150)}


def test_neighbours_of_repeated_keys(spark):
    """Other rows of a query's own key do not take the places of its neighbours."""
    df = spark.createDataFrame([(i // 4, [float(i // 4)]) for i in range(40)], "key long, x array<double>").persist()
    got = {r["query"]: r["d"] for r in neighbors.nearest(df.filter("key = 0").limit(1), df, 5, skip_same=True).groupBy(
        "query").agg(F.sort_array(F.collect_list("distance")).alias("d")).collect()}
    assert got == {0: [1.0] * 4 + [2.0]}


def test_neighbour_blocks_are_a_share_of_the_table():
    """Where every cell is searched, a row is sent to about PARTS blocks, however many cells there are."""
    rng = np.random.default_rng(3)
    size = rng.integers(50, 400, 600)
    size[7] = 20_000
    rows = int(size.sum()) // neighbors.PARTS
    blocks = neighbors._packed(rng.normal(size=(600, 8)), size, rows)
    assert len(set().union(*blocks)) <= 2 * neighbors.PARTS and all(len(b) for b in blocks)
    held = {}
    for b, n in zip(blocks, size):
        for block in b:
            held[block] = held.get(block, 0) + n / len(b)
    assert max(held.values()) <= rows and set(held) == set(range(len(held)))


def test_small_forests_of_several_folds_are_fitted_at_once(signal, tmp_path, monkeypatch):
    """Fits meet at a barrier, which one fit after the other would not pass."""
    met = threading.Barrier(3)

    def build(p, s):
        met.wait(60)
        return zoo.CATALOGUE["regression"]["random_forest_regressor"].build(p, s)
    df = signal.drop("label")
    entry = dataclasses.replace(zoo.CATALOGUE["regression"]["random_forest_regressor"], build=build)
    split = folds.assign_folds(df, "key", task_type="regression", target="price", n_splits=3)
    found = training.cross_train(df, split, {"forest": entry}, features.feature_encoder(df, "price"), "regression", "price",
                                 str(tmp_path), params={"forest": {"n_estimators": 2, "max_depth": 3}})
    assert found.results.filter("status = 'ok'").count() == 3


def test_room_is_never_overdrawn():
    room, most, now = training.Room(10), [0], [0]

    def fit(need):
        with room.hold(need):
            now[0] += 1
            most[0] = max(most[0], room.used)
            time.sleep(0.01)
            assert room.used <= 10 or now[0] == 1  # a larger one is alone
            now[0] -= 1
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(fit, [4, 5, 12, 3, 20, 1, 9, 2]))
    assert room.used == 0 and most[0] >= 12


def test_classifiers_learn(signal, tmp_path):
    found = cross(signal.drop("price"), "classification", "label",
                  ["logistic_regression", "random_forest", "naive_bayes", "knn", "mlp", "xgboost", "nonsense"], tmp_path,
                  params={"random_forest": {"n_estimators": 20}, "mlp": {"max_iter": 100}})
    scores = means(found, "roc_auc")
    assert set(scores) == {"logistic_regression", "random_forest", "naive_bayes", "knn", "mlp"}
    assert all(v > 0.75 for v in scores.values()), scores
    assert found.skipped[0][0] == "xgboost"
    assert found.oof.groupBy("model").count().filter("count <> 120").count() == 0


def test_failing_model_does_not_stop_others(signal, tmp_path):
    found = cross(signal.drop("price"), "classification", "label", ["logistic_regression", "svm"], tmp_path,
                  params={"svm": {"C": -1.0}})
    state = {r["model"]: r["status"] for r in found.results.collect()}
    assert state["svm"] == "failed" and state["logistic_regression"] == "ok"


def test_regressors_learn(signal, tmp_path):
    found = cross(signal.drop("label"), "regression", "price", ["linear_regression", "elastic_net", "knn_regressor"], tmp_path,
                  params={"elastic_net": {"alpha": 0.01}})
    scores = means(found, "r2")
    assert scores["linear_regression"] > 0.9 and scores["elastic_net"] > 0.9 and scores["knn_regressor"] > 0.5


def test_anomaly_models(blob, tmp_path):
    scores = means(cross(blob, "anomaly", "odd", None, tmp_path), "roc_auc")
    assert set(scores) == {"isolation_forest", "local_outlier_factor", "one_class_svm"}
    assert scores["isolation_forest"] > 0.9


def test_autoencoder_beats_the_mean(blob, tmp_path):
    df = blob.withColumn("d", F.col("a") + F.col("b")).drop("odd")
    split = folds.assign_folds(df, "key", "kfold", n_splits=2)
    encoder = features.feature_encoder(df)
    first = run_latent(df, split, encoder, "denoising", str(tmp_path / "1"), epochs=30, learning_rate=0.01)
    row = first.comparison.first()
    assert row["candidate_better"] and row["candidate"] < row["baseline"]
    second = run_latent(df, split, encoder, "denoising", str(tmp_path / "2"), epochs=30, learning_rate=0.01)
    assert second.comparison.first()["candidate"] == pytest.approx(row["candidate"], abs=1e-6)


def test_unlabelled_anomalies_give_statistics(blob, tmp_path):
    df = blob.drop("odd")
    split = folds.assign_folds(df, "key", "kfold", n_splits=2)
    found = run_latent(df, split, features.feature_encoder(df), "anomaly_detection", str(tmp_path), epochs=2)
    assert found.comparison.first()["conclusive"] is False and found.stats.first()["p95"] > 0


def test_models_repeat(blob):
    v = blob.select("key", array_to_vector(F.array("a", "b", "c")).alias("features"))
    shuffled = v.orderBy(F.xxhash64("key")).coalesce(1)
    forest = IsolationForest.of("key", n_estimators=10)
    assert forest.fit(v).fitted == forest.fit(shuffled).fitted
    net = Autoencoder.of("key", epochs=2)
    assert net.fit(v).fitted == net.fit(v).fitted


def test_permutation_importance_finds_the_signal(signal, tmp_path):
    df = signal.drop("price", "city")
    split = folds.assign_folds(df, "key", "stratified_kfold", target="label", n_splits=2)
    labels = training.learn_labels(df, "classification", "label")
    data = training.encode_fold(df, split, 0, features.feature_encoder(df, "label"), labels, 42)
    model = zoo.CATALOGUE["classification"]["naive_bayes"].build({}, data.shape).fit(data.train)
    top = explain.explain(model, data.test, data.encoder.feature_names(), "classification").collect()
    assert top[0]["feature"] == "x1" and top[0]["importance"] > 0.1


def test_search(signal, tmp_path):
    df = signal.drop("price")
    split = folds.assign_folds(df, "key", "stratified_kfold", target="label", n_splits=2)
    models, _ = zoo.select_models("classification", ["naive_bayes", "lightgbm"])
    trials, skipped = search.tune(df, split, models, features.feature_encoder(df, "label"), "classification", "label",
                                  "accuracy", str(tmp_path), n_trials=2)
    best = search.best_trials(trials, models, "accuracy").first()
    assert best["model"] == "naive_bayes" and best["n_complete"] == 2 and skipped == [("lightgbm", "no search space")]
    assert search.trial_points(models, 3, 1) == search.trial_points(models, 3, 1)


def test_trials_need_no_ranks(spark, signal, tmp_path, monkeypatch):
    """A trial measured by counts does not rank its scores, and its value is the metric of all metrics."""
    df = signal.drop("price")
    split = folds.assign_folds(df, "key", task_type="classification", target="label", n_splits=2)
    models, _ = zoo.select_models("classification", ["naive_bayes"])
    encoder = features.feature_encoder(df, "label")
    point = {"var_smoothing": 1e-8}
    want = training.cross_train(df, split, models, encoder, "classification", "label", str(tmp_path / "all"),
                                params={"naive_bayes": point}).results.agg(F.avg(F.col("metrics")["macro_f1"])).first()[0]
    monkeypatch.setattr(metrics, "ranking_metrics", lambda *a, **b: pytest.fail("ranks"))
    labels = training.learn_labels(df, "classification", "label")
    table = split.attach(df, str(tmp_path / "folds"))
    data = [training.encode_fold(table, split, i, encoder, labels, 42) for i in range(2)]
    assert search.score_point(models["naive_bayes"], point, data, labels, "macro_f1") == pytest.approx(want, abs=1e-12)


def test_neighbours_in_few_columns(spark, monkeypatch):
    """Two columns and a type: a row looks into few blocks and there at few rows; ties and keys that stand twice as by brute force."""
    rng = np.random.default_rng(3)
    kind = rng.integers(0, 3, 1500)
    x = np.column_stack([rng.exponential(size=1500).round(2), rng.uniform(-1.7, 1.7, 1500), np.eye(3)[kind]])
    x[700:760], keys = x[3], np.arange(1500) // 2 * 2 + (np.arange(1500) >= 100) * (np.arange(1500) % 2)
    monkeypatch.setattr(neighbors, "BOX_ROWS", 16)
    boxes = neighbors._near_boxes(x, x, 7)
    assert sorted(np.concatenate([at for at, _ in boxes])) == list(range(1500))
    assert sum(len(at) * len(near) for at, near in boxes) < 0.4 * 1500 ** 2
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 300)
    monkeypatch.setattr(neighbors, "KNOWN_ROWS", 500)
    df = spark.createDataFrame([(int(k), r.tolist()) for k, r in zip(keys, x)], "key long, x array<double>").persist()
    got = {}
    for r in neighbors.nearest(df, df.filter("key >= 0"), 5, skip_same=True).collect():
        got.setdefault(r["query"], []).append((r["distance"], r["ref"]))
    for i in [*range(100, 1500, 7), *range(700, 760)]:
        exact = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        exact[keys == keys[i]] = np.inf
        best = np.lexsort((keys, exact))[:5]
        assert sorted(got[keys[i]]) == [(exact[j], keys[j]) for j in best]


def test_experiment_end_to_end(spark, signal, tmp_path):
    store = RecordStore(spark, str(tmp_path / "records"))
    run = run_experiment(spark, str(tmp_path / "scratch"), key="key", task_type="classification", target="label",
                         dataframe=signal.drop("price"), n_splits=3, include=["logistic_regression", "decision_tree"],
                         deploy=True, monitor=signal.withColumn("x1", F.col("x1") + 8), store=store)
    assert run.parts["ranking"].count() == 2 and run.parts["drift"].filter("drifted").count() == 1
    assert run.parts["retraining"].first()["by_drift"] and run.parts["artifact"].first()["files"] > 0
    events = [r["event_type"] for r in store.events_of(run.id).collect()]
    assert events[0] == "problem_formulation" and events[-1] == "report_generation" and len(events) == 9
    stored = store.table("model_results")
    assert stored.filter("fold is not null").count() == 6 and stored.filter("fold is null").count() == 2
    assert store.experiment(run.id).first()["status"] == "finished" and store.runs_of(run.id).first()["status"] == "finished"
    assert store.ranking(run.run_id).count() == 2 and store.latest_report(run.id).count() == 1
    assert store.latest_dataset(run.id).first()["content_hash"]
    total = stored.filter("fold is null and artifact_path is not null").collect()
    assert [r["model_name"] for r in total] == [run.parts["chosen"].first()["model"]] and total[0]["artifact_hash"]
    assert stored.filter("hyperparameters is null").count() == 0
    assert run.parts["explanation"].count() > 0 and run.parts["secondary"].count() > 0
    assert run.parts["confusion"].groupBy().sum("n").first()[0] == 120
    assert training.predict(run.model, signal).filter("prediction = label").count() > 90


def test_stream(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = [(dt.datetime(2024, 1, 1 + i % 6, i % 24), float(rng.normal() + (9 if i % 6 == 3 else 0)), "ab"[i % 2])
            for i in range(1200)]
    df = spark.createDataFrame(data, "ts timestamp, x double, c string")
    df.write.parquet(str(tmp_path / "in"))
    reference = drift_reference(df.filter("ts < '2024-01-03'").select("x", "c"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    drift_stream(stream, reference, "ts", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = stream_drift(spark, str(tmp_path / "out"), reference)
    assert {r["window_start"].day for r in got.collect()} == {1, 2, 3, 4, 5, 6}
    moved = [(r["window_start"].day, r["column"]) for r in got.filter("drifted and column = 'x'").collect()]
    assert (4, "x") in moved and (1, "x") not in moved


def test_task_rules():
    task = resolve_task("classification", "y")
    assert (task.metric, task.strategy, task.success_threshold) == ("macro_f1", "stratified_kfold", 0.7)
    assert resolve_task("regression", "y", time_column="t").strategy == "time_split"
    assert resolve_task("anomaly").secondary == ("average_precision", "f1")
    for bad in (dict(task_type="other"), dict(task_type="regression"), dict(task_type="regression", target="y", metric="roc_auc"),
                dict(task_type="regression", target="y", strategy="x")):
        with pytest.raises(ValueError):
            resolve_task(**bad)



def test_keys_keep_their_type(signal, tmp_path):
    named = signal.withColumn("key", F.concat(F.lit("a"), F.col("key").cast("string")))
    found = cross(named, "classification", "label", ["knn"], tmp_path)
    rows = found.oof.groupBy("model").agg(F.countDistinct("key").alias("n")).collect()
    assert found.oof.schema["key"].dataType.simpleString() == "string"
    assert {r["n"] for r in rows} == {120}


def test_depth_reaches_the_trees():
    shape = zoo.Shape(100, 3, 2, 1.0, "key", 42)
    entry = zoo.select_models("classification", ["random_forest"])[0]["random_forest"]
    assert entry.build({**entry.defaults, "max_depth": 24}, shape).getMaxDepth() == 24
    with pytest.raises(ValueError, match="31"):
        entry.build({**entry.defaults, "max_depth": 31}, shape)


def test_search_query_runs_the_defaults(spark, sf, monkeypatch):
    class Stop(Exception):
        pass

    def tune(df, split, *args, n_trials=fixed.N_TRIALS, **more):
        raise Stop(split.n_splits, n_trials)

    monkeypatch.setattr(search, "tune", tune)
    with pytest.raises(Stop) as seen:
        modelling.search_trials(spark, sf)
    assert seen.value.args == (fixed.N_SPLITS, fixed.N_TRIALS)


def test_folds_run_side_by_side(signal, tmp_path):
    """Each fold's fit waits for that of another fold; a model that fails in some folds is listed once, for the first."""
    meeting = threading.Barrier(3)

    class Meets(GaussianBayes):
        def _fit(self, dataset):
            meeting.wait(60)
            return super()._fit(dataset)

    class Fails(GaussianBayes):
        def _fit(self, dataset):
            raise RuntimeError("no fit")

    df = signal.drop("price")
    split = folds.assign_folds(df, "key", task_type="classification", target="label", n_splits=3)
    models = {"meets": zoo.Entry(lambda p, s: Meets.of(n_classes=2), "none"), "fails": zoo.Entry(lambda p, s: Fails.of(), "none")}
    found = training.cross_train(df, split, models, features.feature_encoder(df, "label"), "classification", "label", str(tmp_path))
    state = sorted((r["model"], r["status"]) for r in found.results.collect())
    assert state == [("fails", "failed"), *[("meets", "ok")] * 3] and len(found.alerts) == 1
    assert found.oof.groupBy("key").count().filter("count <> 1").isEmpty() and found.oof.count() == 120
    assert {r["fold"] for r in found.oof.select("fold").distinct().collect()} == {0, 1, 2}


# -- forests whose trees grow some at a time ----------------------------------------------

@pytest.mark.parametrize("task", ["classification", "regression"])
def test_forest_of_sets_of_trees(spark, tmp_path, task):
    rows = spark.range(400).select(F.array((F.col("id") % 7).cast("double"), (F.col("id") % 5).cast("double")).alias("x"),
                                   (F.col("id") % 7 > 3).cast("double").alias("label"))
    rows = rows.select(array_to_vector("x").alias("features"), "label")
    name = "random_forest" if task == "classification" else "random_forest_regressor"
    build = zoo.CATALOGUE[task][name].build
    one = build({"n_estimators": 9}, zoo.Shape(400, 2, 2))
    many = build({"n_estimators": 9}, zoo.Shape(400, 2, 2))
    assert one.at_once >= 9
    many.at_once = 4
    forest = many.fit(rows)
    assert len(forest.trees) == forest.getNumTrees == 9
    right = forest.transform(rows).filter(F.abs(F.col("prediction") - F.col("label")) < 0.2).count()
    assert right == 400 == one.fit(rows).transform(rows).filter(F.abs(F.col("prediction") - F.col("label")) < 0.2).count()
    forest.save(f"{tmp_path}/forest")
    again = type(forest).load(f"{tmp_path}/forest")
    assert sorted(r.prediction for r in again.transform(rows).collect()) == sorted(
        r.prediction for r in forest.transform(rows).collect())


def test_bags_and_nodes_of_a_forest_are_bounded():
    entry = zoo.CATALOGUE["classification"]["random_forest"]
    few, many = (entry.build(entry.defaults, zoo.Shape(n, 8, 2)).at_once for n in (16_000, 4_800_000))
    assert few >= 300 and many * 4_800_000 <= 100_000_000
    assert training.folds_at_once({"f": entry}, 6_000_000) == 1
    assert training.folds_at_once({"f": entry}, 100_000) == training.FOLDS_AT_ONCE

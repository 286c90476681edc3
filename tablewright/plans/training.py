"""Cross training, out-of-fold predictions, final fit and batch prediction."""

from __future__ import annotations

import math
import threading
import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import fixed
from tablewright.functions.exprs import as_text, col, dtype_of, nan_to_null
from tablewright.operators.explain import explain
from tablewright.operators.folds import Folds, check_folds
from tablewright.operators.metrics import anomaly_positive, evaluate
from tablewright.operators.profile import require_columns
from tablewright.plans.budget import BudgetSpent, left, side_by_side, within
from tablewright.plans.zoo import Entry, MissingPackage, Shape

ROWS_PER_TASK = 20_000
# Folds that are fitted at once: most fits are chains of short jobs, which leave cores idle.
FOLDS_AT_ONCE = 5
# Rows that folds fitted at once may have in all where forests are among the models: these fill the cores and keep the
# rows' bags and nodes beside the rows. A larger fold is alone.
FOREST_FOLD_ROWS = 2_000_000
# Tree nodes that forests fitted at once may have in the driver, by their bounds; a larger forest is fitted alone.
MOST_NODES = 4_000_000
# Classes a target may have; one row each reaches the driver.
MOST_CLASSES = 10_000
OOF = ("label double, prediction double, score double, scores array<double>, model string, fold int")
RESULTS = "model string, fold int, metrics map<string,double>, fit_seconds double, status string"


@dataclass
class Labels:
    """How the target becomes the numeric ``label`` column."""

    task_type: str
    target: str | None
    classes: list[str] = field(default_factory=list)
    positive: object = None

    def column(self, df: DataFrame):
        if not self.target:
            return F.lit(None).cast("double")
        value = col(self.target)
        if self.task_type == "regression":
            return value.cast("double")
        if self.task_type == "anomaly":
            return (value == self.positive).cast("double")
        text = as_text(value, dtype_of(df, self.target))
        return (F.array_position(F.array(*map(F.lit, self.classes)), text) - 1).cast("double")

    def name(self, index):
        """The class a predicted index stands for."""
        return F.element_at(F.array(*map(F.lit, self.classes)), index.cast("int") + 1)


def learn_labels(df: DataFrame, task_type: str, target: str | None) -> Labels:
    require_columns(df, target=target)
    labels = Labels(task_type, target)
    if target and task_type == "classification":
        # One row per class; numbers in their own order, text by its own.
        found = df.filter(col(target).isNotNull()).select(col(target).alias("v")).distinct()
        if found.limit(MOST_CLASSES + 1).count() > MOST_CLASSES:
            raise ValueError(f"Target '{target}' has more than {MOST_CLASSES} classes.")
        found = found.orderBy("v")
        labels.classes = [r["v"] for r in found.select(as_text(F.col("v"), dtype_of(df, target)).alias("v")).collect()]
        if len(labels.classes) < 2:
            raise ValueError(f"Target '{target}' has fewer than 2 classes.")
    if target and task_type == "anomaly":
        labels.positive = anomaly_positive(df, target)
    return labels


@dataclass
class FoldData:
    """One fold, encoded by an encoder that saw its training rows only."""

    fold: int
    train: DataFrame
    test: DataFrame
    shape: Shape
    encoder: object

    def release(self) -> None:
        self.train.unpersist()
        self.test.unpersist()


def encode_fold(df: DataFrame, folds: Folds, fold: int, encoder: Estimator, labels: Labels, seed: int) -> FoldData:
    train, test = folds.side(df, fold, "train"), folds.side(df, fold, "test")
    model = encoder.fit(train)

    def vectors(part):
        coded = model.transform(part.withColumn("_label", labels.column(part)))
        # Small tables in few partitions: an iteration of a fit is then a few tasks, not hundreds.
        few = max(1, math.ceil(folds.n_samples / ROWS_PER_TASK))
        return coded.select(col(folds.key).alias("key"), F.col("_label").alias("label"), "features").coalesce(
            few).persist(StorageLevel.MEMORY_AND_DISK)
    train, test = vectors(train), vectors(test)
    row = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s")).first()
    shape = Shape(row["n"], len(model.feature_names()), len(labels.classes), row["s"] or 1.0, "key", seed)
    return FoldData(fold, train, test, shape, model)


class Room:
    """Fits that share the driver's memory: one starts when what it may need fits beside the others, or when it is alone."""

    def __init__(self, size: int) -> None:
        self.size, self.used, self.changed = size, 0, threading.Condition()

    @contextmanager
    def hold(self, need: int):
        with self.changed:
            self.changed.wait_for(lambda: not need or not self.used or self.used + need <= self.size)
            self.used += need
        try:
            yield
        finally:
            with self.changed:
                self.used -= need
                self.changed.notify_all()


def nodes_bound(entry: Entry, params: dict, data: FoldData) -> int:
    """Tree nodes that the model may have: a tree has no more leaves than there are different rows. 0 for small models."""
    if entry.nodes is None:
        return 0
    different = data.train.agg(F.approx_count_distinct(F.xxhash64(vector_to_array("features")))).first()[0]
    return entry.nodes(params, min(data.shape.n, different))


def folds_at_once(models: dict[str, Entry], n_rows: int) -> int:
    """Folds that are encoded and fitted side by side."""
    if not any(entry.nodes for entry in models.values()):
        return FOLDS_AT_ONCE
    return max(1, min(FOLDS_AT_ONCE, FOREST_FOLD_ROWS // max(1, n_rows)))


def predictions(model, data: DataFrame, name: str, fold: int) -> DataFrame:
    """Rows of the out-of-fold table from one fitted model."""
    out = model.transform(data)
    by_class = next((c for c in ("probability", "rawPrediction", "margin") if c in out.columns), None)
    nothing = F.lit(None).cast("double")
    scores = vector_to_array(by_class) if by_class else F.lit(None).cast("array<double>")
    score = F.col("score") if "score" in out.columns else F.element_at(scores, -1) if by_class else nothing
    return out.select(
        "key", "label",
        (F.col("prediction").cast("double") if "prediction" in out.columns else nothing).alias("prediction"),
        score.cast("double").alias("score"), scores.alias("scores"), F.lit(name).alias("model"),
        F.lit(fold).alias("fold"))


def _foretold(start: float, fold: int, n_splits: int) -> float:
    """Seconds that all folds take as those begun foretell: in the first fold what it took so far for each fold, later
    the time spent."""
    spent = time.monotonic() - start
    return spent * n_splits if fold == 0 else spent


def fold_explanation(df: DataFrame, folds: Folds, encoder: Estimator, entry: Entry, params: dict, task_type: str,
                     target: str | None, scratch: str, seed: int = fixed.SEED) -> DataFrame:
    """Top features of one model fitted on the training rows of fold 0 and looked at on its test rows."""
    df = nan_to_null(df)
    data = encode_fold(folds.attach(df, f"{scratch}/explained"), folds, 0, encoder, learn_labels(df, task_type, target),
                       seed)
    model = entry.build({**entry.defaults, **params}, data.shape).fit(data.train)
    found = explain(model, data.test, data.encoder.feature_names(), task_type, seed=seed)
    kept = df.sparkSession.createDataFrame(found.collect(), found.schema)  # a few rows
    data.release()
    return kept


@dataclass
class CrossResult:
    results: DataFrame          # (model, fold, metrics, fit_seconds, status)
    oof: DataFrame              # out-of-fold rows, see OOF
    labels: Labels
    params: dict[str, dict]
    skipped: list[tuple[str, str]]
    alerts: list[str]


def metric_maps(oof: DataFrame, labels: Labels, times: list[tuple], n_rows: int | None = None,
                only: str | None = None) -> DataFrame:
    """Results rows: all metrics (or those that ``only`` one of them needs) of all models and folds from one set of
    aggregates."""
    if labels.task_type == "anomaly":
        scored = oof.filter(F.col("score").isNotNull())
        long = evaluate(scored, "anomaly", positive=1, n_rows=n_rows) if labels.target else None
    else:
        long = evaluate(oof, labels.task_type, positive=1, n_rows=n_rows,
                        classes=list(range(len(labels.classes))) or None, only=only)
    spent = oof.sparkSession.createDataFrame(times, "model string, fold int, fit_seconds double, status string")
    if long is None:
        return spent.select("model", "fold", F.create_map().cast("map<string,double>").alias("metrics"),
                            "fit_seconds", "status")
    maps = long.groupBy("model", "fold").agg(F.map_from_entries(
        F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    return spent.join(maps, ["model", "fold"], "left").select("model", "fold", "metrics", "fit_seconds", "status")


def cross_train(df: DataFrame, folds: Folds, models: dict[str, Entry], encoder: Estimator, task_type: str,
                target: str | None, scratch: str, params: dict[str, dict] | None = None, seed: int = fixed.SEED,
                time_budget_seconds: float | None = None) -> CrossResult:
    """Every model on every fold.

    A fold is encoded once and shared by all models; folds run side by side, with a time budget one after the other.
    Predictions are written below ``scratch`` (a shared folder), so metrics never run a model again. A model
    that fails is recorded and the others go on; with a time budget, models whose turn comes
    after it (in the first fold: as it foretells) are skipped, and a fit that runs when it ends is stopped.
    """
    df = nan_to_null(df)
    check_folds(folds, df)
    labels = learn_labels(df, task_type, target)
    spark = df.sparkSession
    chosen = {m: {**e.defaults, **(params or {}).get(m, {})} for m, e in models.items()}
    active, skipped, alerts = dict(models), [], []
    times: list[tuple] = []
    failed: dict[str, tuple[int, float, str]] = {}  # model: its first fold that failed, seconds, alert
    changing, room = threading.Lock(), Room(MOST_NODES)
    start = time.monotonic()
    end = None if time_budget_seconds is None else start + time_budget_seconds
    path = f"{scratch}/oof"
    table = folds.attach(df, f"{scratch}/folds")

    def run_fold(fold: int) -> None:
        data = encode_fold(table, folds, fold, encoder, labels, seed)
        for name, entry in models.items():
            with changing:
                if name not in active:
                    continue
                if time_budget_seconds is not None and _foretold(start, fold, folds.n_splits) > time_budget_seconds:
                    skipped.append((name, "time budget spent"))
                    del active[name]
                    continue
            began = time.monotonic()

            def fit_and_predict():
                fitted = entry.build(chosen[name], data.shape).fit(data.train)
                # folds that are written at once need folders of their own
                predictions(fitted, data.test, name, fold).drop("fold").write.mode("append").partitionBy("model").parquet(
                    f"{path}/fold={fold}")

            try:
                with room.hold(nodes_bound(entry, chosen[name], data)):
                    began = time.monotonic()
                    within(spark, left(end), fit_and_predict)
                outcome = (name, fold, round(time.monotonic() - began, 4), "ok")
                with changing:
                    times.append(outcome)
            except BudgetSpent:
                with changing:
                    skipped.append((name, "time budget spent"))
                    active.pop(name, None)
            except MissingPackage as problem:
                with changing:
                    if active.pop(name, None) is not None:
                        skipped.append((name, f"missing package {problem.name}"))
                        alerts.append(f"Model '{name}' is skipped: {problem}")
            except Exception as problem:  # one model must not stop the others
                with changing:
                    active.pop(name, None)
                    if name not in failed or fold < failed[name][0]:
                        failed[name] = (fold, round(time.monotonic() - began, 4),
                                        f"Model '{name}' failed: {type(problem).__name__}: {problem}")
        data.release()

    side_by_side(spark, [lambda fold=fold: run_fold(fold) for fold in range(folds.n_splits)],
                 folds_at_once(models, folds.n_samples) if time_budget_seconds is None else 1)
    alerts += [failed[m][2] for m in models if m in failed]
    times += [(m, fold, seconds, "failed") for m, (fold, seconds, _) in failed.items()]
    if not any(t[3] == "ok" for t in times):
        raise ValueError("No model could be trained: " + "; ".join(alerts + [f"{m}: {r}" for m, r in skipped]))
    oof = spark.read.schema(f"key {dtype_of(df, folds.key).simpleString()}, {OOF}").parquet(path).select(
        "key", *[c.split()[0] for c in OOF.split(", ")])
    # a stopped write leaves nothing, a fit that ended late leaves rows that no result stands for
    complete = [F.struct(F.lit(m).alias("model"), F.lit(k).alias("fold")) for m, k, _, state in times if state == "ok"]
    oof = oof.filter(F.struct("model", "fold").isin(complete)) if skipped else oof
    if failed:
        oof = oof.filter(~F.col("model").isin(*failed))
        times = [t for t in times if t[0] not in failed or t[3] == "failed"]
    return CrossResult(metric_maps(oof, labels, times), oof, labels, chosen, skipped, alerts)


def fit_final(df: DataFrame, key: str, encoder: Estimator, entry: Entry, params: dict, task_type: str,
              target: str | None, seed: int = fixed.SEED) -> tuple[PipelineModel, Labels]:
    """Encoder and model on the whole table, as one saveable pipeline."""
    df = nan_to_null(df)
    labels = learn_labels(df, task_type, target)
    coded = encoder.fit(df)
    ready = coded.transform(df.withColumn("label", labels.column(df))).select(
        col(key), "label", "features").persist(StorageLevel.MEMORY_AND_DISK)
    row = ready.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s")).first()
    shape = Shape(row["n"], len(coded.feature_names()), len(labels.classes), row["s"] or 1.0, key, seed)
    model = entry.build({**entry.defaults, **params}, shape).fit(ready)
    ready.unpersist()
    return PipelineModel(stages=[coded, model]), labels


def predict(model: PipelineModel, df: DataFrame, labels: Labels | None = None) -> DataFrame:
    """Predictions for new rows, batch or stream; class names when ``labels`` are given."""
    out = model.transform(nan_to_null(df))
    kept = [c for c in ("prediction", "score", "probability") if c in out.columns]
    out = out.select(*[col(c) for c in df.columns], *kept)
    if labels is not None and labels.classes:
        out = out.withColumn("prediction", labels.name(F.col("prediction")))
    return out


def prediction_type(task_type: str) -> str:
    return {"classification": "class_label", "regression": "continuous_value",
            "anomaly": "anomaly_score"}.get(task_type, "unknown")


def selected_model(chosen: DataFrame | None, params: dict[str, dict], catalogue: dict[str, Entry],
                   given: tuple[str, dict] | None = None) -> tuple[str, Entry, dict]:
    """The model to ship: the given one, else the chosen row looked up in what was trained."""
    if given is not None:
        name, own = given
        if name not in catalogue:
            raise ValueError(f"Model '{name}' is not in the catalogue.")
        return name, catalogue[name], own
    row = chosen.first() if chosen is not None else None
    if row is None:
        raise ValueError("Give a model or an evaluation with a chosen one.")
    if row["model"] not in params or row["model"] not in catalogue:
        raise ValueError(f"Model '{row['model']}' is not among the training results.")
    return row["model"], catalogue[row["model"]], params[row["model"]]



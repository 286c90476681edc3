"""Hyperparameter search: seeded random draws as a trial table, folds encoded once for all."""

from __future__ import annotations

import json
import time
import zlib

import numpy as np
from pyspark.ml import Estimator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import fixed
from tablewright.functions.exprs import nan_to_null
from tablewright.operators.folds import Folds, check_folds
from tablewright.operators.ranking import minimised
from tablewright.plans.budget import BudgetSpent, left, side_by_side, within
from tablewright.plans.training import FoldData, encode_fold, learn_labels, metric_maps, predictions
from tablewright.plans.zoo import Entry, MissingPackage

TRIALS = "model string, trial int, params string, value double, status string, seconds double"


def draw(space: dict, rng: np.random.Generator) -> dict:
    """One point of a search space."""
    point = {}
    for name, spec in space.items():
        kind = spec.get("type")
        if kind == "categorical":
            point[name] = spec["choices"][int(rng.integers(len(spec["choices"])))]
            continue
        if kind not in ("int", "float"):
            raise ValueError(f"Unknown kind of parameter '{name}': '{kind}'.")
        low, high = spec["low"], spec["high"]
        if spec.get("log"):
            value = float(np.exp(rng.uniform(np.log(low), np.log(high))))
            point[name] = int(round(value)) if kind == "int" else value
        elif kind == "int":
            step = spec.get("step", 1)
            point[name] = int(low + step * rng.integers((high - low) // step + 1))
        else:
            point[name] = float(rng.uniform(low, high))
    return point


def trial_points(models: dict[str, Entry], n_trials: int, seed: int,
                 spaces: dict[str, dict] | None = None) -> dict[str, list[dict]]:
    """Points per model; a given space goes before the catalogue's."""
    points = {}
    for name, entry in models.items():
        space = (spaces or {}).get(name) or entry.space
        rng = np.random.default_rng([seed, zlib.crc32(name.encode())])
        points[name] = [draw(space, rng) for _ in range(n_trials)] if space else []
    return points


def score_point(entry: Entry, params: dict, folds: list[FoldData], labels, metric: str) -> float | None:
    """Mean of the metric over the folds, all folds measured together."""
    rows, times = None, []
    for data in folds:
        fitted = entry.build({**entry.defaults, **params}, data.shape).fit(data.train)
        part = predictions(fitted, data.test, "trial", data.fold)
        rows = part if rows is None else rows.unionByName(part)
        times.append(("trial", data.fold, 0.0, "ok"))
    rows = rows.persist()
    try:
        values = metric_maps(rows, labels, times, only=metric).agg(
            F.avg(F.col("metrics")[metric]).alias("v"), F.count(F.col("metrics")[metric]).alias("n")).first()
        return values["v"] if values["n"] == len(folds) else None
    finally:
        rows.unpersist()


def tune(df: DataFrame, folds: Folds, models: dict[str, Entry], encoder: Estimator, task_type: str,
         target: str | None, metric: str, scratch: str, n_trials: int = fixed.N_TRIALS, seed: int = fixed.SEED,
         timeout_seconds: float | None = None, per_model_timeout_seconds: float | None = None,
         spaces: dict[str, dict] | None = None, threads: int = 4) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The trial table (model, trial, params, value, status, seconds) and the skipped models.

    Trials of a model run on a few driver threads, each in a pool of its own. A trial that runs when the time is up is
    stopped and not recorded.
    """
    df = nan_to_null(df)
    check_folds(folds, df)
    labels = learn_labels(df, task_type, target)
    table = folds.attach(df, f"{scratch}/folds")
    data = [encode_fold(table, folds, i, encoder, labels, seed) for i in range(folds.n_splits)]
    start, rows, skipped = time.monotonic(), [], []
    points = trial_points(models, n_trials, seed, spaces)

    def run(name, entry, number, params, deadline):
        began = time.monotonic()
        value, status = None, "complete"
        try:
            value = within(df.sparkSession, left(deadline), lambda: score_point(entry, params, data, labels, metric))
            status = "complete" if value is not None else "pruned"
        except MissingPackage:
            raise
        except BudgetSpent:
            return None
        except Exception:  # a bad combination prunes its trial
            status = "pruned"
        return name, number, json.dumps(params), value, status, round(time.monotonic() - began, 4)

    try:
        for name, entry in models.items():
            now = time.monotonic()
            if timeout_seconds is not None and now - start >= timeout_seconds:
                skipped.append((name, "time budget spent"))
                continue
            if not points[name]:
                skipped.append((name, "no search space"))
                continue
            limits = [x for x in (None if timeout_seconds is None else start + timeout_seconds,
                                  None if per_model_timeout_seconds is None else now + per_model_timeout_seconds)
                      if x is not None]
            deadline = min(limits) if limits else None
            try:
                done = side_by_side(df.sparkSession, [
                    lambda n=n, p=p, name=name, entry=entry, deadline=deadline: run(name, entry, n, p, deadline)
                    for n, p in enumerate(points[name])], threads)
                rows += [r for r in done if r is not None]
            except MissingPackage as problem:
                skipped.append((name, f"missing package {problem.name}"))
    finally:
        for fold in data:
            fold.release()
    return df.sparkSession.createDataFrame(rows, TRIALS), skipped


def best_trials(trials: DataFrame, models: dict[str, Entry], metric: str) -> DataFrame:
    """One ranked row per model: best value, tuned parameters over the defaults, trial counts."""
    pick = F.min_by if minimised(metric) else F.max_by
    done = F.when(F.col("status") == "complete", F.col("value"))
    table = trials.groupBy("model").agg(
        F.round(F.min(done) if minimised(metric) else F.max(done), 6).alias("best_value"),
        pick("params", done).alias("tuned_params"), F.count_if(F.col("status") == "complete").alias("n_complete"),
        F.count_if(F.col("status") == "pruned").alias("n_pruned"), F.sum("seconds").alias("elapsed_seconds"))
    defaults = F.create_map(*[F.lit(x) for m, e in models.items() for x in (m, json.dumps(e.defaults))])
    kind = "map<string,string>"
    both = F.map_concat(
        F.map_filter(F.from_json(defaults[F.col("model")], kind),
                     lambda k, v: ~F.array_contains(F.map_keys(F.from_json(F.coalesce("tuned_params", F.lit("{}")), kind)), k)),
        F.from_json(F.coalesce("tuned_params", F.lit("{}")), kind))
    order = F.asc_nulls_last("best_value") if minimised(metric) else F.desc_nulls_last("best_value")
    return table.select(
        F.when(F.col("n_complete") > 0, F.row_number().over(Window.orderBy(order, "model"))).alias("rank"),
        "model", "best_value", "tuned_params", F.to_json(both).alias("best_params"), "n_complete", "n_pruned",
        "elapsed_seconds", F.when(F.col("n_complete") > 0, "ok").otherwise("failed").alias("status"))

"""A whole experiment: every step in order, each logged, results as DataFrames."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions import fixed
from tablewright.operators import drift, features, folds as fold_ops, metrics, profile, quality, ranking
from tablewright.operators.clean import Cleaner
from tablewright.plans import training, zoo
from tablewright.plans.latent import LatentResult, run_latent
from tablewright.plans.search import best_trials, tune
from tablewright.plans.task import Task, resolve_task
from tablewright.sources import records
from tablewright.sources.tables import artifact_digest, load, save_pipeline


@dataclass
class Experiment:
    id: str
    run_id: str
    task: Task
    parts: dict[str, DataFrame] = field(default_factory=dict)
    cleaning: object = None
    encoder: object = None
    folds: fold_ops.Folds | None = None
    training: training.CrossResult | None = None
    latent: LatentResult | None = None
    model: object = None
    artifact: str | None = None


def _json_rows(df: DataFrame) -> str:
    """A small result table (one row per column, finding or model) as JSON text."""
    return json.dumps([json.loads(r) for r in df.toJSON().collect()])


def run_experiment(spark: SparkSession, scratch: str, *, key: str, task_type: str, target: str | None = None,
                   dataframe: DataFrame | None = None, source_type: str | None = None,
                   source_uri: str | None = None, name: str = "experiment", metric: str | None = None,
                   strategy: str | None = None, time_column: str | None = None, group_column: str | None = None,
                   success_threshold: float | None = None, n_splits: int = fixed.N_SPLITS,
                   test_size: float = fixed.TEST_SIZE, seed: int = fixed.SEED, cleaning: dict | None = None,
                   encoding: dict | None = None, include: list[str] | None = None,
                   exclude: list[str] | None = None, params: dict[str, dict] | None = None,
                   time_budget_seconds: float | None = None, autoencoder: dict | None = None,
                   search: dict | None = None, selection_rule: str = "best_mean",
                   confidence: float = fixed.CONFIDENCE, deploy: bool = False, monitor: DataFrame | None = None,
                   monitored_on: date | None = None, store: records.RecordStore | None = None) -> Experiment:
    task = resolve_task(task_type, target, metric, strategy, success_threshold, time_column, group_column)
    run = Experiment(uuid.uuid4().hex, uuid.uuid4().hex, task)
    counter = 0

    def event(agent: str, kind: str, why: str, output: dict | None = None) -> None:
        nonlocal counter
        counter += 1
        if store is not None:
            store.log_event(run.id, agent, kind, counter, datetime.now(timezone.utc), why,
                            output_json=json.dumps(output or {}))

    def experiment_row(status: str) -> None:
        if store is not None:
            config = json.dumps({"n_splits": n_splits, "seed": seed, "strategy": task.strategy})
            store.append("experiments", [dict(
                id=run.id, name=name, task_type=task.task_type, target_column=target, primary_metric=task.metric,
                status=status, created_at=datetime.now(timezone.utc), config=config)])

    experiment_row("running")
    event("problem", "problem_formulation", "; ".join(task.alerts))
    try:
        _run(spark, scratch, run, event, key, load(spark, source_type, source_uri, dataframe), n_splits, test_size, seed,
             cleaning or {}, encoding or {}, include, exclude, params or {}, time_budget_seconds, autoencoder,
             search, selection_rule, confidence, deploy, monitor, monitored_on, store, name, source_type or "dataframe", source_uri)
    except Exception:
        experiment_row("failed")
        raise
    experiment_row("finished")
    return run


def _run(spark, scratch, run, event, key, df, n_splits, test_size, seed, cleaning, encoding, include, exclude,
         params, budget, autoencoder, search, rule, confidence, deploy, monitor, monitored_on, store, name, source_type,
         source_uri):
    task, parts, target = run.task, run.parts, run.task.target
    started = datetime.now(timezone.utc)
    # -- look at the table
    facts = profile.profile_table(df, target, key, task.time_column, task.group_column)
    parts["profile"] = spark.createDataFrame(facts.collect(), facts.schema)  # one row per column
    parts["profile_alerts"] = profile.profile_alerts(df, target, parts["profile"], task.task_type)
    event("data_profile", "data_profiling", "One row per column.", {"columns": parts["profile"].count()})
    # -- clean it
    run.cleaning = Cleaner.of(target, **cleaning).fit(df)
    # Written once: profile, folds, training and drift all read the clean rows.
    cleaned, place = run.cleaning.transform(df), f"{scratch}/{run.run_id}/clean"
    cleaned.write.parquet(place)
    clean = spark.read.schema(cleaned.schema).parquet(place)
    parts["actions"], parts["clean_alerts"] = run.cleaning.actions(spark), run.cleaning.alerts(spark)
    parts["quality"] = quality.quality_report(run.cleaning.representation(df), target)
    parts["clean"] = clean
    event("cleaning", "data_cleaning", "Steps are repeatable from the plan.",
          {"actions": [dict(zip(("operation", "column", "rows", "value", "reason"), a[1:]))
                       for a in run.cleaning.steps["actions"]]})
    if store is not None:
        digest = profile.content_hash(clean).first()["content_hash"]
        store.append("datasets", [dict(
            id=uuid.uuid4().hex, experiment_id=run.id, name=name, source_type=source_type, source_uri=source_uri,
            content_hash=digest, schema_json=df.schema.json(), profile_json=_json_rows(parts["profile"]),
            quality_report_json=_json_rows(parts["quality"].filter(F.col("finding") != "rare_category")),
            created_at=datetime.now(timezone.utc))])
        store.append("pipeline_runs", [dict(id=run.run_id, experiment_id=run.id, data_version=digest, seed=seed,
                                            status="running", started_at=started)])
    # -- features and folds
    rows = [r for r in profile.profile_table(clean, target, key, task.time_column, task.group_column,
                                             sniff_dates=False).collect()]
    run.encoder = features.feature_encoder(clean, target, rows, **encoding)
    event("feature", "feature_engineering", "Fitted on training rows only.",
          {"groups": json.loads(run.encoder.getOrDefault("groups"))})
    run.folds = fold_ops.assign_folds(
        clean, key, task.strategy, target=target, task_type=task.task_type, group_column=task.group_column,
        time_column=task.time_column, n_splits=n_splits, test_size=test_size, seed=seed)
    fold_ops.check_folds(run.folds, clean, task.group_column if run.folds.grouped else None)
    parts["folds"] = fold_ops.fold_summary(run.folds)
    event("split", "data_splitting", "; ".join(run.folds.alerts), {"strategy": run.folds.strategy})
    # -- train, compare, search
    models, alerts = zoo.select_models(task.task_type, include, exclude)
    run.training = training.cross_train(clean, run.folds, models, run.encoder, task.task_type, target,
                                        f"{scratch}/{run.run_id}", params, seed, budget)
    results = run.training.results
    parts["results"] = spark.createDataFrame(results.collect(), results.schema)  # models x folds rows
    parts["oof"] = run.training.oof
    event("trainer", "model_training", "; ".join(alerts + run.training.alerts))
    if autoencoder is not None:
        run.latent = run_latent(clean, run.folds, run.encoder, scratch=f"{scratch}/{run.run_id}/latent",
                                task_type=task.task_type, target=target, metric=task.metric, seed=seed, **autoencoder)
        parts["latent"] = run.latent.comparison
        event("autoencoder", "autoencoder_training", "; ".join(run.latent.alerts))
    if search is not None:
        trials, _ = tune(clean, run.folds, models, run.encoder, task.task_type, target, task.metric,
                         f"{scratch}/{run.run_id}/search", seed=seed, **search)
        parts["trials"], parts["best_trials"] = trials, best_trials(trials, models, task.metric)
        event("optimization", "hyperparameter_search", "Random draws, seeded.")
    # -- choose
    summary = ranking.model_summary(parts["results"], task.metric, confidence)
    chosen = ranking.meets_threshold(ranking.select_model(summary, task.metric, rule), task.metric, task.success_threshold)
    parts["ranking"], parts["chosen"] = summary, chosen
    parts["significance"] = ranking.significance(summary)
    best = chosen.first()
    if best is None:
        raise ValueError(f"No model has the metric '{task.metric}'.")
    event("evaluator", "model_evaluation", f"Rule {rule}.", {"best_model": best["model"]})
    of_best = parts["oof"].filter(F.col("model") == best["model"])
    if task.task_type == "regression":
        parts["residuals"] = metrics.residuals(of_best)
    else:
        parts["confusion"] = metrics.confusion(of_best)
    parts["secondary"] = secondary_means(parts["results"], task.metric)
    parts["left_out"] = spark.createDataFrame(run.training.skipped, "model string, reason string")
    if task.task_type != "anomaly":
        parts["explanation"] = training.fold_explanation(
            clean, run.folds, run.encoder, models[best["model"]], run.training.params[best["model"]], task.task_type,
            target, f"{scratch}/{run.run_id}", seed)
    # -- ship
    if deploy:
        model_name, entry, own = training.selected_model(chosen, run.training.params, models)
        run.model, labels = training.fit_final(clean, key, run.encoder, entry, own, task.task_type, target, seed)
        run.artifact = save_pipeline(run.model, f"{scratch}/{run.run_id}/{model_name}")
        parts["artifact"] = artifact_digest(spark, run.artifact)
        groups, _ = features.column_groups(rows, target)
        monitored = [c for g in groups.values() for c in g]
        parts["drift_reference"] = drift.drift_reference(clean, monitored)
        if monitor is not None:
            parts["drift"] = drift.drift_columns(parts["drift_reference"], monitor)
            parts["retraining"] = drift.retraining_due(
                drift.summarise(parts["drift"]), date.today(), monitored_on or date.today(), metric_met=best["meets_success_threshold"])
        event("deployment", "model_deployment", model_name, {"artifact": run.artifact})
    # -- report
    parts["notes"] = notes(spark, run, alerts + run.training.alerts)
    parts["results_table"] = records.result_table(summary)
    parts["model_card"] = records.model_card(chosen, name, task.task_type, target, task.metric, seed)
    event("report", "report_generation", f"Recommended: {best['model']}.")
    if store is not None:
        rows = records.result_rows(parts["results"].filter(F.col("metrics").isNotNull()), run.run_id)
        own = spark.createDataFrame([(m, json.dumps(p, sort_keys=True, default=str))
                                     for m, p in run.training.params.items()], "model_name string, hyperparameters string")
        digest = parts["artifact"].first()["sha256"] if deploy else None
        shipped = F.col("fold").isNull() & (F.col("model_name") == best["model"])
        store.append("model_results", rows.join(F.broadcast(own), "model_name", "left").select(  # one row per model
            F.xxhash64("run_id", "model_name", F.coalesce("fold", F.lit(-1))).alias("id"), "run_id", "model_name", "fold",
            "hyperparameters", "metrics_json", "fit_seconds",
            F.when(shipped, F.lit(run.artifact).cast("string")).alias("artifact_path"),
            F.when(shipped, F.lit(digest).cast("string")).alias("artifact_hash"),
            F.current_timestamp().alias("created_at")))
        store.append("reports", [dict(
            id=uuid.uuid4().hex, experiment_id=run.id, run_id=run.run_id, format="json", content=None,
            summary_json=_json_rows(parts["model_card"]), created_at=datetime.now(timezone.utc))])
        store.append("pipeline_runs", [dict(
            id=run.run_id, experiment_id=run.id, seed=seed, status="finished", started_at=started,
            finished_at=datetime.now(timezone.utc), metrics_json=json.dumps({"best_model": best["model"],
                                                                             task.metric: best["primary_mean"]}))])


def secondary_means(results: DataFrame, primary: str) -> DataFrame:
    """(model, metric, mean): mean over the folds of every metric but the primary one."""
    return (results.select("model", F.explode("metrics").alias("metric", "value")).filter(F.col("metric") != primary)
            .groupBy("model", "metric").agg(F.round(F.avg("value"), 6).alias("mean")))


def notes(spark, run: Experiment, alerts: list[str]) -> DataFrame:
    """(pos, kind, text): risks, limits and next steps, each text once, in order."""
    risks, limits, steps = [], [], []
    for r in run.parts["profile_alerts"].collect():  # findings: a few per column
        if r["alert"] in ("correlated_with_target", "imbalanced_target"):
            risks.append(f"{r['alert']}: {r['column']} ({r['value']})")
        else:
            limits.append(f"[profile] {r['alert']}: {r['column']}")
    for r in run.parts["significance"].filter("overlap").collect():
        limits.append(f"The intervals of {r['first']} and {r['second']} overlap.")
    if run.parts["chosen"].first()["meets_success_threshold"] is False:
        limits.append("The chosen model misses the success threshold.")
        steps.append("Gather more data or features: the success threshold is missed.")
    if run.folds.n_samples < fixed.SMALL_TABLE_ROWS:
        limits.append(f"Small table ({run.folds.n_samples} rows).")
        steps.append("Enlarge the table.")
    limits += [f"[cleaning] {r['alert']}: {r['column']}" for r in run.parts["clean_alerts"].collect()]
    limits += [f"[split] {a}" for a in run.folds.alerts] + [f"[training] {a}" for a in alerts]
    limits += [f"[training] '{m}' is left out: {r}" for m, r in run.training.skipped]
    if run.latent is not None:
        limits += [f"[autoencoder] {a}" for a in run.latent.alerts]
    steps += ["Monitor drift and set a retraining trigger.", "Review the decision and its risks by hand."]
    rows = [(k, t) for k, ts in (("risk", risks), ("limit", limits), ("next_step", steps)) for t in ts]
    table = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "pos int, kind string, text string")
    return table.groupBy("kind", "text").agg(F.min("pos").alias("pos")).select("pos", "kind", "text").orderBy("pos")

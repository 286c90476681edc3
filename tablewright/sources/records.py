"""Run records as append-only Parquet tables, and the queries on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.exprs import any_of, col
from tablewright.operators.ranking import stored_ranking

# Table and column names of the record store.
SCHEMAS = {
    "experiments": "id string, name string, task_type string, target_column string, "
                   "primary_metric string, status string, created_at timestamp, config string",
    "datasets": "id string, experiment_id string, name string, source_type string, source_uri string, "
                "content_hash string, schema_json string, profile_json string, "
                "quality_report_json string, created_at timestamp",
    "agent_events": "id long, experiment_id string, agent_name string, event_type string, "
                    "input_json string, output_json string, rationale string, created_at timestamp",
    "pipeline_runs": "id string, experiment_id string, code_version string, data_version string, "
                     "seed int, status string, started_at timestamp, finished_at timestamp, "
                     "metrics_json string",
    "model_results": "id long, run_id string, model_name string, fold int, hyperparameters string, "
                     "metrics_json string, fit_seconds double, artifact_path string, "
                     "artifact_hash string, created_at timestamp",
    "reports": "id string, experiment_id string, run_id string, format string, content string, "
               "summary_json string, created_at timestamp",
}
# Tables whose queries name one parent are partitioned by its hash: a folder for each parent is as many files as parents.
PARTITIONS = {"agent_events": "experiment_id", "model_results": "run_id"}
BUCKET, BUCKETS = "_bucket", 64
ACTION = "array<struct<operation:string,column:string,rows:long,value:string,reason:string>>"


class RecordStore:
    """Tables below one folder. Changes are appended; readers take the latest row per id."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def append(self, table: str, rows: DataFrame | list[dict]) -> None:
        schema = SCHEMAS[table]
        if isinstance(rows, list):
            names = [part.strip().split(" ")[0] for part in schema.split(",")]
            rows = self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
        writer = rows.write.mode("append")
        if table in PARTITIONS:
            # One file per bucket where it is small, several where one parent is most rows; sorted, so that a reader of
            # one parent skips the other row groups.
            parent = PARTITIONS[table]
            dealt = rows.withColumn(BUCKET, _bucket(F.col(parent))).hint("rebalance", BUCKET)
            writer = dealt.sortWithinPartitions(BUCKET, parent).write.mode("append").partitionBy(BUCKET)
        writer.parquet(self.path(table))

    def table(self, table: str, parent: str | None = None) -> DataFrame:
        """All rows, or those of one parent."""
        if table not in PARTITIONS:
            return self.spark.read.schema(SCHEMAS[table]).parquet(self.path(table))
        rows = self.spark.read.schema(f"{SCHEMAS[table]}, {BUCKET} int").parquet(self.path(table))
        if parent is not None:
            rows = rows.filter((F.col(BUCKET) == _bucket(F.lit(parent))) & (F.col(PARTITIONS[table]) == parent))
        # the parent's column last, where partitioned tables have it
        return rows.select(*[c for c in rows.columns if c not in (BUCKET, PARTITIONS[table])], PARTITIONS[table])

    def log_event(self, experiment_id: str, agent_name: str, event_type: str, number: int, when,
                  rationale: str = "", input_json: str | None = None, output_json: str | None = None):
        self.append("agent_events", [dict(
            id=number, experiment_id=experiment_id, agent_name=agent_name, event_type=event_type,
            input_json=input_json, output_json=output_json, rationale=rationale, created_at=when)])

    def experiments(self) -> DataFrame:
        return latest_by_id(self.table("experiments"), "created_at")

    def runs(self) -> DataFrame:
        """Latest state of each run: a finished row follows its running row."""
        moment = F.coalesce("finished_at", "started_at")
        return latest_by_id(self.table("pipeline_runs").withColumn("_at", moment), "_at").drop("_at")

    def experiment(self, experiment_id: str) -> DataFrame:
        return latest_by_id(self.table("experiments").filter(F.col("id") == experiment_id), "created_at")

    def experiment_of_run(self, run_id: str) -> DataFrame:
        return owner_of_run(self.experiments(), self.runs(), run_id)

    def events_of(self, experiment_id: str) -> DataFrame:
        return event_history(self.table("agent_events", experiment_id), experiment_id)

    def runs_of(self, experiment_id: str) -> DataFrame:
        return self.runs().filter(F.col("experiment_id") == experiment_id).orderBy("started_at", "id")

    def latest_report(self, experiment_id: str | None = None) -> DataFrame:
        return self._latest("reports", experiment_id)

    def latest_dataset(self, experiment_id: str | None = None) -> DataFrame:
        return self._latest("datasets", experiment_id)

    def _latest(self, table, experiment_id):
        rows = self.table(table)
        if experiment_id is not None:
            rows = rows.filter(F.col("experiment_id") == experiment_id)
        return latest_per(rows, ["experiment_id"], ["created_at", "id"])

    def ranking(self, run_id: str) -> DataFrame:
        found = self.experiment_of_run(run_id).select("primary_metric").first()
        metric = found["primary_metric"] if found else ""
        return stored_ranking(self.table("model_results", run_id), metric, run_id)


def _bucket(parent: Column) -> Column:
    return F.pmod(F.xxhash64(parent), F.lit(BUCKETS)).cast("int")


def latest_per(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row per ``by`` in the given order: a map-side aggregate, no window."""
    rest = [c for c in df.columns if c not in by]
    picked = df.groupBy(*by).agg(
        F.max_by(F.struct(*[col(c) for c in rest]), F.struct(*[col(c) for c in order])).alias("_r"))
    return picked.select(*by, *[F.col(f"_r.`{c}`").alias(c) for c in rest]).select(
        *[col(c) for c in df.columns])


def latest_by_id(df: DataFrame, moment: str) -> DataFrame:
    return latest_per(df, ["id"], [moment])


def owner_of_run(experiments: DataFrame, runs: DataFrame, run_id: str) -> DataFrame:
    wanted = runs.filter(F.col("id") == run_id).select(F.col("experiment_id").alias("id"))
    return experiments.join(wanted, "id", "left_semi")


def event_history(events: DataFrame, experiment_id: str) -> DataFrame:
    return events.filter(F.col("experiment_id") == experiment_id).orderBy("created_at", "id")


def search(df: DataFrame, text: str | None, columns: list[str], equal: dict | None = None) -> DataFrame:
    """Rows with ``text`` in one of the columns, whatever the case, and the given equalities."""
    for c, v in (equal or {}).items():
        df = df.filter(col(c) == v)
    if text:
        df = df.filter(any_of([F.contains(F.lower(col(c).cast("string")), F.lit(text.lower()))
                               for c in columns]))
    return df


def browse(df: DataFrame, text: str | None, columns: list[str], order: str, descending: bool = True,
           key: str | None = None) -> DataFrame:
    """Search, then newest (or any order) first."""
    by = [F.desc(order) if descending else F.asc(order)] + ([F.asc(key)] if key else [])
    return search(df, text, columns).orderBy(*by)


def agent_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("agent_name").agg(F.count(F.lit(1)).alias("events"))


def logged_actions(events: DataFrame, field: str = "actions", schema: str = ACTION) -> DataFrame:
    """(id, position, fields of the action): actions out of the event JSON."""
    parsed = F.from_json(F.get_json_object("output_json", f"$.{field}"), schema)
    return events.select("id", F.posexplode(parsed).alias("position", "action")).select(
        "id", "position", "action.*")


def operation_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("operation").agg(F.count(F.lit(1)).alias("n"))


def result_rows(results: DataFrame, run_id: str) -> DataFrame:
    """(run_id, model_name, fold, metrics_json, fit_seconds): fold rows and one total per model.

    The total has fold NULL and holds the mean of each metric; both come from one grouping-sets
    aggregate over (model, fold, metric).
    """
    long = results.select("model", "fold", "fit_seconds", F.explode("metrics").alias("metric", "value"))
    sets = long.groupingSets([["model", "metric", "fold"], ["model", "metric"]], "model", "metric", "fold").agg(
        F.round(F.avg("value"), 6).alias("value"), F.avg("fit_seconds").alias("fit_seconds"))
    return sets.groupBy("model", "fold").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("m"),
        F.max("fit_seconds").alias("fit_seconds")).select(
        F.lit(run_id).alias("run_id"), F.col("model").alias("model_name"), "fold",
        F.to_json("m").alias("metrics_json"), "fit_seconds")


def deduplicated(notes: DataFrame) -> DataFrame:
    """(pos, text) without repeated texts, first place kept."""
    return notes.groupBy("text").agg(F.min("pos").alias("pos")).select("pos", "text").orderBy("pos")


def result_table(summary: DataFrame) -> DataFrame:
    """The table of the report: one row per ranked model."""
    return summary.select("rank", "model", F.col("primary_mean").alias("mean"),
                          F.col("primary_std").alias("std"), "ci_low", "ci_high",
                          F.col("n_folds").alias("folds"), "mean_fit_seconds")


def model_card(chosen: DataFrame, experiment: str, task_type: str, target: str | None, metric: str,
               seed: int) -> DataFrame:
    """One row for the chosen model; ``chosen`` carries threshold and selection rule."""
    return chosen.select(
        F.lit(experiment).alias("experiment"), F.col("model"), F.lit(task_type).alias("task_type"),
        F.lit(target).alias("target_column"), F.lit(metric).alias("primary_metric"),
        F.col("primary_mean").alias("mean"), F.col("primary_std").alias("std"), "ci_low", "ci_high",
        F.col("selection_rule").alias("selection_criterion"), F.lit(seed).alias("random_seed"),
        "meets_success_threshold")

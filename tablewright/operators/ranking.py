"""From fold results to a chosen model.

A results table has one row per model and fold: (model, fold, metrics map<string,double>,
fit_seconds, status). All tables here have one row per model, or per model and metric.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import fixed
from tablewright.functions.order import lookup
from tablewright.functions.student import t_quantile


def minimised(metric: str) -> bool:
    return (metric or "").lower() in fixed.MINIMISED


def direction(metric: str) -> str:
    return "minimize" if minimised(metric) else "maximize"


def _ok(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") == "ok") if "status" in results.columns else results


def aggregate_metrics(results: DataFrame) -> DataFrame:
    """(model, metric, mean, std): population deviation over the folds, 6 digits."""
    long = _ok(results).select("model", F.explode("metrics").alias("metric", "value"))
    return long.filter(F.col("value").isNotNull()).groupBy("model", "metric").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))


def _by_value(metric: str, column: str):
    return F.asc_nulls_last(column) if minimised(metric) else F.desc_nulls_last(column)


def rank_models(results: DataFrame, metric: str) -> DataFrame:
    """Order of training: mean of the metric in its direction."""
    order = Window.orderBy(_by_value(metric, "mean"), "model")  # one row per model
    return (aggregate_metrics(results).filter(F.col("metric") == metric)
            .withColumn("rank", F.row_number().over(order))
            .select("rank", "model", F.col("mean").alias("primary_metric_mean"),
                    F.col("std").alias("primary_metric_std")))


def model_summary(results: DataFrame, metric: str, confidence: float = fixed.CONFIDENCE,
                  means: DataFrame | None = None) -> DataFrame:
    """Ranked models with mean, sample deviation, interval, range, folds and times.

    ``means`` (model, metrics) serves models without fold values: they rank by their mean,
    without a spread.
    """
    value = F.col("metrics")[metric]
    folds = _ok(results).withColumn("_v", value)
    timed = folds.groupBy("model").agg(
        F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"), F.min("_v").alias("low"),
        F.max("_v").alias("high"), F.count("_v").alias("n"), F.avg("fit_seconds").alias("avg_s"),
        F.sum("fit_seconds").alias("sum_s")).filter(F.col("n") > 0)
    counts = [r["n"] for r in timed.select("n").distinct().collect()]
    factor = lookup(F.col("n"), {n: t_quantile((1 + confidence) / 2, n - 1) for n in counts if n > 1})
    std = F.coalesce(F.col("std"), F.lit(0.0))
    margin = F.when((F.col("n") > 1) & (std > 0), std / F.sqrt("n") * factor).otherwise(0.0)
    table = timed.select(
        "model", F.round("mean", 6).alias("primary_mean"), F.round(std, 6).alias("primary_std"),
        F.round(F.col("mean") - margin, 6).alias("ci_low"),
        F.round(F.col("mean") + margin, 6).alias("ci_high"),
        F.round("low", 6).alias("primary_min"), F.round("high", 6).alias("primary_max"),
        F.col("n").alias("n_folds"), F.round("avg_s", 4).alias("mean_fit_seconds"),
        F.round("sum_s", 4).alias("total_fit_seconds"))
    if means is not None:
        bare = means.join(table.select("model"), "model", "left_anti").filter(value.isNotNull())
        table = table.unionByName(bare.select(
            "model", F.round(value, 6).alias("primary_mean"), F.lit(0).cast("long").alias("n_folds")),
            allowMissingColumns=True)
    order = Window.orderBy(_by_value(metric, "primary_mean"), F.asc_nulls_last("primary_std"),
                           F.asc_nulls_last("mean_fit_seconds"), "model")
    return table.select(F.row_number().over(order).alias("rank"), "*")


def left_out(results: DataFrame, metric: str) -> DataFrame:
    """(model, reason): failed models and models without the metric."""
    status = F.col("status") if "status" in results.columns else F.lit("ok")
    per_model = results.groupBy("model").agg(
        F.count_if(status != "ok").alias("failed"), F.count(F.col("metrics")[metric]).alias("n"))
    return per_model.filter("failed > 0 OR n = 0").select(
        "model", F.when(F.col("failed") > 0, "status not ok").otherwise("no primary metric").alias("reason"))


def secondary_means(results: DataFrame, metric: str) -> DataFrame:
    """(model, metric, mean) of every metric but the primary."""
    return aggregate_metrics(results).filter(F.col("metric") != metric).select("model", "metric", "mean")


def select_model(summary: DataFrame, metric: str, rule: str = "best_mean") -> DataFrame:
    """The row of the chosen model: the first, or the fastest within one standard error."""
    if rule not in fixed.SELECTION_RULES:
        raise ValueError(f"Unknown selection rule '{rule}'; one of {fixed.SELECTION_RULES}.")
    first = summary.filter(F.col("rank") == 1)
    if rule == "best_mean":
        return first.withColumn("selection_rule", F.lit(rule))
    se = F.coalesce(F.col("primary_std"), F.lit(0.0)) / F.sqrt(F.greatest(F.col("n_folds"), F.lit(1)))
    reach = first.select((F.col("primary_mean") + (se if minimised(metric) else -se)).alias("_limit"))
    joined = summary.crossJoin(F.broadcast(reach))  # one row on the right
    inside = (F.col("primary_mean") <= F.col("_limit") if minimised(metric)
              else F.col("primary_mean") >= F.col("_limit"))
    return (joined.filter(inside).drop("_limit")
            .orderBy(F.asc_nulls_last("mean_fit_seconds"), "rank").limit(1)
            .withColumn("selection_rule", F.lit(rule)))


def significance(summary: DataFrame) -> DataFrame:
    """(first, second, overlap) of ranks 1 and 2; no row for one model, NULL without intervals."""
    after = Window.orderBy("rank")
    paired = summary.select(
        "rank", F.col("model").alias("first"), F.lead("model").over(after).alias("second"),
        "ci_low", "ci_high", F.lead("ci_low").over(after).alias("low2"),
        F.lead("ci_high").over(after).alias("high2"))
    return paired.filter((F.col("rank") == 1) & F.col("second").isNotNull()).select(
        "first", "second",
        (~((F.col("ci_high") < F.col("low2")) | (F.col("high2") < F.col("ci_low")))).alias("overlap"))


def meets_threshold(chosen: DataFrame, metric: str, threshold: float | None) -> DataFrame:
    """The chosen row with success_threshold and whether it is met; NULL if none is set."""
    limit = F.lit(threshold).cast("double")
    met = F.col("primary_mean") <= limit if minimised(metric) else F.col("primary_mean") >= limit
    return chosen.withColumn("success_threshold", limit).withColumn("meets_success_threshold", met)


def stored_ranking(model_results: DataFrame, metric: str, run_id: str | None = None) -> DataFrame:
    """Ranking from stored rows: fold rows only, the metric taken from the JSON field."""
    rows = model_results.filter(F.col("fold").isNotNull())
    if run_id is not None:
        rows = rows.filter(F.col("run_id") == run_id)
    value = F.get_json_object("metrics_json", f"$.{metric}").try_cast("double")
    table = rows.withColumn("_v", value).filter(F.col("_v").isNotNull()).groupBy("model_name").agg(
        F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.count("_v").alias("folds"),
        F.avg("fit_seconds").alias("mean_fit_seconds"))
    order = Window.orderBy(_by_value(metric, "mean"), "model_name")
    return table.select(F.row_number().over(order).alias("rank"), "model_name",
                        F.lit(metric).alias("primary_metric"), "mean", "std", "folds", "mean_fit_seconds")


def compare(candidate: DataFrame, baseline: DataFrame, metric: str) -> DataFrame:
    """Candidate against baseline means: two (metric, mean) tables; not conclusive if absent."""
    a = candidate.filter(F.col("metric") == metric).agg(F.first("mean").alias("candidate"))
    b = baseline.filter(F.col("metric") == metric).agg(F.first("mean").alias("baseline"))
    low = minimised(metric)
    x, y = F.col("candidate"), F.col("baseline")
    return a.crossJoin(F.broadcast(b)).select(  # one row each
        F.lit(metric).alias("primary_metric"), "candidate", "baseline", F.round(x - y, 6).alias("delta"),
        F.lit(low).alias("lower_is_better"), (x < y if low else x > y).alias("candidate_better"),
        (x.isNotNull() & y.isNotNull()).alias("conclusive"))

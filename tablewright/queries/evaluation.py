"""Folds, metrics, ranking and drift."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tablewright.operators import drift as D
from tablewright.operators import folds as V
from tablewright.operators import metrics as E
from tablewright.operators import ranking as R
from tablewright.queries.base import (
    FOLD_RESULTS, PREDICTED_PRICES, RATED_ORDERS, SCORED_EVENTS, T_975_4, fold_results, longs,
    predicted_prices, rated_orders, rounded, scored_events, table)

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f
    return register


# -- folds -----------------------------------------------------------------------------

HASHED = "md5('42|' || event_id), event_id"


@query("folds_kfold", f"select event_id, cast((row_number() over (order by {HASHED}) - 1) % 5 as int) as fold from events")
def folds_kfold(spark, d):
    return V.assign_folds(table(spark, d, "events"), "event_id", "kfold").table


@query("folds_kfold_ordered", """select event_id, cast(case when r < m * (s + 1) then r // (s + 1) else m + (r - m * (s + 1)) // s end as int) as fold
  from (select event_id, row_number() over (order by event_id) - 1 as r, count(*) over () % 7 as m, count(*) over () // 7 as s from events)""")
def folds_kfold_ordered(spark, d):
    return V.assign_folds(table(spark, d, "events"), "event_id", "kfold", n_splits=7, shuffle=False).table


STRATIFIED = f"""select event_id, event_type, cast((r + s) % 5 as int) as fold from (
  select event_id, event_type, row_number() over (partition by event_type order by {HASHED}) - 1 as r from events)
  join (select event_type, coalesce(sum(n) over (order by event_type rows between unbounded preceding and 1 preceding), 0) % 5 as s
  from (select event_type, count(*) as n from events group by 1)) using (event_type)"""


@query("folds_stratified", f"select event_id, fold from ({STRATIFIED})")
def folds_stratified(spark, d):
    return V.assign_folds(table(spark, d, "events"), "event_id", "stratified_kfold", target="event_type").table


GROUPED = """select event_id, user_id, fold from events join (select user_id,
  cast((row_number() over (order by md5('42|' || user_id), user_id) - 1) % 5 as int) as fold
  from (select distinct user_id from events)) using (user_id)"""


@query("folds_group", f"select event_id, fold from ({GROUPED})")
def folds_group(spark, d):
    return V.assign_folds(table(spark, d, "events"), "event_id", "group_kfold", group_column="user_id").table


@query("folds_group_sized", """with sizes as (select user_id, row_number() over (order by count(*) desc, md5('0|' || user_id), user_id) - 1 as p
  from events group by 1)
  select event_id, cast(case when p // 3 % 2 = 0 then p % 3 else 2 - p % 3 end as int) as fold
  from events join sizes using (user_id)""")
def folds_group_sized(spark, d):
    return V.assign_folds(table(spark, d, "events"), "event_id", "group_kfold", group_column="user_id",
                          n_splits=3, shuffle=False).table


TIME = """(select event_id, i as fold, case when r < n - (5 - i) * t then 'train' else 'test' end as part from (
  select event_id, row_number() over (order by ts, md5('42|' || event_id), event_id) - 1 as r, count(*) over () as n,
  count(*) over () // 6 as t from ({source})), (select unnest([0, 1, 2, 3, 4]) as i) where r < n - (4 - i) * t)"""


@query("folds_time", TIME.format(source="select event_id, ts from events"))
def folds_time(spark, d):
    return V.assign_folds(table(spark, d, "events"), "event_id", "time_split", time_column="ts").table


@query("folds_time_tied", TIME.format(source="""select event_id, case when event_id % 3 = 0 then timestamp '2024-01-20'
  else date_trunc('day', ts) end as ts from events"""))
def folds_time_tied(spark, d):
    """A third of all rows share one moment."""
    e = table(spark, d, "events").select("event_id", F.expr(
        "case when event_id % 3 = 0 then timestamp_ntz '2024-01-20' else cast(date_trunc('day', ts) as timestamp_ntz) end").alias("ts"))
    return V.assign_folds(e, "event_id", "time_split", time_column="ts").table


HOLDOUT = f"""with c as (select event_type, count(*) as n from events group by 1), q as (select event_type, n,
  n * k / a as share, k from c, (select ceil(sum(n) * 0.2) as k, sum(n) as a from c)),
  z as (select event_type, floor(share) + case when row_number() over (order by share - floor(share) desc, event_type)
   <= k - sum(floor(share)) over () then 1 else 0 end as quota from q)
  select event_id, 0 as fold, case when r <= quota then 'test' else 'train' end as part from (select event_id, event_type,
  row_number() over (partition by event_type order by {HASHED}) as r from events) join z using (event_type)"""


@query("folds_holdout", HOLDOUT)
def folds_holdout(spark, d):
    return V.assign_folds(table(spark, d, "events"), "event_id", "holdout", target="event_type",
                          task_type="classification").table


@query("folds_fallback", f"""select cast(f as int) as fold, count(*) as n_test from (select (row_number() over (
  order by {HASHED}) - 1) % 5 as f from events) group by 1""")
def folds_fallback(spark, d):
    """Stratification of a regression target falls back to plain folds."""
    folds = V.assign_folds(table(spark, d, "events"), "event_id", "stratified_kfold", target="value", task_type="regression")
    return V.fold_summary(folds).select("fold", "n_test")


@query("folds_check", """select cast(null as int) as fold, cast(null as varchar) as value limit 0""")
def folds_check(spark, d):
    e = table(spark, d, "events")
    grouped = V.assign_folds(e, "event_id", "group_kfold", group_column="user_id")
    V.check_folds(grouped, e, "user_id")
    parts = grouped.parts()
    return V.contamination(parts, "event_id").unionByName(V.group_contamination(parts, e, "event_id", "user_id"))


@query("folds_check_mixed", f"""select fold, cast(user_id as varchar) as value from (select user_id, i as fold from
  (select user_id, cast((row_number() over (order by {HASHED}) - 1) % 5 as int) as f from events),
  (select cast(unnest([0, 1, 2, 3, 4]) as int) as i) group by 1, 2 having bool_or(f = i) and bool_or(f <> i))""")
def folds_check_mixed(spark, d):
    """Groups that plain folds tear apart."""
    e = table(spark, d, "events")
    return V.group_contamination(V.assign_folds(e, "event_id", "kfold").parts(), e, "event_id", "user_id")


@query("folds_unknown_rows", "select event_id from events where user_id % 10 = 3")
def folds_unknown_rows(spark, d):
    e = table(spark, d, "events")
    return V.unknown_rows(V.assign_folds(e, "event_id", "kfold").table, e.filter("user_id % 10 <> 3"), "event_id")


@query("folds_summary", f"""select fold, (select count(*) from events) - count(*) as n_train, count(*) as n_test,
  true as stratified, false as grouped, false as temporal, 42::bigint as seed from ({STRATIFIED}) group by fold""")
def folds_summary(spark, d):
    folds = V.assign_folds(table(spark, d, "events"), "event_id", task_type="classification", target="event_type")
    return longs(V.fold_summary(folds), "seed")


# -- metrics ---------------------------------------------------------------------------

CONFUSED = f"""with t as {RATED_ORDERS}, n as (select model, fold, label, prediction, count(*) as n from t group by all),
  c as (select model, fold, class, sum(a) as a, sum(p) as p, sum(h) as h from (
    select model, fold, label as class, n as a, 0 as p, case when label = prediction then n else 0 end as h from n
    union all select model, fold, prediction, 0, n, 0 from n) group by 1, 2, 3)"""


@query("metric_classification", CONFUSED + """, m as (select model, fold, sum(h) / sum(a) as accuracy,
  avg(case when a > 0 then h / a end) as balanced_accuracy, avg(2.0::double * h / (a + p)) as macro_f1,
  sum(2.0::double * h / (a + p) * a) / sum(a) as weighted_f1, sum(a * p)::double / (sum(a) * sum(a)) as pe from c group by 1, 2)
  select model, fold, metric, round(value, 6) as value from (select model, fold,
  unnest(['accuracy', 'balanced_accuracy', 'macro_f1', 'weighted_f1', 'kappa']) as metric,
  unnest([accuracy, balanced_accuracy, macro_f1, weighted_f1, (accuracy - pe) / (1 - pe)]) as value from m)""")
def metric_classification(spark, d):
    sums = E.confusion_metrics(rated_orders(spark, d))
    return rounded(E.unpivot(sums, E.BY, E.CONFUSION_METRICS[:5]), value=6)


@query("metric_precision_recall", CONFUSED + """select model, fold, round(avg(case when p > 0 then h / p else 0 end), 6) as precision,
  round(avg(case when a > 0 then h / a else 0 end), 6) as recall from c group by 1, 2""")
def metric_precision_recall(spark, d):
    return rounded(E.confusion_metrics(rated_orders(spark, d)).select("model", "fold", "precision", "recall"),
                   precision=6, recall=6)


@query("metric_confusion", f"select label, prediction, count(*) as n from {RATED_ORDERS} group by 1, 2")
def metric_confusion(spark, d):
    return E.confusion(rated_orders(spark, d))


@query("metric_confusion_matrix", f"""select label, count(*) filter (prediction = 'F') as F, count(*) filter (prediction = 'O') as O,
  count(*) filter (prediction = 'P') as P from {RATED_ORDERS} group by 1""")
def metric_confusion_matrix(spark, d):
    return E.confusion_matrix(rated_orders(spark, d), ["F", "O", "P"])


def _auc_sql(source: str, by: str) -> str:
    return f"""(select {by}, sum(pos * (below + neg / 2.0::double)) / (sum(pos)::double * sum(neg)) as roc_auc,
      sum(pos * found / taken) / sum(pos) as average_precision from (select *,
      coalesce(sum(neg) over (partition by {by} order by score rows between unbounded preceding and 1 preceding), 0) as below,
      sum(pos) over (partition by {by} order by score desc) as found,
      sum(pos + neg) over (partition by {by} order by score desc) as taken
      from (select {by}, score, sum(label)::double as pos, sum(1 - label)::double as neg from {source} group by all)) group by {by})"""


@query("metric_auc", f"select model, fold, round(roc_auc, 6) as roc_auc from {_auc_sql(SCORED_EVENTS, 'model, fold')}")
def metric_auc(spark, d):
    return rounded(E.ranking_metrics(scored_events(spark, d)).select("model", "fold", "roc_auc"), roc_auc=6)


@query("metric_average_precision",
       f"select model, fold, round(average_precision, 6) as average_precision from {_auc_sql(SCORED_EVENTS, 'model, fold')}")
def metric_average_precision(spark, d):
    return rounded(E.ranking_metrics(scored_events(spark, d)).select("model", "fold", "average_precision"),
                   average_precision=6)


LONG_ORDERS = f"""(select model, fold, 'F' as class, case when label = 'F' then 1 else 0 end as label, s1 as score from {RATED_ORDERS}
  union all select model, fold, 'O', case when label = 'O' then 1 else 0 end, s2 from {RATED_ORDERS}
  union all select model, fold, 'P', case when label = 'P' then 1 else 0 end, s3 from {RATED_ORDERS})"""


@query("metric_auc_multiclass", f"select model, fold, round(avg(roc_auc), 6) as roc_auc from {_auc_sql(LONG_ORDERS, 'model, fold, class')} group by 1, 2")
def metric_auc_multiclass(spark, d):
    return rounded(E.multiclass_auc(rated_orders(spark, d), ["F", "O", "P"]), roc_auc=6)


REGRESSION = f"""select model, fold, unnest(['rmse', 'mse', 'mae', 'r2', 'mape', 'medae']) as metric,
  round(unnest([sqrt(avg(e * e)) , avg(e * e) / 1000.0, avg(abs(e)), 1 - sum(e * e) / (var_pop(label) * count(*)),
  case when count(*) filter (label = 0) = 0 then avg(abs(e / label)) end, median(abs(e))]), 4) as value
  from (select *, label - prediction as e from {PREDICTED_PRICES}) group by 1, 2"""


@query("metric_regression", REGRESSION)
def metric_regression(spark, d):
    long = E.evaluate(predicted_prices(spark, d), "regression")
    scaled = F.when(F.col("metric") == "mse", F.col("value") / 1000.0).otherwise(F.col("value"))
    return long.select("model", "fold", "metric", F.round(scaled, 4).alias("value"))


TOP_K = f"""with t as {SCORED_EVENTS}, r as (select *, row_number() over (partition by model, fold
  order by score desc, md5('0|' || key), key) as r, sum(label) over (partition by model, fold) as k from t)
  select model, fold, cast(any_value(k) as bigint) as k, round(sum(label) filter (r <= k) / any_value(k)::double, 6) as precision_at_k,
  round(sum(label) filter (r <= k) / any_value(k)::double, 6) as recall_at_k from r group by 1, 2"""


@query("metric_precision_at_k", TOP_K)
def metric_precision_at_k(spark, d):
    return rounded(E.precision_at_k(scored_events(spark, d)), precision_at_k=6, recall_at_k=6)


@query("metric_log_loss", f"""select model, fold, round(-avg(ln(greatest(least(case when label = 1 then score else 1 - score end,
  1 - 2.220446049250313e-16), 2.220446049250313e-16))), 6) as log_loss from {SCORED_EVENTS} group by 1, 2""")
def metric_log_loss(spark, d):
    return rounded(E.log_loss(scored_events(spark, d)), log_loss=6)


@query("metric_f1", f"""select model, fold, round(2.0::double * count(*) filter (label = 1 and prediction = 1) /
  (count(*) filter (label = 1) + count(*) filter (prediction = 1)), 6) as f1 from {SCORED_EVENTS} group by 1, 2""")
def metric_f1(spark, d):
    return rounded(E.binary_f1(scored_events(spark, d)), f1=6)


@query("metric_residuals", f"""select model, round(avg(e), 4) as mean_error, round(stddev_samp(e), 4) as std_error,
  round(max(abs(e)), 4) as max_abs_error from (select model, label - prediction as e from {PREDICTED_PRICES}) group by 1""")
def metric_residuals(spark, d):
    return rounded(E.residuals(predicted_prices(spark, d)), mean_error=4, std_error=4, max_abs_error=4)


RARE_LABEL = SCORED_EVENTS.replace("case when event_type = 'error' then 1 else 0 end", "case when value > 150 then 1 else 0 end")


@query("metric_anomaly", f"""with a as {_auc_sql(RARE_LABEL, 'model, fold')} select model, fold,
  unnest(['roc_auc', 'average_precision']) as metric, round(unnest([roc_auc, average_precision]), 6) as value from a""")
def metric_anomaly(spark, d):
    """Without 0/1 labels the rarer class is the anomaly."""
    oof = scored_events(spark, d).drop("label", "prediction").join(table(spark, d, "events").select(
        F.col("event_id").alias("key"), F.when(F.col("value") > 150, "odd").otherwise("usual").alias("label")), "key")
    found = E.evaluate(oof, "anomaly", positive=E.anomaly_positive(oof))
    return rounded(found.filter(F.col("metric") != "precision_at_k"), value=6)


@query("score_stats", """select round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std,
  round(quantile_cont(value, 0.95), 6) as p95, round(max(value), 6) as max from events""")
def score_stats(spark, d):
    return E.score_stats(table(spark, d, "events"), "value")


# -- ranking ---------------------------------------------------------------------------

LONG_RESULTS = f"""(select model, fold, unnest(['rmse', 'r2']) as metric, unnest([rmse, r2]) as value, fit_seconds from {FOLD_RESULTS})"""


@query("rank_aggregate", f"""select model, metric, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std
  from {LONG_RESULTS} group by 1, 2""")
def rank_aggregate(spark, d):
    return R.aggregate_metrics(fold_results(spark, d))


def _rank_sql(metric: str, way: str) -> str:
    return f"""select row_number() over (order by mean {way}, model) as rank, model, mean as primary_metric_mean,
      std as primary_metric_std from (select model, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std
      from {LONG_RESULTS} where metric = '{metric}' group by 1)"""


@query("rank_models", _rank_sql("rmse", "asc"))
def rank_models(spark, d):
    return longs(R.rank_models(fold_results(spark, d), "rmse"), "rank")


@query("rank_models_maximised", _rank_sql("r2", "desc"))
def rank_models_maximised(spark, d):
    return longs(R.rank_models(fold_results(spark, d), "r2"), "rank")


SUMMARY = f"""(select row_number() over (order by primary_mean, primary_std, mean_fit_seconds, model) as rank, * from (
  select model, round(avg(rmse), 6) as primary_mean, round(stddev_samp(rmse), 6) as primary_std,
  round(avg(rmse) - {T_975_4} * stddev_samp(rmse) / sqrt(5), 6) as ci_low,
  round(avg(rmse) + {T_975_4} * stddev_samp(rmse) / sqrt(5), 6) as ci_high, round(min(rmse), 6) as primary_min,
  round(max(rmse), 6) as primary_max, count(*) as n_folds, round(avg(fit_seconds), 4) as mean_fit_seconds,
  round(sum(fit_seconds), 4) as total_fit_seconds from {FOLD_RESULTS} group by 1))"""


@query("rank_summary", f"select * from {SUMMARY}")
def rank_summary(spark, d):
    return longs(R.model_summary(fold_results(spark, d), "rmse"), "rank")


@query("rank_secondary", f"""select model, 'r2' as metric, round(avg(r2), 6) as mean from {FOLD_RESULTS} group by 1""")
def rank_secondary(spark, d):
    return R.secondary_means(fold_results(spark, d), "rmse")


@query("select_best", f"select model, primary_mean, 'best_mean' as selection_rule from {SUMMARY} where rank = 1")
def select_best(spark, d):
    return R.select_model(R.model_summary(fold_results(spark, d), "rmse"), "rmse").select(
        "model", "primary_mean", "selection_rule")


@query("select_one_se", f"""with s as {SUMMARY} select model, primary_mean, 'one_se' as selection_rule from s
  where primary_mean <= (select primary_mean + primary_std / sqrt(n_folds) from s where rank = 1)
  order by mean_fit_seconds, rank limit 1""")
def select_one_se(spark, d):
    summary = R.model_summary(fold_results(spark, d), "rmse")
    return R.select_model(summary, "rmse", "one_se").select("model", "primary_mean", "selection_rule")


@query("select_significance", f"""with s as {SUMMARY} select a.model as first, b.model as second,
  not (a.ci_high < b.ci_low or b.ci_high < a.ci_low) as overlap from s a, s b where a.rank = 1 and b.rank = 2""")
def select_significance(spark, d):
    return R.significance(R.model_summary(fold_results(spark, d), "rmse"))


@query("select_threshold", f"""select model, 40.0::double as success_threshold, primary_mean <= 40 as meets_success_threshold
  from {SUMMARY} where rank = 1""")
def select_threshold(spark, d):
    chosen = R.select_model(R.model_summary(fold_results(spark, d), "rmse"), "rmse")
    return R.meets_threshold(chosen, "rmse", 40.0).select("model", "success_threshold", "meets_success_threshold")


@query("rank_left_out", """select 'click' as model, 'status not ok' as reason union all select 'error', 'no primary metric'""")
def rank_left_out(spark, d):
    results = fold_results(spark, d).withColumn(
        "status", F.when(F.col("model") == "click", "failed").otherwise("ok")).withColumn(
        "metrics", F.when(F.col("model") == "error", F.map_filter("metrics", lambda k, v: k != "rmse")).otherwise(F.col("metrics")))
    return R.left_out(results, "rmse")


@query("rank_stored", """select row_number() over (order by mean desc, model_name) as rank, model_name, 'k' as primary_metric,
  round(mean, 6) as mean, round(std, 6) as std, folds, round(s, 6) as mean_fit_seconds from (select event_type as model_name,
  avg(cast(props->>'$.k' as double)) as mean, stddev_pop(cast(props->>'$.k' as double)) as std, count(*) as folds,
  avg(value) as s from events where user_id % 6 < 5 group by 1)""")
def rank_stored(spark, d):
    rows = table(spark, d, "events").select(
        F.col("event_type").alias("model_name"), F.expr("case when user_id % 6 < 5 then user_id % 6 end").alias("fold"),
        F.col("props").alias("metrics_json"), F.col("value").alias("fit_seconds"))
    return rounded(longs(R.stored_ranking(rows, "k"), "rank"), mean=6, std=6, mean_fit_seconds=6)


@query("rank_json", """select event_type as model_name, round(avg(cast(props->>'$.k' as double)), 4) as mean_k,
  round(stddev_samp(cast(props->>'$.k' as double)), 4) as std_k, count(*) as folds from events group by 1""")
def rank_json(spark, d):
    table(spark, d, "events").createOrReplaceTempView("model_result_rows")
    return spark.sql("""
        SELECT event_type AS model_name, round(avg(cast(get_json_object(props, '$.k') AS double)), 4) AS mean_k,
               round(stddev_samp(cast(get_json_object(props, '$.k') AS double)), 4) AS std_k, count(*) AS folds
        FROM model_result_rows GROUP BY event_type ORDER BY mean_k DESC""")


@query("compare_candidates", f"""select 'rmse' as primary_metric, c.m as candidate, b.m as baseline, round(c.m - b.m, 6) as delta,
  true as lower_is_better, c.m < b.m as candidate_better, true as conclusive from
  (select round(avg(rmse), 6) as m from {FOLD_RESULTS} where model = 'view') c,
  (select round(avg(rmse), 6) as m from {FOLD_RESULTS} where model = 'click') b""")
def compare_candidates(spark, d):
    means = R.aggregate_metrics(fold_results(spark, d))
    return R.compare(means.filter(F.col("model") == "view"), means.filter(F.col("model") == "click"), "rmse")


# -- drift -----------------------------------------------------------------------------

def _halves(spark, d, *names):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double")).withColumn(
        "shifted", F.expr("value + case when ts >= '2024-01-16' then 20 else 0 end")).withColumn(
        "flag", F.expr("(event_id % 3 = 0 and ts < '2024-01-16') or (event_id % 2 = 0 and ts >= '2024-01-16')"))
    names = names or ("value", "k", "shifted", "event_type", "flag")
    return (e.filter("ts < '2024-01-16'").select(*names), e.filter("ts >= '2024-01-16'").select(*names))


HALVES = """e as (select *, cast(props->>'$.k' as double) as k, value + case when ts >= timestamp '2024-01-16' then 20 else 0 end as shifted,
  (event_id % 3 = 0 and ts < timestamp '2024-01-16') or (event_id % 2 = 0 and ts >= timestamp '2024-01-16') as flag,
  ts >= timestamp '2024-01-16' as late from events)"""


def _numeric_psi(c: str) -> str:
    return f"""(with x as (select {c} as v, late from e where {c} is not null),
      q as (select quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) as q from x where not late),
      u as (select list_sort(list_distinct(q)) as u from q),
      b as (select late, len(list_filter(u[2:-2], lambda g: g <= v)) as bin from x, u),
      s as (select i as bin, greatest(count(*) filter (not late and bin = i)::double / (select count(*) from x where not late), 1e-6) as e,
        greatest(count(*) filter (late and bin = i)::double / (select count(*) from x where late), 1e-6) as a
        from b, (select unnest(range(len(u) - 1)) as i from u) group by i)
      select '{c}' as "column", sum((a - e) * ln(a / e)) as psi from s)"""


def _categorical_psi(c: str) -> str:
    return f"""(with s as (select cast({c} as varchar) as item,
      greatest(count(*) filter (not late)::double / (select count({c}) from e where not late), 1e-6) as e,
      greatest(count(*) filter (late)::double / (select count({c}) from e where late), 1e-6) as a from e where {c} is not null group by 1)
      select '{c}' as "column", sum((a - e) * ln(a / e)) as psi from s)"""


PSI = "with " + HALVES + ", p as (" + " union all ".join(
    [f"select * from {_numeric_psi(c)}" for c in ("value", "k", "shifted")]
    + [f"select * from {_categorical_psi(c)}" for c in ("event_type", "flag")]) + ")"


@query("drift_reference", "with " + HALVES + """, q as (select list_sort(list_distinct(quantile_cont(value,
  [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) as u from e where not late)
  select i as bin, round(case when i > 0 then u[i + 1] end, 6) as lower, round(case when i < len(u) - 2 then u[i + 2] end, 6) as upper,
  round(count(*) filter (len(list_filter(u[2:-2], lambda g: g <= value)) = i)::double / count(*), 6) as expected
  from e, (select u, unnest(range(len(u) - 1)) as i from q) where not late group by i, u""")
def drift_reference(spark, d):
    early, _ = _halves(spark, d, "value")
    ref = D.drift_reference(early).select(F.col("item").cast("long").alias("bin"), "lower", "upper", "expected")
    return rounded(ref, lower=6, upper=6, expected=6)


@query("drift_numeric", PSI + """ select "column", round(psi, 5) as psi from p where "column" in ('value', 'k', 'shifted')""")
def drift_numeric(spark, d):
    early, late = _halves(spark, d, "value", "k", "shifted")
    return rounded(D.psi(D.drift_reference(early), late), psi=5)


@query("drift_categorical", PSI + """ select "column", round(psi, 5) as psi from p where "column" in ('event_type', 'flag')""")
def drift_categorical(spark, d):
    early, late = _halves(spark, d, "event_type", "flag")
    return rounded(D.psi(D.drift_reference(early), late), psi=5)


@query("drift_unseen", """with e as (select o_orderkey, o_orderpriority, o_orderkey % 2 = 1 as late,
  case when o_orderkey % 2 = 1 and o_orderpriority = '5-LOW' then 'new' when o_orderkey % 2 = 0 and o_orderpriority = '1-URGENT' then null
  else o_orderpriority end as prio from orders) select "column", round(psi, 4) as psi from """ + _categorical_psi("prio"))
def drift_unseen(spark, d):
    """Categories only one side has count as the floor share."""
    o = table(spark, d, "orders").select("o_orderkey", F.expr(
        "case when o_orderkey % 2 = 1 and o_orderpriority = '5-LOW' then 'new' when o_orderkey % 2 = 0 and "
        "o_orderpriority = '1-URGENT' then null else o_orderpriority end").alias("prio"))
    early, late = (o.filter(f"o_orderkey % 2 = {i}").select("prio") for i in (0, 1))
    return rounded(D.psi(D.drift_reference(early), late), psi=4)


@query("drift_columns", PSI + """ select "column", round(round(psi, 6), 5) as psi, round(psi, 6) >= 0.2 as drifted from p""")
def drift_columns(spark, d):
    early, late = _halves(spark, d)
    return rounded(D.drift_columns(D.drift_reference(early), late), psi=5)


@query("drift_report", PSI + """ select count(*) as n_columns, count(*) filter (psi >= 0.2) as n_drifted, round(round(max(psi), 6), 5) as max_psi,
  string_agg("column", ',' order by "column") filter (psi >= 0.2) as drifted_columns, count(*) filter (psi >= 0.2) > 0 as drift_detected from p""")
def drift_report(spark, d):
    early, late = _halves(spark, d)
    return rounded(D.drift_report(D.drift_reference(early), late), max_psi=5)


@query("retraining_due", PSI + """ select max(psi) >= 0.2 as by_drift, false as by_metric, false as by_age, max(psi) >= 0.2 as retraining_due,
  '2024-02-15' as next_review_date from p""")
def retraining_due(spark, d):
    early, late = _halves(spark, d)
    report = D.drift_report(D.drift_reference(early), late)
    return D.retraining_due(report, date(2024, 1, 16), date(2024, 1, 31), metric_met=True)

"""Run records, and report rows derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import ranking as R
from tablewright.queries.base import (
    AGENT_EVENTS, FOLD_RESULTS, agent_events, fold_results, longs, scratch, table)
from tablewright.queries.evaluation import SUMMARY
from tablewright.sources import records as T

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f
    return register


def _seconds(df, *names):
    return df.select([F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c in names else F.col(c) for c in df.columns])


AT = "strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at"


@query("records_store", f"""select id, experiment_id, agent_name, event_type, output_json, rationale, {AT} from {AGENT_EVENTS}""")
def records_store(spark, d):
    store = T.RecordStore(spark, scratch(spark, "records"))
    events = agent_events(spark, d)
    store.append("agent_events", events.filter(F.col("id") % 2 == 0))
    store.append("agent_events", events.filter(F.col("id") % 2 == 1))
    return _seconds(store.table("agent_events").drop("input_json"), "created_at")


@query("records_status", """select cast(user_id as varchar) as id, event_type as status from (select *,
  row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1""")
def records_status(spark, d):
    """Experiments with a status log: every event changes the status of one of them."""
    e = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("status"), "ts", "event_id")
    return T.latest_per(e, ["id"], ["ts", "event_id"]).select("id", "status")


@query("records_latest", """select conv_id, turn, role, length(text) as n_chars from (select *, row_number() over
  (partition by conv_id order by turn desc) as r from conversations) where r = 1""")
def records_latest(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))
    return T.latest_per(c, ["conv_id"], ["turn"])


@query("records_history", f"""select id, agent_name, event_type, rationale, {AT} from {AGENT_EVENTS} where experiment_id = '7'
  order by created_at, id""")
def records_history(spark, d):
    history = T.event_history(agent_events(spark, d), "7")
    return _seconds(history.select("id", "agent_name", "event_type", "rationale", "created_at"), "created_at")


@query("records_runs", """select o_orderkey as id, o_orderstatus as status, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as started_at
  from orders where o_custkey = (select min(o_custkey) from orders) order by o_orderdate, o_orderkey""")
def records_runs(spark, d):
    o = table(spark, d, "orders")
    first = o.agg(F.min("o_custkey").alias("o_custkey"))
    runs = o.join(F.broadcast(first), "o_custkey", "left_semi").select(  # one row on the right
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("started_at"))
    return _seconds(runs.orderBy("started_at", "id"), "started_at")


@query("records_owner", """select c_custkey as id, c_name from customer where c_custkey = (select o_custkey from orders where o_orderkey = 42)""")
def records_owner(spark, d):
    experiments = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("experiment_id"))
    return T.owner_of_run(experiments, runs, 42)


@query("records_search", f"""select id, agent_name, rationale from {AGENT_EVENTS} where agent_name = 'agent_c'
  and (contains(lower(event_type), '12.3') or contains(lower(rationale), '12.3'))""")
def records_search(spark, d):
    return T.search(agent_events(spark, d), "12.3", ["event_type", "rationale"], {"agent_name": "agent_c"}).select(
        "id", "agent_name", "rationale")


@query("records_agents", f"select agent_name, count(*) as events from {AGENT_EVENTS} group by 1")
def records_agents(spark, d):
    return T.agent_counts(agent_events(spark, d))


@query("records_browse", """select doc_id, source, n_chars from documents where contains(lower(source), 'src1') or contains(lower(lang), 'src1')
  order by n_chars desc, doc_id""")
def records_browse(spark, d):
    return T.browse(table(spark, d, "documents"), "SRC1", ["source", "lang"], "n_chars", key="doc_id").select(
        "doc_id", "source", "n_chars")


def _action_events(spark, d):
    """Events whose JSON lists up to two actions."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    one = F.struct(F.col("event_type").alias("operation"), F.lit("value").alias("column"), k.alias("rows"))
    two = F.struct(F.lit("audit").alias("operation"), F.lit("user").alias("column"), F.col("user_id").alias("rows"))
    actions = F.when(k % 2 == 0, F.array(one)).otherwise(F.array(one, two))
    return e.select(F.col("event_id").alias("id"), F.to_json(F.struct(actions.alias("actions"))).alias("output_json"))


ACTIONS = """(select event_id as id, 0::bigint as position, event_type as operation, 'value' as "column", cast(props->>'$.k' as bigint) as rows
  from events union all select event_id, 1, 'audit', 'user', user_id from events where cast(props->>'$.k' as bigint) % 2 = 1)"""


@query("records_actions", f"select * from {ACTIONS}")
def records_actions(spark, d):
    return longs(T.logged_actions(_action_events(spark, d)), "position").select("id", "position", "operation", "column", "rows")


@query("records_operation_counts", f"select operation, count(*) as n from {ACTIONS} group by 1")
def records_operation_counts(spark, d):
    return T.operation_counts(T.logged_actions(_action_events(spark, d)))


@query("records_grouping_sets", f"""select model as model_name, fold, round(avg(rmse), 6) as rmse, round(avg(r2), 6) as r2
  from {FOLD_RESULTS} group by grouping sets ((model, fold), (model))""")
def records_grouping_sets(spark, d):
    rows = T.result_rows(fold_results(spark, d), "run")
    return rows.select("model_name", "fold", *[
        F.get_json_object("metrics_json", f"$.{m}").cast("double").alias(m) for m in ("rmse", "r2")])


@query("records_notes", """select min(doc_id) as pos, source as text from documents group by 2 order by 1""")
def records_notes(spark, d):
    return T.deduplicated(table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("source").alias("text")))


@query("report_results", f"""select rank, model, primary_mean as mean, primary_std as std, ci_low, ci_high, n_folds as folds,
  mean_fit_seconds from {SUMMARY}""")
def report_results(spark, d):
    return longs(T.result_table(R.model_summary(fold_results(spark, d), "rmse")), "rank")


@query("report_card", f"""select 'events' as experiment, model, 'regression' as task_type, 'value' as target_column, 'rmse' as primary_metric,
  primary_mean as mean, primary_std as std, ci_low, ci_high, 'best_mean' as selection_criterion, 42::bigint as random_seed,
  primary_mean <= 40 as meets_success_threshold from {SUMMARY} where rank = 1""")
def report_card(spark, d):
    chosen = R.select_model(R.model_summary(fold_results(spark, d), "rmse"), "rmse")
    return longs(T.model_card(R.meets_threshold(chosen, "rmse", 40.0), "events", "regression", "value", "rmse", 42), "random_seed")

"""Neighbours, models, search, latent features, explanations, and whole experiments."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewright.operators import explain as X
from tablewright.operators import features, folds, hashing, neighbors, ranking
from tablewright.operators.clean import Cleaner
from tablewright.operators.drift import drift_reference
from tablewright.operators.forest import IsolationForest
from tablewright.operators.kernels import GaussianBayes
from tablewright.plans import latent, search, training, zoo
from tablewright.plans.experiment import run_experiment
from tablewright.queries.base import rounded, scratch, table
from tablewright.sources import tables
from tablewright.streaming import monitor

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f
    return register


# -- neighbours and naive Bayes on embeddings, against SQL ------------------------------

def vectors(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("x"),
        F.col("label").cast("double").alias("label"))


VECTORS = "(select vec_id as key, embedding::double[] as x, label from embeddings)"


def _near(k: int, where: str) -> str:
    return f"""(select q, r, d, lab, row_number() over (partition by q order by d, r) as i from (select a.key as q, b.key as r,
      b.label as lab, list_distance(a.x, b.x) as d from {VECTORS} a, {VECTORS} b where {where}) qualify i <= {k})"""


@query("knn_pairs", f"""select q as query, i as rank, r as ref, round(d, 6) as distance from {_near(5, 'a.key <> b.key')}""")
def knn_pairs(spark, d):
    rows = vectors(spark, d).select("key", "x")
    return rounded(neighbors.nearest(rows, rows, 5, skip_same=True).select(
        F.col("rank").cast("long").alias("rank"), "query", "ref", "distance"), distance=6)


SPLIT = "a.key % 5 = 0 and b.key % 5 > 0"


def _knn(spark, d, **options):
    v = vectors(spark, d).withColumn("features", array_to_vector("x"))
    model = neighbors.Neighbors.of("key", **options).fit(v.filter("key % 5 > 0"))
    return model.transform(v.filter("key % 5 = 0"))


@query("knn_classify", f"""select q as key, cast(any_value(lab) as double) as prediction from (select q, lab, row_number() over (
  partition by q order by count(*) desc, lab) as i from {_near(5, SPLIT)} group by q, lab) where i = 1 group by q""")
def knn_classify(spark, d):
    return _knn(spark, d, n_classes=10).select("key", "prediction")


@query("knn_regress", f"select q as key, round(avg(lab), 6) as prediction from {_near(5, SPLIT)} group by q")
def knn_regress(spark, d):
    return rounded(_knn(spark, d).select("key", "prediction"), prediction=6)


@query("knn_weighted", f"""select q as key, round(sum(lab / d) / sum(1 / d), 6) as prediction from {_near(7, SPLIT)} group by q""")
def knn_weighted(spark, d):
    return rounded(_knn(spark, d, n_neighbors=7, weights="distance").select("key", "prediction"), prediction=6)


@query("knn_hashed_recall", "select count(*) as queries, true as enough from embeddings")
def knn_hashed_recall(spark, d):
    """Whether hashing finds nine in ten of the exact five neighbours of all rows."""
    rows = vectors(spark, d).select("key", "x").persist()
    return hashing.recall(rows, rows, 5, skip_same=True, most_queries=rows.count()).select(
        "queries", (F.col("recall") >= 0.9).alias("enough"))


LOF = f"""with p as {_near(20, 'a.key <> b.key')}, k as (select q, max(d) as kd from p group by 1),
  l as (select p.q, 1 / (avg(greatest(kd, d)) + 1e-10) as lrd from p join k on k.q = p.r group by 1)
  select p.q as key, round(avg(n.lrd) / any_value(l.lrd), 6) as lof from p join l on l.q = p.q join l n on n.q = p.r group by p.q"""


@query("lof_scores", LOF)
def lof_scores(spark, d):
    rows = vectors(spark, d).select("key", "x")
    return rounded(neighbors.local_outlier_factor(rows, 20).select("key", "lof"), lof=6)


BAYES = f"""with long as (select key, label, unnest(x) as v, unnest(range(64)) as j from {VECTORS}),
  eps as (select 1e-9 * max(s) as e from (select var_pop(v) as s from long group by j)),
  prior as (select label as c, count(*) / (select count(*) from {VECTORS}) as p from {VECTORS} group by 1),
  m as (select label as c, j, avg(v) as mu, var_pop(v) + (select e from eps) as s2 from long group by 1, 2),
  ll as (select key, m.c, any_value(ln(p)) + sum(-0.5 * (ln(2 * pi() * s2) + (v - mu) * (v - mu) / s2)) as ll
    from long join m using (j) join prior on prior.c = m.c group by 1, 2)
  select key, cast(arg_max(c, ll) as double) as prediction from ll group by 1"""


@query("gaussian_bayes", BAYES)
def gaussian_bayes(spark, d):
    v = vectors(spark, d).withColumn("features", array_to_vector("x"))
    return GaussianBayes.of(n_classes=10).fit(v).transform(v).select("key", "prediction")


# -- training --------------------------------------------------------------------------

def labelled(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").drop("toxic")


def priced(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate",
                                            (F.col("o_totalprice") / 1000).alias("price"))


def odd_events(spark, d):
    return table(spark, d, "events").select("event_id", "value", "user_id", "event_type",
                                            (F.col("value") > 150).cast("int").alias("odd"))


def crossed(spark, d, df, key, task_type, target, include, n_splits=5, **options):
    split = folds.assign_folds(df, key, task_type=task_type, target=target, n_splits=n_splits)
    models, _ = zoo.select_models(task_type, include)
    return training.cross_train(df, split, models, features.feature_encoder(df, target), task_type, target,
                                scratch(spark, "cross"), **options)


def flat(results):
    return results.select("model", "fold", "status", F.explode_outer("metrics").alias("metric", "value"))


@query("zoo_linear_models")
def zoo_linear_models(spark, d):
    return flat(crossed(spark, d, priced(spark, d), "o_orderkey", "regression", "price",
                        ["linear_regression", "elastic_net"]).results)


@query("zoo_tree_models")
def zoo_tree_models(spark, d):
    return flat(crossed(spark, d, labelled(spark, d), "doc_id", "classification", "quality",
                        ["decision_tree", "random_forest"]).results)


@query("zoo_boosting")
def zoo_boosting(spark, d):
    return flat(crossed(spark, d, labelled(spark, d), "doc_id", "classification", "quality",
                        ["hist_gradient_boosting"]).results)


@query("zoo_classifiers")
def zoo_classifiers(spark, d):
    return flat(crossed(spark, d, labelled(spark, d), "doc_id", "classification", "quality",
                        ["logistic_regression", "naive_bayes", "knn", "svm"]).results)


@query("zoo_nets")
def zoo_nets(spark, d):
    return flat(crossed(spark, d, labelled(spark, d), "doc_id", "classification", "quality", ["mlp"]).results)


def _regressed(spark, d, *models):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_brand", "p_retailprice")
    return flat(crossed(spark, d, p, "p_partkey", "regression", "p_retailprice", list(models)).results)


@query("zoo_regressors")
def zoo_regressors(spark, d):
    return _regressed(spark, d, "decision_tree_regressor", "knn_regressor")


@query("zoo_forest_regressor")
def zoo_forest_regressor(spark, d):
    return _regressed(spark, d, "random_forest_regressor")


@query("zoo_boosting_regressor")
def zoo_boosting_regressor(spark, d):
    return _regressed(spark, d, "hist_gradient_boosting_regressor")


@query("zoo_svr")
def zoo_svr(spark, d):
    return _regressed(spark, d, "svr")


@query("zoo_net_regressor")
def zoo_net_regressor(spark, d):
    return _regressed(spark, d, "mlp_regressor")


@query("zoo_anomaly")
def zoo_anomaly(spark, d):
    return flat(crossed(spark, d, odd_events(spark, d), "event_id", "anomaly", "odd",
                        ["isolation_forest", "local_outlier_factor", "one_class_svm"]).results)


@query("oof_predictions", """select key, label, count(*) as models from (select doc_id as key, cast(quality as double) as label,
  unnest([1, 2]) from documents join labels using (doc_id)) group by all""")
def oof_predictions(spark, d):
    """Every row is predicted once by every model."""
    oof = crossed(spark, d, labelled(spark, d), "doc_id", "classification", "quality",
                  ["logistic_regression", "naive_bayes"]).oof
    return oof.groupBy("key", "label").agg(F.count(F.lit(1)).alias("models"))


RULE = """with f as (select cast((row_number() over (order by md5('42|' || event_id), event_id) - 1) % 5 as int) as fold from events)
  select model, fold, count(*) as predicted, true as found from f, (select unnest([{models}]) as model) group by all"""
RULE_CLASSIFIERS = ("logistic_regression", "decision_tree", "random_forest", "naive_bayes", "mlp")
RULE_REGRESSORS = ("linear_regression", "decision_tree_regressor", "mlp_regressor")


def _rule_found(spark, d, task_type, models, metric):
    """Rows predicted for each model and fold, and whether the model has found the rule behind the target."""
    e = table(spark, d, "events").select(
        "event_id", "event_type", (F.col("user_id") % 7).cast("double").alias("u"),
        (F.lit(5.0) * (F.col("event_type") == "click").cast("int") + F.col("user_id") % 7).alias("size"),
        F.col("event_type").isin("click", "view").cast("int").alias("kind"))
    target = "kind" if task_type == "classification" else "size"
    df = e.drop("size" if target == "kind" else "kind")
    split = folds.assign_folds(df, "event_id", "kfold")
    chosen, _ = zoo.select_models(task_type, list(models))
    found = training.cross_train(df, split, chosen, features.feature_encoder(df, target), task_type, target,
                                 scratch(spark, "rule"))
    rows = found.oof.groupBy("model", "fold").agg(F.countDistinct("key").alias("predicted"))
    good = found.results.select("model", "fold", (F.col("metrics")[metric] > 0.95).alias("found"))
    return rows.join(good, ["model", "fold"])


@query("rule_classifiers", RULE.format(models=", ".join(f"'{m}'" for m in RULE_CLASSIFIERS)))
def rule_classifiers(spark, d):
    return _rule_found(spark, d, "classification", RULE_CLASSIFIERS, "accuracy")


@query("rule_regressors", RULE.format(models=", ".join(f"'{m}'" for m in RULE_REGRESSORS)))
def rule_regressors(spark, d):
    return _rule_found(spark, d, "regression", RULE_REGRESSORS, "r2")


@query("rule_boosting", RULE.format(models="'hist_gradient_boosting'"))
def rule_boosting(spark, d):
    return _rule_found(spark, d, "classification", ["hist_gradient_boosting"], "accuracy")


@query("rule_boosting_regressor", RULE.format(models="'hist_gradient_boosting_regressor'"))
def rule_boosting_regressor(spark, d):
    return _rule_found(spark, d, "regression", ["hist_gradient_boosting_regressor"], "r2")


@query("train_ranking")
def train_ranking(spark, d):
    found = crossed(spark, d, labelled(spark, d), "doc_id", "classification", "quality",
                    ["logistic_regression", "decision_tree", "naive_bayes"])
    return ranking.model_summary(found.results, "macro_f1").select("rank", "model", "primary_mean", "n_folds")


@query("final_model", "select doc_id, quality from documents join labels using (doc_id)")
def final_model(spark, d):
    """Fit on all rows, save, load, predict: one prediction per row."""
    df = labelled(spark, d)
    entry = zoo.CATALOGUE["classification"]["logistic_regression"]
    model, labels = training.fit_final(df, "doc_id", features.feature_encoder(df, "quality"), entry, {},
                                       "classification", "quality")
    again = tables.load_pipeline(tables.save_pipeline(model, scratch(spark, "model")))
    out = training.predict(again, df, labels)
    return out.filter(F.col("prediction").isin("0", "1")).select("doc_id", "quality")


@query("final_model_digest")
def final_model_digest(spark, d):
    df = labelled(spark, d)
    entry = zoo.CATALOGUE["classification"]["naive_bayes"]
    model, _ = training.fit_final(df, "doc_id", features.feature_encoder(df, "quality"), entry, {}, "classification", "quality")
    return tables.artifact_digest(spark, tables.save_pipeline(model, scratch(spark, "model")))


# -- search, latent, explanation -------------------------------------------------------

@query("search_trials")
def search_trials(spark, d):
    df = labelled(spark, d)
    split = folds.assign_folds(df, "doc_id", "stratified_kfold", target="quality")
    models, _ = zoo.select_models("classification", ["logistic_regression", "naive_bayes"])
    trials, _ = search.tune(df, split, models, features.feature_encoder(df, "quality"), "classification", "quality",
                            "macro_f1", scratch(spark, "search"))
    return search.best_trials(trials, models, "macro_f1").select(
        "rank", "model", "best_value", "best_params", "n_complete", "n_pruned", "status")


def _latent(spark, d, df, key, use_case, **options):
    split = folds.assign_folds(df, key, "kfold")
    target = options.get("target")
    return latent.run_latent(df, split, features.feature_encoder(df, target), use_case, scratch(spark, "latent"),
                             **options)


@query("latent_features")
def latent_features(spark, d):
    return _latent(spark, d, labelled(spark, d), "doc_id", "latent_features", task_type="classification",
                   target="quality", metric="roc_auc").comparison


@query("latent_denoising")
def latent_denoising(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"), F.avg("l_discount").alias("d"),
        F.sum(F.col("l_quantity") * 2 + F.col("l_tax")).alias("r"))
    return _latent(spark, d, c, "l_orderkey", "denoising").comparison


@query("latent_anomaly")
def latent_anomaly(spark, d):
    return _latent(spark, d, odd_events(spark, d), "event_id", "anomaly_detection", target="odd").comparison


@query("isolation_scores")
def isolation_scores(spark, d):
    v = vectors(spark, d).withColumn("features", array_to_vector("x"))
    return IsolationForest.of("key").fit(v).transform(v).select("key", "score")


@query("explain_tree")
def explain_tree(spark, d):
    return _explained(spark, d, "random_forest", {})


@query("explain_linear")
def explain_linear(spark, d):
    return _explained(spark, d, "logistic_regression", {})


@query("explain_permutation")
def explain_permutation(spark, d):
    return _explained(spark, d, "naive_bayes", {})


def _explained(spark, d, name, params):
    df = labelled(spark, d)
    split = folds.assign_folds(df, "doc_id", "stratified_kfold", target="quality")
    labels = training.learn_labels(df, "classification", "quality")
    data = training.encode_fold(df, split, 0, features.feature_encoder(df, "quality"), labels, 42)
    entry = zoo.CATALOGUE["classification"][name]
    model = entry.build({**entry.defaults, **params}, data.shape).fit(data.train)
    return X.explain(model, data.test, data.encoder.feature_names(), "classification")


@query("explain_top", """select "column" as feature, round(abs(r), 6) as importance from (
  select 'l_quantity' as "column", corr(l_quantity, l_extendedprice) as r from lineitem union all
  select 'l_discount', corr(l_discount, l_extendedprice) from lineitem union all
  select 'l_tax', corr(l_tax, l_extendedprice) from lineitem) order by 2 desc limit 2""")
def explain_top(spark, d):
    names = ["l_quantity", "l_discount", "l_tax"]
    raw = table(spark, d, "lineitem").agg(*[F.corr(c, "l_extendedprice").alias(c) for c in names]).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in names])))
    return X.top_features(raw, 2).select("feature", F.round(F.abs("importance"), 6).alias("importance"))


# -- whole experiment and stream -------------------------------------------------------

@query("experiment_run")
def experiment_run(spark, d):
    run = run_experiment(spark, scratch(spark, "experiment"), key="doc_id", task_type="classification",
                         target="quality", dataframe=labelled(spark, d),
                         include=["logistic_regression", "decision_tree"])
    return run.parts["results_table"]


@query("stream_drift", """with q as (select list_sort(list_distinct(quantile_cont(value,
  [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) as u from events where ts < '2024-01-16'),
  items as (select ts, 'value' as "column", cast(len(list_filter(u[2:-2], lambda g: g <= value)) as varchar) as item from events, q
   union all select ts, 'event_type', event_type from events),
  e as (select "column", item, greatest(count(*)::double / sum(count(*)) over (partition by "column"), 1e-6) as e
   from items where ts < '2024-01-16' group by 1, 2),
  n as (select date_trunc('day', ts) as w, "column", item, count(*)::double as n from items group by all),
  t as (select w, "column", sum(n) as t from n group by all),
  grid as (select w, "column", item from t join e using ("column") union select w, "column", item from n),
  s as (select w, "column", coalesce(e, 1e-6) as e, greatest(coalesce(n / t, 1e-6), 1e-6) as a from grid
   join t using (w, "column") left join e using ("column", item) left join n using (w, "column", item)),
  p as (select w, "column", round(sum((a - e) * ln(a / e)), 6) as psi from s group by all)
  select cast(w as date) as day, "column", psi, psi >= 0.2 as drifted from p""")
def stream_drift(spark, d):
    """events as a stream: drift of each day against the first half."""
    events = table(spark, d, "events")
    reference = drift_reference(events.filter("ts < '2024-01-16'").select("value", "event_type"))
    # A table's files come in any order, so a row may be as late as its times are apart.
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    delay = f"{int((last - first).total_seconds()) + 1} seconds" if first else "0 seconds"
    source = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    folder = scratch(spark, "stream")
    monitor.drift_stream(source.select("ts", "value", "event_type"), reference, "ts", f"{folder}/out",
                         f"{folder}/state", delay=delay).awaitTermination()
    found = monitor.stream_drift(spark, f"{folder}/out", reference)
    return found.select(F.to_date("window_start").alias("day"), "column", "psi", "drifted")


def _event_stream(spark, d):
    """events as a stream, and how late a row may be in it: a table's files come in any order."""
    events = table(spark, d, "events")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    delay = f"{int((last - first).total_seconds()) + 1} seconds" if first else "0 seconds"
    source = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return events, source.withColumn("ts", F.col("ts").cast("timestamp")), delay


@query("stream_clean", """select event_id, event_type, value from events""")
def stream_clean(spark, d):
    """events with up to two copies of a row, cleaned on a stream: every row once."""
    events, source, delay = _event_stream(spark, d)
    kept = ["event_id", "ts", "event_type", "value"]
    model = Cleaner.of().fit(events.select(*kept))
    copied = source.withColumn("copy", F.explode(F.sequence(F.lit(0), F.pmod("event_id", F.lit(3))))).select(*kept)
    folder = scratch(spark, "clean")
    monitor.write_stream(monitor.clean_stream(copied, model, "ts", delay), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "event_type", "value")


@query("stream_predict", """select event_id, case when event_type in ('click', 'view') then '1' else '0' end as prediction
  from events""")
def stream_predict(spark, d):
    """A model fitted on the table predicts the same rows on a stream; the rule behind the target is found."""
    events, source, _ = _event_stream(spark, d)
    features_of = lambda t: t.select("event_id", "event_type", (F.col("user_id") % 7).cast("double").alias("u"))
    df = features_of(events).withColumn("kind", F.col("event_type").isin("click", "view").cast("int"))
    entry = zoo.CATALOGUE["classification"]["decision_tree"]
    model, labels = training.fit_final(df, "event_id", features.feature_encoder(df, "kind"), entry, {}, "classification", "kind")
    folder = scratch(spark, "predict")
    found = monitor.predict_stream(features_of(source), model).select("event_id", labels.name(F.col("prediction")).alias("prediction"))
    monitor.write_stream(found, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "prediction")

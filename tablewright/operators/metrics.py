"""Exact metrics over out-of-fold rows: (model, fold, key, label, prediction, score).

``score`` is the score of the positive class (larger = more positive or more anomalous);
multi-class AUC takes ``scores``, an array in the order of the sorted classes. Everything is
an aggregate: the confusion counts, the counts per distinct score, or one sum per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.exprs import col
from tablewright.functions.order import PERCENTILE_CELLS, hash_rank, quantiles, running_totals

BY = ("model", "fold")
LOG_FLOOR = 2.220446049250313e-16
CONFUSION_METRICS = ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1", "kappa",
                     "precision", "recall")


def unpivot(df: DataFrame, by, names) -> DataFrame:
    """(by..., metric, value) without the undefined ones."""
    rows = df.select(*by, F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])))
    return rows.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def confusion(oof: DataFrame, by=()) -> DataFrame:
    """(by..., label, prediction, n) over all folds given."""
    return oof.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(oof: DataFrame, labels: list | None = None) -> DataFrame:
    """One row per true label, one column per predicted label, labels sorted."""
    counts = confusion(oof)
    return (counts.groupBy("label").pivot("prediction", labels).agg(F.sum("n"))
            .na.fill(0).orderBy("label"))


def class_counts(oof: DataFrame, by=BY) -> DataFrame:
    """(by..., class, actual, predicted, hit) from the confusion counts: a classes^2 table."""
    n, same = F.col("n"), F.col("label") == F.col("prediction")
    roles = F.array(
        F.struct(F.col("label").alias("class"), n.alias("actual"), F.lit(0).cast("long").alias("predicted"),
                 F.when(same, n).otherwise(F.lit(0)).alias("hit")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("actual"),
                 n.alias("predicted"), F.lit(0).cast("long").alias("hit")))
    return (confusion(oof, by).select(*by, F.inline(roles)).groupBy(*by, "class")
            .agg(*[F.sum(c).alias(c) for c in ("actual", "predicted", "hit")]))


def confusion_metrics(oof: DataFrame, by=BY) -> DataFrame:
    """accuracy, balanced accuracy, macro and weighted F1, kappa, macro precision and recall."""
    f1 = 2.0 * F.col("hit") / (F.col("actual") + F.col("predicted"))
    recall = F.when(F.col("actual") > 0, F.col("hit") / F.col("actual"))
    precision = F.when(F.col("predicted") > 0, F.col("hit") / F.col("predicted")).otherwise(0.0)
    n = F.sum("actual")
    sums = class_counts(oof, by).groupBy(*by).agg(
        (F.sum("hit") / n).alias("accuracy"), F.avg(recall).alias("balanced_accuracy"),
        F.avg(f1).alias("macro_f1"), (F.sum(f1 * F.col("actual")) / n).alias("weighted_f1"),
        F.avg(precision).alias("precision"), F.avg(F.coalesce(recall, F.lit(0.0))).alias("recall"),
        (F.sum(F.col("actual").cast("double") * F.col("predicted")) / (n.cast("double") * n)).alias("_pe"))
    return sums.withColumn("kappa", F.try_divide(F.col("accuracy") - F.col("_pe"), 1.0 - F.col("_pe"))).drop("_pe")


def score_counts(oof: DataFrame, positive, by=BY) -> DataFrame:
    """Counts per distinct score; a score shared by many rows is one row from here on."""
    hit = F.coalesce((F.col("label") == positive).cast("long"), F.lit(0))
    return oof.groupBy(*by, F.col("score").cast("double").alias("score")).agg(
        F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))


def ranking_metrics(oof: DataFrame, positive=1, by=BY, n_rows: int | None = None) -> DataFrame:
    """ROC-AUC (mid-rank ties) and average precision, exact; NULL with one class only."""
    by = list(by)
    below = running_totals(score_counts(oof, positive, by), by, "score",
                           {"pos_below": "pos", "neg_below": "neg"}, n_rows)
    totals = below.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    at = below.join(totals, by) if by else below.crossJoin(F.broadcast(totals))
    found = F.col("p") - F.col("pos_below")
    taken = found + F.col("q") - F.col("neg_below")
    return at.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)),
                     F.max("p").cast("double") * F.max("q")).alias("roc_auc"),
        F.when(F.max("q") > 0, F.try_divide(F.sum(F.col("pos") * (found / taken)), F.max("p")))
        .alias("average_precision"))


def multiclass_auc(oof: DataFrame, classes: list, by=BY, n_rows: int | None = None) -> DataFrame:
    """One-vs-rest AUC averaged over the classes; ``scores`` holds one score per class."""
    long = oof.select(*by, F.inline(F.array(*[
        F.struct(F.lit(i).alias("class"), (F.col("label") == c).cast("int").alias("label"),
                 F.element_at("scores", i + 1).alias("score")) for i, c in enumerate(classes)])))
    per_class = ranking_metrics(long, 1, [*by, "class"], n_rows and n_rows * len(classes))
    return per_class.groupBy(*by).agg(F.avg("roc_auc").alias("roc_auc"))


def precision_at_k(oof: DataFrame, positive=1, by=BY, key: str = "key", seed: int = 0,
                   n_rows: int | None = None) -> DataFrame:
    """Precision and recall in the top k by score, k = number of positives.

    Whole scores are taken from the counts; only the rows of the one score that k cuts are
    ranked (by hash), so neither a fold nor a shared score is one task.
    """
    by = list(by)
    n = oof.count() if n_rows is None else n_rows
    below = running_totals(score_counts(oof, positive, by), by, "score",
                           {"pos_below": "pos", "neg_below": "neg"}, n)
    totals = below.groupBy(*by).agg(F.sum("pos").alias("k"), F.sum(F.col("pos") + F.col("neg")).alias("all"))
    at = below.join(totals, by).withColumn("own", F.col("pos") + F.col("neg")).withColumn(
        "above", F.col("all") - F.col("pos_below") - F.col("neg_below") - F.col("own"))
    whole = at.filter(F.col("above") + F.col("own") <= F.col("k")).groupBy(*by).agg(
        F.sum("pos").alias("hits"))
    cut = at.filter((F.col("above") < F.col("k")) & (F.col("above") + F.col("own") > F.col("k"))).select(
        *by, "score", (F.col("k") - F.col("above")).alias("room"))
    # One row per group on the right, so that a score that most rows share is no single task.
    rows = oof.select(*by, col(key), "label", F.col("score").cast("double").alias("score"))
    tied = hash_rank(rows.join(F.broadcast(cut), [*by, "score"]), key, n, seed, by)
    edge = tied.filter(F.col("rank") < F.col("room")).groupBy(*by).agg(
        F.sum((F.col("label") == positive).cast("long")).alias("hits"))
    hits = whole.unionByName(edge).groupBy(*by).agg(F.sum("hits").alias("hits"))
    share = F.try_divide(F.coalesce(F.col("hits"), F.lit(0)), F.col("k"))
    return totals.join(hits, by, "left").select(*by, "k", share.alias("precision_at_k"),
                                                share.alias("recall_at_k"))


def log_loss(oof: DataFrame, positive=1, by=BY) -> DataFrame:
    """Mean negative log-likelihood from the positive class's probability.

    Over all rows of a group; a group with a score outside [0, 1] or none has no probabilities and no row here.
    """
    p = F.when(F.col("label") == positive, F.col("score")).otherwise(1.0 - F.col("score"))
    clipped = F.least(F.greatest(p, F.lit(LOG_FLOOR)), F.lit(1.0 - LOG_FLOOR))
    likely = F.bool_and(F.coalesce(F.col("score").between(0.0, 1.0), F.lit(False)))
    return (oof.groupBy(*by).agg(F.when(likely, -F.avg(F.log(clipped))).alias("log_loss"))
            .filter(F.col("log_loss").isNotNull()))


def binary_f1(oof: DataFrame, positive=1, by=BY) -> DataFrame:
    y, p = F.col("label") == positive, F.col("prediction") == positive
    return oof.groupBy(*by).agg(F.coalesce(F.try_divide(
        2.0 * F.count_if(y & p), F.count_if(y) + F.count_if(p)), F.lit(0.0)).alias("f1"))


def regression_metrics(oof: DataFrame, by=BY, medae: bool = True, n_rows: int | None = None) -> DataFrame:
    """rmse, mse, mae, r2, mape (only without zero labels) and medae."""
    by = list(by)
    y = F.col("label").cast("double")
    e = y - F.col("prediction").cast("double")
    sse, sst = F.sum(e * e), F.var_pop(y) * F.count(y)
    sums = oof.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.when(sst > 0, 1.0 - sse / F.nullif(sst, F.lit(0.0))).when(sse > 0, 0.0).otherwise(1.0).alias("r2"),
        F.when(F.count_if(y == 0) == 0, F.avg(F.abs(F.try_divide(e, y)))).alias("mape"))
    if not medae:
        return sums
    n = oof.count() if n_rows is None else n_rows
    if n <= PERCENTILE_CELLS:
        middle = oof.groupBy(*by).agg(F.percentile(F.abs(e), F.lit(0.5)).alias("medae"))
    else:  # one column per group (models x folds), selected by rank
        groups = [tuple(r) for r in oof.select(*by).distinct().collect()]
        wide = oof.select([
            F.when(_is_group(by, g), F.abs(e)).alias(f"g{i}") for i, g in enumerate(groups)])
        found = quantiles(wide, wide.columns, [0.5], 0)
        middle = oof.sparkSession.createDataFrame(
            [(*g, found[f"g{i}"][0]) for i, g in enumerate(groups)],
            oof.select(*by).schema.add("medae", "double"))
    return sums.join(middle, by)


def _is_group(by, values):
    test = F.lit(True)
    for c, v in zip(by, values):
        test = test & col(c).eqNullSafe(F.lit(v))
    return test


def residuals(oof: DataFrame, by=("model",)) -> DataFrame:
    """Mean, sample deviation and largest absolute residual over all folds."""
    e = F.col("label").cast("double") - F.col("prediction")
    return oof.groupBy(*by).agg(
        F.round(F.avg(e), 6).alias("mean_error"),
        F.round(F.coalesce(F.stddev_samp(e), F.lit(0.0)), 6).alias("std_error"),
        F.round(F.max(F.abs(e)), 6).alias("max_abs_error"))


def anomaly_positive(df: DataFrame, label: str = "label"):
    """The anomalous class: 1 or True for binary labels, else the rarer one (least on ties)."""
    counts = df.filter(col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.min(F.struct("n", label)).alias("rare"),
                     F.count_if(~col(label).cast("string").isin("0", "1", "0.0", "1.0", "true", "false"))
                     .alias("others")).first()
    if row["rare"] is None:
        return None
    if row["others"]:
        return row["rare"][label]
    kind = df.schema[label].dataType.typeName()
    return True if kind == "boolean" else "1" if kind == "string" else 1


def score_stats(df: DataFrame, score: str = "score") -> DataFrame:
    """Mean, population deviation, 95 % point and maximum of unlabelled scores."""
    p95 = quantiles(df, [score], [0.95])[score]
    return df.agg(F.round(F.avg(score), 6).alias("mean"), F.round(F.stddev_pop(score), 6).alias("std"),
                  F.round(F.first(F.lit(p95[0] if p95 else None).cast("double")), 6).alias("p95"),
                  F.round(F.max(score), 6).alias("max"))


def evaluate(oof: DataFrame, task_type: str, by=BY, positive=1, classes: list | None = None,
             n_rows: int | None = None, key: str = "key", only: str | None = None) -> DataFrame:
    """(by..., metric, value) with all metrics of the task, or ``only`` one of them. Persist ``oof`` first."""
    by = list(by)
    if task_type == "classification" and only in CONFUSION_METRICS[:5]:  # counts alone, no ranks of the scores
        return unpivot(confusion_metrics(oof, by), by, (only,))
    n = oof.count() if n_rows is None else n_rows
    if task_type == "regression":
        return unpivot(regression_metrics(oof, by, n_rows=n), by,
                       ("rmse", "mse", "mae", "r2", "mape", "medae"))
    if task_type == "anomaly":
        parts = unpivot(ranking_metrics(oof, positive, by, n), by, ("roc_auc", "average_precision"))
        parts = parts.unionByName(unpivot(precision_at_k(oof, positive, by, key, n_rows=n), by,
                                          ("precision_at_k",)))
        if "prediction" in oof.columns:
            parts = parts.unionByName(unpivot(binary_f1(oof, positive, by), by, ("f1",)))
        return parts
    parts = unpivot(confusion_metrics(oof, by), by, CONFUSION_METRICS[:5])
    if classes and len(classes) > 2:
        if "scores" in oof.columns:
            parts = parts.unionByName(unpivot(multiclass_auc(
                oof.filter(F.col("scores").isNotNull()), classes, by, n), by, ("roc_auc",)))
    elif "score" in oof.columns:
        scored = oof.filter(F.col("score").isNotNull())
        parts = parts.unionByName(unpivot(ranking_metrics(scored, positive, by, n), by,
                                          ("roc_auc", "average_precision")))
        parts = parts.unionByName(unpivot(log_loss(oof, positive, by), by, ("log_loss",)))
    return parts

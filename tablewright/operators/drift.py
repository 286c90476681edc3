"""Drift of a batch against a reference by the population stability index."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import fixed
from tablewright.functions.exprs import as_text, col, dtype_of, is_numeric, nan_to_null
from tablewright.functions.order import quantiles
from tablewright.operators.profile import cardinality, usable_columns

REFERENCE_SCHEMA = ("column string, kind string, item string, lower double, upper double, "
                    "expected double")


def _bin(c: str, inner: list[float]):
    """Number of inner edges <= x, as text: a sum of comparisons that stays in codegen."""
    x = col(c).cast("double")
    position = F.lit(0)
    for e in inner:
        position = position + (x >= F.lit(e)).cast("int")
    return F.when(x.isNotNull(), position.cast("string"))


def _shares(df: DataFrame, items: dict[str, Column]) -> DataFrame:
    """(column, item, share): one partial aggregate for all columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), e.alias("item")) for c, e in items.items()])
    counts = (df.select(F.explode(pairs).alias("p")).select("p.column", "p.item")
              .filter(F.col("item").isNotNull()).groupBy("column", "item")
              .agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("column").agg(F.sum("n").alias("all"))
    # One row per monitored column on the right.
    return counts.join(F.broadcast(totals), "column").select(
        "column", "item", (F.col("n") / F.col("all")).alias("share"))


def _edges(df: DataFrame, numeric: list[str]) -> dict[str, list[float]]:
    probs = [i / fixed.PSI_BINS for i in range(fixed.PSI_BINS + 1)]
    found = quantiles(df, numeric, probs)
    return {c: sorted(set(q)) for c, q in found.items() if q and len(set(q)) >= 2}


def drift_reference(df: DataFrame, columns: list[str] | None = None,
                    discrete_max: int | None = None) -> DataFrame:
    """(column, kind, item, lower, upper, expected): expected share per bin or category.

    Numeric columns get up to 10 quantile bins with open ends; a column of one value is left
    out. Others (booleans too) get one row per category. With ``discrete_max`` numeric
    columns of at most so many values are treated as categories.
    """
    df = nan_to_null(df)
    columns = columns or usable_columns(df)
    numeric = [c for c in columns if is_numeric(dtype_of(df, c))]
    if discrete_max and numeric:
        few = {r["column"] for r in cardinality(df, numeric).filter(
            F.col("n_unique") <= discrete_max).collect()}
        numeric = [c for c in numeric if c not in few]
    edges = _edges(df, numeric)
    other = [c for c in columns if c not in numeric]
    spark = df.sparkSession
    parts = []
    if edges:
        bins = [(c, str(i), None if i == 0 else e[i], None if i == len(e) - 2 else e[i + 1])
                for c, e in edges.items() for i in range(len(e) - 1)]
        grid = spark.createDataFrame(bins, "column string, item string, lower double, upper double")
        shares = _shares(df, {c: _bin(c, e[1:-1]) for c, e in edges.items()})
        parts.append(grid.join(shares, ["column", "item"], "left").select(
            "column", F.lit("numeric").alias("kind"), "item", "lower", "upper",
            F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(fixed.PSI_FLOOR)).alias("expected")))
    if other:
        shares = _shares(df, {c: as_text(col(c), dtype_of(df, c)) for c in other})
        parts.append(shares.select(
            "column", F.lit("categorical").alias("kind"), "item", F.lit(None).cast("double").alias("lower"),
            F.lit(None).cast("double").alias("upper"), F.col("share").alias("expected")))
    if not parts:
        return spark.createDataFrame([], REFERENCE_SCHEMA)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def psi(reference: DataFrame, batch: DataFrame) -> DataFrame:
    """(column, psi) of the reference columns the batch has values for."""
    batch = nan_to_null(batch)
    # Bin edges: at most 10 rows per numeric column.
    edges: dict[str, list[float]] = {}
    for r in reference.filter(F.col("kind") == "numeric").select("column", "lower").collect():
        edges.setdefault(r["column"], [])
        if r["lower"] is not None:
            edges[r["column"]].append(r["lower"])
    categories = [r["column"] for r in reference.filter(F.col("kind") == "categorical")
                  .select("column").distinct().collect()]
    items = {c: _bin(c, sorted(e)) for c, e in edges.items() if c in batch.columns}
    items.update({c: as_text(col(c), dtype_of(batch, c)) for c in categories if c in batch.columns})
    if not items:
        return batch.sparkSession.createDataFrame([], "column string, psi double")
    actual = _shares(batch, items)
    present = actual.select("column").distinct()
    floor = F.lit(fixed.PSI_FLOOR)
    a = F.greatest(F.coalesce("share", floor), floor)
    e = F.greatest(F.coalesce("expected", floor), floor)
    both = reference.select("column", "item", "expected").join(actual, ["column", "item"], "full_outer")
    return (both.join(present, "column", "left_semi").groupBy("column")
            .agg(F.sum((a - e) * F.log(a / e)).alias("psi")))


def drift_columns(reference: DataFrame, batch: DataFrame,
                  threshold: float = fixed.PSI_THRESHOLD) -> DataFrame:
    """(column, psi, drifted), 6 digits."""
    return psi(reference, batch).select(
        "column", F.round("psi", 6).alias("psi"), (F.round("psi", 6) >= threshold).alias("drifted"))


def drift_report(reference: DataFrame, batch: DataFrame,
                 threshold: float = fixed.PSI_THRESHOLD) -> DataFrame:
    """One row: columns checked, columns drifted (sorted), largest PSI, flag."""
    return summarise(drift_columns(reference, batch, threshold))


def summarise(columns: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return columns.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_columns"), F.count_if("drifted").alias("n_drifted"),
        F.coalesce(F.max("psi"), F.lit(0.0)).alias("max_psi"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.when(F.col("drifted"), F.col("column")))))
        .alias("drifted_columns"),
        (F.count_if("drifted") > 0).alias("drift_detected"))


def retraining_due(report: DataFrame, last_trained: date, today: date,
                   cadence_days: int = fixed.REVIEW_DAYS, metric_met: bool | None = None) -> DataFrame:
    """Whether to retrain and why: drift, a missed success threshold, or age."""
    review = F.date_add(F.lit(last_trained), cadence_days)
    missed = F.lit(metric_met is False)
    old = F.lit(today) >= review
    return report.select(
        F.col("drift_detected").alias("by_drift"), missed.alias("by_metric"), old.alias("by_age"),
        (F.col("drift_detected") | missed | old).alias("retraining_due"),
        review.cast("string").alias("next_review_date"))

"""Quality report: missing values, copies, constants, rare categories, outlier fences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import fixed
from tablewright.functions.exprs import col, nan_to_null, percent, stack_aggregates
from tablewright.functions.order import quantiles
from tablewright.operators.profile import (
    _with_share, column_facts, duplicates, missing, require_columns, type_map, value_counts)


def fences(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Tukey fences per column; none with fewer than 4 values or without an IQR."""
    if not columns:
        return {}
    q = quantiles(df, columns, [0.25, 0.75])
    n = {r["column"]: r["n"] for r in stack_aggregates(
        nan_to_null(df), [(c, {"n": F.count(col(c))}) for c in columns]).collect()}
    result = {}
    for c in columns:
        if n[c] < 4 or q[c] is None:
            continue
        low, high = q[c]
        if high - low > 0:
            reach = fixed.IQR_FACTOR * (high - low)
            result[c] = (low - reach, high + reach)
    return result


def outliers(df: DataFrame, columns: list[str],
             limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(column, n, pct, lower, upper) of columns with values outside their fences."""
    limits = fences(df, columns) if limits is None else limits
    if not limits:
        return df.sparkSession.createDataFrame(
            [], "column string, n long, pct double, lower double, upper double")
    counted = stack_aggregates(nan_to_null(df), [
        (c, {"n": F.count_if((col(c) < low) | (col(c) > high)), "n_rows": F.count(F.lit(1)),
             "lower": F.round(F.first(F.lit(low)), 6), "upper": F.round(F.first(F.lit(high)), 6)})
        for c, (low, high) in limits.items()])
    return counted.filter(F.col("n") > 0).select(
        "column", "n", percent(F.col("n"), F.col("n_rows")).alias("pct"), "lower", "upper")


def rare_categories(df: DataFrame, columns: list[str],
                    threshold: float = fixed.RARE_CATEGORY_SHARE) -> DataFrame:
    """(column, value, count) of the values below the threshold; as long as the data says."""
    return (_with_share(value_counts(df, columns))
            .filter(F.col("count") < F.lit(threshold) * F.col("n_valid"))
            .select("column", "value", "count"))


def frequent_categories(df: DataFrame, columns: list[str],
                        threshold: float = fixed.RARE_CATEGORY_SHARE) -> DataFrame:
    """The complement of the rare list: at most 1 / threshold values per column."""
    return (_with_share(value_counts(df, columns))
            .filter(F.col("count") >= F.lit(threshold) * F.col("n_valid"))
            .select("column", "value", "count"))


def missing_columns(df: DataFrame) -> DataFrame:
    return missing(df).filter(F.col("n_missing") > 0)


def quality_report(df: DataFrame, target: str | None = None,
                   threshold: float = fixed.RARE_CATEGORY_SHARE,
                   facts: DataFrame | None = None) -> DataFrame:
    """(finding, column, value, n, pct, lower, upper), one row per finding."""
    require_columns(df, target=target)
    facts = column_facts(df, sniff_dates=False) if facts is None else facts
    types = type_map(facts)
    numeric = [c for c, t in types.items() if t == "numeric" and c != target]
    categories = [c for c, t in types.items() if t in ("categorical", "boolean") and c != target]
    none = F.lit(None)

    def rows(source, finding, column=none, value=none, n=none, pct=none, lower=none, upper=none):
        return source.select(
            F.lit(finding).alias("finding"), column.cast("string").alias("column"),
            value.cast("string").alias("value"), n.cast("long").alias("n"),
            pct.cast("double").alias("pct"), lower.cast("double").alias("lower"),
            upper.cast("double").alias("upper"))

    name, n = F.col("column"), F.col("n")
    report = rows(facts.filter(F.col("n_missing") > 0), "missing", name, none, F.col("n_missing"),
                  F.col("pct_missing"))
    report = report.unionByName(rows(
        duplicates(df), "duplicate_rows", n=F.col("n_duplicate_rows"), pct=F.col("pct_duplicate_rows")))
    report = report.unionByName(rows(facts.filter("is_constant"), "constant_column", name, none,
                                     F.col("n_unique")))
    if categories:
        report = report.unionByName(rows(rare_categories(df, categories, threshold), "rare_category",
                                         name, F.col("value"), F.col("count")))
    if numeric:
        report = report.unionByName(rows(outliers(df, numeric), "outliers", name, none, n,
                                         F.col("pct"), F.col("lower"), F.col("upper")))
    if target:
        report = report.unionByName(rows(facts.filter(F.col("column") == target), "target_missing",
                                         name, none, F.col("n_missing"), F.col("pct_missing")))
    return report

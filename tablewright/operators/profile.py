"""Profile of a table: types, missing values, distributions, correlations, target, alerts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import fixed
from tablewright.functions.exprs import (
    NESTED, col, corrected_kurtosis, corrected_skewness, dtype_of, fingerprint,
    is_numeric, is_temporal, is_textual, melt, nan_to_null, percent, stack_aggregates, to_moment)
from tablewright.functions.order import PERCENTILE_CELLS, quantiles
from tablewright.operators.gram import wide_correlations

ROLES = ("id", "time", "group")
STAT_PROBS = [0.25, 0.5, 0.75]


def usable_columns(df: DataFrame) -> list[str]:
    """Columns with a semantic type; arrays, maps, structs and bytes have none."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED)]


# -- counts and types ------------------------------------------------------------------

def table_size(df: DataFrame) -> DataFrame:
    """Row and column count."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_missing, pct_missing), all columns in one aggregate."""
    columns = columns or df.columns
    counts = stack_aggregates(nan_to_null(df), [
        (c, {"n_rows": F.count(F.lit(1)), "n_missing": F.count_if(col(c).isNull())})
        for c in columns])
    return counts.select("column", "n_missing",
                         percent(F.col("n_missing"), F.col("n_rows")).alias("pct_missing"))


def missing_cells(df: DataFrame) -> DataFrame:
    """Missing cells of the whole table."""
    return missing(df).agg(F.sum("n_missing").alias("n_missing_cells"))


def cardinality(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, n_unique): distinct non-null values; ``approx`` needs no shuffle of values."""
    columns = columns or usable_columns(df)
    count = F.approx_count_distinct if approx else F.count_distinct
    return stack_aggregates(nan_to_null(df), [(c, {"n_unique": count(col(c))}) for c in columns])


def column_facts(df: DataFrame, approx: bool = False, sniff_dates: bool = True,
                 high_cardinality_ratio: float = fixed.HIGH_CARDINALITY_RATIO,
                 columns: list[str] | None = None) -> DataFrame:
    """One row per column: counts, flags and the semantic type, from one aggregate."""
    df = nan_to_null(df)
    columns = columns or usable_columns(df)
    if not columns:
        raise ValueError("The table has no columns to profile.")
    count = F.approx_count_distinct if approx else F.count_distinct
    entries, physical = [], {}
    for c in columns:
        dtype = dtype_of(df, c)
        text = is_textual(dtype)
        physical[c] = (dtype.simpleString(), "boolean" if dtype.typeName() == "boolean" else
                       "datetime" if is_temporal(dtype) else
                       "numeric" if is_numeric(dtype) else "string")
        entries.append((c, {
            "n_rows": F.count(F.lit(1)),
            "n_missing": F.count_if(col(c).isNull()),
            "n_unique": count(col(c)),
            "avg_length": F.avg(F.length(col(c))) if text else F.lit(None).cast("double"),
            "date_share": (F.avg(F.when(col(c).isNotNull(),
                                        to_moment(col(c)).isNotNull().cast("double")))
                           if text and sniff_dates else F.lit(None).cast("double")),
        }))
    facts = stack_aggregates(df, entries)
    dtypes = F.create_map(*[F.lit(x) for c in columns for x in (c, physical[c][0])])
    kinds = F.create_map(*[F.lit(x) for c in columns for x in (c, physical[c][1])])
    ratio = F.when(F.col("n_rows") > 0, F.col("n_unique") / F.col("n_rows")).otherwise(0.0)
    length = F.coalesce(F.col("avg_length"), F.lit(0.0))
    kind = kinds[F.col("column")]
    inferred = (
        F.when(F.col("n_unique") <= 1, "constant")
        .when(kind != "string", kind)
        .when(F.coalesce(F.col("date_share"), F.lit(0.0)) >= fixed.DATE_SHARE, "datetime")
        .when((length >= fixed.TEXT_AVG_LENGTH)
              | ((ratio >= high_cardinality_ratio) & (length > 1)), "text")
        .otherwise("categorical"))
    return facts.select(
        "column", dtypes[F.col("column")].alias("dtype"), inferred.alias("inferred_type"),
        "n_rows", "n_missing", percent(F.col("n_missing"), F.col("n_rows")).alias("pct_missing"),
        "n_unique", (F.col("n_unique") <= 1).alias("is_constant"),
        ((F.col("n_rows") > 0) & (F.col("n_unique") == F.col("n_rows"))
         & (F.col("n_missing") == 0)).alias("is_id_like"))


def infer_types(df: DataFrame, **options) -> DataFrame:
    """(column, dtype, inferred_type)."""
    return column_facts(df, **options).select("column", "dtype", "inferred_type")


def type_map(facts: DataFrame) -> dict[str, str]:
    """Semantic types on the driver: one entry per column."""
    return {r["column"]: r["inferred_type"] for r in facts.select("column", "inferred_type").collect()}


# -- distributions ---------------------------------------------------------------------

def numeric_stats(df: DataFrame, columns: list[str], max_cells: int = PERCENTILE_CELLS) -> DataFrame:
    """Moments, order statistics and counts per numeric column.

    Skewness and kurtosis are the bias-corrected ones, NULL where undefined. Moments are one
    generated aggregate; the quantiles are fitted before, see ``order.quantiles``.
    """
    values = nan_to_null(df.select([col(c).cast("double").alias(c) for c in columns]))
    known = quantiles(values, columns, STAT_PROBS, max_cells)
    entries = []
    for c in columns:
        x, n = col(c), F.count(col(c))
        points = [F.first(F.lit(v).cast("double")) for v in (known[c] or [None] * 3)]
        entries.append((c, {
            "n": n, "mean": F.avg(x),
            "std": F.when(n > 0, F.coalesce(F.stddev_samp(x), F.lit(0.0))),
            "min": F.min(x), "p25": points[0], "p50": points[1], "p75": points[2], "max": F.max(x),
            "n_zeros": F.count_if(x == 0), "n_negative": F.count_if(x < 0),
            "skewness": corrected_skewness(x, n), "kurtosis": corrected_kurtosis(x, n),
        }))
    return stack_aggregates(values, entries)


def datetime_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, min, max) as ISO text; strings are parsed first."""
    entries = []
    for c in columns:
        x = to_moment(col(c)) if is_textual(dtype_of(df, c)) else col(c)
        layout = "yyyy-MM-dd'T'HH:mm:ss"
        entries.append((c, {"min": F.date_format(F.min(x).cast("timestamp"), layout),
                            "max": F.date_format(F.max(x).cast("timestamp"), layout)}))
    return stack_aggregates(df, entries)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, count) of non-null values, one map-side combined shuffle for all."""
    return (melt(nan_to_null(df), columns).filter(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")))


def _with_share(counts: DataFrame) -> DataFrame:
    totals = counts.groupBy("column").agg(F.sum("count").alias("n_valid"))
    return counts.join(F.broadcast(totals), "column")  # one row per column of the table


def top_values(df: DataFrame, columns: list[str], k: int = fixed.TOP_CATEGORIES) -> DataFrame:
    """The k most frequent values per column; ties by value.

    The rank filter is pushed below the shuffle by Spark (a window group limit), so a column
    of many values sends k rows per partition.
    """
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    return (_with_share(value_counts(df, columns))
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("column", "rank", "value", "count",
                    percent(F.col("count"), F.col("n_valid")).alias("pct")))


def rare_counts(df: DataFrame, columns: list[str],
                threshold: float = fixed.RARE_CATEGORY_SHARE) -> DataFrame:
    """(column, n_rare_categories): values with count < threshold * non-null."""
    shared = _with_share(value_counts(df, columns))
    return shared.groupBy("column").agg(
        F.count_if(F.col("count") < F.lit(threshold) * F.col("n_valid")).alias("n_rare_categories"))


def duplicates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier one, by a 128-bit row fingerprint; copies meet map-side."""
    columns = columns or usable_columns(df)
    groups = nan_to_null(df).groupBy(fingerprint(columns).alias("f")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
                      F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicate_rows")).withColumn(
        "pct_duplicate_rows", percent(F.col("n_duplicate_rows"), F.col("n_rows")))


#: Columns up to which their pairs are expressions of one aggregate.
FEW_COLUMNS = 12


def high_correlations(df: DataFrame, columns: list[str],
                      threshold: float = fixed.CORRELATION_THRESHOLD) -> DataFrame:
    """Pairs with |Pearson r| >= threshold, pairwise complete, strongest first.

    Up to FEW_COLUMNS columns one aggregate holds all pairs, beyond it blocks of Gram matrices do.
    """
    pairs = list(combinations(columns, 2))
    if len(columns) > FEW_COLUMNS:
        return (wide_correlations(df, columns, threshold).select("a", "b", F.round("r", 4).alias("pearson"))
                .orderBy(F.desc(F.abs("pearson")), "a", "b"))
    values = nan_to_null(df.select([col(c).cast("double").alias(c) for c in columns]))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, pearson double")

    def spread(x: str, y: str):
        return F.stddev_pop(F.when(col(y).isNotNull(), col(x)))

    # corr() itself divides by zero where a column is constant
    aggregates = [F.try_divide(F.covar_pop(col(a), col(b)), spread(a, b) * spread(b, a)).alias(f"r{i}")
                  for i, (a, b) in enumerate(pairs)]
    rows = values.agg(*aggregates).select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)])))
    return (rows.filter(F.col("r").isNotNull() & ~F.isnan("r") & (F.abs("r") >= threshold))
            .select("a", "b", F.round("r", 4).alias("pearson"))
            .orderBy(F.desc(F.abs("pearson")), "a", "b"))


# -- target ----------------------------------------------------------------------------

def target_kind(df: DataFrame, target: str, task_type: str | None) -> str:
    """regression, classification or empty."""
    dtype = dtype_of(df, target)
    row = nan_to_null(df).agg(F.count(col(target)).alias("n"),
                              F.count_distinct(col(target)).alias("u")).first()
    if not row["n"]:
        return "empty"
    many = is_numeric(dtype) and row["u"] > fixed.REGRESSION_MIN_DISTINCT
    return "regression" if task_type == "regression" or (task_type is None and many) else "classification"


def class_distribution(df: DataFrame, target: str, k: int = fixed.TOP_CATEGORIES) -> DataFrame:
    """(label, count, pct) of the k largest classes; ties by label."""
    return (top_values(df, [target], k)
            .select("rank", F.col("value").alias("label"), "count", "pct"))


def class_summary(df: DataFrame, target: str) -> DataFrame:
    """Class count, imbalance ratio, smallest and largest class (ties by label)."""
    counts = value_counts(df, [target])
    return counts.agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.round(F.max("count") / F.min("count"), 3).alias("imbalance_ratio"),
        F.min(F.struct(F.col("count"), F.col("value"))).alias("least"),
        F.min(F.struct((-F.col("count")).alias("count"), F.col("value"))).alias("most"),
    ).select("n_classes", "imbalance_ratio", F.col("least.value").alias("minority_class"),
             F.col("most.value").alias("majority_class"))


def profile_target(df: DataFrame, target: str, task_type: str | None = None) -> DataFrame:
    """(measure, label, value): target counts by class, or its statistics."""
    require_columns(df, target=target)
    kind = target_kind(df, target, task_type)
    gaps = missing(df, [target]).select(F.inline(F.array(
        F.struct(F.lit("n_missing").alias("measure"), F.lit(None).cast("string").alias("label"),
                 F.col("n_missing").cast("double").alias("value")),
        F.struct(F.lit("pct_missing").alias("measure"), F.lit(None).cast("string").alias("label"),
                 F.col("pct_missing").alias("value")))))
    if kind == "empty":
        return gaps.withColumn("kind", F.lit(kind))
    if kind == "regression":
        stats = numeric_stats(df, [target]).drop("column")
        rows = stats.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("measure"), F.lit(None).cast("string").alias("label"),
                     F.col(c).cast("double").alias("value")) for c in stats.columns])))
        return gaps.unionByName(rows).withColumn("kind", F.lit(kind))
    spread = class_distribution(df, target).select(F.inline(F.array(
        F.struct(F.lit("count").alias("measure"), "label", F.col("count").cast("double").alias("value")),
        F.struct(F.lit("pct").alias("measure"), "label", F.col("pct").alias("value")))))
    whole = class_summary(df, target).select(F.inline(F.array(
        F.struct(F.lit("n_classes").alias("measure"), F.lit(None).cast("string").alias("label"),
                 F.col("n_classes").cast("double").alias("value")),
        F.struct(F.lit("imbalance_ratio").alias("measure"), F.lit(None).cast("string").alias("label"),
                 F.col("imbalance_ratio").alias("value")),
        F.struct(F.lit("minority_class").alias("measure"), F.col("minority_class").alias("label"),
                 F.lit(None).cast("double").alias("value")),
        F.struct(F.lit("majority_class").alias("measure"), F.col("majority_class").alias("label"),
                 F.lit(None).cast("double").alias("value")))))
    return gaps.unionByName(spread).unionByName(whole).withColumn("kind", F.lit(kind))


# -- the whole profile -----------------------------------------------------------------

def require_columns(df: DataFrame, **named: str | None) -> None:
    for role, name in named.items():
        if name and name not in df.columns:
            raise ValueError(f"{role} column '{name}' is not in the table: {df.columns}.")


def content_hash(df: DataFrame) -> DataFrame:
    """Order-free hash of the content: SHA-256 over row-hash sums, row count and names.

    Sums (not XOR) keep repeated rows from cancelling; one partial aggregate, no shuffle.
    """
    columns = df.columns
    f = fingerprint(columns)
    sums = df.select(f.alias("f")).agg(
        F.sum(F.col("f.h1").cast("decimal(38,0)")).alias("s1"),
        F.sum(F.col("f.h2").cast("decimal(38,0)")).alias("s2"), F.count(F.lit(1)).alias("n"))
    return sums.select(F.sha2(F.concat_ws(
        "|", F.coalesce("s1", F.lit(0)).cast("string"), F.coalesce("s2", F.lit(0)).cast("string"),
        F.col("n").cast("string"), *map(F.lit, columns)), 256).alias("content_hash"))


def profile_table(df: DataFrame, target: str | None = None, id_column: str | None = None,
                  time_column: str | None = None, group_column: str | None = None,
                  approx: bool = False, sniff_dates: bool = True) -> DataFrame:
    """One row per column with its role; the base every later step takes its types from."""
    require_columns(df, target=target)
    roles = {id_column: "id", time_column: "time", group_column: "group"}
    role = F.lit(None).cast("string")
    for name, label in roles.items():
        if name:
            role = F.when(F.col("column") == name, label).otherwise(role)
    return column_facts(df, approx=approx, sniff_dates=sniff_dates).select(
        "*", role.alias("role"), (F.col("column") == F.lit(target)).alias("is_target")
        if target else F.lit(False).alias("is_target"))


def profile_alerts(df: DataFrame, target: str | None = None, facts: DataFrame | None = None,
                   task_type: str | None = None, roles: dict[str, str] | None = None,
                   correlations: DataFrame | None = None) -> DataFrame:
    """(alert, column, value) findings of the profile."""
    facts = column_facts(df) if facts is None else facts

    def rows(source: DataFrame, alert: str, column, value) -> DataFrame:
        return source.select(F.lit(alert).alias("alert"), column.cast("string").alias("column"),
                             value.cast("double").alias("value"))

    name = F.col("column")
    not_target = (name != target) if target else F.lit(True)
    found = [
        rows(facts.filter(F.col("is_constant") & (F.col("n_rows") > 0)), "constant_column", name,
             F.col("n_unique")),
        rows(facts.filter(F.col("is_id_like") & not_target), "id_like_column", name, F.col("n_unique")),
        rows(facts.filter(F.col("pct_missing") >= fixed.MISSING_ALERT_PCT), "high_missing", name,
             F.col("pct_missing")),
        rows(duplicates(df).filter(F.col("n_duplicate_rows") > 0), "duplicate_rows", F.lit(None),
             F.col("n_duplicate_rows")),
        rows(facts.filter(F.col("n_rows") == 0).limit(1), "empty_table", F.lit(None), F.lit(0)),
    ]
    if target:
        if correlations is None:
            numeric = [c for c, t in type_map(facts).items() if t == "numeric"]
            correlations = high_correlations(df, numeric)
        other = F.when(F.col("a") == target, F.col("b")).otherwise(F.col("a"))
        found.append(rows(
            correlations.filter((F.col("a") == target) | (F.col("b") == target)),
            "correlated_with_target", other, F.col("pearson")))
        if target_kind(df, target, task_type) == "classification":
            found.append(rows(
                class_summary(df, target).filter(F.col("imbalance_ratio") >= fixed.IMBALANCE_RATIO),
                "imbalanced_target", F.lit(target), F.col("imbalance_ratio")))
    absent = [(f"absent_{role}_column", c, None) for role, c in (roles or {}).items()
              if c and c not in df.columns]
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    if absent:
        result = result.unionByName(df.sparkSession.createDataFrame(
            absent, "alert string, column string, value double"))
    return result

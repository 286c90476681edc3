"""Cleaning as a fitted plan: an Estimator learns the steps, its Model repeats them.

Order of steps: strip strings, turn numeric strings to numbers, (quality facts), drop rows
without target, drop constant columns, blank impossible values, drop empty columns or impute,
group rare categories, clip or remove outliers, drop duplicates. All fitted values are kept
in a small JSON plan, so a saved model cleans a later batch or a stream the same way.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import fixed
from tablewright.functions.exprs import (
    as_text, col, dtype_of, is_numeric, is_textual, nan_to_null, stack_aggregates, strip, to_number)
from tablewright.functions.order import quantiles
from tablewright.operators.profile import (
    column_facts, content_hash, duplicates, require_columns, usable_columns, value_counts)
from tablewright.operators.quality import fences, frequent_categories

NUMERIC_IMPUTATIONS = ("median", "mean", "constant", "none")
CATEGORICAL_IMPUTATIONS = ("most_frequent", "constant", "none")
OUTLIER_STRATEGIES = ("none", "clip", "remove")
RARE_STRATEGIES = ("group", "none")


# -- single steps ----------------------------------------------------------------------

def strip_strings(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """White space cut at both ends of string columns; empty strings become NULL."""
    chosen = set(columns if columns is not None else
                 [c for c in df.columns if is_textual(dtype_of(df, c))])
    return df.select([strip(col(c)).alias(c) if c in chosen else col(c) for c in df.columns])


def numeric_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, share): non-null strings that spell a number."""
    return stack_aggregates(df, [
        (c, {"n": F.count(col(c)),
             "share": F.avg(F.when(col(c).isNotNull(),
                                   to_number(col(c)).isNotNull().cast("double")))})
        for c in columns])


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    chosen = set(columns)
    return df.select([to_number(col(c)).alias(c) if c in chosen else col(c) for c in df.columns])


def blank_impossible(df: DataFrame, ranges: dict[str, dict[str, float]]) -> DataFrame:
    """Values outside [min, max] become NULL."""
    return df.select([
        F.when(~_impossible(df, c, ranges[c]), col(c)).otherwise(None).alias(c)
        if c in ranges else col(c) for c in df.columns])


def _impossible(df: DataFrame, c: str, bounds: dict[str, float]):
    x = to_number(col(c)) if is_textual(dtype_of(df, c)) else col(c).cast("double")
    bad = F.lit(False)
    if bounds.get("min") is not None:
        bad = bad | (x < float(bounds["min"]))
    if bounds.get("max") is not None:
        bad = bad | (x > float(bounds["max"]))
    return F.coalesce(bad, F.lit(False))


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent value per column, the least on ties; values meet map-side first."""
    rows = value_counts(df, columns).groupBy("column").agg(
        F.min(F.struct((-F.col("count")).alias("n"), F.col("value"))).alias("best")).collect()
    return {r["column"]: r["best"]["value"] for r in rows}


def fill(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    return df.select([
        F.coalesce(col(c), _literal(df, c, fills[c])).alias(c) if c in fills else col(c)
        for c in df.columns])


def _literal(df: DataFrame, c: str, value):
    dtype = dtype_of(df, c)
    if is_numeric(dtype):  # a median or mean of whole numbers need not be whole
        return F.lit(float(value))
    return F.lit(value).cast(dtype)


def group_rare(df: DataFrame, keep: dict[str, list[str]], label: str = fixed.RARE_LABEL) -> DataFrame:
    """Every category not kept becomes ``label``.

    The plan holds the frequent values (at most 1 / threshold per column), not the rare
    ones, whose number grows with the data. A value unseen in fitting counts as rare.
    """
    def grouped(c):
        text = as_text(col(c), dtype_of(df, c))
        return F.when(text.isNull() | text.isin(keep[c]), text).otherwise(F.lit(label)).alias(c)
    return df.select([grouped(c) if c in keep else col(c) for c in df.columns])


def clip(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    def clipped(c):
        low, high = limits[c]
        x = col(c).cast("double")
        return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high))).alias(c)
    return df.select([clipped(c) if c in limits else col(c) for c in df.columns])


def _outside(c: str, limits) -> Column:
    low, high = limits[c]
    return F.coalesce((col(c) < low) | (col(c) > high), F.lit(False))


def remove_outside(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    for c in limits:
        df = df.filter(~_outside(c, limits))
    return df


def removed_by_column(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """(column, rows): rows the filters take one after another, by the first that fails."""
    first = F.coalesce(*[F.when(_outside(c, limits), F.lit(c)) for c in limits])
    return (df.select(first.alias("column")).filter(F.col("column").isNotNull())
            .groupBy("column").agg(F.count(F.lit(1)).alias("rows")))


# -- estimator and model ---------------------------------------------------------------

class _Options(Params):
    target = Param(Params._dummy(), "target", "target column or ''", TypeConverters.toString)
    options = Param(Params._dummy(), "options", "strategies as JSON", TypeConverters.toString)
    plan = Param(Params._dummy(), "plan", "fitted steps as JSON", TypeConverters.toString)


DEFAULTS = {
    "normalize_strings": True, "coerce_numeric_strings": True, "drop_constant": True,
    "impossible_ranges": {}, "drop_column_missing_fraction": fixed.DROP_COLUMN_MISSING_SHARE,
    "numeric_imputation": "median", "categorical_imputation": "most_frequent",
    "constant_fill_value": fixed.MISSING_LABEL, "rare_category_strategy": "group",
    "rare_category_threshold": fixed.RARE_CATEGORY_SHARE, "outlier_strategy": "none",
    "drop_duplicates": True,
}


class Cleaner(Estimator, _Options, DefaultParamsReadable, DefaultParamsWritable):
    """Learns a cleaning plan; see the module text for the steps and DEFAULTS for options."""

    @keyword_only
    def __init__(self, target: str = "", options: str = "{}"):
        super().__init__()
        self._setDefault(target="", options="{}")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @classmethod
    def of(cls, target: str | None = None, **options) -> "Cleaner":
        unknown = set(options) - set(DEFAULTS)
        if unknown:
            raise ValueError(f"Unknown cleaning options: {sorted(unknown)}.")
        merged = {**DEFAULTS, **options}
        for name, allowed in (("numeric_imputation", NUMERIC_IMPUTATIONS),
                              ("categorical_imputation", CATEGORICAL_IMPUTATIONS),
                              ("outlier_strategy", OUTLIER_STRATEGIES),
                              ("rare_category_strategy", RARE_STRATEGIES)):
            if merged[name] not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, not '{merged[name]}'.")
        return cls(target=target or "", options=json.dumps(options))

    def _fit(self, dataset: DataFrame) -> "CleaningModel":
        cfg = {**DEFAULTS, **json.loads(self.getOrDefault(self.options))}
        target = self.getOrDefault(self.target) or None
        require_columns(dataset, target=target)
        if not dataset.columns:
            raise ValueError("The table has no columns to clean.")
        df = nan_to_null(dataset)
        plan = {"target": target, "strip": [], "coerce": [], "drop": [], "ranges": {}, "fills": {},
                "keep": {}, "clip": {}, "remove": {}, "drop_duplicates": cfg["drop_duplicates"]}
        actions: list[tuple] = []
        alerts: list[tuple] = []

        def log(operation, column=None, rows=None, value=None, reason=""):
            text = value if value is None or isinstance(value, str) else json.dumps(value)
            actions.append((len(actions) + 1, operation, column, rows, text, reason))

        texts = [c for c in df.columns if is_textual(dtype_of(df, c))]
        if texts and (cfg["normalize_strings"] or cfg["coerce_numeric_strings"]):
            self._learn_strings(df, texts, target, cfg, plan, log)
        df = apply_representation(df, plan)

        facts_table = column_facts(df, sniff_dates=False)
        facts = {r["column"]: r for r in facts_table.collect()}
        types = {c: r["inferred_type"] for c, r in facts.items()}
        n_rows = next(iter(facts.values()))["n_rows"] if facts else 0
        numeric = [c for c, t in types.items() if t == "numeric" and c != target]
        categories = [c for c, t in types.items() if t in ("categorical", "boolean") and c != target]
        limits = fences(df, numeric) if cfg["outlier_strategy"] != "none" else {}
        keep: dict[str, list[str]] = {}
        if cfg["rare_category_strategy"] == "group" and categories:
            keep = self._learn_categories(df, categories, facts, cfg)

        if target and facts[target]["n_missing"]:
            n = facts[target]["n_missing"]
            df = df.filter(col(target).isNotNull())
            log("drop_missing_target_rows", target, n, reason="Rows without a label cannot be used.")
            alerts.append(("missing_target_rows_dropped", target, float(n)))
            n_rows -= n
        if cfg["drop_constant"]:
            for c, r in facts.items():
                if r["is_constant"] and c != target:
                    plan["drop"].append(c)
                    log("drop_constant_column", c, reason="At most one distinct value.")
        df = df.drop(*plan["drop"])

        plan["ranges"] = {c: b for c, b in cfg["impossible_ranges"].items() if c in df.columns}
        if plan["ranges"]:
            bad = df.agg(*[F.count_if(_impossible(df, c, b)).alias(c)
                           for c, b in plan["ranges"].items()]).first()
            for c, b in plan["ranges"].items():
                if bad[c]:
                    log("coerce_impossible_to_nan", c, bad[c], b, "Outside the plausible range.")
            df = blank_impossible(df, plan["ranges"])

        self._learn_gaps(df, types, target, n_rows, cfg, plan, log, alerts)
        df = fill(df.drop(*plan["drop"]), plan["fills"])

        keep = {c: v for c, v in keep.items() if c in df.columns}
        if keep:
            for c in keep:
                if c in plan["fills"] and plan["fills"][c] not in keep[c]:
                    # An imputed label that is no category of the data is never rare.
                    if not self._seen(dataset, plan, c):
                        keep[c].append(str(plan["fills"][c]))
            grouped = df.agg(*[
                F.count_if(F.coalesce(~as_text(col(c), dtype_of(df, c)).isin(v), F.lit(False))).alias(c)
                for c, v in keep.items()]).first()
            for c in keep:
                if grouped[c]:
                    plan["keep"][c] = keep[c]
                    log("group_rare_categories", c, grouped[c], fixed.RARE_LABEL,
                        "Categories below the frequency threshold.")
            df = group_rare(df, plan["keep"])

        limits = {c: (round(a, 6), round(b, 6)) for c, (a, b) in limits.items() if c in df.columns}
        if limits:
            if cfg["outlier_strategy"] == "clip":
                out = df.agg(*[F.count_if(_outside(c, limits)).alias(c) for c in limits]).first()
                counts = {c: out[c] for c in limits}
            else:
                counts = {r["column"]: r["rows"] for r in removed_by_column(df, limits).collect()}
            kind = cfg["outlier_strategy"]
            plan[kind] = {c: limits[c] for c in limits if counts.get(c)}
            for c in plan[kind]:
                log(f"{kind}_outliers", c, counts[c], {"lower": limits[c][0], "upper": limits[c][1]},
                    "Outside the Tukey fences.")
            df = clip(df, plan["clip"]) if kind == "clip" else remove_outside(df, plan["remove"])
        if cfg["drop_duplicates"]:
            n = duplicates(df).first()["n_duplicate_rows"]
            if n:
                log("drop_duplicates", rows=n, reason="Exact copies of another row.")
        plan["actions"], plan["alerts"] = actions, alerts
        return CleaningModel(plan=json.dumps(plan))

    @staticmethod
    def _learn_strings(df, texts, target, cfg, plan, log):
        entries = []
        for c in texts:
            clean = strip(col(c)) if cfg["normalize_strings"] else col(c)
            entries.append((c, {
                "changed": F.count_if(~clean.eqNullSafe(col(c))), "n": F.count(clean),
                "numbers": F.count_if(to_number(clean).isNotNull())}))
        for r in stack_aggregates(df, entries).collect():
            c = r["column"]
            if cfg["normalize_strings"] and r["changed"]:
                plan["strip"].append(c)
                log("strip_whitespace", c, r["changed"], reason="Blanks cut; empty means missing.")
            if (cfg["coerce_numeric_strings"] and c != target and r["n"]
                    and r["numbers"] and r["numbers"] / r["n"] >= fixed.NUMERIC_SHARE):
                plan["coerce"].append(c)
        for c in plan["coerce"]:
            log("coerce_to_numeric", c, reason="Nearly all values spell a number.")

    @staticmethod
    def _learn_categories(df, categories, facts, cfg):
        keep = {c: [] for c in categories}
        counts = {c: 0 for c in categories}
        for r in frequent_categories(df, categories, cfg["rare_category_threshold"]).collect():
            keep[r["column"]].append(r["value"])
            counts[r["column"]] += 1
        # Columns whose categories are all frequent have no rare list.
        return {c: v for c, v in keep.items() if counts[c] < facts[c]["n_unique"]}

    @staticmethod
    def _seen(dataset, plan, c) -> bool:
        value = str(plan["fills"][c])
        df = apply_representation(nan_to_null(dataset), plan)
        return bool(df.filter(as_text(col(c), dtype_of(df, c)) == value).limit(1).count())

    @staticmethod
    def _learn_gaps(df, types, target, n_rows, cfg, plan, log, alerts):
        columns = [c for c in df.columns if c != target]
        if not columns:
            return
        missing = df.agg(*[F.count_if(col(c).isNull()).alias(c) for c in columns]).first()
        numeric, other = [], []
        for c in columns:
            if not missing[c]:
                continue
            share = missing[c] / n_rows if n_rows else 0.0
            if share >= cfg["drop_column_missing_fraction"]:
                plan["drop"].append(c)
                log("drop_high_missing_column", c, missing[c], round(100.0 * share, 3),
                    "Too empty to impute.")
            elif types.get(c) == "numeric":
                numeric.append((c, share))
            else:
                other.append(c)
        how = cfg["numeric_imputation"]
        names = [c for c, _ in numeric]
        if how == "median":
            values = {c: q[0] for c, q in quantiles(df, names, [0.5]).items() if q}
        elif how == "mean" and names:
            row = df.agg(*[F.avg(col(c)).alias(c) for c in names]).first()
            values = {c: row[c] for c in names if row[c] is not None}
        elif how == "constant":
            given = cfg["constant_fill_value"]
            values = dict.fromkeys(names, given if isinstance(given, (int, float)) else 0)
        else:
            values = {}
        for c, share in numeric:
            if c in values:
                plan["fills"][c] = values[c]
                log(f"{how}_imputation", c, missing[c], values[c], "Missing numbers filled.")
                if share >= fixed.IMPUTED_ALERT_SHARE:
                    alerts.append(("heavily_imputed", c, round(100.0 * share, 3)))
            else:
                alerts.append(("missing_left", c, float(missing[c])))
        how = cfg["categorical_imputation"]
        values = {}
        if how == "most_frequent" and other:
            values = modes(df, [c for c in other if c in usable_columns(df)])
        elif how == "constant":
            values = {c: str(cfg["constant_fill_value"]) for c in other
                      if is_textual(dtype_of(df, c))}
        for c in other:
            if c in values:
                plan["fills"][c] = values[c]
                log(f"{how}_imputation", c, missing[c], values[c], "Missing categories filled.")
            else:
                alerts.append(("missing_left", c, float(missing[c])))


def apply_representation(df: DataFrame, plan: dict) -> DataFrame:
    return coerce_numeric(strip_strings(df, plan["strip"]), plan["coerce"])


class CleaningModel(Model, _Options, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted plan. ``transform`` is row-wise (and streams) up to the duplicate drop."""

    @keyword_only
    def __init__(self, plan: str = "{}"):
        super().__init__()
        self._setDefault(plan="{}")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @property
    def steps(self) -> dict:
        return json.loads(self.getOrDefault(self.plan))

    def representation(self, df: DataFrame) -> DataFrame:
        """Stripped strings and coerced numbers alone: the table that findings are about."""
        plan, present = self.steps, set(df.columns)
        return apply_representation(nan_to_null(df), {
            "strip": [c for c in plan["strip"] if c in present],
            "coerce": [c for c in plan["coerce"] if c in present]})

    def transform_rows(self, df: DataFrame) -> DataFrame:
        """All steps but the duplicate drop."""
        plan = self.steps
        present = set(df.columns)
        df = self.representation(df)
        if plan["target"] and plan["target"] in present:
            df = df.filter(col(plan["target"]).isNotNull())
        df = blank_impossible(df, plan["ranges"]).drop(*plan["drop"])
        df = group_rare(fill(df, plan["fills"]), plan["keep"])
        return remove_outside(clip(df, plan["clip"]), plan["remove"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        df = self.transform_rows(dataset)
        if self.steps["drop_duplicates"] and not dataset.isStreaming:
            df = df.dropDuplicates()
        return df

    def actions(self, spark) -> DataFrame:
        """(step, operation, column, rows, value, reason): one row per logged step."""
        return spark.createDataFrame(
            [tuple(a) for a in self.steps["actions"]],
            "step int, operation string, column string, rows long, value string, reason string")

    def alerts(self, spark) -> DataFrame:
        return spark.createDataFrame([tuple(a) for a in self.steps["alerts"]],
                                     "alert string, column string, value double")

    def summary(self, before: DataFrame, after: DataFrame | None = None) -> DataFrame:
        """Rows, columns and content hash before and after."""
        after = self.transform(before) if after is None else after

        def side(df, label):
            return df.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(
                F.broadcast(content_hash(df))).select(
                F.lit(label).alias("side"), "n_rows", F.lit(len(df.columns)).alias("n_cols"),
                "content_hash")  # one row each
        return side(before, "before").unionByName(side(after, "after"))


def clean(df: DataFrame, target: str | None = None, **options) -> tuple[DataFrame, CleaningModel]:
    """Fit and apply in one call."""
    model = Cleaner.of(target, **options).fit(df)
    return model.transform(df), model

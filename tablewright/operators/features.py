"""Feature encoding as one Estimator: all fitted values come from a few shared aggregates.

``TableEncoder.fit`` learns fill values, scales, category lists, ordinal codes and tf-idf
weights from the rows it is given (training rows only); the model encodes with expressions
and yields a vector column, or the same features as named columns.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
    MLReader, MLWritable, MLWriter)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import fixed
from tablewright.functions.exprs import (
    as_text, col, dtype_of, is_temporal, nan_to_null, stack_aggregates, to_moment)
from tablewright.functions.order import dense_codes, quantiles, spread
from tablewright.operators.clean import modes
from tablewright.operators.profile import (
    column_facts, high_correlations, require_columns, value_counts)

NUMERIC_IMPUTATIONS = ("median", "mean", "constant", "none")
SCALINGS = ("standard", "minmax", "robust", "none")
CATEGORICAL_IMPUTATIONS = ("most_frequent", "constant")
ENCODINGS = ("onehot", "ordinal")
TEXT_STRATEGIES = ("stats", "tfidf", "drop")
DEFAULTS = {
    "numeric_imputation": "median", "scaling": "standard", "categorical_imputation": "most_frequent",
    "categorical_encoding": "onehot", "high_cardinality_threshold": fixed.HIGH_CARDINALITY_LIMIT,
    "one_hot_max_categories": None, "datetime_features": True, "text_strategy": "stats",
    "tfidf_max_features": fixed.TFIDF_TERMS, "add_interactions": False,
}
TOKEN = r"([\p{L}\p{N}_]{2,})"
# Distinct values up to which codes are numbered in one window per column.
CODES_PER_TASK = 200_000
GROUP_OF_TYPE = {"numeric": "numeric", "categorical": "categorical", "boolean": "categorical",
                 "datetime": "datetime", "text": "text"}

# Categories of all one-hot columns of a table; each is a column of the vector and a row on the driver.
MOST_CATEGORIES = 100_000


def resolve_options(options: dict) -> dict:
    options = dict(options)
    if options.get("categorical_encoding") == "one_hot":
        options["categorical_encoding"] = "onehot"
    unknown = set(options) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"Unknown feature options: {sorted(unknown)}.")
    merged = {**DEFAULTS, **options}
    for name, allowed in (("numeric_imputation", NUMERIC_IMPUTATIONS), ("scaling", SCALINGS),
                          ("categorical_imputation", CATEGORICAL_IMPUTATIONS),
                          ("categorical_encoding", ENCODINGS), ("text_strategy", TEXT_STRATEGIES)):
        if merged[name] not in allowed:
            raise ValueError(f"{name} must be one of {allowed}, not '{merged[name]}'.")
    return merged


# -- choice of columns -----------------------------------------------------------------

def id_like_columns(facts: list) -> list[str]:
    """Identifiers: the declared id, or distinct in every row and not floating."""
    return [r["column"] for r in facts if not r.asDict().get("is_target") and (
        r.asDict().get("role") == "id"
        or (r["is_id_like"] and r["dtype"] not in ("double", "float")))]


def column_groups(facts: list, target: str | None = None) -> tuple[dict[str, list[str]], list[str]]:
    """Columns by kind of transformer, and the columns left out."""
    ids = set(id_like_columns(facts))
    groups: dict[str, list[str]] = {"numeric": [], "categorical": [], "datetime": [], "text": []}
    left_out = []
    for r in facts:
        group = GROUP_OF_TYPE.get(r["inferred_type"])
        if r["column"] == target or r["column"] in ids or group is None:
            left_out.append(r["column"])
        else:
            groups[group].append(r["column"])
    if not any(groups.values()):
        raise ValueError("No usable feature column is left without target, ids and constants.")
    return groups, left_out


def split_by_cardinality(facts: list, columns: list[str], cfg: dict) -> tuple[list[str], list[str]]:
    """(one-hot columns, ordinal columns): too many categories for one-hot go ordinal."""
    if cfg["categorical_encoding"] == "ordinal":
        return [], columns
    n = {r["column"]: r["n_unique"] for r in facts}
    low = [c for c in columns if n[c] <= cfg["high_cardinality_threshold"]]
    return low, [c for c in columns if c not in low]


def leakage_alerts(df: DataFrame, target: str | None, numeric: list[str], scaling: str = "standard",
                   correlations: DataFrame | None = None) -> DataFrame:
    """(alert, column, value): fit on training rows only; features that mirror the target."""
    notes = [("fit_on_training_rows_only", None, None)]
    if scaling != "none":
        notes.append(("scaling_learns_from_data", None, None))
    base = df.sparkSession.createDataFrame(notes, "alert string, column string, value double")
    if not target or target not in numeric:
        return base
    pairs = high_correlations(df, numeric) if correlations is None else correlations
    hit = pairs.filter((F.col("a") == target) | (F.col("b") == target))
    return base.unionByName(hit.select(
        F.lit("correlated_with_target").alias("alert"),
        F.when(F.col("a") == target, F.col("b")).otherwise(F.col("a")).alias("column"),
        F.col("pearson").alias("value")))


# -- expressions -----------------------------------------------------------------------

def date_parts(c: Column) -> list[tuple[str, Column]]:
    """Calendar parts, Monday = 0; a missing date gives zeros."""
    day = F.weekday(c)
    values = {"year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "dayofweek": day,
              "hour": F.hour(c.cast("timestamp")), "quarter": F.quarter(c),
              "is_weekend": (day >= 5).cast("int")}
    return [(p, F.coalesce(values[p], F.lit(0)).cast("double")) for p in fixed.DATE_PARTS]


def text_stats(c: Column) -> list[tuple[str, Column]]:
    """Characters and white-space separated words; a missing text gives zeros."""
    words = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    values = {"char_len": F.length(c), "n_words": words}
    return [(p, F.when(c.isNull(), 0).otherwise(values[p]).cast("double")) for p in fixed.TEXT_PARTS]


def tokens(c: Column) -> Column:
    """Lower-case tokens of two or more word characters, from the whole text."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(1))


def tfidf_terms(df: DataFrame, column: str, max_features: int = fixed.TFIDF_TERMS) -> DataFrame:
    """(term, tf, df, idf) of the most frequent terms, ties by term.

    Tokens meet map-side; the top list is a bounded top-n per partition.
    """
    lists = spread(df.select(col(column).alias("x"))).select(F.array_sort(tokens(F.col("x"))).alias("t"))
    # In sorted order a term's first place in a document is where it differs from the one before.
    marked = F.transform("t", lambda w, i: F.struct(w.alias("term"), F.when(
        (i > 0) & (w == F.get("t", i - 1)), 0).otherwise(1).alias("first")))
    top = (lists.select(F.inline(marked)).groupBy("term")
           .agg(F.count(F.lit(1)).alias("tf"), F.sum("first").alias("df"))
           .orderBy(F.desc("tf"), F.asc("term")).limit(max_features))
    size = df.agg(F.count(F.lit(1)).alias("n"))
    return top.crossJoin(F.broadcast(size)).select(  # one row on the right
        "term", "tf", "df", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def ordinal_codes(df: DataFrame, columns: list[str], n_distinct: int | None = None) -> DataFrame:
    """(column, value, code): position of each value in the sorted values of its column."""
    values = value_counts(df, columns).select("column", "value")
    n = values.count() if n_distinct is None else n_distinct
    if n <= CODES_PER_TASK:
        order = Window.partitionBy("column").orderBy("value")
        return values.select("column", "value", (F.row_number().over(order) - 1).alias("code"))
    coded = dense_codes(values, ["column", "value"])
    first = coded.groupBy("column").agg(F.min("code").alias("_first"))
    return coded.join(F.broadcast(first), "column").select(  # one row per column
        "column", "value", (F.col("code") - F.col("_first")).alias("code"))


# -- estimator and model ---------------------------------------------------------------

class _Shared(Params):
    groups = Param(Params._dummy(), "groups", "columns by group as JSON", TypeConverters.toString)
    options = Param(Params._dummy(), "options", "strategies as JSON", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)
    plan = Param(Params._dummy(), "plan", "fitted values as JSON", TypeConverters.toString)


class TableEncoder(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Unfitted encoder; ``groups`` has numeric, onehot, ordinal, datetime and text columns."""

    @keyword_only
    def __init__(self, groups: str = "{}", options: str = "{}", outputCol: str = "features"):
        super().__init__()
        self._setDefault(groups="{}", options="{}", outputCol="features")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "TableEncoderModel":
        cfg = resolve_options(json.loads(self.getOrDefault(self.options)))
        groups = json.loads(self.getOrDefault(self.groups))
        df = nan_to_null(dataset)
        plan = {"numeric": self._fit_numeric(df, groups.get("numeric", []), cfg),
                "interactions": cfg["add_interactions"], "onehot": [], "ordinal": [],
                "datetime": groups.get("datetime", []) if cfg["datetime_features"] else [],
                "text": groups.get("text", []) if cfg["text_strategy"] == "stats" else [], "tfidf": []}
        onehot, ordinal = groups.get("onehot", []), groups.get("ordinal", [])
        if cfg["categorical_imputation"] == "constant":
            fills = dict.fromkeys([*onehot, *ordinal], fixed.MISSING_LABEL)
        else:
            fills = modes(df, [*onehot, *ordinal]) if onehot or ordinal else {}
        if onehot:
            plan["onehot"] = self._fit_onehot(df, onehot, fills, cfg)
        codes = None
        if ordinal:
            filled = self._filled(df, ordinal, fills)
            codes = ordinal_codes(filled, ordinal)
            plan["ordinal"] = [{"column": c, "fill": fills.get(c)} for c in ordinal]
        if cfg["text_strategy"] == "tfidf":
            for c in groups.get("text", []):
                rows = sorted(tfidf_terms(df, c, cfg["tfidf_max_features"]).collect(),
                              key=lambda r: r["term"])
                plan["tfidf"].append({"column": c, "terms": [r["term"] for r in rows],
                                      "idf": [r["idf"] for r in rows]})
        model = TableEncoderModel(plan=json.dumps(plan), outputCol=self.getOrDefault(self.outputCol))
        model.codes = codes
        return model

    @staticmethod
    def _filled(df, columns, fills):
        return df.select([
            F.coalesce(as_text(col(c), dtype_of(df, c)), F.lit(fills.get(c))).alias(c) for c in columns])

    @staticmethod
    def _fit_numeric(df, columns, cfg):
        if not columns:
            return []
        how, scaling = cfg["numeric_imputation"], cfg["scaling"]
        if how == "none" and scaling == "none" and not cfg["add_interactions"]:
            how = "median"
        values = df.select([col(c).cast("double").alias(c) for c in columns])
        first, second = (F.min, F.max) if scaling == "minmax" else (F.avg, F.stddev_pop)
        facts = {r["column"]: r for r in stack_aggregates(values, [
            (c, {"missing": F.count_if(col(c).isNull()), "mean": F.avg(col(c)), "a": first(col(c)),
                 "b": second(col(c))}) for c in columns]).collect()}
        wanted = ([0.5] if how == "median" else []) + ([0.25, 0.5, 0.75] if scaling == "robust" else [])
        points = quantiles(values, columns, wanted) if wanted else dict.fromkeys(columns)
        if how == "median":
            fills = {c: (points[c][0] if points[c] else 0.0) for c in columns}
        elif how == "mean":
            fills = {c: facts[c]["mean"] if facts[c]["mean"] is not None else 0.0 for c in columns}
        else:
            fills = dict.fromkeys(columns, 0.0 if how == "constant" else None)
        # Columns with gaps are measured again as filled; the others are known already.
        gappy = [c for c in columns if facts[c]["missing"] and how != "none" and scaling != "none"]
        if gappy:
            filled = values.select([F.coalesce(col(c), F.lit(fills[c])).alias(c) for c in gappy])
            if scaling == "robust":
                points.update({c: [0.0, *q] for c, q in quantiles(filled, gappy, [0.25, 0.5, 0.75]).items()})
            else:
                facts.update({r["column"]: r for r in stack_aggregates(filled, [
                    (c, {"a": first(col(c)), "b": second(col(c))}) for c in gappy]).collect()})
        centre, scale = dict.fromkeys(columns, 0.0), dict.fromkeys(columns, 1.0)
        for c in columns:
            if scaling == "robust" and points[c]:
                low, middle, high = points[c][-3:]
                centre[c], scale[c] = middle, (high - low) or 1.0
            elif scaling in ("standard", "minmax"):
                start, end = facts[c]["a"] or 0.0, facts[c]["b"] or 0.0
                centre[c], scale[c] = start, (end if scaling == "standard" else end - start) or 1.0
        return [{"column": c, "fill": fills[c], "centre": centre[c], "scale": scale[c]} for c in columns]

    @classmethod
    def _fit_onehot(cls, df, columns, fills, cfg):
        limit = cfg["one_hot_max_categories"]
        counts: dict[str, list] = {c: [] for c in columns}
        found = value_counts(cls._filled(df, columns, fills), columns).limit(MOST_CATEGORIES + 1).collect()
        if len(found) > MOST_CATEGORIES:
            raise ValueError(f"One-hot columns have more than {MOST_CATEGORIES} categories: {columns}.")
        for r in found:
            counts[r["column"]].append((r["value"], r["count"]))
        result = []
        for c in columns:
            by_count = sorted(counts[c], key=lambda p: (-p[1], p[0]))
            if limit and len(by_count) > limit:
                kept, rest = by_count[:limit - 1], by_count[limit - 1:]
            else:
                kept, rest = by_count, []
            result.append({"column": c, "fill": fills.get(c), "categories": sorted(v for v, _ in kept),
                           "infrequent": sorted(v for v, _ in rest)})
        return result


class TableEncoderModel(Model, _Shared, MLReadable, MLWritable):
    """Fitted encoder. ``codes`` is the (column, value, code) table of ordinal columns."""

    codes: DataFrame | None = None

    @keyword_only
    def __init__(self, plan: str = "{}", outputCol: str = "features"):
        super().__init__()
        self._setDefault(plan="{}", outputCol="features")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @property
    def fitted(self) -> dict:
        return json.loads(self.getOrDefault(self.plan))

    def copy(self, extra=None):
        twin = super().copy(extra)
        twin.codes = self.codes
        return twin

    def feature_names(self) -> list[str]:
        p = self.fitted
        numeric = [n["column"] for n in p["numeric"]]
        names = list(numeric)
        if p["interactions"]:
            names += [f"{a} {b}" for a, b in combinations(numeric, 2)]
        for o in p["onehot"]:
            names += [f"{o['column']}_{v}" for v in o["categories"]]
            names += [f"{o['column']}_infrequent"] if o["infrequent"] else []
        names += [o["column"] for o in p["ordinal"]]
        names += [f"{c}__{part}" for c in p["datetime"] for part in fixed.DATE_PARTS]
        names += [f"{c}__{part}" for c in p["text"] for part in fixed.TEXT_PARTS]
        for t in p["tfidf"]:
            names += t["terms"] if len(p["tfidf"]) == 1 else [f"{t['column']}_{x}" for x in t["terms"]]
        return names

    def _joined(self, df: DataFrame, p: dict) -> DataFrame:
        for i, o in enumerate(p["ordinal"]):
            c = o["column"]
            table = self.codes.filter(F.col("column") == c).select(
                F.col("value").alias(f"_v{i}"), F.col("code").alias(f"_code{i}"))
            value = F.coalesce(as_text(col(c), dtype_of(df, c)), F.lit(o["fill"]))
            df = df.join(table, value == F.col(f"_v{i}"), "left").drop(f"_v{i}")
        if p["tfidf"]:
            df = spread(df)
        for i, t in enumerate(p["tfidf"]):
            df = df.withColumn(f"_tokens{i}", tokens(col(t["column"])))
            if t["terms"]:
                counter = CountVectorizerModel.from_vocabulary(
                    t["terms"], inputCol=f"_tokens{i}", outputCol=f"_counts{i}")
                df = counter.transform(df)
        return df

    def _blocks(self, df: DataFrame, p: dict) -> tuple[list[Column], list[Column]]:
        """Single feature columns in order, then arrays (one per tf-idf column)."""
        numeric = {}
        for n in p["numeric"]:
            x = col(n["column"]).cast("double")
            if n["fill"] is not None:
                x = F.coalesce(x, F.lit(float(n["fill"])))
            numeric[n["column"]] = (x - F.lit(float(n["centre"]))) / F.lit(float(n["scale"]))
        single = list(numeric.values())
        if p["interactions"]:
            single += [numeric[a] * numeric[b] for a, b in combinations(numeric, 2)]
        for o in p["onehot"]:
            value = F.coalesce(as_text(col(o["column"]), dtype_of(df, o["column"])), F.lit(o["fill"]))
            single += [F.coalesce((value == v).cast("double"), F.lit(0.0)) for v in o["categories"]]
            if o["infrequent"]:
                single.append(F.coalesce(value.isin(o["infrequent"]).cast("double"), F.lit(0.0)))
        single += [F.coalesce(F.col(f"_code{i}"), F.lit(-1)).cast("double") for i in range(len(p["ordinal"]))]
        for c in p["datetime"]:
            moment = col(c) if is_temporal(dtype_of(df, c)) else to_moment(as_text(col(c), dtype_of(df, c)))
            single += [e for _, e in date_parts(moment)]
        for c in p["text"]:
            single += [e for _, e in text_stats(as_text(col(c), dtype_of(df, c)))]
        arrays = []
        for i, t in enumerate(p["tfidf"]):
            if not t["terms"]:
                continue
            weights = F.array(*[F.lit(float(w)) for w in t["idf"]])
            raw = F.zip_with(vector_to_array(F.col(f"_counts{i}")), weights, lambda x, w: x * w)
            norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + x * x))
            arrays.append(F.when(norm > 0, F.transform(raw, lambda x: x / norm)).otherwise(raw))
        return single, arrays

    def _transform(self, dataset: DataFrame) -> DataFrame:
        p = self.fitted
        df = self._joined(nan_to_null(dataset), p)
        single, arrays = self._blocks(df, p)
        parts = ([F.array(*[F.coalesce(e, F.lit(float("nan"))) for e in single])] if single else []) + arrays
        whole = F.concat(*parts) if len(parts) > 1 else parts[0]
        names = self.feature_names()
        attributes = [{"idx": i, "name": n} for i, n in enumerate(names)]
        metadata = {"ml_attr": {"attrs": {"numeric": attributes}, "num_attrs": len(names)}}
        out = self.getOrDefault(self.outputCol)
        return df.select(*[col(c) for c in dataset.columns],
                         array_to_vector(whole).alias(out, metadata=metadata))

    def encode_columns(self, dataset: DataFrame, keep: list[str]) -> DataFrame:
        """The features as named columns next to ``keep``."""
        p = self.fitted
        df = self._joined(nan_to_null(dataset), p)
        single, arrays = self._blocks(df, p)
        columns = list(single)
        for block, t in zip(arrays, (t for t in p["tfidf"] if t["terms"])):
            columns += [F.element_at(block, i + 1) for i in range(len(t["terms"]))]
        return df.select(*[col(c) for c in keep],
                         *[e.alias(n) for e, n in zip(columns, self.feature_names())])

    def term_weights(self, dataset: DataFrame, key: str, which: int = 0) -> DataFrame:
        """(key, term, weight) of the non-zero tf-idf weights; row-wise, no shuffle."""
        p = self.fitted
        df = self._joined(nan_to_null(dataset), p)
        _, arrays = self._blocks(df, p)
        terms = F.array(*[F.lit(t) for t in p["tfidf"][which]["terms"]])
        return (df.select(col(key), F.explode(F.arrays_zip(terms.alias("term"), arrays[which].alias("weight")))
                          .alias("w")).select(col(key), "w.term", "w.weight").filter("weight <> 0"))

    def write(self):
        return _EncoderWriter(self)

    @classmethod
    def read(cls):
        return _EncoderReader()


class _EncoderWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sc)
        if self.instance.codes is not None:
            self.instance.codes.write.mode("overwrite").parquet(f"{path}/codes")


class _EncoderReader(MLReader):
    def load(self, path: str) -> TableEncoderModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sc)
        model = TableEncoderModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        if model.fitted["ordinal"]:
            model.codes = self.sparkSession.read.parquet(f"{path}/codes")
        return model


def feature_encoder(df: DataFrame, target: str | None = None, facts: list | None = None,
                    **options) -> TableEncoder:
    """An unfitted encoder for the usable columns of ``df``.

    ``facts`` are the collected rows of a profile, one per column; without them the columns
    are looked at once.
    """
    require_columns(df, target=target)
    cfg = resolve_options(options)
    facts = facts if facts is not None else column_facts(df, sniff_dates=False).collect()
    groups, _ = column_groups(facts, target)
    onehot, ordinal = split_by_cardinality(facts, groups["categorical"], cfg)
    chosen = {"numeric": groups["numeric"], "onehot": onehot, "ordinal": ordinal,
              "datetime": groups["datetime"], "text": groups["text"]}
    if not (chosen["numeric"] or onehot or ordinal or (chosen["datetime"] and cfg["datetime_features"])
            or (chosen["text"] and cfg["text_strategy"] != "drop")):
        raise ValueError("No transformer applies to the usable columns.")
    return TableEncoder(groups=json.dumps(chosen), options=json.dumps(options))

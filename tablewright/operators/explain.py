"""Which features a fitted model leans on."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import fixed
from tablewright.functions.order import hash_rank

IMPORTANCES = "feature string, importance double, method string"


def native_importances(model, names: list[str], spark) -> DataFrame | None:
    """Tree importances, or absolute coefficients (mean over the classes); None if neither."""
    core = model.stages[-1] if isinstance(model, PipelineModel) else model
    if hasattr(core, "featureImportances"):
        values, method = core.featureImportances.toArray(), "feature_importances"
    elif getattr(core, "coefficientMatrix", None) is not None:
        values, method = np.abs(core.coefficientMatrix.toArray()).mean(axis=0), "coef_abs"
    elif getattr(core, "coefficients", None) is not None:
        values, method = np.abs(core.coefficients.toArray()), "coef_abs"
    else:
        return None
    if len(values) != len(names):
        return None
    return spark.createDataFrame([(n, round(float(v), 6), method) for n, v in zip(names, values)], IMPORTANCES)


def _score(rows: DataFrame, by: list[str], task_type: str) -> DataFrame:
    if task_type == "classification":
        value = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    else:
        e = F.col("label") - F.col("prediction")
        value = 1.0 - F.try_divide(F.sum(e * e), F.var_pop("label") * F.count("label"))
    return rows.groupBy(*by).agg(value.alias("value"))


def permutation_importance(model, data: DataFrame, names: list[str], task_type: str, n: int | None = None,
                           repeats: int = fixed.PERMUTATION_REPEATS, seed: int = fixed.SEED) -> DataFrame:
    """Mean loss of accuracy (or R^2) when one feature is shuffled over the rows.

    ``data`` is (key, label, features). Two hash orders of the rows are joined on rank, so
    every row gets a random donor; one element of its vector is then the donor's. All
    features of a repeat are scored in one pass.
    """
    n = data.count() if n is None else n
    own = hash_rank(data.withColumn("x", vector_to_array("features")).drop("features"), "key", n, seed)
    base = _score(model.transform(data), [], task_type).withColumnRenamed("value", "base")
    parts = None
    for r in range(repeats):
        donors = hash_rank(own.drop("rank"), "key", n, seed + 1 + r).select(
            "rank", F.col("x").alias("donor"))
        mixed = own.join(donors, "rank").select(
            "key", "label", "x", "donor", F.lit(r).alias("repeat"),
            F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("j"))
        swapped = F.transform(F.col("x"), lambda v, i: F.when(
            i == F.col("j"), F.element_at(F.col("donor"), i + 1)).otherwise(v))
        shuffled = mixed.select(F.xxhash64("key", "j", "repeat").alias("key"), "label", "j", "repeat",
                                array_to_vector(swapped).alias("features"))
        scored = _score(model.transform(shuffled), ["j", "repeat"], task_type)
        parts = scored if parts is None else parts.unionByName(scored)
    label = F.element_at(F.array(*map(F.lit, names)), F.col("j") + 1)
    return parts.crossJoin(F.broadcast(base)).groupBy(label.alias("feature")).agg(  # one row on the right
        F.round(F.avg(F.col("base") - F.col("value")), 6).alias("importance")).withColumn(
        "method", F.lit("permutation_importance"))


def top_features(importances: DataFrame, k: int = fixed.TOP_FEATURES) -> DataFrame:
    return importances.orderBy(F.desc(F.abs("importance")), "feature").limit(k)


def explain(model, data: DataFrame, names: list[str], task_type: str, k: int = fixed.TOP_FEATURES,
            seed: int = fixed.SEED) -> DataFrame:
    """Top features by the model's own importances, else by permutation."""
    found = native_importances(model, names, data.sparkSession)
    if found is None:
        found = permutation_importance(model, data, names, task_type, seed=seed)
    return top_features(found, k)

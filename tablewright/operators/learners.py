"""Base of the models Spark ML lacks: a small fitted state kept as JSON, applied by Arrow UDFs."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LearnerParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    keyCol = Param(Params._dummy(), "keyCol", "unique key column", TypeConverters.toString)
    options = Param(Params._dummy(), "options", "options as JSON", TypeConverters.toString)
    state = Param(Params._dummy(), "state", "fitted state as JSON", TypeConverters.toString)

    def column(self, which: str) -> str:
        return self.getOrDefault(getattr(self, which))

    def option(self, name: str):
        return {**self.DEFAULTS, **json.loads(self.getOrDefault(self.options))}[name]


class Learner(Estimator, LearnerParams, DefaultParamsReadable, DefaultParamsWritable):
    """An estimator with options as JSON."""

    DEFAULTS: dict = {}

    @keyword_only
    def __init__(self, featuresCol: str = "features", labelCol: str = "label", keyCol: str = "",
                 options: str = "{}"):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", keyCol="", options="{}")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @classmethod
    def of(cls, key: str = "", **options):
        unknown = set(options) - set(cls.DEFAULTS)
        if unknown:
            raise ValueError(f"{cls.__name__} has no options {sorted(unknown)}.")
        return cls(keyCol=key, options=json.dumps(options))

    def _model(self, cls, state: dict):
        return cls(featuresCol=self.column("featuresCol"), keyCol=self.column("keyCol"),
                   state=json.dumps(state))


class LearnedModel(Model, LearnerParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, featuresCol: str = "features", keyCol: str = "", state: str = "{}"):
        super().__init__()
        self._setDefault(featuresCol="features", keyCol="", state="{}")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @property
    def fitted(self) -> dict:
        return json.loads(self.getOrDefault(self.state))

    def features(self):
        return vector_to_array(F.col(self.column("featuresCol")))


def moments(df: DataFrame, features: str) -> dict:
    """Count, mean and population deviation of every vector element, in one aggregate."""
    row = df.select(Summarizer.metrics("count", "mean", "variance").summary(F.col(features)).alias("s")).first()["s"]
    n = row["count"]
    factor = (n - 1) / n if n > 1 else 0.0
    return {"n": n, "mean": row["mean"].toArray().tolist(),
            "std": [(v * factor) ** 0.5 for v in row["variance"].toArray()]}

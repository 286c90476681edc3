"""Gaussian naive Bayes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from tablewright.operators.learners import LearnedModel, Learner, moments


class GaussianBayes(Learner):
    """Per class and feature: mean and variance, from one grouped aggregate."""

    DEFAULTS = {"var_smoothing": 1e-9, "n_classes": 2}

    def _fit(self, dataset):
        x, y = self.column("featuresCol"), self.column("labelCol")
        whole = moments(dataset, x)
        floor = self.option("var_smoothing") * max((s * s for s in whole["std"]), default=0.0)
        rows = dataset.groupBy(y).agg(
            Summarizer.metrics("count", "mean", "variance").summary(F.col(x)).alias("s")).collect()
        classes = sorted(rows, key=lambda r: r[y])
        state = {"class": [float(r[y]) for r in classes], "n_classes": self.option("n_classes"),
                 "prior": [r["s"]["count"] / whole["n"] for r in classes],
                 "mean": [r["s"]["mean"].toArray().tolist() for r in classes],
                 "var": [(r["s"]["variance"].toArray() * (r["s"]["count"] - 1) / r["s"]["count"] + floor).tolist()
                         for r in classes]}
        return self._model(GaussianBayesModel, state)


class GaussianBayesModel(LearnedModel):
    def _transform(self, dataset):
        s = self.fitted
        mean, var, prior = np.array(s["mean"]), np.maximum(np.array(s["var"]), 1e-300), np.array(s["prior"])
        at = np.array(s["class"], dtype=int)

        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            rows = np.vstack(x.to_numpy())
            joint = np.stack([np.log(prior[i]) - 0.5 * (np.log(2 * np.pi * var[i]).sum()
                              + ((rows - mean[i]) ** 2 / var[i]).sum(axis=1)) for i in range(len(prior))], axis=1)
            e = np.exp(joint - joint.max(axis=1, keepdims=True))
            p = np.zeros((len(rows), max(s["n_classes"], at.max() + 1)))
            p[:, at] = e / e.sum(axis=1, keepdims=True)
            return pd.Series(list(p))
        scored = dataset.withColumn("_p", run(self.features()))
        return scored.withColumn("probability", array_to_vector("_p")).withColumn(
            "prediction", (F.array_position("_p", F.array_max("_p")) - 1).cast("double")).drop("_p")

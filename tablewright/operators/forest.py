"""Isolation forest: every tree from 256 rows, all trees grown at once, one group per tree. Spark's random forests, in
larger tables some trees at a time."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright.functions import fixed
from tablewright.operators.learners import LearnedModel, Learner

# Hashes are compared in 62 bits, so that a tree's share of any table is a whole number of them.
HASH_RANGE = 1 << 62
# Rows x trees that Spark's forests grow at once (a row keeps 4 bytes a tree for its bag and 8 for its nodes), and trees
# at least, as each set of trees reads the rows anew.
GROWN_CELLS, GROWN_TREES = 100_000_000, 16
# Between the seeds of two sets of trees.
SEED_STEP = 1_000_003
NODE = "tree int, node int, feature int, threshold double, left int, right int, length double"


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """The nodes of one tree from its (at most max_samples) rows."""
    tree = int(pdf["tree"].iloc[0])
    x = np.vstack(pdf.sort_values("h")["x"].to_numpy())
    rng = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes, todo = [], [(0, np.arange(len(x)), 0)]
    count = 1
    while todo:
        node, rows, depth = todo.pop()
        part = x[rows]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 else []
        if depth >= limit or not len(spread):
            nodes.append((tree, node, -1, 0.0, -1, -1, depth + average_path(len(rows))))
            continue
        f = int(rng.choice(spread))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        goes_left = part[:, f] <= cut
        nodes.append((tree, node, f, cut, count, count + 1, 0.0))
        todo += [(count, rows[goes_left], depth + 1), (count + 1, rows[~goes_left], depth + 1)]
        count += 2
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "length"])


class IsolationForest(Learner):
    DEFAULTS = {"n_estimators": 100, "max_samples": 256, "contamination": None, "seed": fixed.SEED}

    def _fit(self, dataset):
        x, key, seed = self.column("featuresCol"), self.column("keyCol"), self.option("seed")
        trees, size = int(self.option("n_estimators")), int(self.option("max_samples"))
        n = dataset.count()
        mixed = F.xxhash64(F.lit(seed), F.col(key) if key else F.col(x).cast("string"))
        # Every tree draws from the whole table: twice the rows it needs by hash, then the first of them.
        share = min(1.0, 2.0 * size / max(n, 1))
        rows = dataset.select(vector_to_array(x).alias("x"), mixed.alias("k"))
        picks = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(
            F.xxhash64(t, F.col("k")), F.lit(HASH_RANGE)) < F.lit(int(share * HASH_RANGE)))
        drawn = rows.select("x", "k", F.explode(picks).alias("tree")).withColumn(
            "h", F.xxhash64("tree", "k"))
        order = Window.partitionBy("tree").orderBy("h")  # the limit is pushed below the shuffle
        chosen = drawn.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= size)
        nodes = chosen.select("tree", "x", "h").groupBy("tree").applyInPandas(
            lambda pdf: _grow(pdf, seed), NODE).orderBy("tree", "node").collect()
        columns = [[r[c] for r in nodes] for c in ("tree", "node", "feature", "threshold", "left", "right", "length")]
        state = {"trees": trees, "nodes": columns, "norm": average_path(min(n, size)), "offset": None}
        model = self._model(IsolationForestModel, state)
        if self.option("contamination"):
            from tablewright.functions.order import quantiles
            scores = model.transform(dataset).select("score")
            state["offset"] = quantiles(scores, ["score"], [1 - self.option("contamination")])["score"][0]
            model = self._model(IsolationForestModel, state)
        return model


class IsolationForestModel(LearnedModel):
    """score in (0, 1), larger = more anomalous; prediction 1 above the offset (or 0.5)."""

    def _transform(self, dataset):
        s = self.fitted
        tree, node, feature, threshold, left, right, length = (np.asarray(c) for c in s["nodes"])
        n_nodes = int(node.max()) + 1 if len(node) else 1
        grid = {}
        for name, values, fill in (("feature", feature, -1), ("threshold", threshold, 0.0), ("left", left, -1),
                                   ("right", right, -1), ("length", length, 0.0)):
            table = np.full((s["trees"], n_nodes), fill, dtype=values.dtype if len(values) else float)
            table[tree, node] = values
            grid[name] = table
        norm = s["norm"] or 1.0

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            rows = np.vstack(x.to_numpy())
            total = np.zeros(len(rows))
            each = np.arange(len(rows))
            for t in range(grid["feature"].shape[0]):
                at = np.zeros(len(rows), dtype=int)
                while True:
                    f = grid["feature"][t, at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    goes_left = rows[each, np.maximum(f, 0)] <= grid["threshold"][t, at]
                    at = np.where(inner, np.where(goes_left, grid["left"][t, at], grid["right"][t, at]), at)
                total += grid["length"][t, at]
            return pd.Series(2.0 ** (-(total / grid["feature"].shape[0]) / norm))

        offset = s["offset"] if s["offset"] is not None else 0.5
        return dataset.withColumn("score", score(self.features())).withColumn(
            "prediction", (F.col("score") > offset).cast("double"))


# -- Spark's random forests --------------------------------------------------------------

class _Grouped:
    """A random forest whose trees grow some at a time: a row keeps its bag and nodes for these trees only.

    Trees are drawn independently, so a forest of sets is the same kind of forest; a single set is Spark's own fit.
    """

    at_once: int | None = None

    def grown(self, n_rows: int) -> _Grouped:
        """For that many rows."""
        self.at_once = max(GROWN_TREES, GROWN_CELLS // max(1, n_rows))
        return self

    def _fit(self, dataset):
        trees = self.getNumTrees()
        if self.at_once is None or self.at_once >= trees:
            return super()._fit(dataset)
        parts = []
        for k, first in enumerate(range(0, trees, self.at_once)):
            part = self.copy({self.numTrees: min(self.at_once, trees - first),
                              self.seed: self.getSeed() + k * SEED_STEP})
            part.at_once = None
            parts.append(part._fit(dataset))  # a model that nobody holds is dropped in the JVM too
        grown = [tree for part in parts for tree in part._java_obj.trees()]
        context = dataset.sparkSession.sparkContext
        joined = context._gateway.new_array(self._class("DecisionTree", context), len(grown))
        for i, tree in enumerate(grown):
            joined[i] = tree
        model = self._copyValues(self._create_model(self._class("RandomForest", context)(
            self.uid, joined, parts[0].numFeatures, *self._outputs(parts[0]))))
        model._transfer_params_to_java()  # a saved forest names its number of trees
        return model

    def _class(self, of: str, context):
        package = getattr(context._jvm.org.apache.spark.ml, self.package)
        return getattr(package, f"{of}{self.kind}Model")


class GroupedForestClassifier(_Grouped, RandomForestClassifier):
    package, kind = "classification", "Classification"

    def _outputs(self, model) -> list:
        return [model.numClasses]


class GroupedForestRegressor(_Grouped, RandomForestRegressor):
    package, kind = "regression", "Regression"

    def _outputs(self, model) -> list:
        return []

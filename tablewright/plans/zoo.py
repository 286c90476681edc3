"""Model catalogue: name -> tier, default parameters, and a factory of Spark estimators.

A new model is one more entry. Parameters carry the usual scikit-learn names, mapped to
what gives the same optimum in Spark where there is one.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression

from tablewright.operators.boosting import HistBoosting
from tablewright.operators.dual import DualSVM, LandmarkMap
from tablewright.operators.forest import GroupedForestClassifier, GroupedForestRegressor, IsolationForest
from tablewright.operators.kernels import GaussianBayes
from tablewright.operators.neighbors import LocalOutlierFactor, Neighbors
from tablewright.operators.net import NetClassifier, NetRegressor

# Deepest trees: Spark's limit for one tree; forests stay lower, as their size grows with it.
TREE_DEPTH, FOREST_DEPTH, MOST_DEPTH = 30, 16, 30


class MissingPackage(ImportError):
    """The model needs a package that is not installed."""


@dataclass(frozen=True)
class Shape:
    """What a factory may need to know of the training rows."""

    n: int
    n_features: int
    n_classes: int = 0
    label_std: float = 1.0
    key: str = "key"
    seed: int = 42


@dataclass(frozen=True)
class Entry:
    build: Callable[[dict, Shape], Estimator]
    family: str
    tier: str = "minimum"
    defaults: dict = field(default_factory=dict)
    space: dict = field(default_factory=dict)
    # most tree nodes by parameters and different rows, for models that may fill the driver
    nodes: Callable[[dict, int], int] | None = None


def _depth(p: dict, default: int) -> int:
    """The asked depth, or the default where none is asked."""
    depth = int(p["max_depth"]) if p.get("max_depth") else default
    if depth > MOST_DEPTH:
        raise ValueError(f"max_depth is {depth}; trees can be {MOST_DEPTH} deep at most.")
    return depth


def _subset(value, default: str) -> str:
    return {"sqrt": "sqrt", "log2": "log2", None: "all"}.get(value, str(value)) if value != "" else default


def logistic(p, s):
    return LogisticRegression(maxIter=int(p.get("max_iter", 1000)), regParam=1.0 / (p.get("C", 1.0) * s.n),
                              standardization=False)


def ridge(alpha: float, s: Shape):
    return LinearRegression(elasticNetParam=0.0, regParam=alpha * s.label_std / s.n, standardization=False)


def elastic_net(p, s):
    alpha, l1 = p.get("alpha", 1.0), p.get("l1_ratio", 0.5)
    # Spark divides the quadratic part by the label deviation.
    strength = alpha * (l1 + s.label_std * (1.0 - l1))
    return LinearRegression(maxIter=1000, regParam=strength, elasticNetParam=alpha * l1 / strength,
                            standardization=False, tol=1e-8)


def _tree(kind):
    return lambda p, s: kind(maxDepth=_depth(p, TREE_DEPTH), maxBins=64, seed=s.seed,
                             minInstancesPerNode=max(1, int(p.get("min_samples_split", 2)) // 2))


def _forest(kind, subset: str):
    # with node ids beside the rows, a level does not send the forest grown so far to every task
    return lambda p, s: kind(numTrees=int(p["n_estimators"]), maxDepth=_depth(p, FOREST_DEPTH), maxBins=64,
                             featureSubsetStrategy=_subset(p.get("max_features", ""), subset), seed=s.seed,
                             cacheNodeIds=True).grown(s.n)


def _forest_nodes(p, different: int) -> int:
    return int(p["n_estimators"]) * 2 * min(different, 1 << _depth(p, FOREST_DEPTH))


def boosted_classifier(p, s):
    return HistBoosting.of(n_classes=s.n_classes, seed=s.seed, **p)


def boosted_regressor(p, s):
    return HistBoosting.of(seed=s.seed, **p)


def _mapped(p, s, *stages):
    first = LandmarkMap.of(gamma=p.get("gamma", "scale"), seed=s.seed)
    return Pipeline(stages=[first, *stages])


def _dual(s, objective: str, **options):
    return DualSVM(featuresCol="mapped", options=json.dumps({"objective": objective, "seed": s.seed, **options}))


def kernel_classifier(p, s):
    """Margins in the landmark space, probabilities by a logistic fit on them."""
    platt = LogisticRegression(featuresCol="margin", predictionCol="likely", rawPredictionCol="likely_raw", maxIter=50)
    return _mapped(p, s, _dual(s, "hinge", C=p.get("C", 1.0), n_classes=s.n_classes), platt)


def kernel_regressor(p, s):
    return _mapped(p, s, _dual(s, "epsilon", C=p.get("C", 1.0), epsilon=p.get("epsilon", 0.1)))


def neighbours(p, s):
    return Neighbors.of(s.key, n_neighbors=int(p.get("n_neighbors", 5)), weights=p.get("weights", "uniform"),
                        n_classes=s.n_classes)


def bayes(p, s):
    return GaussianBayes.of(n_classes=s.n_classes, **p)


def net_classifier(p, s):
    return NetClassifier.of(s.key, n_classes=s.n_classes, seed=s.seed, **p)


def net_regressor(p, s):
    return NetRegressor.of(s.key, seed=s.seed, **p)


def isolation(p, s):
    return IsolationForest.of(s.key, seed=s.seed, **p)


def outlier_factor(p, s):
    return LocalOutlierFactor.of(s.key, **p)


def one_class(p, s):
    return _mapped(p, s, _dual(s, "one_class", nu=float(p.get("nu", 0.5))))


def absent(package: str):
    def build(p, s):
        raise MissingPackage(f"{package} is not installed.", name=package)
    return build


# Names, tiers, defaults and search spaces of the catalogue.
REAL, WHOLE, PICK = "float", "int", "categorical"


def _range(kind, low, high, **more):
    return {"type": kind, "low": low, "high": high, **more}


def _pick(*choices):
    return {"type": PICK, "choices": list(choices)}


C_SPACE = _range(REAL, 0.1, 100.0, log=True)
GAMMA_SPACE = _pick("scale", "auto")
NEAR_SPACE = {"n_neighbors": _range(WHOLE, 3, 30), "weights": _pick("uniform", "distance")}
DEPTH_SPACE = _range(WHOLE, 2, 20)
FOREST_SPACE = {"n_estimators": _range(WHOLE, 100, 500, step=50), "max_depth": _range(WHOLE, 2, 24)}
BOOST_SPACE = {"learning_rate": _range(REAL, 0.01, 0.3, log=True), "max_leaf_nodes": _range(WHOLE, 15, 63)}

CATALOGUE: dict[str, dict[str, Entry]] = {
    "classification": {
        "logistic_regression": Entry(logistic, "linear", defaults={"max_iter": 1000},
                                     space={"C": _range(REAL, 0.01, 100.0, log=True)}),
        "decision_tree": Entry(_tree(DecisionTreeClassifier), "tree",
                               space={"max_depth": DEPTH_SPACE, "min_samples_split": _range(WHOLE, 2, 20)}),
        "random_forest": Entry(_forest(GroupedForestClassifier, "sqrt"), "ensemble", defaults={"n_estimators": 300},
                               space={**FOREST_SPACE, "max_features": _pick("sqrt", "log2", None)}, nodes=_forest_nodes),
        "hist_gradient_boosting": Entry(boosted_classifier, "ensemble", space={
            **BOOST_SPACE, "l2_regularization": _range(REAL, 1e-6, 1.0, log=True)}),
        "svm": Entry(kernel_classifier, "kernel", space={"C": C_SPACE, "gamma": GAMMA_SPACE}),
        "knn": Entry(neighbours, "neighbors", space=NEAR_SPACE),
        "naive_bayes": Entry(bayes, "bayes", space={"var_smoothing": _range(REAL, 1e-12, 1e-6, log=True)}),
        "mlp": Entry(net_classifier, "net", defaults={"max_iter": 500}, space={
            "alpha": _range(REAL, 1e-6, 0.1, log=True), "learning_rate_init": _range(REAL, 1e-4, 0.1, log=True)}),
        "xgboost": Entry(absent("xgboost"), "ensemble", "bonus", {"n_estimators": 400, "tree_method": "hist"}),
        "lightgbm": Entry(absent("lightgbm"), "ensemble", "bonus"),
    },
    "regression": {
        "linear_regression": Entry(lambda p, s: LinearRegression(regParam=0.0), "linear"),
        "elastic_net": Entry(elastic_net, "linear", space={
            "alpha": _range(REAL, 1e-3, 10.0, log=True), "l1_ratio": _range(REAL, 0.0, 1.0)}),
        "decision_tree_regressor": Entry(_tree(DecisionTreeRegressor), "tree", space={"max_depth": DEPTH_SPACE}),
        "random_forest_regressor": Entry(_forest(GroupedForestRegressor, "all"), "ensemble",
                                         defaults={"n_estimators": 300}, space=FOREST_SPACE, nodes=_forest_nodes),
        "hist_gradient_boosting_regressor": Entry(boosted_regressor, "ensemble", space=BOOST_SPACE),
        "svr": Entry(kernel_regressor, "kernel", space={"C": C_SPACE, "gamma": GAMMA_SPACE}),
        "knn_regressor": Entry(neighbours, "neighbors", space=NEAR_SPACE),
        "mlp_regressor": Entry(net_regressor, "net", defaults={"max_iter": 500},
                               space={"alpha": _range(REAL, 1e-6, 0.1, log=True)}),
    },
    "anomaly": {
        "isolation_forest": Entry(isolation, "ensemble", space={
            "n_estimators": _range(WHOLE, 100, 400, step=50), "contamination": _range(REAL, 0.01, 0.3)}),
        "local_outlier_factor": Entry(outlier_factor, "neighbors", space={"n_neighbors": _range(WHOLE, 5, 40)}),
        "one_class_svm": Entry(one_class, "kernel", space={"nu": _range(REAL, 0.01, 0.5), "gamma": GAMMA_SPACE}),
    },
}


def select_models(task_type: str, include: list[str] | None = None, exclude: list[str] | None = None,
                  tiers: tuple[str, ...] = ("minimum",), catalogue: dict | None = None
                  ) -> tuple[dict[str, Entry], list[str]]:
    """Chosen entries and alerts; ``include`` ignores tiers, unknown names give an alert."""
    entries = (catalogue or CATALOGUE).get(task_type, {})
    alerts, barred = [], set(exclude or [])
    if include:
        alerts = [f"Model '{m}' is not in the catalogue of '{task_type}'." for m in include if m not in entries]
        chosen = {m: entries[m] for m in include if m in entries and m not in barred}
    else:
        chosen = {m: e for m, e in entries.items() if e.tier in tiers and m not in barred}
    if not chosen:
        raise ValueError(f"No model is left for '{task_type}'.")
    return chosen, alerts

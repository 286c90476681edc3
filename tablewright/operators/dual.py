"""Support vector machines in a landmark space, solved in the dual with a known gap.

The RBF kernel is mapped by landmarks (Nystroem): rows chosen by hash, their kernel matrix's inverse root. In that
space hinge, epsilon-insensitive and one-class objectives are solved to a known gap. Rows that fit one task are solved
there in one job by dual coordinate steps. More rows stay in packed blocks: the loss is rounded off over a width, Newton
steps on the sums of one pass over the blocks minimise it, and the width shrinks until the gap is small. The slopes of the
rounded loss are dual values, so every pass knows the primal and the dual objective; a fit ends when they are `tol` apart
(relative). A pass sends the driver sums of the size of the weights squared, and passes hardly grow with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import fixed
from tablewright.operators.learners import LearnedModel, Learner, moments

#: Rows that one task solves alone, and that a task has beyond.
ONE_TASK_ROWS = 20_000
#: Tasks whose sums the driver adds up itself; those of more meet in groups first.
DIRECT_TASKS = 32
#: Shrinking of the width over which the loss is rounded off, and lengths tried where a whole Newton step goes too far.
SHRINK, LENGTHS = 3.0, 0.5 ** np.arange(1, 25)


class LandmarkMap(Learner):
    """RBF kernel of width gamma ('scale' = 1 / (d Var X), 'auto' = 1 / d) as coordinates by landmarks."""

    DEFAULTS = {"gamma": "scale", "size": 256, "seed": fixed.SEED, "output": "mapped"}

    def _fit(self, dataset):
        s = moments(dataset, self.column("featuresCol"))
        mean, std = np.array(s["mean"]), np.array(s["std"])
        d, gamma = len(mean), self.option("gamma")
        if gamma == "scale":
            spread = float((std ** 2).mean() + mean.var())  # variance of all matrix entries
            gamma = 1.0 / (d * spread) if spread > 0 else 1.0
        elif gamma == "auto":
            gamma = 1.0 / d
        x = vector_to_array(self.column("featuresCol"))
        hashed = F.xxhash64(x, F.lit(self.option("seed")))
        chosen = dataset.select(x.alias("x"), hashed.alias("h")).groupBy("h").agg(F.first("x").alias("x"))
        marks = np.array([r["x"] for r in chosen.orderBy("h").limit(int(self.option("size"))).collect()])
        values, vectors = np.linalg.eigh(rbf(marks, marks, gamma))
        kept = values > values.max() * 1e-10
        root = vectors[:, kept] / np.sqrt(values[kept])
        return self._model(LandmarkMapModel, {"gamma": gamma, "marks": marks.tolist(), "root": root.tolist(),
                                              "output": self.option("output")})


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.exp(-gamma * np.maximum(square, 0.0))


class LandmarkMapModel(LearnedModel):
    def _transform(self, dataset):
        s = self.fitted
        marks, root = np.array(s["marks"]), np.array(s["root"])

        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            return pd.Series(list(rbf(np.vstack(x.to_numpy()), marks, s["gamma"]) @ root) if len(x) else [], dtype=object)
        return dataset.withColumn(s["output"], array_to_vector(run(self.features())))


# -- objectives --------------------------------------------------------------------------

def coordinate_steps(kind: str, x: np.ndarray, y: np.ndarray, a: np.ndarray, w: np.ndarray, limit: float,
                     epsilon: float, rng) -> tuple[np.ndarray, np.ndarray]:
    """A walk over the rows in random order: new dual values and the change of the weights.

    hinge: 0 <= a <= limit, weights are the sum of a y x. epsilon: -limit <= a <= limit, the sum of a x.
    """
    a, change, square = a.copy(), np.zeros_like(w), (x * x).sum(axis=1)
    for i in rng.permutation(len(x)):
        if not square[i]:
            continue
        at = float(x[i] @ w) + float(x[i] @ change)
        if kind == "hinge":
            new = min(max(a[i] - (y[i] * at - 1.0) / square[i], 0.0), limit)
            step = (new - a[i]) * y[i]
        else:
            up, down = a[i] - (at - y[i] + epsilon) / square[i], a[i] - (at - y[i] - epsilon) / square[i]
            new = min(max(up if up > 0 else down if down < 0 else 0.0, -limit), limit)
            step = new - a[i]
        if step:
            change += step * x[i]
            a[i] = new
    return a, change


def dual_sum(kind: str, y: np.ndarray, a: np.ndarray, epsilon: float) -> float:
    """The dual objective without its quadratic part."""
    return float(a.sum()) if kind == "hinge" else float((y * a).sum() - epsilon * np.abs(a).sum())


def loss_sum(kind: str, x: np.ndarray, y: np.ndarray, w: np.ndarray, epsilon: float) -> float:
    at = x @ w
    return float((np.maximum(1.0 - y * at, 0.0) if kind == "hinge" else np.maximum(np.abs(y - at) - epsilon, 0.0)).sum())


class _OneTask:
    """Rows in arrays."""

    def __init__(self, kind: str, x: np.ndarray, y: np.ndarray, epsilon: float, seed: int) -> None:
        self.kind, self.x, self.y, self.epsilon = kind, x, y, epsilon
        self.a, self.rng, self.n, self.width = np.zeros(len(x)), np.random.default_rng(seed), len(x), x.shape[1]

    def rescale(self, factor: float) -> None:
        self.a = self.a * factor

    def round(self, w: np.ndarray, limit: float) -> tuple[np.ndarray, float, float]:
        """New weights, dual sum, sum of the dual values."""
        self.a, change = coordinate_steps(self.kind, self.x, self.y, self.a, w, limit, self.epsilon, self.rng)
        return w + change, dual_sum(self.kind, self.y, self.a, self.epsilon), float(self.a.sum())

    def loss(self, w: np.ndarray) -> float:
        return loss_sum(self.kind, self.x, self.y, w, self.epsilon)


def excess(kind: str, x: np.ndarray, y: np.ndarray, w: np.ndarray, rho: float, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """What every row loses before it is cut off at 0, and the sign with which the row pulls the weights."""
    at = x @ w
    if kind == "epsilon":
        return np.abs(y - at) - epsilon, np.sign(y - at)
    return (1.0 - y * at, y) if kind == "hinge" else (rho - at, np.ones(len(x)))


def rounded_loss(lost: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """The loss, quadratic up to `width`, and its slopes from 0 to 1."""
    lost = np.maximum(lost, 0.0)
    slope = np.minimum(lost / width, 1.0)
    return lost * slope - 0.5 * width * slope * slope, slope


class _ManyTasks:
    """Rows in partitions, packed into blocks of numbers. kind: hinge, epsilon or one_class."""

    def __init__(self, kind: str, rows: DataFrame, n: int, width: int, tasks: int, epsilon: float) -> None:
        self.kind, self.n, self.width, self.tasks, self.epsilon = kind, n, width, tasks, epsilon

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pd.DataFrame({"x": [np.vstack(pdf["x"].to_numpy()).astype(float).tobytes()],
                                        "y": [pdf["y"].to_numpy(dtype=float).tobytes()]})
        self.blocks = rows.repartition(tasks).mapInPandas(pack, "x binary, y binary").persist(StorageLevel.MEMORY_AND_DISK)

    def release(self) -> None:
        self.blocks.unpersist()

    def sums(self, of) -> np.ndarray:
        """The sum of of(x, y) over the blocks."""
        width = self.width

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = None
            for pdf in batches:
                for x, y in zip(pdf["x"], pdf["y"]):
                    part = of(np.frombuffer(x).reshape(-1, width), np.frombuffer(y))
                    out = part if out is None else out + part
            if out is not None:
                yield pd.DataFrame({"sums": [out.tobytes()]})

        def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = [np.frombuffer(part) for pdf in batches for part in pdf["sums"]]
            if parts:
                yield pd.DataFrame({"sums": [np.sum(parts, axis=0).tobytes()]})

        found = self.blocks.mapInPandas(run, "sums binary")
        if self.tasks > DIRECT_TASKS:
            found = found.repartition(math.ceil(math.sqrt(self.tasks))).mapInPandas(meet, "sums binary")
        return np.sum([np.frombuffer(r["sums"]) for r in found.collect()], axis=0)

    def middle(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean row, and the means of y and y squared."""
        found = self.sums(lambda x, y: np.concatenate([x.sum(axis=0), [y.sum(), (y * y).sum()]])) / self.n
        return found[:-2], found[-2:]

    def at(self, w: np.ndarray, rho: float, width: float) -> dict:
        """Sums at these weights: loss, rounded loss, dual values (slopes) and what the dual objective takes of them, the
        pull on the weights, and the curvature of (w, rho)."""
        kind, epsilon, d = self.kind, self.epsilon, self.width

        def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            lost, sign = excess(kind, x, y, w, rho, epsilon)
            soft, slope = rounded_loss(lost, width)
            pull = slope * sign
            dual = (y * pull - epsilon * slope).sum() if kind == "epsilon" else slope.sum()
            bent = x[(slope > 0) & (slope < 1)]
            bent = np.column_stack([bent, np.full(len(bent), -1.0)])
            return np.concatenate([[np.maximum(lost, 0.0).sum(), soft.sum(), slope.sum(), dual], pull @ x,
                                   (bent.T @ bent / width).ravel()])
        found = self.sums(of)
        return {"loss": found[0], "soft": found[1], "held": found[2], "dual": found[3], "pull": found[4:4 + d],
                "bent": found[4 + d:].reshape(d + 1, d + 1)}

    def along(self, w: np.ndarray, rho: float, step: np.ndarray, rho_step: float, width: float) -> np.ndarray:
        """Rounded losses at parts of a step, by LENGTHS."""
        kind, epsilon = self.kind, self.epsilon
        return self.sums(lambda x, y: np.array([
            rounded_loss(excess(kind, x, y, w + t * step, rho + t * rho_step, epsilon)[0], width)[0].sum() for t in LENGTHS]))


def solve_many(rows: _ManyTasks, limit: float, tol: float, rounds: int) -> dict:
    """What `solve` and, for kind one_class with limit 1 / (nu n), `solve_one_class` return, by at most `rounds` passes.

    One-class: rho is minimised over beside w. Divided by rho it is the hinge problem whose gap is given.
    """
    d, one_class = rows.width, rows.kind == "one_class"
    mean, (y_mean, y_square) = rows.middle()
    w, rho = (mean, float(mean @ mean)) if one_class else (np.zeros(d), 0.0)
    width = max(rho, 1e-6) if one_class else 1.0 if rows.kind == "hinge" else max(math.sqrt(y_square), 1e-6)
    best, step, before = None, None, None
    for _ in range(rounds):
        s = rows.at(w, rho, width)
        value = 0.5 * float(w @ w) - rho + limit * s["soft"]
        if step is not None and value > before + 1e-4 * slope + 1e-12 * abs(before):
            losses = rows.along(w - step[:d], rho - step[d], step[:d], step[d], width)
            old, old_rho = w - step[:d], rho - step[d]
            values = [0.5 * float(v @ v) - old_rho - t * step[d] + limit * q
                      for t, q in zip(LENGTHS, losses) for v in [old + t * step[:d]]]
            if min(values) < before:
                t = LENGTHS[int(np.argmin(values))]
                w, rho = old + t * step[:d], old_rho + t * step[d]
            else:  # as low as numbers go
                w, rho = old, old_rho
                width /= SHRINK
            step = None
            continue
        pulled = limit * s["pull"]
        scale = rho if one_class else 1.0
        if scale > 0:
            primal = (0.5 * float(w @ w) + limit * s["loss"]) / scale ** 2
            dual = limit * s["dual"] / scale - 0.5 * float(pulled @ pulled) / scale ** 2
            off = abs(limit * s["held"] - 1.0) if one_class else 0.0
            gap = (primal - dual) / max(abs(primal), 1e-12)
            found = {"w": w, "rho": rho, "primal": primal, "gap": gap, "held": limit * s["held"]}
            if best is None or max(gap, off) <= best[0]:
                best = max(gap, off), found
            if max(gap, off) <= tol:
                break
        lack = np.concatenate([w - pulled, [limit * s["held"] - 1.0 if one_class else 0.0]])
        curve = limit * s["bent"] + np.diag(np.concatenate([np.ones(d), [0.0]]))
        if one_class:
            curve[d, d] += 1e-2 * limit * rows.n / width
        else:
            curve[d], curve[:, d], curve[d, d] = 0.0, 0.0, 1.0
        step = -np.linalg.solve(curve, lack)
        slope = float(lack @ step)
        if -slope <= 1e-2 * tol * max(abs(value), 1e-12) and abs(lack[d]) <= tol:  # this width is done
            width, step = width / SHRINK, None
            continue
        before, w, rho = value, w + step[:d], rho + step[d]
    if best is None:
        raise ValueError("The one-class fit found no boundary that parts the rows from the origin.")
    return best[1]


def solve(rows, limit: float, w: np.ndarray | None = None, tol: float = 1e-3, rounds: int = 1_000) -> dict:
    """Weights with a relative duality gap of at most tol (or what `rounds` reach): w, primal, gap, held (sum of the
    dual values)."""
    w = np.zeros(rows.width) if w is None else w
    best = None
    for _ in range(rounds):
        w, dual, held = rows.round(w, limit)
        norm = 0.5 * float(w @ w)
        primal = norm + limit * rows.loss(w)
        gap = (primal - (dual - norm)) / max(abs(primal), 1e-12)
        best = {"w": w, "primal": primal, "gap": gap, "held": held}
        if gap <= tol:
            break
    return best


def solve_one_class(rows, nu: float, tol: float = 1e-3, rounds: int = 1_000) -> dict:
    """1/2 |w|^2 - rho + sum(max(0, rho - w x)) / (nu n): w, rho, and the gap and primal value of the last fit.

    Divided by rho this is a hinge problem with limit 1 / (rho nu n), where the dual values fill the share nu of
    their limits; the share falls with the limit, which is found by bisection from the last solution.
    """
    limit, low, high, w = 1.0 / (nu * rows.n), None, None, None
    for _ in range(60):
        found = solve(rows, limit, w, tol, rounds)
        share = found["held"] / (limit * rows.n)
        if abs(share - nu) <= tol * nu:
            break
        low, high = (limit, high) if share > nu else (low, limit)
        new = limit * 4.0 if high is None else limit / 4.0 if low is None else math.sqrt(low * high)
        rows.rescale(new / limit)
        w, limit = found["w"] * (new / limit), new
    rho = 1.0 / (limit * nu * rows.n)
    return {"w": found["w"] * rho, "rho": rho, "gap": found["gap"], "primal": found["primal"]}


def _fit_dual(rows: DataFrame, kind: str, option, one_class: bool) -> dict:
    """rows: x (array), y. The fit in one task or in many."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    n, width = size["n"], size["d"]
    if not n:
        raise ValueError("There are no rows to fit.")
    tol, rounds, epsilon, seed = float(option("tol")), int(option("rounds")), float(option("epsilon")), int(option("seed"))
    limit, nu = float(option("C")), float(option("nu"))
    if limit <= 0 or not 0 < nu <= 1:
        raise ValueError("C must be above 0, nu between 0 and 1.")
    tasks = max(1, math.ceil(n / int(option("one_task_rows"))))

    def run(held) -> dict:
        return solve_one_class(held, nu, tol, rounds) if one_class else solve(held, limit, None, tol, rounds)

    if tasks > 1:
        many = _ManyTasks("one_class" if one_class else kind, rows, n, width, tasks, epsilon)
        found = solve_many(many, 1.0 / (nu * n) if one_class else limit, tol, rounds)
        many.release()
        return {"w": found["w"].tolist(), "rho": float(found["rho"]), "gap": float(found["gap"]), "primal": float(found["primal"])}

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([p for p in batches if len(p)])
        found = run(_OneTask(kind, np.vstack(pdf["x"].to_numpy()), pdf["y"].to_numpy(dtype=float), epsilon, seed))
        yield pd.DataFrame({"w": [found["w"]], "rho": [found.get("rho", 0.0)], "gap": [found["gap"]], "primal": [found["primal"]]})

    row = rows.coalesce(1).mapInPandas(alone, "w array<double>, rho double, gap double, primal double").collect()[0]
    return {"w": row["w"], "rho": row["rho"], "gap": row["gap"], "primal": row["primal"]}


class DualSVM(Learner):
    """SVM on mapped features; objective: hinge (a margin for each class against the rest), epsilon or one_class.

    hinge and epsilon have a constant feature as (regularised) intercept. gap is the relative duality gap reached.
    """

    DEFAULTS = {"objective": "hinge", "C": 1.0, "epsilon": 0.1, "nu": 0.5, "tol": 1e-3, "rounds": 1_000,
                "n_classes": 2, "one_task_rows": ONE_TASK_ROWS, "seed": fixed.SEED}

    def _fit(self, dataset):
        objective = self.option("objective")
        x = vector_to_array(self.column("featuresCol"))
        if objective == "one_class":
            fits = [_fit_dual(dataset.select(x.alias("x"), F.lit(1.0).alias("y")), "hinge", self.option, True)]
            return self._model(DualSVMModel, {"objective": objective, "fits": fits})
        label = F.col(self.column("labelCol")).cast("double")
        rows = dataset.select(F.concat(x, F.array(F.lit(1.0))).alias("x"), label.alias("y")).filter(F.col("y").isNotNull())
        if objective == "epsilon":
            return self._model(DualSVMModel, {"objective": objective, "fits": [_fit_dual(rows, "epsilon", self.option, False)]})
        classes = int(self.option("n_classes"))
        kept = rows.persist(StorageLevel.MEMORY_AND_DISK)
        fits = [_fit_dual(kept.withColumn("y", F.when(F.col("y") == c, 1.0).otherwise(-1.0)), "hinge", self.option, False)
                for c in (range(classes) if classes > 2 else (1,))]
        kept.unpersist()
        return self._model(DualSVMModel, {"objective": objective, "fits": fits})


class DualSVMModel(LearnedModel):
    """hinge: `margin` (a value for each class) and prediction; epsilon: prediction; one_class: score (distance below the
    boundary, larger = more anomalous) and prediction."""

    def _values(self, intercept: bool):
        w = np.array([f["w"] for f in self.fitted["fits"]])

        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            rows = np.vstack(x.to_numpy())
            return pd.Series(list(rows @ w[:, :-1].T + w[:, -1] if intercept else rows @ w.T), dtype=object)
        return run(self.features())

    def _transform(self, dataset):
        s = self.fitted
        valued = dataset.withColumn("_v", self._values(s["objective"] != "one_class"))
        first = F.get("_v", F.lit(0))
        if s["objective"] == "epsilon":
            return valued.withColumn("prediction", first).drop("_v")
        if s["objective"] == "one_class":
            return valued.withColumn("score", F.lit(s["fits"][0]["rho"]) - first).withColumn(
                "prediction", (F.col("score") > 0).cast("double")).drop("_v")
        margins = F.col("_v") if len(s["fits"]) > 1 else F.array(-first, first)
        valued = valued.withColumn("_v", margins)
        return valued.withColumn("margin", array_to_vector("_v")).withColumn(
            "prediction", (F.array_position("_v", F.array_max("_v")) - 1).cast("double")).drop("_v")

"""Dense nets trained by mini-batch Adam.

Rows are dealt into small groups by their key, and every epoch deals the groups anew into mini-batches. A step adds up
the gradient over all rows of its batch and changes the weights once. Rows that fit one task are trained there in one
job. Beyond, rows are dealt by their key into as many shards as there are tasks. An epoch is one job: each shard walks over
its own mini-batches (of up to SHARD_BATCH rows in larger tables) from the common weights, and the weights and moments
reached are averaged by rows (local steps between two averages). So jobs grow with epochs and not with rows, and a net
depends on the number of rows, never on partitions. Shards hold their rows and make their gradients in single precision,
weights and moments stay in double.

With `tasks` given, steps are synchronous over that many tasks instead: a step is one job that reads its groups only and
returns sums of the size of the weights; the net is then that of one task. (A barrier stage would do the same without
jobs, but Spark looks for its gathered messages once a second, ten times the time of such a job.)
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import fixed
from tablewright.operators.learners import LearnedModel, Learner, moments

# Rows of a task or shard; a table of no more is trained in one.
ROWS_PER_TASK = 20_000
# Sums of this many tasks at most reach the driver in one step; those of more are added up in as many slots first.
SLOTS = 32
# Steps of an epoch at most; the batches of larger tables hold more rows than asked.
MOST_STEPS = 1_000
# Rows that a shard's mini-batch may have if fewer are asked and the table is larger than MOST_STEPS such batches.
SHARD_BATCH = 256
# Groups of a batch.
GROUPS = 4
# Stands for the epoch where noise is drawn for tests.
TEST_NOISE = 1 << 31
# Epochs without an improvement by tol after which training ends.
PATIENCE = 10

AUTOENCODER = {  # Fixed values: the default net of the latent step.
    "hidden_dims": [64, 32], "latent_dim": 8, "epochs": 30, "batch_size": 64,
    "learning_rate": 1e-3, "noise_std": 0.1,
}


class Net:
    """Layer sizes and one flat weight vector; ReLU between layers, none in ``linear_after``."""

    def __init__(self, sizes: list[int], loss: str, linear_after: int | None = None, flat=None, seed: int = 0):
        self.sizes, self.loss, self.linear_after = sizes, loss, linear_after
        self.shapes = list(zip(sizes[:-1], sizes[1:]))
        if flat is None:
            rng = np.random.default_rng(seed)
            parts = []
            for a, b in self.shapes:
                reach = math.sqrt(6.0 / (a + b))
                parts += [rng.uniform(-reach, reach, a * b), np.zeros(b)]
            flat = np.concatenate(parts)
        self.flat = np.asarray(flat, dtype=np.float64)

    def layers(self, flat):
        out, at = [], 0
        for a, b in self.shapes:
            out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
            at += a * b + b
        return out

    def _active(self, i: int) -> bool:
        return i < len(self.shapes) - 1 and i != self.linear_after

    def forward(self, x, flat=None, until: int | None = None):
        """Activations of every layer, input first."""
        acts = [x]
        for i, (w, b) in enumerate(self.layers(self.flat if flat is None else flat)):
            z = acts[-1] @ w + b
            acts.append(np.maximum(z, 0.0) if self._active(i) else z)
            if until is not None and i == until:
                break
        return acts

    def gradient(self, flat, x, y):
        """Loss and gradient summed over the rows (the mean over the outputs for squared errors)."""
        acts = self.forward(x, flat)
        out = acts[-1]
        if self.loss == "softmax":
            e = np.exp(out - out.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            loss = -np.log(np.maximum(p[y.astype(bool)], max(1e-300, np.finfo(p.dtype).tiny))).sum(dtype=float)
            delta = p - y
        else:
            diff = out - y
            loss = float((diff ** 2).sum(dtype=float)) / diff.shape[1]
            delta = 2.0 * diff / diff.shape[1]
        grads = []
        layers = self.layers(flat)
        for i in range(len(layers) - 1, -1, -1):
            w, _ = layers[i]
            grads.append((acts[i].T @ delta, delta.sum(axis=0)))
            if i:
                delta = delta @ w.T
                if self._active(i - 1):
                    delta = delta * (acts[i] > 0)
        return loss, np.concatenate([part.ravel() for g in reversed(grads) for part in g])

    def is_weight(self):
        """True for the weights, False for the biases, in the order of the flat vector."""
        return np.concatenate([np.repeat([True, False], [a * b, b]) for a, b in self.shapes])


def batch_count(n: int, batch_size: int) -> int:
    """Mini-batches of an epoch over n rows."""
    return max(1, round(n / max(batch_size, math.ceil(n / MOST_STEPS), 1)))


def batches_of(batches: int, seed: int, epoch: int) -> np.ndarray:
    """(batch, its groups) of an epoch."""
    return np.random.default_rng([seed, epoch]).permutation(batches * GROUPS).reshape(batches, GROUPS)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits well mixed (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _noise(keys: np.ndarray, seed: int, epoch: int, width: int, scale: float) -> np.ndarray:
    """Noise of each row by its key, so that it does not depend on where the row is."""
    return np.vstack([np.random.default_rng([seed, epoch, int(k)]).normal(scale=scale, size=width)
                      for k in keys.astype(np.int64).view(np.uint64)])


def _hashed_noise(keys: np.ndarray, seed: int, epoch: int, width: int, scale: float) -> np.ndarray:
    """The same for all rows at once, as a generator for each row takes longer than the step itself: hashes of key and
    column as uniform numbers, two of them for two normal ones (Box-Muller)."""
    start = np.random.default_rng([seed, epoch]).integers(1 << 64, size=2 * ((width + 1) // 2), dtype=np.uint64)
    u = (_mixed(_mixed(keys.astype(np.int64).view(np.uint64))[:, None] + start) >> np.uint64(11)) * 2.0 ** -53
    radius, turn = np.sqrt(-2.0 * np.log(1.0 - u[:, ::2])), 2.0 * np.pi * u[:, 1::2]
    return scale * np.hstack((radius * np.cos(turn), radius * np.sin(turn)))[:, :width]


def batch_sums(net: Net, w: np.ndarray, keys: np.ndarray, x: np.ndarray, y: np.ndarray, cfg: dict, seed: int,
               epoch: int, noise=_noise) -> np.ndarray:
    """Rows, loss and gradient of some rows, added up."""
    if not len(x):
        return np.zeros(len(w) + 2)
    inp = x + noise(keys, seed, epoch, x.shape[1], cfg["noise_std"]).astype(x.dtype) if cfg["noise_std"] else x
    loss, gradient = net.gradient(w.astype(x.dtype), inp, y)
    return np.concatenate(([len(x), loss], gradient))


class Steps:
    """Weights and moments of Adam, changed by one mini-batch after the other."""

    def __init__(self, net: Net, batches: int, cfg: dict, seed: int) -> None:
        self.batches, self.cfg, self.seed, self.penalty = batches, cfg, seed, net.is_weight() * cfg["alpha"]
        self.w, self.m, self.v, self.t = net.flat.copy(), np.zeros_like(net.flat), np.zeros_like(net.flat), 0

    def epoch(self, epoch: int, sums_of) -> tuple[float, float]:
        """Rows seen and their loss. sums_of(weights, epoch, groups) adds up the rows of the groups."""
        total, seen = 0.0, 0.0
        for groups in batches_of(self.batches, self.seed, epoch):
            sums = sums_of(self.w, epoch, groups)
            if not sums[0]:
                continue
            g = (sums[2:] + self.penalty * self.w) / sums[0]
            self.t += 1
            self.m = 0.9 * self.m + 0.1 * g
            self.v = 0.999 * self.v + 0.001 * g * g
            self.w = self.w - self.cfg["learning_rate"] * (self.m / (1 - 0.9 ** self.t)) / (
                np.sqrt(self.v / (1 - 0.999 ** self.t)) + 1e-8)
            seen, total = seen + sums[0], total + sums[1]
        return seen, total


def adam(steps: Steps, cfg: dict, walk) -> tuple[np.ndarray, float]:
    """Weights and the last epoch's loss. walk(epoch) makes the steps of an epoch: rows seen and their loss.

    cfg: epochs, batch_size, learning_rate, alpha, noise_std, tol (None: no early end).
    """
    best, stale, loss = math.inf, 0, math.nan
    for epoch in range(int(cfg["epochs"])):
        seen, total = walk(epoch)
        loss = total / seen
        if cfg.get("tol") is not None:
            stale = 0 if loss < best - cfg["tol"] else stale + 1
            best = min(best, loss)
            if stale >= PATIENCE:
                break
    return steps.w, loss


def train(rows: DataFrame, n: int, net: Net, cfg: dict, seed: int, target: str,
          tasks: int | None = None) -> tuple[Net, float]:
    """``rows``: key (64-bit, equal keys share a batch), x (array of double) and, unless the input is the target, y.

    ``cfg``: that of adam, mean and std; rows are standardised inside the tasks. ``tasks``: partitions to train in by
    synchronous steps, else a shard for each ROWS_PER_TASK rows.
    """
    shards = max(1, math.ceil(n / ROWS_PER_TASK)) if tasks is None else 1
    size = int(cfg["batch_size"])
    if shards > 1:
        size = max(size, min(SHARD_BATCH, math.ceil(n / MOST_STEPS)))
    batches = batch_count(math.ceil(n / shards), size)
    groups = batches * GROUPS
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(groups)).cast("int"))
    mean, std = np.asarray(cfg["mean"]), np.asarray(cfg["std"])
    sizes, kind, linear_after, flat = net.sizes, net.loss, net.linear_after, net.flat
    small = {k: v for k, v in cfg.items() if k not in ("mean", "std")}

    def arrays(held: list[pd.DataFrame]):
        keys = np.concatenate([np.zeros(0, np.int64), *[p["key"].to_numpy(dtype=np.int64) for p in held]])
        x = (np.vstack([np.zeros((0, sizes[0])), *[np.vstack(p["x"].to_numpy()) for p in held]]) - mean) / std
        if target == "input":
            return keys, x, x
        y = np.concatenate([np.zeros(0), *[p["y"].to_numpy(dtype=float) for p in held]])
        return keys, x, np.eye(sizes[-1])[y.astype(int)] if target == "class" else y.reshape(-1, 1)

    def sorted_arrays(batches):
        held = [pdf for pdf in batches if len(pdf)]
        keys, x, y = arrays(held)
        grp = np.concatenate([np.zeros(0, np.int64), *[p["grp"].to_numpy() for p in held]])
        order = np.lexsort((keys, grp))  # sums do not depend on the order in which rows arrive
        return keys[order], x[order], y[order], np.searchsorted(grp[order], np.arange(groups + 1))

    def walker(steps, worker, keys, x, y, cuts):
        def walk(epoch):
            drawn = None  # the noise of all rows of a shard
            if shards > 1 and small["noise_std"]:
                drawn = _hashed_noise(keys, seed, epoch, x.shape[1], small["noise_std"])

            def sums_of(w, epoch, some):
                at = np.concatenate([np.arange(cuts[g], cuts[g + 1]) for g in some])
                return batch_sums(worker, w, keys[at], x[at], y[at], small, seed, epoch,
                                  _noise if drawn is None else lambda *_: drawn[at])
            return steps.epoch(epoch, sums_of)
        return walk

    def alone(parts):
        worker = Net(sizes, kind, linear_after, flat)
        steps = Steps(worker, batches, small, seed)
        w, loss = adam(steps, small, walker(steps, worker, *sorted_arrays(parts)))
        yield pd.DataFrame({"loss": [loss], "flat": [w]})

    if (tasks or shards) == 1:
        found = rows.coalesce(1).mapInPandas(alone, "loss double, flat array<double>").collect()[0]
        return Net(sizes, kind, linear_after, found["flat"]), float(found["loss"])

    steps = Steps(net, batches, small, seed)
    if tasks:
        # Sorted by group, so that a step reads the cached blocks of its groups only.
        kept = rows.repartition(tasks, "key").sortWithinPartitions("grp", "key").persist(StorageLevel.MEMORY_AND_DISK)
    else:
        def packed(parts):
            keys, x, y, cuts = sorted_arrays(parts)
            held = (keys, x.astype(np.float32), y[:0] if target == "input" else y.astype(np.float32), cuts)
            yield pd.DataFrame([[a.tobytes() for a in held]], columns=["keys", "x", "y", "cuts"])

        # A row for each shard, which an epoch reads without looking at single values.
        kept = rows.repartition(shards, "key").mapInPandas(packed, "keys binary, x binary, y binary, cuts binary").persist(
            StorageLevel.MEMORY_AND_DISK)

    def gathered(sums: DataFrame, many: int) -> np.ndarray:
        """Sums of the tasks' rows (slot, sums); beyond SLOTS tasks they meet in as many slots first."""
        if many > SLOTS:
            sums = sums.groupBy("slot").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
        return np.sum([r["sums"] for r in sorted(sums.collect())], axis=0)  # in the order of the slots

    def together(epoch):
        def sums_of(w, epoch, some):
            def run(parts):
                from pyspark import TaskContext
                worker, total = Net(sizes, kind, linear_after, flat), np.zeros(len(w) + 2)
                for pdf in parts:
                    if len(pdf):
                        total += batch_sums(worker, w, *arrays([pdf]), small, seed, epoch)
                yield pd.DataFrame({"slot": [TaskContext.get().partitionId() % SLOTS], "sums": [total]})
            return gathered(kept.filter(F.col("grp").isin([int(g) for g in some])).mapInPandas(
                run, "slot int, sums array<double>"), tasks)
        return steps.epoch(epoch, sums_of)

    def apart(epoch):
        state, width = (steps.w, steps.m, steps.v, steps.t), sizes[0]

        def run(parts):
            from pyspark import TaskContext
            worker, total = Net(sizes, kind, linear_after, flat), np.zeros(3 + 3 * len(state[0]))
            for pdf in parts:
                for r in pdf.itertuples():
                    keys, x, y, cuts = (np.frombuffer(v, t) for v, t in ((r.keys, np.int64), (r.x, np.float32),
                                                                         (r.y, np.float32), (r.cuts, np.int64)))
                    if not len(keys):
                        continue
                    own = Steps(worker, batches, small, seed)
                    own.w, own.m, own.v, own.t = state
                    x = x.reshape(-1, width)
                    seen, loss = walker(own, worker, keys, x, x if target == "input" else y.reshape(len(keys), -1),
                                        cuts)(epoch)
                    total += np.concatenate(([seen, loss, seen * own.t], seen * own.w, seen * own.m, seen * own.v))
            yield pd.DataFrame({"slot": [TaskContext.get().partitionId() % SLOTS], "sums": [total]})

        sums = gathered(kept.mapInPandas(run, "slot int, sums array<double>"), shards)
        seen, loss = sums[0], sums[1]
        steps.t, (steps.w, steps.m, steps.v) = sums[2] / seen, np.split(sums[3:] / seen, 3)
        return seen, loss

    try:
        w, loss = adam(steps, small, together if tasks else apart)
    finally:
        kept.unpersist()
    return Net(sizes, kind, linear_after, w), float(loss)


def _row_key(learner: Learner, features: str, label: str | None = None):
    """64 bits of the row's key, or of its values where no key is known: equal rows then share a batch."""
    key = learner.column("keyCol")
    values = [F.col(key)] if key else [vector_to_array(features), *([F.col(label)] if label else [])]
    return F.xxhash64(*values).alias("key")


def _as_state(net: Net, scale: dict, **more) -> dict:
    return {"sizes": net.sizes, "loss": net.loss, "linear_after": net.linear_after,
            "flat": net.flat.tolist(), "mean": scale["mean"], "std": scale["std"], **more}


def _safe(scale: dict) -> dict:
    return {**scale, "std": [s or 1.0 for s in scale["std"]]}


class _NetModel(LearnedModel):
    def net_and_scale(self):
        s = self.fitted
        return (Net(s["sizes"], s["loss"], s["linear_after"], s["flat"]), np.asarray(s["mean"]), np.asarray(s["std"]))

    def apply(self, f, kind: str = "array<double>"):
        """An Arrow UDF of the standardised rows of a batch."""
        net, mean, std = self.net_and_scale()

        @F.pandas_udf(kind)
        def run(x: pd.Series) -> pd.Series:
            out = f(net, (np.vstack(x.to_numpy()) - mean) / std) if len(x) else []
            return pd.Series(list(out))
        return run(self.features())


class Autoencoder(Learner):
    """Dense autoencoder on the standardised features."""

    DEFAULTS = {**AUTOENCODER, "denoising": False, "seed": fixed.SEED}

    def _fit(self, dataset):
        x = self.column("featuresCol")
        scale = _safe(moments(dataset, x))
        d = len(scale["mean"])
        hidden = [int(h) for h in self.option("hidden_dims") if h > 0] or [32]
        sizes = [d, *hidden, int(self.option("latent_dim")), *reversed(hidden), d]
        cfg = {"epochs": self.option("epochs"), "batch_size": self.option("batch_size"),
               "learning_rate": self.option("learning_rate"), "alpha": 0.0,
               "noise_std": self.option("noise_std") if self.option("denoising") else 0.0,
               "mean": scale["mean"], "std": scale["std"]}
        seed = self.option("seed")
        rows = dataset.select(_row_key(self, x), vector_to_array(x).alias("x"))
        net, loss = train(rows, scale["n"], Net(sizes, "mse", len(hidden), seed=seed), cfg, seed, "input")
        return self._model(AutoencoderModel, _as_state(net, scale, latent=len(hidden), train_loss=loss, rows=scale["n"]))


class AutoencoderModel(_NetModel):
    def latent(self):
        at = self.fitted["latent"]
        return self.apply(lambda net, x: net.forward(x, until=at)[-1])

    def reconstruction_error(self):
        return self.apply(lambda net, x: ((net.forward(x)[-1] - x) ** 2).mean(axis=1), "double")

    def _transform(self, dataset):
        """Adds the latent vector and the error of each row (larger = more anomalous)."""
        return (dataset.withColumn("latent", array_to_vector(self.latent()))
                .withColumn("score", self.reconstruction_error()))

    def denoise(self, dataset, noise_std: float, seed: int):
        """Squared errors per row: reconstruction of noisy input, mean predictor, noisy input."""
        at = self.features()
        net, mean, std = self.net_and_scale()
        # Noise is drawn by key, so a retried task draws the same; a model of more than one task's rows draws by hashes.
        many = self.fitted.get("rows", 0) > ROWS_PER_TASK

        @F.pandas_udf("struct<ae:double,base:double,noisy:double>")
        def run(x: pd.Series, key: pd.Series) -> pd.DataFrame:
            clean = (np.vstack(x.to_numpy()) - mean) / std
            if many:
                draws = _hashed_noise(key.to_numpy(dtype=np.int64), seed, TEST_NOISE, clean.shape[1], noise_std)
            else:
                draws = np.vstack([np.random.default_rng([seed, int(k) & 0x7FFFFFFFFFFFFFFF])
                                   .normal(scale=noise_std, size=clean.shape[1]) for k in key])
            noisy = clean + draws
            back = net.forward(noisy)[-1]
            return pd.DataFrame({"ae": ((back - clean) ** 2).mean(axis=1), "base": (clean ** 2).mean(axis=1),
                                 "noisy": (draws ** 2).mean(axis=1)})
        key = self.column("keyCol")
        return dataset.select(run(at, F.xxhash64(key)).alias("e")).select("e.*")


class NetClassifier(Learner):
    """One hidden layer with a softmax output; labels are class indexes."""

    DEFAULTS = {"hidden": [100], "max_iter": 500, "batch_size": 200, "learning_rate_init": 1e-3,
                "alpha": 1e-4, "tol": 1e-4, "n_classes": 2, "seed": fixed.SEED}

    def _fit(self, dataset):
        x = self.column("featuresCol")
        scale = _safe(moments(dataset, x))
        net = Net([len(scale["mean"]), *self.option("hidden"), self.option("n_classes")], "softmax",
                  seed=self.option("seed"))
        y = self.column("labelCol")
        rows = dataset.select(_row_key(self, x, y), vector_to_array(x).alias("x"), F.col(y).alias("y"))
        net, loss = train(rows, scale["n"], net, _net_cfg(self, scale), self.option("seed"), "class")
        return self._model(NetClassifierModel, _as_state(net, scale, train_loss=loss))


def _net_cfg(learner: Learner, scale: dict) -> dict:
    return {"epochs": learner.option("max_iter"), "batch_size": learner.option("batch_size"),
            "learning_rate": learner.option("learning_rate_init"), "alpha": learner.option("alpha"),
            "noise_std": 0.0, "tol": learner.option("tol"), "mean": scale["mean"], "std": scale["std"]}


def _softmax(net: Net, x):
    out = net.forward(x)[-1]
    e = np.exp(out - out.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class NetClassifierModel(_NetModel):
    def _transform(self, dataset):
        scored = dataset.withColumn("_p", self.apply(_softmax))
        return scored.withColumn("probability", array_to_vector("_p")).withColumn(
            "prediction", (F.array_position("_p", F.array_max("_p")) - 1).cast("double")).drop("_p")


class NetRegressor(Learner):
    """One hidden layer with a linear output; the label is standardised in training."""

    DEFAULTS = {k: v for k, v in NetClassifier.DEFAULTS.items() if k != "n_classes"}

    def _fit(self, dataset):
        x, y = self.column("featuresCol"), self.column("labelCol")
        scale = _safe(moments(dataset, x))
        row = dataset.agg(F.avg(y).alias("m"), F.stddev_pop(y).alias("s")).first()
        centre, width = row["m"] or 0.0, row["s"] or 1.0
        net = Net([len(scale["mean"]), *self.option("hidden"), 1], "mse", seed=self.option("seed"))
        rows = dataset.select(_row_key(self, x, y), vector_to_array(x).alias("x"),
                              ((F.col(y) - centre) / width).alias("y"))
        net, loss = train(rows, scale["n"], net, _net_cfg(self, scale), self.option("seed"), "value")
        return self._model(NetRegressorModel, _as_state(net, scale, train_loss=loss, centre=centre, width=width))


class NetRegressorModel(_NetModel):
    def _transform(self, dataset):
        s = self.fitted
        raw = self.apply(lambda net, x: net.forward(x)[-1][:, 0], "double")
        return dataset.withColumn("prediction", raw * s["width"] + s["centre"])


"""Histogram gradient boosting: binned features, leaf-wise trees, Newton leaves with an L2 penalty.

Rows are binned once and packed into blocks, a column of bytes for each feature. A level is one job: each task adds
gradients, hessians and counts of its blocks into histograms (leaf x feature x bin), the histograms of a leaf and feature
meet in the shuffle, where the best cut of each is found; only these cuts reach the driver. Histograms of few megabytes
in all meet on the driver instead, which saves a stage. Trees grow best-first to ``max_leaf_nodes``: a level tries all leaves that the rest of the
budget could still reach, and the growth is replayed in the order of gains, so few levels give the tree that splitting
one leaf after the other gives. Missing values have a bin of their own and go to the side with the larger gain. Several
classes have one tree each and iteration, on softmax gradients.

Rows that fit one task (``one_task_cells``) are boosted there in one job by the same functions.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import fixed
from tablewright.operators.learners import LearnedModel, Learner
from tablewright.session import shared_path

#: Bins of a feature's values at most; one more is for missing ones.
MAX_BINS = 255
#: Least hessian of a side of a cut.
LEAST_HESSIAN = 1e-3
#: Rows x features up to which one task boosts alone, and that a task has beyond.
ONE_TASK_CELLS = 2_000_000
#: Trees after which the rows' scores are written, so that lineage stays short; those of each tree are cached.
REFRESH = 10
#: Rows and cells of a block at most.
BLOCK_ROWS, BLOCK_CELLS = 65_536, 4_000_000
#: Tasks in which the histograms of a level meet at most, and bytes up to which they meet on the driver.
MEETING_TASKS, MEETING_BYTES = 8, 16 << 20
#: Features whose quantiles are taken in one pass.
QUANTILE_COLUMNS = 100


# -- binning -----------------------------------------------------------------------------

def _distinct_values(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray | None] = []
        for batch in batches:
            x = _matrix(batch.column("x"))
            if not len(x):
                continue
            found = found or [np.zeros(0)] * x.shape[1]
            for j, held in enumerate(found):
                if held is not None:
                    values = np.unique(np.concatenate((held, x[~np.isnan(x[:, j]), j])))
                    found[j] = values if len(values) <= limit else None
        from pyspark import TaskContext
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(found)), pa.int32()), pa.array([TaskContext.get().partitionId() % 64] * len(found), pa.int32()),
             pa.array([v is None for v in found], pa.bool_()),
             pa.array([[] if v is None else v.tolist() for v in found], pa.list_(pa.float64()))],
            names=["feature", "slot", "many", "held"])
    return run


def bin_edges(rows: DataFrame, d: int, max_bins: int = MAX_BINS) -> list[list[float]]:
    """Upper edges of each feature's bins: midpoints of its distinct values, or quantiles where these are too many."""
    each = rows.select("x").mapInArrow(_distinct_values(max_bins), "feature int, slot int, many boolean, held array<double>")

    def merged(parts: DataFrame, *by: str) -> DataFrame:
        # one row of at most max_bins values for each task, first met in 64 slots
        return parts.groupBy(*by).agg(F.max("many").alias("many"), F.array_distinct(F.flatten(F.collect_list("held"))).alias(
            "held")).withColumn("many", F.col("many") | (F.size("held") > max_bins)).withColumn(
            "held", F.when(F.col("many"), F.array().cast("array<double>")).otherwise(F.col("held")))

    edges: list[list[float]] = [[] for _ in range(d)]
    wide = []
    for r in merged(merged(each, "feature", "slot"), "feature").collect():
        values = sorted(r["held"])
        edges[r["feature"]] = [(a + b) / 2 for a, b in zip(values, values[1:])]
        wide += [r["feature"]] * r["many"]
    probs = [k / max_bins for k in range(1, max_bins)]
    for k in range(0, len(wide), QUANTILE_COLUMNS):
        part = sorted(wide)[k:k + QUANTILE_COLUMNS]
        columns = rows.select(*[F.get("x", F.lit(j)).alias(f"x{j}") for j in part])
        for j, cuts in zip(part, columns.approxQuantile([f"x{j}" for j in part], probs, 0.1 / max_bins)):
            edges[j] = sorted(set(cuts))
    return edges


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each value; MAX_BINS for a missing one."""
    out = np.empty(x.shape, dtype=np.uint8)
    for j, cuts in enumerate(edges):
        out[:, j] = np.searchsorted(cuts, x[:, j], side="left")
    out[np.isnan(x)] = MAX_BINS
    return out


def _bin_rows(edges: list[list[float]], start: list[float]):
    """Rows to blocks: bins with a run of bytes for each feature, labels, and the first scores of each output."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = [np.asarray(e) for e in edges]
        most = max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(1, len(cuts))))
        held, n = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, most):
                part = batch.slice(k, most)
                if n + part.num_rows > most:
                    yield _block(held, start)
                    held, n = [], 0
                held.append((binned(_matrix(part.column("x")), cuts), part.column("y").to_numpy(zero_copy_only=False)))
                n += part.num_rows
        if n:
            yield _block(held, start)
    return run


def _block(held: list[tuple[np.ndarray, np.ndarray]], start: list[float]) -> pa.RecordBatch:
    bins, y = np.concatenate([b for b, _ in held]), np.concatenate([v for _, v in held])
    return _packed(np.ascontiguousarray(bins.T), y, np.repeat(np.asarray(start), len(y)).reshape(len(start), len(y)))


BLOCK = "n int, bins binary, y binary, score binary"


def _packed(bins: np.ndarray, y: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([len(y)], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (bins, y.astype(np.float64), score))],
        names=["n", "bins", "y", "score"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bins (feature, row), labels, scores (output, row)) of each block."""
    for n, *parts in zip(*(batch.column(c) for c in ("n", "bins", "y", "score"))):
        rows, (bins, y, score) = n.as_py(), (v.as_buffer() for v in parts)
        yield (np.frombuffer(bins, np.uint8).reshape(-1, rows), np.frombuffer(y), np.frombuffer(score).reshape(-1, rows))


# -- trees -------------------------------------------------------------------------------

@dataclass
class Cut:
    """The best cut of a node: values of bins up to `bin` go left; sums are (gradient, hessian, rows)."""

    gain: float
    feature: int
    bin: int
    missing_left: bool
    left: tuple[float, float, float]
    right: tuple[float, float, float]


def best_cut(sums: np.ndarray, l2: float, least_rows: int, first: int = 0) -> Cut | None:
    """Best cut by the histograms (feature, bin, 3) of a node; `first` is the number of the first feature.

    Of equal gains the first feature, the lowest bin, missing values to the right. Where no value is missing, later
    missing ones follow the larger side.
    """
    missing = sums[:, -1:, :]
    total = sums.sum(axis=1, keepdims=True)
    below = np.cumsum(sums[:, :-1, :], axis=1)  # the last cut parts known values from missing ones
    left = np.stack((below, below + missing), axis=1)  # feature, missing side, bin, sum
    right = total[:, None] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left[..., 0] ** 2 / (left[..., 1] + l2) + right[..., 0] ** 2 / (right[..., 1] + l2)
                - (total[..., 0] ** 2 / (total[..., 1] + l2))[:, None])
    fine = ((left[..., 2] >= least_rows) & (right[..., 2] >= least_rows)
            & (left[..., 1] >= LEAST_HESSIAN) & (right[..., 1] >= LEAST_HESSIAN))
    fine[:, 1] &= missing[:, :, 2] > 0
    gain = np.where(fine, gain, -np.inf)
    if not gain.size or not gain.max() > 1e-12:
        return None
    j, side, k = (int(v) for v in np.unravel_index(gain.argmax(), gain.shape))
    goes_left = bool(side) if missing[j, 0, 2] > 0 else bool(left[j, 0, k, 2] > right[j, 0, k, 2])
    return Cut(float(gain[j, side, k]), first + j, k, goes_left, tuple(left[j, side, k].tolist()),
               tuple(right[j, side, k].tolist()))


class Tree:
    """Nodes by number: cuts of inner ones with their children, sums of all."""

    def __init__(self, total: tuple[float, float, float]) -> None:
        self.sums = [total]
        self.cut: dict[int, Cut] = {}
        self.children: dict[int, tuple[int, int]] = {}

    def split(self, node: int, cut: Cut) -> tuple[int, int]:
        if node not in self.children:
            self.children[node] = (len(self.sums), len(self.sums) + 1)
            self.cut[node] = cut
            self.sums += [cut.left, cut.right]
        return self.children[node]

    def arrays(self) -> dict[str, np.ndarray]:
        """Columns by node; feature -1 at leaves."""
        n = len(self.sums)
        out = {"feature": np.full(n, -1), "bin": np.zeros(n, dtype=int), "missing_left": np.zeros(n, dtype=bool),
               "left": np.zeros(n, dtype=int), "right": np.zeros(n, dtype=int)}
        for node, cut in self.cut.items():
            out["feature"][node], out["bin"][node], out["missing_left"][node] = cut.feature, cut.bin, cut.missing_left
            out["left"][node], out["right"][node] = self.children[node]
        return out


def parted(tree: dict, node: int, bins: np.ndarray, rows: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an inner node that go left and right; bins: (feature, row)."""
    value = bins[tree["feature"][node]][rows]
    left = value <= tree["bin"][node]
    missing = value == MAX_BINS
    if missing.any():
        left = np.where(missing, tree["missing_left"][node], left)
    if isinstance(rows, slice):
        return np.flatnonzero(left), np.flatnonzero(~left)
    return rows[left], rows[~left]


def rows_of_nodes(tree: dict, bins: np.ndarray, wanted: set[int] | None = None) -> dict[int, np.ndarray | slice]:
    """Rows of each wanted node, else of each leaf; all rows are a slice."""
    out, todo = {}, [(0, slice(None))]
    while todo:
        node, rows = todo.pop()
        leaf = tree["feature"][node] < 0
        if leaf if wanted is None else node in wanted:
            out[node] = rows
        if not leaf:
            todo += zip((tree["left"][node], tree["right"][node]), parted(tree, node, bins, rows))
    return out


@dataclass
class Growth:
    """Trees that grow side by side in one iteration, one for each output."""

    max_leaf_nodes: int
    max_depth: int | None
    least_rows: int
    rate: float
    l2: float

    def grow(self, totals: list[tuple], find: Callable[[list[Tree], list[tuple[int, int]]], dict]) -> list[dict]:
        """Trees as plain lists. find(trees, [(output, node)]) gives the best cut (or None) of each asked node."""
        trees = [Tree(t) for t in totals]
        known: dict[tuple[int, int], Cut | None] = {}
        wanted = [(k, 0) for k in range(len(trees))]
        while wanted:
            worth = [w for w in wanted if trees[w[0]].sums[w[1]][2] >= 2 * self.least_rows]
            known.update(dict.fromkeys(wanted))
            known.update(find(trees, worth) if worth else {})
            wanted = [(k, n) for k, tree in enumerate(trees) for n in self._next(k, tree, known)]
        return [self._final(k, tree, known) for k, tree in enumerate(trees)]

    def _replay(self, k: int, tree: Tree, known: dict) -> tuple[list[int], list[tuple[float, int, int]], bool]:
        """Best-first growth as far as cuts are known: cut nodes, leaves that could be cut (-gain, node, depth), done."""
        heap = [(-known[k, 0].gain, 0, 0)] if known.get((k, 0)) else []
        chosen: list[int] = []
        while heap and len(chosen) + 1 < self.max_leaf_nodes:
            _, node, depth = heap[0]
            sides = tree.children.get(node)
            # what lies below the last cut, or at the deepest level, is never asked for
            last = len(chosen) + 2 == self.max_leaf_nodes or (self.max_depth is not None and depth + 1 >= self.max_depth)
            if not last and (sides is None or any((k, s) not in known for s in sides)):
                return chosen, heap, False
            heapq.heappop(heap)
            chosen.append(node)
            for side in tree.split(node, known[k, node]):
                if not last and known.get((k, side)):
                    heapq.heappush(heap, (-known[k, side].gain, side, depth + 1))
        return chosen, heap, True

    def _next(self, k: int, tree: Tree, known: dict) -> list[int]:
        """Nodes whose cuts are needed next: children of all leaves that the rest of the budget could reach."""
        chosen, heap, done = self._replay(k, tree, known)
        if done:
            return []
        rest = self.max_leaf_nodes - 1 - len(chosen)
        return [side for _, node, depth in heapq.nsmallest(rest, heap)
                if self.max_depth is None or depth + 1 < self.max_depth
                for side in tree.split(node, known[k, node]) if (k, side) not in known]

    def _final(self, k: int, tree: Tree, known: dict) -> dict:
        """The chosen part of the tree, nodes renumbered in the order of growth."""
        chosen, *_ = self._replay(k, tree, known)
        number, out = {0: 0}, {"feature": [], "bin": [], "missing_left": [], "left": [], "right": [], "value": []}
        order = [0]
        for node in chosen:
            for side in tree.children[node]:
                number[side] = len(order)
                order.append(side)
        inner = set(chosen)
        for node in order:
            g, h, _ = tree.sums[node]
            cut = tree.cut[node] if node in inner else None
            left, right = tree.children[node] if cut else (node, node)
            for name, value in (("feature", cut.feature if cut else -1), ("bin", cut.bin if cut else 0),
                                ("missing_left", bool(cut and cut.missing_left)), ("left", number.get(left, 0)),
                                ("right", number.get(right, 0)), ("value", -self.rate * g / (h + self.l2) if h + self.l2 else 0.0)):
                out[name].append(value)
        return out


def tree_values(tree: dict, bins: np.ndarray) -> np.ndarray:
    """The tree's value for each row; bins: (feature, row)."""
    out = np.empty(bins.shape[1])
    for node, rows in rows_of_nodes(tree, bins).items():
        out[rows] = tree["value"][node]
    return out


def histograms(bins: np.ndarray, rows: np.ndarray | slice, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(feature, bin, 3) sums of gradient, hessian and rows over the rows of a node."""
    width, d = MAX_BINS + 1, len(bins)
    out = np.zeros((d, width, 3))
    g, h = g[rows], h[rows]
    for j in range(d):
        cell = bins[j][rows]
        for c, weights in enumerate((g, h, None)):
            out[j, :, c] = np.bincount(cell, weights, width)
    return out


# -- losses ------------------------------------------------------------------------------

def gradients(loss: str, score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives (outputs, rows)."""
    if loss == "squared_error":
        return score - y, np.ones_like(score)
    if len(score) == 1:
        p = 1.0 / (1.0 + np.exp(-score))
        return p - y, p * (1.0 - p)
    e = np.exp(score - score.max(axis=0))
    p = e / e.sum(axis=0)
    return p - (y == np.arange(len(score))[:, None]), p * (1.0 - p)


def _baseline(rows: DataFrame, loss: str, n_classes: int) -> list[float]:
    if loss == "squared_error":
        return [rows.agg(F.avg("y")).first()[0] or 0.0]
    counts = {int(r["y"]): r["count"] for r in rows.groupBy("y").count().collect()}
    n = sum(counts.values())
    share = [min(max(counts.get(c, 0) / n, 1e-12), 1 - 1e-12) for c in range(max(n_classes, 2))]
    return [math.log(share[1] / share[0])] if n_classes <= 2 else [math.log(s) for s in share]


# -- one task ----------------------------------------------------------------------------

def _in_one_task(loss: str, iterations: int, growth: Growth):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [block for b in batches for block in _unpacked(b)]
        bins, y, score = (np.concatenate([block[i] for block in held], axis=-1) for i in range(3))
        out = []
        for _ in range(iterations):
            g, h = gradients(loss, score, y)
            rows = {(k, 0): slice(None) for k in range(len(score))}  # of the nodes asked for and their parents

            def find(trees: list[Tree], asked: list[tuple[int, int]]) -> dict:
                for k, tree in enumerate(trees):
                    arrays = tree.arrays()
                    for node, sides in tree.children.items():
                        if (k, node) in rows and any((k, s) not in rows for s in sides):
                            rows.update(zip(((k, s) for s in sides), parted(arrays, node, bins, rows[k, node])))
                return {(k, n): best_cut(histograms(bins, rows[k, n], g[k], h[k]), growth.l2, growth.least_rows)
                        for k, n in asked}

            trees = growth.grow([(g[k].sum(), h[k].sum(), len(y)) for k in range(len(score))], find)
            for k, tree in enumerate(trees):
                score[k] += tree_values(tree, bins)
            out.append(trees)
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(out)])], names=["trees"])
    return run


# -- many tasks --------------------------------------------------------------------------

def _level(loss: str, growing: list[dict[str, np.ndarray]], asked: list[list[int]]):
    """Histograms of the asked nodes over a task's rows, bins up to the last with rows; node -1 has the totals of an
    output."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        totals = np.zeros((len(asked), 3))
        for bins, y, score in (block for batch in batches for block in _unpacked(batch)):
            g, h = gradients(loss, score, y)
            for k, nodes in enumerate(asked):
                totals[k] += (g[k].sum(), h[k].sum(), len(y))
                for node, rows in rows_of_nodes(growing[k], bins, set(nodes)).items():
                    found = histograms(bins, rows, g[k], h[k])
                    sums[k, node] = sums[k, node] + found if (k, node) in sums else found
        rows = [(k, -1, -1, totals[k].tobytes()) for k in range(len(asked))]
        for (k, node), found in sums.items():
            used = MAX_BINS + 1 - (found[:, ::-1, 2] > 0).argmax(axis=1)
            used[found[:, -1, 2] > 0] = MAX_BINS + 1
            rows += [(k, int(node), j, one[:most].tobytes()) for j, (one, most) in enumerate(zip(found, used))]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.binary() if c == 3 else pa.int32())
                                          for c in range(4)], names=["output", "node", "feature", "sums"])
    return run


def _best_cuts(growth: Growth):
    """Sums of each output, node and feature of a task added up, and the best cut of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for *key, sums in zip(*(batch.column(c).to_pylist() for c in ("output", "node", "feature", "sums"))):
                part = np.frombuffer(sums).reshape(-1, 3)
                total = held.setdefault(tuple(key), np.zeros((MAX_BINS + 1 if key[2] >= 0 else 1, 3)))
                total[:len(part)] += part
        out = []
        for (output, node, feature), sums in sorted(held.items()):
            if feature < 0:
                out.append((output, node, feature, 0.0, 0, False, sums[0].tolist(), []))
                continue
            cut = best_cut(sums[None], growth.l2, growth.least_rows, feature)
            if cut is not None:
                out.append((output, node, feature, cut.gain, cut.bin, cut.missing_left, list(cut.left), list(cut.right)))
        kinds = [pa.int32()] * 3 + [pa.float64(), pa.int32(), pa.bool_()] + [pa.list_(pa.float64())] * 2
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)],
                                         names=["output", "node", "feature", "gain", "bin", "missing_left", "left", "right"])
    return run


def _run_level(blocks: DataFrame, parts: int, d: int, loss: str, growing, asked, growth: Growth) -> tuple[dict, dict]:
    """Totals of each output and best cut of each asked node, over all rows: one job."""
    each = blocks.mapInArrow(_level(loss, growing, asked), "output int, node int, feature int, sums binary")
    if parts * d * sum(map(len, asked)) * (MAX_BINS + 1) * 24 <= MEETING_BYTES:
        found = [r for batch in _best_cuts(growth)(iter(each.toArrow().to_batches())) for r in batch.to_pylist()]
    else:
        met = each.repartition(min(parts, MEETING_TASKS), "output", "node", "feature")
        found = met.mapInArrow(_best_cuts(growth), "output int, node int, feature int, gain double, bin int, "
                               "missing_left boolean, left array<double>, right array<double>").collect()
    totals, cuts = {}, {}
    for r in sorted(found, key=lambda r: r["feature"]):  # a row for each node and feature at most
        if r["feature"] < 0:
            totals[r["output"]] = tuple(r["left"])
            continue
        cut = Cut(r["gain"], r["feature"], r["bin"], r["missing_left"], tuple(r["left"]), tuple(r["right"]))
        held = cuts.get((r["output"], r["node"]))
        if held is None or cut.gain > held.gain:
            cuts[r["output"], r["node"]] = cut
    return totals, cuts


def _scored(trees: list[dict]):
    """Blocks with the trees of one iteration added to their scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, y, score in (block for batch in batches for block in _unpacked(batch)):
            yield _packed(bins, y, score + np.array([tree_values(tree, bins) for tree in trees]))
    return run


def _in_many_tasks(blocks: DataFrame, parts: int, d: int, loss: str, outputs: int, iterations: int,
                   growth: Growth) -> list[list[dict]]:
    spark = blocks.sparkSession
    done: list[list[dict]] = []
    now, older = blocks, None
    root = {"feature": np.array([-1])}
    for i in range(iterations):
        totals, first = _run_level(now, parts, d, loss, [root] * outputs, [[0]] * outputs, growth)
        if older is not None:  # the scores it led to are cached since
            older.unpersist()

        def find(trees: list[Tree], asked: list[tuple[int, int]], first=first, now=now) -> dict:
            if all(node == 0 for _, node in asked):
                return first
            nodes = [[n for o, n in asked if o == k] for k in range(len(trees))]
            return _run_level(now, parts, d, loss, [t.arrays() for t in trees], nodes, growth)[1]

        trees = growth.grow([totals[k] for k in range(outputs)], find)
        done.append(trees)
        if i + 1 < iterations:
            older, scored = now, now.mapInArrow(_scored(trees), BLOCK)
            if len(done) % REFRESH == 0:
                path = shared_path(spark, "boosting")
                scored.write.parquet(path)
                scored = spark.read.schema(BLOCK).parquet(path).coalesce(parts)
            now = scored.persist(StorageLevel.MEMORY_AND_DISK)
    now.unpersist()
    return done


# -- estimator ---------------------------------------------------------------------------

class HistBoosting(Learner):
    """Boosting with histograms; n_classes 0 is regression with squared errors, else log loss on class indexes."""

    DEFAULTS = {"n_classes": 0, "max_iter": 100, "learning_rate": 0.1, "max_leaf_nodes": 31, "max_depth": None,
                "min_samples_leaf": 20, "l2_regularization": 0.0, "max_bins": MAX_BINS,
                "one_task_cells": ONE_TASK_CELLS, "seed": fixed.SEED}

    def _fit(self, dataset):
        n_classes = int(self.option("n_classes"))
        loss = "log_loss" if n_classes else "squared_error"
        if not 2 <= int(self.option("max_bins")) <= MAX_BINS:
            raise ValueError(f"max_bins must lie between 2 and {MAX_BINS}.")
        rows = dataset.select(vector_to_array(self.column("featuresCol")).alias("x"),
                              F.col(self.column("labelCol")).cast("double").alias("y")).filter(F.col("y").isNotNull())
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
        n, d = size["n"], size["d"] or 0
        if not n:
            raise ValueError("There are no rows to fit.")
        parts = max(1, math.ceil(n * max(d, 1) / int(self.option("one_task_cells"))))
        edges = bin_edges(rows, d, int(self.option("max_bins")))
        start = _baseline(rows, loss, n_classes)
        depth = self.option("max_depth")
        growth = Growth(int(self.option("max_leaf_nodes")), int(depth) if depth else None,
                        int(self.option("min_samples_leaf")), float(self.option("learning_rate")),
                        float(self.option("l2_regularization")))
        iterations = int(self.option("max_iter"))
        if parts == 1:
            blocks = rows.mapInArrow(_bin_rows(edges, start), BLOCK)
            trees = json.loads(blocks.coalesce(1).mapInArrow(
                _in_one_task(loss, iterations, growth), "trees string").collect()[0]["trees"])
        else:
            kept = rows.repartition(parts).mapInArrow(_bin_rows(edges, start), BLOCK).persist(StorageLevel.MEMORY_AND_DISK)
            trees = _in_many_tasks(kept, parts, d, loss, len(start), iterations, growth)
        return self._model(HistBoostingModel, {"edges": edges, "start": start, "trees": trees, "n_classes": n_classes})


class HistBoostingModel(LearnedModel):
    """Adds prediction and, for classes, probability."""

    def raw(self):
        """An Arrow UDF of the summed trees, one value for each output."""
        state = self.fitted
        edges, start, trees = [np.asarray(e) for e in state["edges"]], np.asarray(state["start"]), state["trees"]

        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            bins = np.ascontiguousarray(binned(np.vstack(x.to_numpy()).astype(np.float64), edges).T)
            score = np.tile(start, (len(x), 1))
            for outputs in trees:
                for k, tree in enumerate(outputs):
                    score[:, k] += tree_values(tree, bins)
            if state["n_classes"] > 2:
                e = np.exp(score - score.max(axis=1, keepdims=True))
                score = e / e.sum(axis=1, keepdims=True)
            elif state["n_classes"]:
                p = 1.0 / (1.0 + np.exp(-score[:, 0]))
                score = np.column_stack((1.0 - p, p))
            return pd.Series(list(score))
        return run(self.features())

    def _transform(self, dataset):
        scored = dataset.withColumn("_p", self.raw())
        if not self.fitted["n_classes"]:
            return scored.withColumn("prediction", F.get("_p", F.lit(0))).drop("_p")
        return scored.withColumn("probability", array_to_vector("_p")).withColumn(
            "prediction", (F.array_position("_p", F.array_max("_p")) - 1).cast("double")).drop("_p")

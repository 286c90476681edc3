"""Exact nearest neighbours by pivot cells, and what is built on them.

Reference rows go to the cell of their nearest pivot. For a query, the distances to the
pivots, the cell radii and the distances to some reference rows bound its k-th neighbour from above
and every cell from below (triangle inequality); only cells that may hold a neighbour are searched. Neighbouring cells are
packed into blocks, larger cells cut into several, and the queries sent to a block are cut into
chunks of the same size, so a cell with a third of all rows is many tasks. A task returns k rows
per query and block, never all pairs. Blocks grow with the table up to a bound in memory: where
cells rule nothing out, every row is sent to every block, and this is PARTS copies of the table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReader, MLWriter
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.exprs import col
from tablewright.operators.learners import LearnedModel, Learner

# Rows of a block: a share of the table, within bounds of rows and of numbers in its vectors.
BLOCK_ROWS, PARTS = 2_048, 16
MOST_ROWS, MOST_NUMBERS = 1 << 16, 1 << 22
# Distances that a task holds at once.
TILE = 1 << 21
# References looked at beside the k nearest, so that ties and rounding seldom need a closer look.
SPARE = 8
# Rows of the boxes that a block is cut into, and the share of the block near a box from which boxes do not pay.
BOX_ROWS, MOST_NEAR = 64, 0.5
# Reference rows whose distances bound the k-th neighbour of every query, within a bound of numbers.
KNOWN_ROWS, KNOWN_NUMBERS = 4_096, 1 << 20


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by the product form; errors are covered by the callers' slack."""
    sq = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0.0))


def _local_top(query_keys, q, ref_keys, r, k: int, skip_same: bool, place=None) -> pd.DataFrame:
    """The k nearest references of every query within one block, ties by key, exactly."""
    if place is None:
        place = np.unique(ref_keys, return_inverse=True)[1]  # keys of any type by their order
    want = min(k + (1 if skip_same else 0), len(ref_keys))
    out_q, out_r, out_d = [], [], []
    # squares of distances by one product, around the middle of the references, so that errors stay below the slack
    middle = r.mean(axis=0)
    middle = np.where(np.isfinite(middle), middle, 0.0)
    a, b = q - middle, r - middle
    a_square, b_square = (a * a).sum(axis=1), (b * b).sum(axis=1)
    a, b = np.column_stack([-2.0 * a, np.ones(len(a))]), np.vstack([b.T, b_square])
    slack = 2e-6 * (1.0 + math.sqrt(float(np.nan_to_num(a_square).max(initial=0.0))) + math.sqrt(
        float(np.nan_to_num(b_square).max(initial=0.0))))

    def reach(nearest_square):
        return (np.sqrt(np.maximum(nearest_square, 0.0)) + slack) ** 2

    few = want + SPARE
    step = max(1, min(TILE // len(ref_keys), 4 * TILE // (few * q.shape[1])))
    held = np.empty((min(step, len(q)), len(ref_keys)))
    for start in range(0, len(query_keys), step):
        part = a[start:start + step]
        rough = np.matmul(part, b, out=held[:len(part)])
        rough += a_square[start:start + step, None]
        left = np.arange(len(rough))
        if few < len(ref_keys):
            near = np.argpartition(rough, few, axis=1)
            beyond, near = rough[left, near[:, few]], near[:, :few]
            exact = np.sqrt(((r[near] - q[start:start + step, None]) ** 2).sum(axis=2))
            if skip_same:
                exact[ref_keys[near] == query_keys[start:start + step, None]] = np.inf
            best = np.lexsort((place[near], exact), axis=1)[:, :k]
            near, exact = np.take_along_axis(near, best, axis=1), np.take_along_axis(exact, best, axis=1)
            # all others are farther than the last
            sure = np.isfinite(exact).all(axis=1) & (beyond > reach(exact[:, -1] ** 2))
            out_q.append(np.repeat(query_keys[start:start + step][sure], near.shape[1]))
            out_r.append(ref_keys[near[sure]].ravel())
            out_d.append(exact[sure].ravel())
            left = np.flatnonzero(~sure)
        if not len(left):
            continue
        rough = rough[left]
        # the k-th of some references bounds the k-th of all, and leaves few to look at
        some = max(want, len(ref_keys) // 8)
        limit = reach(np.partition(rough[:, :some], want - 1, axis=1)[:, want - 1])
        at, near_all = np.nonzero(rough <= limit[:, None])
        ends = np.searchsorted(at, np.arange(len(rough) + 1))
        for i in range(len(rough)):
            row = start + left[i]
            key, near = query_keys[row], near_all[ends[i]:ends[i + 1]]
            if len(near) > want:
                close = rough[i, near]
                near = near[close <= reach(np.partition(close, want - 1)[want - 1])]
            if skip_same:
                near = near[ref_keys[near] != key]
                others = np.flatnonzero(ref_keys != key) if len(near) < k else near
                if len(others) > len(near):  # its key stands there more than once
                    close = rough[i, others]
                    last = min(k, len(close)) - 1
                    near = others[close <= reach(np.partition(close, last)[last])]
            exact = np.sqrt(((r[near] - q[row]) ** 2).sum(axis=1))
            best = np.lexsort((place[near], exact))[:k]
            out_q.append(np.repeat(query_keys[row:row + 1], len(best)))
            out_r.append(ref_keys[near][best])
            out_d.append(exact[best])
    out_q, out_r, out_d = (np.concatenate([*lists, none]) for lists, none in (
        (out_q, query_keys[:0]), (out_r, ref_keys[:0]), (out_d, np.empty(0))))
    return pd.DataFrame({"query": out_q, "ref": out_r, "distance": out_d})


def _boxes(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows cut at the middle of their widest column until few are left: the places in each box, its corners."""
    todo, boxes = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= BOX_ROWS:
            boxes.append(at)
            continue
        axis, half = int(np.ptp(x[at], axis=0).argmax()), len(at) // 2
        at = at[np.argpartition(x[at, axis], half)]
        todo += [at[:half], at[half:]]
    return boxes, np.array([x[at].min(axis=0) for at in boxes]), np.array([x[at].max(axis=0) for at in boxes])


def _near_boxes(q: np.ndarray, r: np.ndarray, need: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Boxes of queries, each with the references that may be among the nearest `need` of one of them. None where that is
    a large share of all, and the boxes would not pay."""
    if len(r) <= 4 * BOX_ROWS or not (np.isfinite(q).all() and np.isfinite(r).all()):
        return None
    (asked, q_low, q_high), (held, r_low, r_high) = _boxes(q), _boxes(r)
    size, found, looks = np.array([len(at) for at in held]), [], 0
    for at, low, high in zip(asked, q_low, q_high):
        least = (np.maximum(np.maximum(r_low - high, low - r_high), 0.0) ** 2).sum(axis=1)
        most = (np.maximum(r_high - low, high - r_low) ** 2).sum(axis=1)
        order = np.argsort(most)
        last = min(int(np.searchsorted(np.cumsum(size[order]), need)), len(order) - 1)
        near = np.flatnonzero(least <= most[order[last]] * (1.0 + 1e-9))
        looks += len(at) * int(size[near].sum())
        if looks > MOST_NEAR * len(q) * len(r):
            return None
        found.append((at, np.concatenate([held[i] for i in near])))
    return found


def _packed(centres: np.ndarray, size: np.ndarray, rows: int) -> list[range]:
    """Block numbers of every cell: cells side by side on the main axis share a block of up to ``rows`` rows, and a
    cell of more rows has several of its own."""
    centres = np.nan_to_num(centres)
    axis = np.linalg.svd(centres - centres.mean(axis=0), full_matrices=False)[2][0]
    blocks: list[range] = [range(0)] * len(size)
    number, open_block, held = 0, None, 0
    for c in np.argsort(centres @ axis, kind="stable"):
        if size[c] > rows:
            blocks[c] = range(number, number + math.ceil(size[c] / rows))
            number = blocks[c].stop
            continue
        if open_block is None or held + size[c] > rows:
            open_block, held, number = number, 0, number + 1
        blocks[c], held = range(open_block, open_block + 1), held + size[c]
    return blocks


def _by_value(lists: pd.Series) -> dict[tuple, list[int]]:
    """Places of equal lists."""
    found: dict[tuple, list[int]] = {}
    for i, one in enumerate(lists):
        found.setdefault(tuple(one), []).append(i)
    return found


def nearest(queries: DataFrame, refs: DataFrame, k: int, skip_same: bool = False,
            n_refs: int | None = None) -> DataFrame:
    """(query, ref, distance, rank) of the k nearest refs of every query, ties by ref.

    Both inputs are (key, x array<double>) with keys of any type; ``skip_same`` leaves out a row's own key.
    Persist both if they are expensive.
    """
    n = refs.count() if n_refs is None else n_refs
    if not n:
        raise ValueError("There are no reference rows.")
    n_pivots = max(1, math.ceil(math.sqrt(n) / 4))
    first = refs.orderBy(F.xxhash64("key"), "key").limit(max(n_pivots, KNOWN_ROWS)).collect()
    pivots = np.array([r["x"] for r in first[:n_pivots]])
    # one row of a key, so that at most one of them is the query's own
    some = np.array([*{r["key"]: r["x"] for r in reversed(first)}.values()])
    some = some[:max(n_pivots, KNOWN_NUMBERS // max(1, some.shape[1]))]
    furthest = math.sqrt(float(np.nan_to_num((some * some).sum(axis=1)).max()))

    @F.pandas_udf("struct<cell:int,away:double>")
    def place(x: pd.Series) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({"cell": pd.Series(dtype="int32"), "away": pd.Series(dtype=float)})
        d = _distances(np.vstack(x.to_numpy()), pivots)
        cell = d.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "away": d[np.arange(len(d)), cell]})

    placed = refs.select("key", "x", place("x").alias("p")).select("key", "x", "p.cell", "p.away")
    # One row per pivot.
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect()}
    ids = np.array(sorted(cells))
    size = np.array([cells[c]["n"] for c in ids])
    low, high = (np.array([cells[c][b] for c in ids]) for b in ("low", "high"))
    centres = pivots[ids]
    gaps = np.vstack([np.sqrt(((centres - c) ** 2).sum(axis=1)) for c in centres])
    half_gap = np.divide(0.5, gaps, out=np.zeros_like(gaps), where=gaps > 0)
    rows = max(BLOCK_ROWS, min(math.ceil(n / PARTS), MOST_ROWS, MOST_NUMBERS // max(1, centres.shape[1])))
    blocks = _packed(centres, size, rows)
    need = k + (1 if skip_same else 0)

    @F.pandas_udf("array<struct<block:int,cells:array<int>>>")
    def candidates(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        rows_x = np.vstack(x.to_numpy())
        d = _distances(rows_x, centres)
        # beside rounding of the result, that of the product form
        far = 1e-7 * (np.sqrt((rows_x * rows_x).sum(axis=1)) + furthest)
        slack = 1e-6 * (1.0 + d) + far[:, None]
        upper = d + high + slack
        order = np.argsort(upper, axis=1)
        filled = np.cumsum(size[order], axis=1) >= need
        at = np.where(filled.any(axis=1), filled.argmax(axis=1), len(ids) - 1)
        reach = upper[np.arange(len(d)), order[np.arange(len(d)), at]]
        step = max(1, TILE // len(some))
        for start in range(0, len(rows_x) if len(some) >= need else 0, step):
            part = slice(start, start + step)
            bound = np.partition(_distances(rows_x[part], some), need - 1, axis=1)[:, need - 1]
            reach[part] = np.fmin(reach[part], bound + 1e-6 * (1.0 + bound) + far[part])
        lower = np.maximum(np.maximum(d - high, low - d), 0.0) - slack
        # a cell lies beyond the plane midway between its pivot and the query's
        own = d.argmin(axis=1)
        beyond = (d * d - d.min(axis=1)[:, None] ** 2 - far[:, None] ** 2) * half_gap[own] - slack
        lower = np.maximum(lower, beyond)
        known: dict[bytes, list] = {}

        def sent(row: np.ndarray) -> list:
            code = row.tobytes()
            if code not in known:
                parts: dict[int, list[int]] = {}
                for c in np.flatnonzero(row):
                    for block in blocks[c]:
                        parts.setdefault(block, []).append(int(ids[c]))
                known[code] = [{"block": b, "cells": cells} for b, cells in parts.items()]
            return known[code]
        return pd.Series([sent(row) for row in lower <= reach[:, None]])

    asked = queries.select("key", "x", F.explode(candidates("x")).alias("to")).select("key", "x", "to.block", "to.cells")
    # One row per block: how many queries visit it.
    visits = {r["block"]: r["n"] for r in asked.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    chunks = {b: max(1, math.ceil(visits.get(b, 0) / rows)) for b in range(max(r.stop for r in blocks))}

    def looked_up(table, at):
        return F.create_map(*[F.lit(v) for c, m in table.items() for v in (c, m)])[at]

    spread = F.xxhash64("key", F.lit("block"))
    left = asked.select("key", "x", "cells", F.col("block").alias("b"),
                        F.pmod(spread, looked_up(chunks, F.col("block"))).cast("int").alias("h"))
    # New names: both sides may come from one table.
    own = [looked_up({int(c): value(b) for c, b in zip(ids, blocks)}, F.col("cell")) for value in (min, len)]
    right = placed.select(F.col("key").alias("ref_key"), F.col("x").alias("ref_x"), "cell",
                          (own[0] + F.pmod(spread, own[1])).cast("int").alias("b")).select(
        "ref_key", "ref_x", "cell", "b", F.explode(F.sequence(F.lit(0), looked_up(chunks, F.col("b")) - 1)).alias("h"))

    def search(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query": q["key"].iloc[:0], "ref": r["ref_key"].iloc[:0],
                               "distance": pd.Series(dtype=float)})]
        if len(q) and len(r):
            r = r.sort_values("cell", kind="stable")
            query_keys, ref_keys, cell = q["key"].to_numpy(), r["ref_key"].to_numpy(), r["cell"].to_numpy()
            x, ref_x = np.vstack(q["x"].to_numpy()), np.vstack(r["ref_x"].to_numpy())
            order = np.unique(ref_keys, return_inverse=True)[1]
            # a key's own rows do not count
            own = int(np.bincount(order).max()) if skip_same else 0
            boxes = _near_boxes(x, ref_x, k + own)
            if boxes is None:  # queries that look into the same cells are searched together
                boxes = [(np.array(same), np.flatnonzero(np.isin(cell, cells))) for cells, same in _by_value(q["cells"]).items()]
            for same, near in boxes:
                if len(near):
                    found.append(_local_top(query_keys[same], x[same], ref_keys[near], ref_x[near], k, skip_same, order[near]))
        return pd.concat(found[1:]) if len(found) > 1 else found[0]

    by = ["b", "h"]
    query_type, ref_type = (t.schema["key"].dataType.simpleString() for t in (queries, refs))
    pairs = f"query {query_type}, ref {ref_type}, distance double"
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(search, pairs)
    order = Window.partitionBy("query").orderBy("distance", "ref")  # limited before the shuffle
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# -- k nearest neighbours as a model ---------------------------------------------------

class _RowsWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sc)
        self.instance.rows.write.mode("overwrite").parquet(f"{path}/rows")


class _RowsReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sc)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.rows = self.sparkSession.read.parquet(f"{path}/rows")
        return model


class _RowsModel(LearnedModel):
    """A model whose fitted state is a table next to its params."""

    rows: DataFrame | None = None

    def copy(self, extra=None):
        twin = super().copy(extra)
        twin.rows = self.rows
        return twin

    def write(self):
        return _RowsWriter(self)

    @classmethod
    def read(cls):
        return _RowsReader(cls)

    def queries(self, dataset: DataFrame) -> DataFrame:
        key = self.column("keyCol")
        if not key:
            raise ValueError("Neighbour models need a key column.")
        return dataset.select(col(key).alias("key"), self.features().alias("x"))

    def attach(self, dataset: DataFrame, scored: DataFrame) -> DataFrame:
        key = self.column("keyCol")
        return dataset.join(scored, col(key) == F.col("query"), "left").drop("query")


def _rows(learner: Learner, dataset: DataFrame, *more) -> DataFrame:
    key = learner.column("keyCol")
    if not key:
        raise ValueError("Neighbour models need a key column.")
    return dataset.select(col(key).alias("key"),
                          vector_to_array(learner.column("featuresCol")).alias("x"), *more)


def vote_weight(weights: str):
    """1, or 1 / distance; a neighbour at distance 0 outweighs all others."""
    if weights == "uniform":
        return F.lit(1.0)
    zero = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("query")) == 1
    return F.when(zero, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))


class Neighbors(Learner):
    """Classifier (class indexes) or regressor by the k nearest training rows.

    search: "exact", or "hashed" for the neighbours that locality-sensitive hashing finds (operators/hashing.py).
    """

    DEFAULTS = {"n_neighbors": 5, "weights": "uniform", "n_classes": 0, "search": "exact"}

    def _fit(self, dataset):
        rows = _rows(self, dataset, F.col(self.column("labelCol")).cast("double").alias("label"))
        state = {o: self.option(o) for o in self.DEFAULTS}
        model = self._model(NeighborsModel, {**state, "n": rows.count()})
        model.rows = rows
        return model


class NeighborsModel(_RowsModel):
    def neighbours(self, dataset: DataFrame) -> DataFrame:
        from tablewright.operators.hashing import nearest_hashed
        s = self.fitted
        search = nearest_hashed if s.get("search") == "hashed" else nearest
        found = search(self.queries(dataset), self.rows.select("key", "x"), s["n_neighbors"], n_refs=s["n"])
        return found.join(self.rows.select(F.col("key").alias("ref"), "label"), "ref")

    def _transform(self, dataset):
        s = self.fitted
        weighted = self.neighbours(dataset).withColumn("w", vote_weight(s["weights"]))
        if not s["n_classes"]:
            scored = weighted.groupBy("query").agg(
                (F.sum(F.col("w") * F.col("label")) / F.sum("w")).alias("prediction"))
            return self.attach(dataset, scored)
        votes = [F.sum(F.when(F.col("label") == c, F.col("w")).otherwise(0.0)) / F.sum("w")
                 for c in range(s["n_classes"])]
        scored = weighted.groupBy("query").agg(F.array(*votes).alias("_p"))
        scored = scored.select("query", array_to_vector("_p").alias("probability"),
                               (F.array_position("_p", F.array_max("_p")) - 1).cast("double").alias("prediction"))
        return self.attach(dataset, scored)


# -- local outlier factor --------------------------------------------------------------

def _density(pairs: DataFrame, reach_of: DataFrame) -> DataFrame:
    """(query, lrd): inverse mean reachability distance to the neighbours."""
    joined = pairs.join(reach_of.select(F.col("key").alias("ref"), "kdist"), "ref")
    return joined.groupBy("query").agg(
        (1.0 / (F.avg(F.greatest("kdist", "distance")) + 1e-10)).alias("lrd"))


def local_outlier_factor(rows: DataFrame, k: int) -> DataFrame:
    """(key, kdist, lrd, lof) of every row among the others; neighbour joins only."""
    pairs = nearest(rows, rows, k, skip_same=True).persist(StorageLevel.MEMORY_AND_DISK)
    kdist = pairs.groupBy(F.col("query").alias("key")).agg(F.max("distance").alias("kdist"))
    lrd = _density(pairs, kdist)
    near = pairs.join(lrd.select(F.col("query").alias("ref"), F.col("lrd").alias("near")), "ref")
    factor = near.groupBy("query").agg(F.avg("near").alias("near"))
    return (lrd.join(factor, "query").join(kdist, F.col("query") == F.col("key"))
            .select("key", "kdist", "lrd", (F.col("near") / F.col("lrd")).alias("lof")))


class LocalOutlierFactor(Learner):
    """Novelty mode: densities of the training rows, scores of new rows against them."""

    DEFAULTS = {"n_neighbors": 20}

    def _fit(self, dataset):
        rows = _rows(self, dataset).persist(StorageLevel.MEMORY_AND_DISK)
        n = rows.count()
        k = max(1, min(self.option("n_neighbors"), n - 1))
        dense = local_outlier_factor(rows, k).select("key", "kdist", "lrd")
        model = self._model(LocalOutlierFactorModel, {"k": k, "n": n})
        # Read several times per scoring; kept, so the densities are computed once.
        model.rows = rows.join(dense, "key").persist(StorageLevel.MEMORY_AND_DISK)
        return model


class LocalOutlierFactorModel(_RowsModel):
    """score = local outlier factor; prediction 1 above 1.5."""

    def _transform(self, dataset):
        s = self.fitted
        pairs = nearest(self.queries(dataset), self.rows.select("key", "x"), s["k"], n_refs=s["n"])
        joined = pairs.join(self.rows.select(F.col("key").alias("ref"), "kdist", "lrd"), "ref")
        scored = joined.groupBy("query").agg(
            (F.avg("lrd") * (F.avg(F.greatest("kdist", "distance")) + 1e-10)).alias("score"))
        return self.attach(dataset, scored).withColumn("prediction", (F.col("score") > 1.5).cast("double"))

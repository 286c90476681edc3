"""Pairwise-complete correlations of many columns by blocks of masked Gram matrices.

A task turns its rows into matrices of values and of masks, and adds up for each pair of column blocks the products that
a correlation needs: counts, sums, squares and cross products over the rows where both columns have a value. Blocks meet in a
shuffle, first in a few slots; the correlation of a pair is computed where its block is summed, so that only pairs above
the threshold go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.exprs import col, nan_to_null

#: Columns of a block; slots in which the tasks' blocks first meet.
BLOCK = 64
SLOTS = 16


def _blocks(n_columns: int, size: int) -> list[tuple[int, int]]:
    return [(k, min(k + size, n_columns)) for k in range(0, n_columns, size)]


def _task_sums(n_columns: int, size: int, centre: list[float]):
    """Rows (i, j, slot, sums): for a pair of blocks six matrices of masked sums, of values less the centres."""
    edges = _blocks(n_columns, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").values.to_numpy(zero_copy_only=False)
            offsets = batch.column("x").offsets.to_numpy()
            x = x[offsets[0]:offsets[-1]].reshape(batch.num_rows, n_columns).astype(np.float64) - np.asarray(centre)
            mask = ~np.isnan(x)
            x = np.where(mask, x, 0.0)
            mask = mask.astype(np.float64)
            square = x * x
            for i, (a, b) in enumerate(edges):
                for j, (c, d) in enumerate(edges[i:], i):
                    sums = np.stack((mask[:, a:b].T @ mask[:, c:d], x[:, a:b].T @ mask[:, c:d], mask[:, a:b].T @ x[:, c:d],
                                     square[:, a:b].T @ mask[:, c:d], mask[:, a:b].T @ square[:, c:d],
                                     x[:, a:b].T @ x[:, c:d]))
                    held[i, j] = held[i, j] + sums if (i, j) in held else sums
        slot = TaskContext.get().partitionId() % SLOTS
        for (i, j), sums in held.items():  # one block at a time
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([slot], pa.int32()),
                 pa.array([sums.tobytes()], pa.binary())], names=["i", "j", "slot", "sums"])
    return run


def _added(pdf: pd.DataFrame) -> np.ndarray:
    out = np.frombuffer(pdf["sums"].iloc[0]).copy()
    for part in pdf["sums"].iloc[1:]:
        out += np.frombuffer(part)
    return out


def _slot_sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": [key[0]], "j": [key[1]], "sums": [_added(pdf).tobytes()]})


def _pairs(n_columns: int, size: int, threshold: float):
    edges = _blocks(n_columns, size)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        (a, b), (c, d) = edges[key[0]], edges[key[1]]
        n, sx, sy, sxx, syy, sxy = _added(pdf).reshape(6, b - a, d - c)
        with np.errstate(divide="ignore", invalid="ignore"):
            spread_x, spread_y = sxx - sx * sx / n, syy - sy * sy / n
            r = (sxy - sx * sy / n) / np.sqrt(spread_x * spread_y)
        # a column that is constant over the rows of a pair has no correlation; rounding may leave it a tiny spread
        flat = (spread_x <= 1e-12 * sxx) | (spread_y <= 1e-12 * syy)
        r = np.clip(np.where(flat | (n < 2), np.nan, r), -1.0, 1.0)
        rows, columns = np.nonzero(np.abs(r) >= threshold)
        later = rows + a < columns + c  # each pair once, and none with itself
        rows, columns = rows[later], columns[later]
        return pd.DataFrame({"a": (rows + a).astype("int32"), "b": (columns + c).astype("int32"), "r": r[rows, columns]})
    return run


def wide_correlations(df: DataFrame, columns: list[str], threshold: float, size: int = BLOCK) -> DataFrame:
    """(a, b, r) of the column pairs with |Pearson r| >= threshold, pairwise complete; a comes before b in `columns`."""
    values = nan_to_null(df.select([col(c).cast("double").alias(c) for c in columns]))
    # near the mean, sums of squares keep their digits
    means = values.agg(F.array(*[F.coalesce(F.avg(col(c)), F.lit(0.0)) for c in columns]).alias("m")).first()["m"]
    rows = values.select(F.array(*[F.coalesce(col(c), F.lit(float("nan"))) for c in columns]).alias("x"))
    each = rows.mapInArrow(_task_sums(len(columns), size, means), "i int, j int, slot int, sums binary")
    met = each.groupBy("i", "j", "slot").applyInPandas(_slot_sums, "i int, j int, sums binary")
    found = met.groupBy("i", "j").applyInPandas(_pairs(len(columns), size, threshold), "a int, b int, r double")
    names = F.array(*map(F.lit, columns))
    return found.select(F.get(names, F.col("a")).alias("a"), F.get(names, F.col("b")).alias("b"), "r")

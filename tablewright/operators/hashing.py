"""Nearest neighbours by locality-sensitive hashing: random projections, multi-probe, exact re-ranking.

Each table cuts space by hyperplanes through the medians of random projections, so a bucket is a string of sides and
buckets are even. Reference rows stand in one bucket of each table. A query looks into its own buckets and into those
beyond the planes that it lies closest to (query-directed probing). What the buckets hold is compared by exact
distances. Buckets and the queries sent to them are cut into blocks, so none is a task of its own.

Neighbours outside all probed buckets are missed: `recall` measures how many on a sample of queries against the exact
search. The exact search stays the default everywhere.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import fixed
from tablewright.operators import neighbors

#: Expected reference rows of a bucket, tables, and buckets looked into for each table and query.
BUCKET_ROWS = 256
TABLES = 8
PROBES = 8
#: Planes of a table at most.
MOST_PLANES = 24


class Planes:
    """Random planes of some tables, and the buckets of points."""

    def __init__(self, d: int, planes: int, tables: int, seed: int) -> None:
        self.planes, self.tables = planes, tables
        self.directions = np.random.default_rng(seed).normal(size=(d, tables * planes))
        self.medians = np.zeros(tables * planes)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Signed distance of each point to each plane: (rows, tables, planes)."""
        return (x @ self.directions - self.medians).reshape(len(x), self.tables, self.planes)

    def codes(self, margins: np.ndarray) -> np.ndarray:
        """Bucket of each point in each table."""
        return (margins > 0) @ (1 << np.arange(self.planes, dtype=np.int64))

    def probes(self, margins: np.ndarray, n: int) -> np.ndarray:
        """(rows, tables, n) buckets in the order of the squared margins of the planes they lie beyond."""
        flips = self._flips(n)
        order = np.argsort(np.abs(margins), axis=2)
        near = np.take_along_axis(np.abs(margins), order, axis=2)[:, :, :len(flips[0])] ** 2
        cost = near @ flips.T.astype(float)
        best = np.argsort(cost, axis=2, kind="stable")[:, :, :n]
        bit = (1 << order[:, :, :len(flips[0])]).astype(np.int64)
        mask = bit @ flips.T.astype(np.int64)  # each flip's planes
        return self.codes(margins)[:, :, None] ^ np.take_along_axis(mask, best, axis=2)

    def _flips(self, n: int) -> np.ndarray:
        """Sets of the nearest planes that can be among the n cheapest: as rows of 0 and 1, the empty set first."""
        width = min(self.planes, max(1, n))
        sets = [c for size in range(min(width, max(1, n.bit_length())) + 1) for c in combinations(range(width), size)
                if math.prod(k + 1 for k in c) <= n]
        return np.array([[int(k in c) for k in range(width)] for c in sets])


def _array(x: pd.Series) -> np.ndarray:
    return np.vstack(x.to_numpy()).astype(np.float64)


def fit_planes(refs: DataFrame, n: int, bucket_rows: int, tables: int, seed: int) -> Planes:
    """Planes for n reference rows (key, x); their medians come from one sketch over all rows."""
    d = refs.select(F.size("x")).first()[0]
    count = min(MOST_PLANES, max(1, round(math.log2(max(2, n / bucket_rows)))))
    planes = Planes(d, count, tables, seed)

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        return pd.Series(list(_array(x) @ planes.directions) if len(x) else [], dtype=object)

    shown = refs.select(project("x").alias("p")).select(*[F.get("p", F.lit(j)).alias(f"p{j}") for j in range(tables * count)])
    medians = shown.approxQuantile(shown.columns, [0.5], 0.01)
    planes.medians = np.array([m[0] for m in medians])
    return planes


def nearest_hashed(queries: DataFrame, refs: DataFrame, k: int, skip_same: bool = False, tables: int = TABLES,
                   probes: int = PROBES, bucket_rows: int = BUCKET_ROWS, block_rows: int = neighbors.BLOCK_ROWS,
                   seed: int = fixed.SEED, n_refs: int | None = None) -> DataFrame:
    """(query, ref, distance, rank) of the k nearest refs found for every query, ties by ref; fewer where the probed
    buckets hold fewer. Inputs as for `neighbors.nearest`."""
    n = refs.count() if n_refs is None else n_refs
    if not n:
        raise ValueError("There are no reference rows.")
    planes = fit_planes(refs, n, bucket_rows, tables, seed)

    @F.pandas_udf("array<long>")
    def own(x: pd.Series) -> pd.Series:
        return pd.Series(list(planes.codes(planes.margins(_array(x)))) if len(x) else [], dtype=object)

    @F.pandas_udf("array<array<long>>")
    def looked_into(x: pd.Series) -> pd.Series:
        found = planes.probes(planes.margins(_array(x)), probes) if len(x) else []
        return pd.Series([list(row) for row in found], dtype=object)

    placed = refs.select("key", "x", F.posexplode(own("x")).alias("t", "code"))
    asked = (queries.select("key", "x", F.posexplode(looked_into("x")).alias("t", "codes"))
             .select("key", "x", "t", F.explode("codes").alias("code")))

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("t", "code").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))

    sizes = blocks(placed, "blocks").join(blocks(asked, "chunks"), ["t", "code"])
    spread = F.xxhash64("key", F.lit("block"))

    def cut(own_count: str, other_count: str) -> tuple[Column, Column]:
        """A row's own part, and every part of the other side."""
        return F.pmod(spread, F.col(own_count)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other_count) - 1))

    chunk, every_block = cut("chunks", "blocks")
    left = asked.join(sizes, ["t", "code"]).select("key", "x", "t", "code", chunk.alias("h"), every_block.alias("b"))
    block, every_chunk = cut("blocks", "chunks")
    right = placed.join(sizes, ["t", "code"]).select(
        F.col("key").alias("ref_key"), F.col("x").alias("ref_x"), "t", "code", block.alias("b"), every_chunk.alias("h"))

    def search(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query": q["key"].iloc[:0], "ref": r["ref_key"].iloc[:0],
                                 "distance": pd.Series(dtype=float)})
        return neighbors._local_top(q["key"].to_numpy(), _array(q["x"]), r["ref_key"].to_numpy(), _array(r["ref_x"]), k,
                                    skip_same)

    by = ["t", "code", "h", "b"]
    kinds = (t.schema["key"].dataType.simpleString() for t in (queries, refs))
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(
        search, "query {}, ref {}, distance double".format(*kinds))
    met = found.groupBy("query", "ref").agg(F.min("distance").alias("distance"))  # by several tables
    order = Window.partitionBy("query").orderBy("distance", "ref")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def recall(queries: DataFrame, refs: DataFrame, k: int, skip_same: bool = False, most_queries: int = 1_000,
           **options) -> DataFrame:
    """(queries, recall): share of the exact k nearest refs that `nearest_hashed` finds, for the `most_queries` queries
    of smallest hash."""
    some = queries.orderBy(F.xxhash64("key"), "key").limit(most_queries).persist(StorageLevel.MEMORY_AND_DISK)
    exact = neighbors.nearest(some, refs, k, skip_same).select("query", "ref")
    found = nearest_hashed(some, refs, k, skip_same, **options).select("query", "ref", F.lit(1).alias("hit"))
    return exact.join(found, ["query", "ref"], "left").agg(
        F.countDistinct("query").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))

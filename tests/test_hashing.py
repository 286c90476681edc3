"""Hashed neighbours: probing order, recall against the exact search, hot buckets."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewright.operators import hashing, neighbors


def points(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, x array<double>").persist()


def test_probes_come_by_margin():
    """The n cheapest sets of planes to cross, by the sum of squared margins, against all sets."""
    rng = np.random.default_rng(1)
    for planes, n in ((1, 1), (1, 5), (3, 4), (5, 8), (7, 12)):
        cutter = hashing.Planes(4, planes, 2, 3)
        x = rng.normal(size=(20, 4))
        margins = cutter.margins(x)
        got = cutter.probes(margins, n)
        for i in range(len(x)):
            for t in range(2):
                cost = {sum(1 << j for j in range(planes) if s >> j & 1): sum(margins[i, t, j] ** 2 for j in range(planes) if s >> j & 1)
                        for s in range(1 << planes)}
                own = int(cutter.codes(margins)[i, t])
                want = sorted(cost, key=cost.get)[:min(n, 1 << planes)]
                assert [int(c) ^ own for c in got[i, t]] == want


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 16)).repeat(100, axis=0) + 0.5 * rng.normal(size=(4000, 16))
    df = points(spark, x)
    row = hashing.recall(df, df, 5, skip_same=True, most_queries=300).first()
    assert row["queries"] == 300 and row["recall"] >= 0.9


@pytest.mark.parametrize("block", [2048, 16])
def test_all_buckets_are_exact(spark, block):
    """With every bucket probed the result is the exact one, also where a third of the rows are equal."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 3))
    x[:50] = x[0]
    df = points(spark, x)
    got = hashing.nearest_hashed(df, df, 4, skip_same=True, tables=2, probes=8, bucket_rows=20, block_rows=block)
    want = neighbors.nearest(df, df, 4, skip_same=True)
    columns = ["query", "rank", "ref"]
    assert sorted(got.select(columns).collect()) == sorted(want.select(columns).collect())


def test_model_and_errors(spark):
    rng = np.random.default_rng(4)
    df = points(spark, rng.normal(size=(200, 2))).withColumn("features", array_to_vector("x")).withColumn(
        "label", (F.get("x", F.lit(0)) > 0).cast("double"))
    model = neighbors.Neighbors.of("key", n_classes=2, search="hashed").fit(df)
    assert model.transform(df).filter("prediction = label").count() > 185
    with pytest.raises(ValueError):
        hashing.nearest_hashed(df.select("key", "x"), df.select("key", "x").limit(0), 3)

"""The distributed ways give what one window or one aggregate over the whole table gives."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright.functions import order as O
from tablewright.functions.student import t_quantile


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all values is one value; some are missing."""
    rng = np.random.default_rng(0)
    return spark.createDataFrame([
        (int(i), float("7") if i % 3 == 0 else float(rng.exponential(50)), float(rng.integers(0, 2)),
         None if i % 5 == 0 else float(rng.normal())) for i in range(4000)], "key long, a double, b double, c double").persist()


def test_selected_quantiles_equal_percentile(skewed, monkeypatch):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0]
    want = O.quantiles(skewed, ["a", "b", "c"], probs, 10**9)
    assert O.quantiles(skewed, ["a", "b", "c"], probs, 0) == want
    # Rough sketches and a tiny fetch limit force widening and narrowing.
    monkeypatch.setattr(O, "SKETCH_ACCURACY", 20)
    monkeypatch.setattr(O, "BRACKET_VALUES", 3)
    assert O.quantiles(skewed, ["a", "b", "c"], probs, 0) == want
    pdf = skewed.toPandas()
    assert np.allclose(want["c"], pdf["c"].dropna().quantile(probs))


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(None,)], "x double")
    assert O.quantiles(empty, ["x"], [0.5]) == {"x": None}
    assert O.quantiles(empty, ["x"], [0.5], 0) == {"x": None}


@pytest.mark.parametrize("groups", [[], ["b"]])
def test_hash_rank_equals_window(skewed, monkeypatch, groups):
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", 50)
    w = Window.partitionBy(*groups).orderBy(F.md5(F.concat(F.lit("1|"), F.col("key").cast("string"))), "key")
    want = skewed.select("key", (F.row_number().over(w) - 1).alias("want"))
    got = O.hash_rank(skewed.select("key", "b"), "key", 4000, 1, groups)
    assert got.join(want, "key").filter("rank <> want").count() == 0 and got.count() == 4000


def test_running_totals_equal_window(skewed, monkeypatch):
    counts = skewed.groupBy("b", "a").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("b").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    want = counts.select("b", "a", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("want"))
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", 100)
    got = O.running_totals(counts, ["b"], "a", {"before": "n"})
    assert got.join(want, ["b", "a"]).filter("before <> want").count() == 0


def test_dense_codes_equal_sorted_positions(spark):
    values = [f"v{i:04d}" for i in np.random.default_rng(1).permutation(3000)]
    df = spark.createDataFrame([(v,) for v in values], "value string").repartition(6)
    got = {r["value"]: r["code"] for r in O.dense_codes(df, ["value"]).collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}


def test_t_quantiles():
    # Published table values of Student's t.
    for df, want in ((1, 12.7062), (2, 4.3027), (4, 2.7764), (9, 2.2622), (29, 2.0452)):
        assert t_quantile(0.975, df) == pytest.approx(want, abs=1e-4)

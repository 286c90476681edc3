"""Correlations of wide tables against pandas, in blocks of any size."""

import numpy as np
import pandas as pd
import pytest

from tablewright.operators import gram
from tablewright.operators.profile import high_correlations


def frame(n, d, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 4))
    x = base[:, rng.integers(0, 4, d)] * rng.choice((1, -2), d) + rng.choice((0.05, 1, 3), d) * rng.normal(size=(n, d))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 0], x[:, 1] = 7.0, np.nan  # a constant and an empty column
    x[:, 2] = 1e9 + x[:, 3]  # far from zero
    x[:n // 2, 4] = 1.0
    x[n // 2:, 5] = np.nan  # constant where column 4 varies
    return pd.DataFrame(x, columns=[f"c{k}" if k % 7 else f"odd.{k} `x" for k in range(d)])


@pytest.mark.parametrize("size,parts", [(64, 1), (5, 4), (1, 3)])
def test_equals_pandas(spark, size, parts):
    data = frame(300, 17, 1)
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in data.to_numpy()],
                               ", ".join(f"`{c.replace('`', '``')}` double" for c in data.columns)).repartition(parts)
    want = data.corr(min_periods=2)
    names = list(data.columns)
    got = {(r["a"], r["b"]): r["r"] for r in gram.wide_correlations(df, names, 0.3, size).collect()}
    expected = {(a, b) for i, a in enumerate(names) for b in names[i + 1:] if abs(want.loc[a, b]) >= 0.3}
    assert set(got) == expected and len(expected) > 10
    assert all(abs(got[p] - want.loc[p]) < 1e-6 for p in expected)


def test_both_ways_agree(spark):
    data = frame(200, 13, 2)
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in data.to_numpy()]
    df = spark.createDataFrame(rows, ", ".join(f"`{c.replace('`', '``')}` double" for c in data.columns))
    wide = {(r["a"], r["b"]): r["pearson"] for r in high_correlations(df, list(data.columns), 0.5).collect()}
    few = {}
    for k in range(0, 13):
        for j in range(k + 1, 13):
            for r in high_correlations(df, [data.columns[k], data.columns[j]], 0.5).collect():
                few[r["a"], r["b"]] = r["pearson"]
    assert wide == few


def test_two_thousand_columns(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 2000))
    x[:, 1999] = x[:, 0] + 0.01 * x[:, 1]
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{k}" for k in range(2000)]))
    got = high_correlations(df, df.columns, 0.95).collect()
    assert ("c0", "c1999") in {(r["a"], r["b"]) for r in got} and len(got) < 50

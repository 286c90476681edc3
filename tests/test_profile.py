import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import profile as P
from tests.conftest import by, rows


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([
        (i, int(rng.integers(18, 80)), float(rng.normal(5000, 1500)), ("SP", "RJ", "MG")[i % 3],
         dt.datetime(2020, 1, 1) + dt.timedelta(days=i), int(i % 10 == 0)) for i in range(100)],
        "customer_id long, age int, income double, city string, signup timestamp, target int").persist()


def test_types_and_flags(people):
    facts = by(P.profile_table(people, "target", id_column="customer_id"), "column")
    assert {c: r["inferred_type"] for c, r in facts.items()} == {
        "customer_id": "numeric", "age": "numeric", "income": "numeric", "city": "categorical",
        "signup": "datetime", "target": "numeric"}
    assert facts["customer_id"]["is_id_like"] and not facts["age"]["is_id_like"]
    assert facts["customer_id"]["role"] == "id" and facts["target"]["is_target"]


def test_statistics_equal_pandas(people):
    s = by(P.numeric_stats(people, ["age", "income"]), "column")
    pdf = people.toPandas()
    for c in ("age", "income"):
        assert s[c]["mean"] == pytest.approx(pdf[c].mean()) and s[c]["std"] == pytest.approx(pdf[c].std())
        assert s[c]["skewness"] == pytest.approx(pdf[c].skew()) and s[c]["kurtosis"] == pytest.approx(pdf[c].kurt())
        assert s[c]["p25"] == pytest.approx(pdf[c].quantile(0.25))


def test_statistics_without_spread_or_values(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None)], "a double, b double")
    s = by(P.numeric_stats(df, ["a", "b"]), "column")
    assert s["a"]["std"] == 0.0 and s["a"]["skewness"] is None and s["b"]["mean"] is None


def test_target_imbalance_and_alerts(people):
    summary = P.class_summary(people, "target").first()
    assert (summary["imbalance_ratio"], summary["minority_class"], summary["majority_class"]) == (9.0, "1", "0")
    assert P.target_kind(people, "income", None) == "regression"
    found = {(r["alert"], r["column"]) for r in rows(P.profile_alerts(
        people.withColumn("half", F.when(F.col("age") > 200, 1)), "target", roles={"time": "nowhere"}))}
    assert ("id_like_column", "customer_id") in found and ("absent_time_column", "nowhere") in found
    assert ("high_missing", "half") in found and ("constant_column", "half") in found


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a double, b string")
    facts = by(P.column_facts(empty), "column")
    assert facts["a"]["pct_missing"] == 0.0 and facts["a"]["inferred_type"] == "constant"
    assert "empty_table" in {r["alert"] for r in rows(P.profile_alerts(empty))}
    assert P.duplicates(empty).first()["n_duplicate_rows"] == 0


def test_date_strings_and_text(spark):
    df = spark.createDataFrame([(f"{i + 1:02d}/02/2021", f"word{i} " * 10, f"2021-03-{i + 1:02d} 10:00:00")
                                for i in range(20)], "d string, t string, s string")
    kinds = P.type_map(P.column_facts(df))
    assert kinds == {"d": "datetime", "t": "text", "s": "datetime"}
    assert P.type_map(P.column_facts(df, sniff_dates=False))["d"] == "text"


def test_missing_treats_nan_as_null(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "a double")
    assert P.missing(df).first()["n_missing"] == 2


def test_duplicates_tell_null_positions_apart(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None), (None, None)], "x string, y string")
    assert P.duplicates(df).first()["n_duplicate_rows"] == 1


def test_content_hash_ignores_order_only(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "a int, b string")
    same, fewer = a.orderBy(F.desc("a")), a.distinct()
    value = P.content_hash(a).first()[0]
    assert P.content_hash(same).first()[0] == value != P.content_hash(fewer).first()[0]
    assert P.content_hash(a.withColumnRenamed("b", "c")).first()[0] != value


def test_nested_columns_have_no_type(spark):
    df = spark.createDataFrame([([1, 2], 3)], "v array<int>, n int")
    assert [r["column"] for r in rows(P.column_facts(df))] == ["n"]


def test_target_must_exist(people):
    with pytest.raises(ValueError):
        P.profile_table(people, "nothing")

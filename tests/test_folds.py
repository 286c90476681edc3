import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablewright.operators import folds as V
from tests.conftest import rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([
        (i, float(i), int(i % 10 < 3), i % 10, dt.datetime(2022, 1, 1) + dt.timedelta(days=i)) for i in range(100)],
        "key long, x double, label int, patient int, date timestamp").persist()


def sizes(folds):
    return sorted(r["n_test"] for r in rows(V.fold_summary(folds)))


def test_kfold_covers_every_row_once_and_repeats(table):
    a = V.assign_folds(table, "key", "kfold")
    b = V.assign_folds(table, "key", "kfold")
    assert sizes(a) == [20] * 5 and a.table.exceptAll(b.table).count() == 0
    assert a.table.select("key").distinct().count() == 100
    other = V.assign_folds(table, "key", "kfold", seed=7)
    assert a.table.exceptAll(other.table).count() > 0


def test_stratified_keeps_the_ratio(table):
    folds = V.assign_folds(table, "key", "stratified_kfold", target="label")
    share = folds.table.join(table, "key").groupBy("fold").agg(F.sum("label").alias("n")).collect()
    assert [r["n"] for r in share] == [6] * 5


def test_groups_stay_whole(table):
    for shuffle in (True, False):
        folds = V.assign_folds(table, "key", "group_kfold", group_column="patient", shuffle=shuffle)
        V.check_folds(folds, table, "patient")
        assert folds.n_splits == 5 and sizes(folds) == [20] * 5


def test_groups_may_miss_and_keys_may_not(spark):
    rows = spark.createDataFrame([(i, i % 4 or None, i % 2) for i in range(40)], "key int, patient int, label int")
    for shuffle in (True, False):
        folds = V.assign_folds(rows, "key", "group_kfold", group_column="patient", shuffle=shuffle, n_splits=2)
        assert sizes(folds) == [20] * 2
    nameless = rows.withColumn("key", F.expr("nullif(key, 3)"))
    with pytest.raises(ValueError, match="1 rows have no 'key'"):
        V.assign_folds(nameless, "key", "kfold")


def test_time_split_never_trains_on_the_future(table):
    folds = V.assign_folds(table, "key", time_column="date", n_splits=4)
    joined = folds.table.join(table, "key").groupBy("fold", "part").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    span = {(r["fold"], r["part"]): (r["a"], r["b"]) for r in joined.collect()}
    assert all(span[(i, "train")][1] < span[(i, "test")][0] for i in range(4)) and sizes(folds) == [20] * 4


def test_holdout_and_attach(spark, table, tmp_path):
    folds = V.assign_folds(table, "key", "holdout", target="label", task_type="classification")
    placed = folds.attach(table, str(tmp_path / "h"))
    test, train = folds.side(placed, 0, "test"), folds.side(placed, 0, "train")
    assert (test.count(), train.count(), test.agg(F.sum("label")).first()[0]) == (20, 80, 6)
    kfold = V.assign_folds(table, "key", "kfold")
    placed = kfold.attach(table, str(tmp_path / "k"))
    for i in range(5):
        assert kfold.side(placed, i, "test").exceptAll(kfold.side(table, i, "test").select(*table.columns)).count() == 0
        assert kfold.side(placed, i, "train").count() == 80


def test_fallbacks_and_limits(spark, table):
    assert V.assign_folds(table, "key", "stratified_kfold", target="x", task_type="regression").strategy == "kfold"
    lonely = table.withColumn("label", (F.col("key") == 0).cast("int"))
    assert V.assign_folds(lonely, "key", "stratified_kfold", target="label").alerts
    few = V.assign_folds(table, "key", "group_kfold", group_column="label", n_splits=5)
    assert few.n_splits == 2 and few.alerts
    for bad in (dict(strategy="nonsense"), dict(strategy="kfold", n_splits=1), dict(strategy="time_split"),
                dict(strategy="group_kfold"), dict(strategy="kfold", target="absent")):
        with pytest.raises(ValueError):
            V.assign_folds(table, "key", **bad)
    with pytest.raises(ValueError):
        V.assign_folds(table.limit(1), "key", "kfold")
    with pytest.raises(ValueError):
        V.assign_folds(table.withColumn("label", F.expr("nullif(label, 1)")), "key", "stratified_kfold", target="label")
    with pytest.raises(ValueError):
        V.assign_folds(table.withColumn("date", F.lit("not a date")), "key", time_column="date")


def test_check_finds_contamination(spark, table):
    folds = V.assign_folds(table, "key", "kfold")
    folds.table = folds.table.unionByName(spark.createDataFrame([(0, 9)], "key long, fold int"))
    with pytest.raises(ValueError):
        V.check_folds(folds)
    good = V.assign_folds(table, "key", "kfold")
    with pytest.raises(ValueError):
        V.check_folds(good, table.filter("key > 3"))
    with pytest.raises(ValueError):
        V.check_folds(good, table, "patient")


def test_default_strategy():
    assert [V.default_strategy("classification"), V.default_strategy("regression"), V.default_strategy("classification", "t", "g"),
            V.default_strategy("regression", None, "g")] == ["stratified_kfold", "kfold", "time_split", "group_kfold"]

import datetime as dt
import json

import pytest
from pyspark.ml.functions import vector_to_array

from tablewright.functions import order as O
from tablewright.operators import features as X
from tablewright.operators.profile import profile_table


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([
        (i, 20.0 + i % 30 if i else None, 1000.0 + 10 * i, ("SP", "RJ", "MG")[i % 3], dt.datetime(2021, 1, 1 + i % 28),
         1, i % 2) for i in range(40)],
        "customer_id long, age double, income double, city string, signup timestamp, const int, label int").persist()


def test_groups_and_names(table):
    facts = profile_table(table, "label", id_column="customer_id").collect()
    groups, left = X.column_groups(facts, "label")
    assert groups == {"numeric": ["age", "income"], "categorical": ["city"], "datetime": ["signup"], "text": []}
    assert set(left) == {"customer_id", "const", "label"}
    model = X.feature_encoder(table, "label", facts).fit(table)
    names = model.feature_names()
    assert names[:5] == ["age", "income", "city_MG", "city_RJ", "city_SP"] and len(names) == 12
    out = model.transform(table).select(vector_to_array("features").alias("v")).collect()
    assert all(len(r["v"]) == 12 for r in out)
    assert sum(r["v"][1] for r in out) == pytest.approx(0.0, abs=1e-9)


def test_fit_sees_training_rows_only(table):
    encoder = X.TableEncoder(groups=json.dumps({"numeric": ["income"], "onehot": ["city"]}))
    model = encoder.fit(table.filter("customer_id < 10 and city <> 'MG'"))
    coded = {r["customer_id"]: r for r in model.encode_columns(table, ["customer_id"]).collect()}
    assert model.fitted["numeric"][0]["centre"] < 1100
    assert (coded[2]["city_RJ"], coded[2]["city_SP"]) == (0.0, 0.0)


@pytest.mark.parametrize("scaling", ["minmax", "robust", "standard"])
def test_constant_columns_scale_to_zero(spark, scaling):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "k int, c double")
    model = X.TableEncoder(groups=json.dumps({"numeric": ["c"]}), options=json.dumps({"scaling": scaling})).fit(df)
    assert {r["c"] for r in model.encode_columns(df, ["k"]).collect()} == {0.0}


def test_codes_beyond_one_task(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"a{i % 50:02d}", f"b{i % 7}") for i in range(200)], "k int, a string, b string")
    want = sorted(map(tuple, X.ordinal_codes(df, ["a", "b"]).collect()))
    monkeypatch.setattr(X, "CODES_PER_TASK", 0)
    assert sorted(map(tuple, X.ordinal_codes(df, ["a", "b"]).collect())) == want


def test_saved_encoder(spark, table, tmp_path):
    encoder = X.TableEncoder(groups=json.dumps({"numeric": ["age"], "ordinal": ["city"]}))
    model = encoder.fit(table)
    model.write().overwrite().save(str(tmp_path / "e"))
    again = X.TableEncoderModel.load(str(tmp_path / "e"))
    a, b = (m.encode_columns(table, ["customer_id"]) for m in (model, again))
    assert a.exceptAll(b).count() == 0 and again.feature_names() == ["age", "city"]


def test_options_and_errors(table):
    assert X.resolve_options({"categorical_encoding": "one_hot"})["categorical_encoding"] == "onehot"
    for bad in ({"scaling": "huge"}, {"text_strategy": "x"}, {"what": 1}):
        with pytest.raises(ValueError):
            X.resolve_options(bad)
    with pytest.raises(ValueError):
        X.feature_encoder(table.select("const", "label"), "label")


def test_spread_leaves_wide_tables(spark):
    wide = spark.range(100).repartition(64)
    assert O.spread(wide).rdd.getNumPartitions() == 64

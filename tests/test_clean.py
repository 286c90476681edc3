import pytest

from tablewright.operators import quality as Q
from tablewright.operators.clean import Cleaner, CleaningModel, clean
from tests.conftest import by, rows


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(
        [(25.0, 3000.0, "SP", 1, 0), (30.0, 5000.0, "RJ", 1, 1), (None, 4000.0, "SP", 1, 0),
         (45.0, None, None, 1, 1), (30.0, 5000.0, "SP", 1, 0), (30.0, 5000.0, "SP", 1, 0)],
        "age double, income double, city string, const int, label int")


def ops(model):
    return {(a[1], a[2]) for a in model.steps["actions"]}


def test_whole_cleaning(messy):
    out, model = clean(messy, "label")
    assert ops(model) == {("drop_constant_column", "const"), ("median_imputation", "age"),
                          ("median_imputation", "income"), ("most_frequent_imputation", "city"),
                          ("drop_duplicates", None)}
    assert model.steps["fills"] == {"age": 30.0, "income": 5000.0, "city": "SP"}
    assert out.count() == 5 and out.columns == ["age", "income", "city", "label"]
    assert out.filter("age is null or income is null or city is null").count() == 0


def test_report(messy):
    found = rows(Q.quality_report(messy, "label"))
    kinds = {(r["finding"], r["column"]): r["n"] for r in found}
    assert kinds[("missing", "age")] == 1 and kinds[("duplicate_rows", None)] == 1
    assert ("constant_column", "const") in kinds and kinds[("target_missing", "label")] == 0


def test_rare_category(spark):
    df = spark.createDataFrame([(i, "a") for i in range(199)] + [(199, "rare")], "i int, c string")
    out, model = clean(df, rare_category_threshold=0.01)
    assert [r["value"] for r in rows(Q.rare_categories(df, ["c"]))] == ["rare"]
    assert out.filter("c = '__rare__'").count() == 1 and out.filter("c = 'a'").count() == 199
    # Unseen in fitting counts as rare; missing stays missing where nothing was imputed.
    later = spark.createDataFrame([(1, "new"), (2, None), (3, "a")], "i int, c string")
    assert [r["c"] for r in model.transform_rows(later).orderBy("i").collect()] == ["__rare__", None, "a"]


def test_imputed_label_is_not_rare(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(300)] + [(300, None), (301, "z")], "i int, c string")
    out, _ = clean(df, categorical_imputation="constant")
    assert out.filter("c = '__missing__'").count() == 1 and out.filter("c = '__rare__'").count() == 1


def test_outliers(spark):
    df = spark.createDataFrame([(float(x),) for x in (10, 11, 12, 13, 14, 15, 16, 1000)], "x double")
    assert [r["n"] for r in rows(Q.outliers(df, ["x"]))] == [1]
    clipped, model = clean(df, outlier_strategy="clip")
    assert max(r["x"] for r in rows(clipped)) == model.steps["clip"]["x"][1] < 1000
    removed, _ = clean(df, outlier_strategy="remove")
    assert removed.count() == 7


def test_target_is_left_alone(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, None), (3.0, 1000.0), (4.0, 1.0), (5.0, 2.0), (6.0, 1.5)], "x double, y double")
    out, model = clean(df, "y", outlier_strategy="clip")
    assert out.count() == 5 and max(r["y"] for r in rows(out)) == 1000.0
    assert ("drop_missing_target_rows", "y") in ops(model)


def test_empty_column_and_impossible_values(spark):
    df = spark.createDataFrame([(1.0, 1, 25), (2.0, 2, 30), (None, 3, 200), (None, 4, 40), (None, 5, 35)],
                               "gone double, y int, age int")
    out, model = clean(df, impossible_ranges={"age": {"min": 0, "max": 120}})
    assert "gone" not in out.columns and ("coerce_impossible_to_nan", "age") in ops(model)
    assert {r["age"] for r in rows(out)} == {25.0, 30.0, 32.5, 40.0, 35.0}


def test_strings(spark):
    df = spark.createDataFrame([(f" {i}\t", " a ") for i in range(19)] + [("oops", "")], "n string, s string")
    out, model = clean(df, categorical_imputation="none", drop_duplicates=False, drop_constant=False)
    assert dict(out.dtypes)["n"] == "double" and {r["s"] for r in rows(out)} == {"a", None}
    assert {("strip_whitespace", "n"), ("strip_whitespace", "s"), ("coerce_to_numeric", "n")} <= ops(model)
    assert ("missing_left", "s") in {(a[0], a[1]) for a in model.steps["alerts"]}


def test_numeric_looking_target_stays_text(spark):
    df = spark.createDataFrame([(str(i % 2), float(i)) for i in range(20)], "y string, x double")
    out, _ = clean(df, "y")
    assert dict(out.dtypes)["y"] == "string"


def test_saved_model_cleans_alike(spark, messy, tmp_path):
    model = Cleaner.of("label", drop_duplicates=False).fit(messy)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = CleaningModel.load(str(tmp_path / "m"))
    assert again.transform(messy).exceptAll(model.transform(messy)).count() == 0
    sides = by(model.summary(messy), "side")
    assert sides["before"]["n_cols"] == 5 and sides["after"]["n_cols"] == 4


@pytest.mark.parametrize("bad", [{"numeric_imputation": "guess"}, {"outlier_strategy": "hide"},
                                 {"categorical_imputation": "x"}, {"rare_category_strategy": "x"}, {"nonsense": 1}])
def test_unknown_options(bad):
    with pytest.raises(ValueError):
        Cleaner.of(**bad)

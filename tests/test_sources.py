import pytest

from tablewright.sources import records as R
from tablewright.sources import tables as S


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,name,score,flag,mixed\n1,"a, ""b""",1.5,True,1\n2,NA,nan,False,x\n3,None,,True,2\n')
    df = S.load(spark, "csv", str(path))
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("score", "double"), ("flag", "boolean"), ("mixed", "string")]
    got = df.orderBy("id").collect()
    assert got[0]["name"] == 'a, "b"' and [r["name"] for r in got[1:]] == [None, None]
    assert [r["score"] for r in got] == [1.5, None, None]


def test_given_table_goes_first(spark):
    df = spark.createDataFrame([(float("nan"),)], "x double")
    assert S.load(spark, "csv", "/nowhere", df).first()["x"] is None


def test_errors(spark):
    for bad in (dict(), dict(source_type="csv"), dict(source_type="postgres", source_uri="x")):
        with pytest.raises(ValueError):
            S.load(spark, **bad)
    with pytest.raises(TypeError):
        S.load(spark, dataframe=[1])


def test_records_of_many_parents_lie_in_few_folders(spark, tmp_path):
    store = R.RecordStore(spark, str(tmp_path / "records"))
    parents = [None, *map(str, range(200))]
    rows = [dict(id=i, experiment_id=parents[i % len(parents)], agent_name="a") for i in range(500)]
    for part in (rows[:250], rows[250:]):
        store.append("agent_events", part)
    assert len(list((tmp_path / "records" / "agent_events").glob("*=*"))) <= R.BUCKETS
    assert sorted((r["id"], r["experiment_id"]) for r in store.table("agent_events").collect()) == [
        (r["id"], r["experiment_id"]) for r in rows]
    assert sorted(r["id"] for r in store.events_of("7").collect()) == [r["id"] for r in rows if r["experiment_id"] == "7"]
    assert store.events_of("none").count() == 0

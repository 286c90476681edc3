"""Duplicates on a stream: within the delay, over micro-batches, and after a batch that failed."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablewright.operators.clean import Cleaner
from tablewright.streaming import monitor

SCHEMA = "id long, ts timestamp, x double"


def rows(first, last):
    start = dt.datetime(2024, 1, 1)
    return [(i, start + dt.timedelta(minutes=i), float(i % 7)) for i in range(first, last)]


@pytest.fixture()
def source(spark, tmp_path):
    """Three files, read one after the other; the second repeats half of the first."""
    for k, part in enumerate((rows(0, 20) + rows(5, 10), rows(10, 40), rows(38, 45) + rows(38, 45))):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_duplicates_are_dropped_over_batches(spark, source, tmp_path):
    model = Cleaner.of().fit(spark.createDataFrame(rows(0, 45), SCHEMA))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    monitor.write_stream(monitor.clean_stream(source, model, "ts", "2 hours"), out, state).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(r.id for r in got.collect()) == list(range(45)) and got.select("batch").distinct().count() > 1
    with pytest.raises(ValueError):
        monitor.clean_stream(spark.createDataFrame(rows(0, 3), SCHEMA), model, "ts")
    assert monitor.clean_stream(source, model).isStreaming


def test_a_failed_batch_runs_again(spark, source, tmp_path):
    """The second micro-batch dies after it has written; started again, the stream gives every row once."""
    model = Cleaner.of().fit(spark.createDataFrame(rows(0, 45), SCHEMA))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    cleaned = monitor.clean_stream(source, model, "ts", "2 hours")

    def dies(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception):
        (cleaned.writeStream.foreachBatch(dies).option("checkpointLocation", state).trigger(availableNow=True).start()
         .awaitTermination())
    monitor.write_stream(cleaned, out, state).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(45))

"""The fitted steps on a stream: cleaning, prediction, and drift per window of event time.

The stream keeps counters per window and bin and writes those that changed; drift is a batch query over the newest
counter of each. So the last window is there without waiting for a later row to close it.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions import fixed
from tablewright.functions.exprs import as_text, col, dtype_of, fingerprint, nan_to_null
from tablewright.operators.clean import CleaningModel
from tablewright.operators.drift import _bin


#: Categories of a column that a stream may watch.
MOST_ITEMS = 10_000


def clean_stream(stream: DataFrame, model: CleaningModel, time_column: str | None = None,
                 delay: str = "1 hour") -> DataFrame:
    """Row-wise cleaning; with a time column, rows that repeat an earlier one within ``delay`` are dropped too.

    Rows are told apart by a 128-bit fingerprint of all columns, so state is 16 bytes a row, kept for the delay only.
    Without a time column duplicates stay, as their state would grow with the stream.
    """
    rows = model.transform_rows(stream)
    if time_column is None:
        return rows
    if not rows.isStreaming:
        raise ValueError("Duplicates of a batch table are dropped by the cleaning model itself.")
    marked = rows.withColumn("_row", fingerprint(rows.columns)).withWatermark(time_column, delay)
    return marked.dropDuplicatesWithinWatermark(["_row"]).drop("_row")


def write_stream(stream: DataFrame, out: str, checkpoint: str):
    """Start a query that appends each micro-batch to its own folder below ``out``, so that a batch which runs again
    after a failure replaces itself."""
    def emit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (stream.writeStream.outputMode("append").foreachBatch(emit).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def predict_stream(stream: DataFrame, model: PipelineModel) -> DataFrame:
    return model.transform(nan_to_null(stream))


def window_counts(stream: DataFrame, reference: DataFrame, time_column: str, window: str, delay: str) -> DataFrame:
    """(window_start, column, item, n) of the monitored columns, late rows up to ``delay``.

    State is one counter per window and bin or category, whatever the number of rows; a column with more than
    MOST_ITEMS categories in the reference is refused, as its state would grow with the rows.
    """
    wide = reference.groupBy("column").count().filter(F.col("count") > MOST_ITEMS).select("column").collect()
    if wide:
        raise ValueError(f"Too many categories to watch on a stream: {sorted(r['column'] for r in wide)}.")
    stream = nan_to_null(stream)
    edges: dict[str, list[float]] = {}
    for r in reference.filter(F.col("kind") == "numeric").select("column", "lower").collect():
        edges.setdefault(r["column"], [])
        if r["lower"] is not None:
            edges[r["column"]].append(r["lower"])
    names = [r["column"] for r in reference.filter(F.col("kind") == "categorical").select("column").distinct().collect()]
    items = {c: _bin(c, sorted(e)) for c, e in edges.items() if c in stream.columns}
    items.update({c: as_text(col(c), dtype_of(stream, c)) for c in names if c in stream.columns})
    moment = col(time_column).cast("timestamp").alias("_at")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), e.alias("item")) for c, e in items.items()])
    return (stream.select(moment, F.explode(pairs).alias("p")).select("_at", "p.column", "p.item")
            .filter(F.col("item").isNotNull()).withWatermark("_at", delay)
            .groupBy(F.window("_at", window).alias("w"), "column", "item")
            .agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "column", "item", "n"))


def window_psi(counts: DataFrame, reference: DataFrame, threshold: float = fixed.PSI_THRESHOLD) -> DataFrame:
    """(window_start, column, psi, drifted) of each window in the counters."""
    by = ["window_start", "column"]
    totals = counts.groupBy(*by).agg(F.sum("n").alias("all"))
    floor = F.lit(fixed.PSI_FLOOR)
    expected = totals.join(reference.select("column", "item", "expected"), "column")
    both = expected.join(counts, [*by, "item"], "full_outer")
    # Items the reference lacks come from the counts alone; their total is looked up.
    both = both.drop("all").join(totals, by)
    a = F.greatest(F.coalesce(F.col("n") / F.col("all"), floor), floor)
    e = F.greatest(F.coalesce("expected", floor), floor)
    return both.groupBy(*by).agg(F.round(F.sum((a - e) * F.log(a / e)), 6).alias("psi")).withColumn(
        "drifted", F.col("psi") >= threshold)


def drift_stream(stream: DataFrame, reference: DataFrame, time_column: str, out: str, checkpoint: str,
                 window: str = "1 day", delay: str = "1 hour"):
    """Start a query that writes the changed counters of every micro-batch below ``out``; see stream_drift.

    Each micro-batch writes its own folder, so a batch that runs again replaces itself. Rows more than ``delay`` behind
    the newest are late and left out; for files in any order, ``delay`` is the span of their times.
    """
    counts = window_counts(stream, reference, time_column, window, delay)

    def emit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (counts.writeStream.outputMode("update").foreachBatch(emit)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_drift(spark: SparkSession, out: str, reference: DataFrame,
                 threshold: float = fixed.PSI_THRESHOLD) -> DataFrame:
    """(window_start, column, psi, drifted) of every window that the stream has written counters of."""
    by = ["window_start", "column", "item"]
    newest = spark.read.parquet(out).groupBy(*by).agg(F.max_by("n", "batch").alias("n"))
    return window_psi(newest, reference, threshold)

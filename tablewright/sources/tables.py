"""Reading and writing tables and fitted pipelines."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions import fixed
from tablewright.functions.exprs import all_of, col, nan_to_null, stack_aggregates

SOURCE_TYPES = ("csv", "parquet")


def load(spark: SparkSession, source_type: str | None = None, source_uri: str | None = None,
         dataframe: DataFrame | None = None) -> DataFrame:
    """A given DataFrame, else the CSV or Parquet table at ``source_uri``."""
    if dataframe is not None:
        if not isinstance(dataframe, DataFrame):
            raise TypeError("dataframe must be a Spark DataFrame.")
        table = dataframe
    else:
        kind = (source_type or "").strip().lower()
        if not source_uri:
            raise ValueError("Give a dataframe or a source_uri.")
        if kind not in SOURCE_TYPES:
            raise ValueError(f"Unknown source_type '{kind}'; one of {SOURCE_TYPES}.")
        table = read_csv(spark, source_uri) if kind == "csv" else spark.read.parquet(source_uri)
    if not table.columns:
        raise ValueError("The table has no columns.")
    return nan_to_null(table)


def read_csv(spark: SparkSession, uri: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header. NA spellings become NULL first, then types are inferred.

    A column is whole, decimal or boolean if all its values are; one aggregate decides for
    all columns, so the files are read once to infer and once to use. ``multi_line`` allows
    line ends inside quotes; such files cannot be split between tasks.
    """
    text = spark.read.csv(uri, header=True, inferSchema=False, quote='"', escape='"',
                          multiLine=multi_line)
    if not text.columns:
        raise ValueError("The table has no columns.")
    text = text.select([
        F.when(col(c).isin(*fixed.NA_SPELLINGS), None).otherwise(col(c)).alias(c)
        for c in text.columns])
    fits = {
        "bigint": lambda c: F.trim(c).rlike(r"^[+-]?\d{1,18}$"),
        "double": lambda c: F.trim(c).rlike(
            r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI]nf(inity)?)$"),
        "boolean": lambda c: c.isin("True", "TRUE", "true", "False", "FALSE", "false"),
    }
    rows = stack_aggregates(text, [
        (c, {"n": F.count(col(c)),
             **{name: F.count_if(test(col(c))) for name, test in fits.items()}})
        for c in text.columns]).collect()
    chosen = {r["column"]: next((k for k in fits if r["n"] and r[k] == r["n"]), None) for r in rows}
    return text.select([
        (F.trim(col(c)).try_cast(chosen[c]).alias(c) if chosen[c] else col(c)) for c in text.columns])


def preview(df: DataFrame, key: str, n: int = 15) -> DataFrame:
    """The first rows by ``key``: a top-n per partition, merged."""
    return df.orderBy(col(key)).limit(n)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def save_pipeline(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def artifact_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file of a saved pipeline."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))
    return files.filter(all_of([~F.col("path").endswith("_SUCCESS")])).select(
        F.col("path").alias("file"), F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"))


def artifact_digest(spark: SparkSession, path: str) -> DataFrame:
    """One SHA-256 over the sorted digests of a saved pipeline's files (a few per stage)."""
    return artifact_files(spark, path).agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"),
        F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("sha256"))), 256).alias("sha256"))

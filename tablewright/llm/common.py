"""Shared small helpers of the text operators: words, row keys, shared folders, sizes."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the control characters from tab to carriage return.
GAP = r"[\x20\x09-\x0D]+"
#: A character that belongs to a word.
WORD_CHAR = r"[^\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in order; none of a NULL text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row, also where body's lambdas use it many times.

    Without it the optimizer may put the value's expression itself into each lambda.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def full_text(text: Column) -> Column:
    """The text, empty where it is NULL."""
    return F.coalesce(text, F.lit(""))


def packed(docs: DataFrame) -> Column:
    """All columns of a table as one struct, whatever their names; getField takes them out again."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def numbered(docs: DataFrame) -> DataFrame:
    """The table with its columns called c0, c1 and so on, as mapInArrow takes no dots or backticks in names."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on equal keys, NULL equal to NULL; the right table's keys go, its other columns must not clash."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(named, condition, how).drop(*[f"_right_{k}" for k in keys])


def shared_folder(spark: SparkSession, given: str | None = None) -> str:
    """A new folder name below the shared folder: the given one, or the session's spark.checkpoint.dir.

    Where neither is set, only a local session gets one, below its warehouse folder.
    """
    root = given or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder that all machines share.")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, given: str | None = None) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends in files that outlive executors."""
    path = shared_folder(df.sparkSession, given)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import written

#: Rounds are logarithmic in the longest chain; a run that needs more has a fault.
MOST_ROUNDS = 60


def _stars(links: DataFrame) -> DataFrame:
    """One round. links: distinct (a, b) with a > b; every node is tied to the smallest node it sees."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = (both.filter(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
             .filter(F.col("a") > F.col("b")).distinct())
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a")
    return (small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))).filter(F.col("a") > F.col("b")).distinct())


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, folder: str | None = None) -> DataFrame:
    """(node, root) for every node in links (a, b): root is the smallest node reachable.

    Each round is written to the shared folder, so nothing depends on executors that may be lost. Only a row count
    and a checksum reach the driver.
    """
    now = written(links.filter(F.col("a") != F.col("b"))
                  .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder)
    before = _state(now)
    for _ in range(MOST_ROUNDS):
        if before[0] == 0:
            break
        now = written(_stars(now), folder)
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("The stars did not settle.")
    children = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return children.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

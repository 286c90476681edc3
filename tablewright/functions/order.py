"""Exact order statistics, ranks and running totals without a one-task window.

* ``quantiles``: at small size one ``percentile`` aggregate; above it the ranks are
  bracketed by a sketch and only the values inside the (thin) brackets are grouped, so a
  large column is scanned, not shuffled.
* ``hash_rank``: rows ordered by a hash are bucketed by its leading digits, which spreads
  evenly whatever the data; a bucket's offset is the count of the lower buckets.
* ``running_totals``: rows (already one per value) are cut into ranges by a sketch.
* ``dense_codes``: range-partitioned sort, offsets per partition, cut by a checkpoint.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.functions.exprs import any_of, col, hash_order, stack_aggregates
from tablewright.session import shared_path

# Cells (rows x columns) up to which the state of `percentile` is held by one task.
PERCENTILE_CELLS = 1_000_000
# Distinct bracket values fetched by the driver at most; thicker brackets are narrowed again.
BRACKET_VALUES = 200_000
SKETCH_ACCURACY = 20_000
ROWS_PER_BUCKET = 500_000


def _interpolate(low: float, high: float, fraction: float) -> float:
    return low if low == high else (1 - fraction) * low + fraction * high


def quantiles(df: DataFrame, columns: list[str], probs: list[float],
              max_cells: int | None = None) -> dict[str, list[float] | None]:
    """Exact linear-interpolated quantiles; None for a column without values."""
    max_cells = PERCENTILE_CELLS if max_cells is None else max_cells
    if not columns:
        return {}
    values = df.select([col(c).cast("double").alias(c) for c in columns])
    if values.count() * len(columns) <= max_cells:
        rows = stack_aggregates(values, [
            (c, {"q": F.percentile(col(c), F.array(*map(F.lit, probs)))}) for c in columns
        ]).collect()
        return {r["column"]: (None if r["q"] is None else list(r["q"])) for r in rows}
    return _selected_quantiles(values, columns, probs)


def _ranks(p: float, n: int) -> tuple[int, int]:
    position = p * (n - 1)
    return math.floor(position), math.ceil(position)


def _selected_quantiles(values: DataFrame, columns: list[str], probs: list[float]):
    """Quantiles by rank selection: a sketch brackets each, exact counts pick it.

    Scans of the columns only: one for the sketches, one for the counts below the brackets,
    one for the values inside. A wrong or thick bracket costs further rounds, never the result.
    """
    slack = 2.0 / SKETCH_ACCURACY
    edges = [min(1.0, max(0.0, p + s)) for p in probs for s in (-slack, slack)]
    rows = stack_aggregates(values, [
        (c, {"n": F.count(col(c)), "lo": F.min(col(c)), "hi": F.max(col(c)),
             "q": F.percentile_approx(col(c), F.array(*map(F.lit, edges)), F.lit(SKETCH_ACCURACY))})
        for c in columns]).collect()
    facts = {r["column"]: r for r in rows}
    brackets = {}
    for c in columns:
        if facts[c]["n"]:
            for i, p in enumerate(probs):
                brackets[(c, _ranks(p, facts[c]["n"]))] = (facts[c]["q"][2 * i], facts[c]["q"][2 * i + 1])
    ends = {c: (facts[c]["lo"], facts[c]["hi"]) for c in columns}
    found = order_statistics(values, brackets, ends)
    result = {}
    for c in columns:
        n = facts[c]["n"]
        if not n:
            result[c] = None
            continue
        result[c] = [_interpolate(found[c][_ranks(p, n)[0]], found[c][_ranks(p, n)[1]],
                                  p * (n - 1) - _ranks(p, n)[0]) for p in probs]
    return result


def order_statistics(values: DataFrame, brackets: dict, ends: dict) -> dict[str, dict[int, float]]:
    """The values at 0-based ranks of (double) columns, exactly.

    ``brackets`` maps (column, ranks) to a first guess (low, high); ``ends`` has the least and
    the largest value per column. Values in a bracket are grouped before they are fetched, so
    one value shared by many rows is one row.
    """
    found: dict[str, dict[int, float]] = {c: {} for c, _ in brackets}
    while brackets:
        keys = sorted(brackets)
        below = values.agg(*[
            e for i, (c, _) in enumerate(keys)
            for e in (F.count_if(col(c) < brackets[keys[i]][0]).alias(f"b{i}"),
                      F.count_if(col(c) <= brackets[keys[i]][1]).alias(f"u{i}"))
        ]).first()
        inside, pending = [], {}
        for i, (c, ranks) in enumerate(keys):
            low, high = brackets[(c, ranks)]
            start, end = below[f"b{i}"], below[f"u{i}"]
            if ranks[0] < start or ranks[-1] >= end:  # the sketch was off: widen
                pending[(c, ranks)] = (ends[c][0] if ranks[0] < start else low,
                                       ends[c][1] if ranks[-1] >= end else high)
            elif low == high:
                found[c].update(dict.fromkeys(ranks, low))
            else:
                inside.append((i, c, ranks, low, high, start))
        if inside:
            tagged = F.array_compact(F.array(*[
                F.when((col(c) >= low) & (col(c) <= high),
                       F.struct(F.lit(i).alias("i"), col(c).alias("v")))
                for i, c, _, low, high, _ in inside]))
            touched = [(col(c) >= low) & (col(c) <= high) for _, c, _, low, high, _ in inside]
            grouped = (values.filter(any_of(touched)).select(F.explode(tagged).alias("t"))
                       .select("t.i", "t.v").groupBy("i", "v").count())
            fetched = grouped.limit(BRACKET_VALUES + 1).collect()
            if len(fetched) > BRACKET_VALUES:
                pending.update(_narrowed(grouped, inside))
            else:
                histogram: dict[int, list[tuple[float, int]]] = {}
                for row in fetched:
                    histogram.setdefault(row["i"], []).append((row["v"], row["count"]))
                for i, c, ranks, _, _, start in inside:
                    for v, k in sorted(histogram.get(i, [])):
                        found[c].update({r: v for r in ranks if start <= r < start + k})
                        start += k
        brackets = pending
    return found


def _narrowed(grouped: DataFrame, inside) -> dict:
    """Smaller brackets, one per rank: the range of distinct bracket values that holds it."""
    cuts = {r["i"]: sorted(set(r["q"])) for r in grouped.groupBy("i").agg(
        F.percentile_approx("v", F.array(*[F.lit(k / 200) for k in range(201)]), F.lit(2_000)).alias("q")).collect()}
    edges = F.create_map(*[x for i, q in cuts.items() for x in (F.lit(i), F.array(*map(F.lit, q)))])
    slot = F.size(F.filter(edges[F.col("i")], lambda x: x <= F.col("v")))
    slots: dict[int, list] = {}
    for r in grouped.groupBy("i", slot.alias("s")).agg(
            F.sum("count").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
        slots.setdefault(r["i"], []).append((r["lo"], r["hi"], r["n"]))
    smaller = {}
    for i, c, ranks, _, _, start in inside:
        for r in ranks:
            at = start
            for low, high, n in sorted(slots[i]):  # least and largest value: always shrinks
                if r < at + n:
                    smaller[(c, (r,))] = (low, high)
                    break
                at += n
    return smaller


def hash_digits(n_rows: int) -> int:
    """Leading md5 digits that make buckets of about ROWS_PER_BUCKET rows."""
    return max(1, min(6, math.ceil(math.log(max(n_rows / ROWS_PER_BUCKET, 1.0001), 16))))


def hash_rank(df: DataFrame, key: str, n_rows: int, seed: int, by: list[str] | None = None,
              name: str = "rank") -> DataFrame:
    """0-based rank of every row by (md5(seed|key), key), within ``by`` if given.

    Same ranks as ``row_number() over (partition by ... order by ...) - 1``; the sort runs
    in buckets of the hash, so neither the table nor a huge class ends in one task. The
    ``by`` columns hold no NULL; a NULL key has the hash of an empty one.
    """
    by = by or []
    hashed = df.withColumn("_h", F.coalesce(hash_order(seed, col(key)), F.md5(F.lit(f"{seed}|")))).withColumn(
        "_b", F.substring("_h", 1, hash_digits(n_rows)))
    # At most classes x 16^digits rows, i.e. the table divided by ROWS_PER_BUCKET.
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (hashed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
               .select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o")))
    inside = Window.partitionBy(*by, "_b").orderBy("_h", col(key))
    joined = hashed.withColumn("_r", F.row_number().over(inside) - 1)
    # Same keys as the window, so its partitioning serves the join as well.
    return joined.join(offsets, [*by, "_b"]).select(
        *[col(c) for c in df.columns], (F.col("_r") + F.col("_o")).alias(name))


def range_cuts(df: DataFrame, order: str, parts: int) -> list[float]:
    """Strictly rising cut points that split ``order`` into about equal ranges."""
    probs = [i / parts for i in range(1, parts)]
    if not probs:
        return []
    cuts = df.agg(F.percentile_approx(
        col(order), F.array(*map(F.lit, probs)), F.lit(max(1000, 4 * parts)))).first()[0]
    return sorted(set(cuts or []))


def running_totals(df: DataFrame, by: list[str], order: str, sums: dict[str, str],
                   n_rows: int | None = None) -> DataFrame:
    """Sums over all rows of the same ``by`` with a strictly smaller ``order``.

    ``df`` holds one row per (by, order), i.e. equal values were aggregated before, so no
    single value can fill a range. ``sums`` maps output name to input column.
    """
    n = df.count() if n_rows is None else n_rows
    parts = max(1, math.ceil(n / ROWS_PER_BUCKET))
    cuts = range_cuts(df, order, parts) if parts > 1 else []
    if not cuts:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(s).over(w), F.lit(0)).alias(o)
                                for o, s in sums.items()])
    cut = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=order, outputCol="_b")
    ranged = cut.transform(df)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "_b").agg(*[F.sum(s).alias(f"_t_{o}") for o, s in sums.items()])
    offsets = totals.select(*by, "_b", *[
        F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums])
    w = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.select("*", *[F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"_r_{o}")
                                 for o, s in sums.items()])
    return inner.join(offsets, [*by, "_b"]).select(
        *[col(c) for c in df.columns],
        *[(F.col(f"_r_{o}") + F.col(f"_o_{o}")).alias(o) for o in sums])


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, for work heavy on the CPU.

    Only where its plan has fewer partitions than that; a large table has more and is left alone. Nothing is run.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < df.rdd.getNumPartitions() < cores else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; only a local session gets one of its own."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(named or shared_path(spark, "checkpoints"))


def dense_codes(distinct_values: DataFrame, order: list[str], name: str = "code") -> DataFrame:
    """0-based position of each row in the order of all rows (rows are distinct).

    Range partitions are sorted on their own and numbered after a count per partition. The
    checkpoint fixes the partitions between the two passes, executor loss included.
    """
    spark = distinct_values.sparkSession
    ensure_checkpoint_dir(spark)
    placed = (distinct_values.repartitionByRange(*[col(c) for c in order])
              .sortWithinPartitions(*[col(c) for c in order])
              .withColumn("_id", F.monotonically_increasing_id())
              .withColumn("_p", F.shiftright("_id", 33)).checkpoint())
    # One row per partition.
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select(
        "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return placed.join(F.broadcast(offsets), "_p").select(
        *[col(c) for c in distinct_values.columns],
        (F.col("_o") + F.col("_id") - F.shiftleft(F.col("_p"), 33)).alias(name))


def lookup(values: Column, table: dict) -> Column:
    """A small fixed map as an expression."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[values] if pairs else F.lit(None)

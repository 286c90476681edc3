"""Seeded fold assignment as tables, and the checks on them.

``assign_folds`` yields (key, fold, part) with part ``train`` or ``test``; rows are listed as
test once per fold, and ``training_rows`` gives the other side, so that k-fold tables hold one
row per key instead of k. Order of rows: md5 of seed and key, then key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import fixed
from tablewright.functions.exprs import col, dtype_of, hash_order, is_temporal, to_moment
from tablewright.functions.order import hash_rank, running_totals
from tablewright.operators.profile import require_columns

# Columns that ``Folds.attach`` adds.
FOLD, PARTS = "_fold", "_parts"


@dataclass
class Folds:
    """``table`` is (key, fold) for k-fold kinds, where fold is the fold a row tests in, and
    (key, fold, part) for time and holdout splits."""

    table: DataFrame
    key: str
    strategy: str
    n_splits: int
    seed: int
    n_samples: int
    stratified: bool = False
    grouped: bool = False
    temporal: bool = False
    shuffle: bool = True
    alerts: list[str] = field(default_factory=list)

    @property
    def explicit(self) -> bool:
        return "part" in self.table.columns

    def parts(self) -> DataFrame:
        """(key, fold, part) with every membership spelled out (k rows per key for k-fold)."""
        if self.explicit:
            return self.table
        return self.table.select(
            col(self.key), F.col("fold").alias("_own"),
            F.explode(F.sequence(F.lit(0), F.lit(self.n_splits - 1))).alias("fold")).select(
            col(self.key), "fold",
            F.when(F.col("_own") == F.col("fold"), "test").otherwise("train").alias("part"))

    def attach(self, df: DataFrame, path: str) -> DataFrame:
        """``df`` with its fold (or its parts by fold), joined once and written below ``path``.

        All folds then read filtered scans of one table instead of joining for each side;
        k-fold tables are laid out by fold, so a side reads only its own files.
        """
        if self.explicit:
            parts = self.table.groupBy(self.key).agg(F.map_from_entries(
                F.collect_list(F.struct("fold", "part"))).alias(PARTS))  # n_splits entries at most
            df.join(parts, self.key).write.parquet(path)
        else:
            placed = df.join(self.table.select(self.key, F.col("fold").alias(FOLD)), self.key)
            placed.write.partitionBy(FOLD).parquet(path)
        return df.sparkSession.read.parquet(path)

    def side(self, df: DataFrame, fold: int, part: str) -> DataFrame:
        """The rows of ``df`` (attached or not) in one side of one fold."""
        if FOLD in df.columns:
            return df.filter((F.col(FOLD) == fold) if part == "test" else (F.col(FOLD) != fold)).drop(FOLD)
        if PARTS in df.columns:
            return df.filter(F.col(PARTS)[fold] == part).drop(PARTS)
        t = self.table
        if self.explicit:
            chosen = t.filter((F.col("fold") == fold) & (F.col("part") == part))
        else:
            chosen = t.filter((F.col("fold") == fold) if part == "test" else (F.col("fold") != fold))
        return df.join(chosen.select(self.key), self.key, "left_semi")


def default_strategy(task_type: str | None, time_column: str | None = None,
                     group_column: str | None = None) -> str:
    if time_column:
        return "time_split"
    if group_column:
        return "group_kfold"
    return "stratified_kfold" if task_type == "classification" else "kfold"


def _bounded(n_splits: int, limit: int, strategy: str, alerts: list[str]) -> int:
    if n_splits < 2:
        raise ValueError(f"n_splits must be at least 2 for {strategy}.")
    if limit < 2:
        raise ValueError(f"Too few rows or groups for {strategy}: at least 2 are needed.")
    if n_splits > limit:
        alerts.append(f"n_splits reduced from {n_splits} to {limit} for {strategy}.")
        return limit
    return n_splits


def assign_folds(df: DataFrame, key: str, strategy: str | None = None, *, target: str | None = None,
                 task_type: str | None = None, group_column: str | None = None,
                 time_column: str | None = None, n_splits: int = fixed.N_SPLITS,
                 test_size: float = fixed.TEST_SIZE, seed: int = fixed.SEED,
                 shuffle: bool = True) -> Folds:
    strategy = (strategy or default_strategy(task_type, time_column, group_column)).strip().lower()
    if strategy not in fixed.SPLIT_STRATEGIES:
        raise ValueError(f"Unknown split strategy '{strategy}'; one of {fixed.SPLIT_STRATEGIES}.")
    require_columns(df, key=key, target=target, group=group_column, time=time_column)
    alerts: list[str] = []
    n, nameless = df.agg(F.count(F.lit(1)), F.count_if(col(key).isNull())).first()
    if n < 2:
        raise ValueError("At least 2 rows are needed to split a table.")
    if nameless:
        raise ValueError(f"{nameless} rows have no '{key}'; every row needs a key to be assigned to a fold.")
    common = dict(key=key, seed=seed, n_samples=n, alerts=alerts)
    if strategy == "time_split":
        if not time_column:
            raise ValueError("time_split needs time_column.")
        k = _bounded(n_splits, n - 1, strategy, alerts)
        return Folds(_time_folds(df, key, time_column, n, k, seed), strategy=strategy, n_splits=k,
                     temporal=True, **{**common}, shuffle=False)
    if strategy == "group_kfold":
        if not group_column:
            raise ValueError("group_kfold needs group_column.")
        table, k = _group_folds(df, key, group_column, n_splits, seed, shuffle, alerts)
        return Folds(table, strategy=strategy, n_splits=k, grouped=True, shuffle=shuffle, **common)
    if strategy == "holdout":
        classes = _usable_classes(df, target, task_type, alerts)
        return Folds(_holdout(df, key, target if classes else None, n, test_size, seed, shuffle),
                     strategy=strategy, n_splits=1, stratified=bool(classes), shuffle=shuffle, **common)
    if strategy == "stratified_kfold":
        least = _least_class(df, target, task_type, alerts)
        if least:
            k = _bounded(n_splits, least, strategy, alerts)
            return Folds(_stratified_folds(df, key, target, n, k, seed, shuffle), strategy=strategy,
                         n_splits=k, stratified=True, shuffle=shuffle, **common)
        strategy = "kfold"
    k = _bounded(n_splits, n, strategy, alerts)
    return Folds(_kfold(df, key, n, k, seed, shuffle), strategy=strategy, n_splits=k,
                 shuffle=shuffle, **common)


def _ranked(df, key, columns, n, seed, shuffle, by=None):
    """0-based rank by the seeded hash, or by the key itself when not shuffled."""
    kept = df.select(*dict.fromkeys([key, *columns]))
    if shuffle:
        return hash_rank(kept, key, n, seed, by)
    if by:
        inside = kept.groupBy(*by, key).agg(F.count(F.lit(1)).alias("_c"))
        return running_totals(inside, by, key, {"rank": "_c"}, n).drop("_c")
    ordered = running_totals(kept.withColumn("_all", F.lit(0)).withColumn("_c", F.lit(1)), ["_all"], key,
                             {"rank": "_c"}, n)
    return ordered.drop("_all", "_c")


def _kfold(df, key, n, k, seed, shuffle):
    ranked = _ranked(df, key, [], n, seed, shuffle)
    if shuffle:
        fold = F.col("rank") % k
    else:  # consecutive blocks; the first n mod k are one row longer
        big, size = n % k, n // k
        fold = F.when(F.col("rank") < big * (size + 1), F.floor(F.col("rank") / (size + 1))).otherwise(
            big + F.floor((F.col("rank") - big * (size + 1)) / max(size, 1)))
    return ranked.select(key, fold.cast("int").alias("fold"))


def _class_counts(df, target):
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))


def _least_class(df, target, task_type, alerts) -> int:
    if task_type == "regression":
        alerts.append("Stratification does not apply to regression; plain k-fold is used.")
        return 0
    if not target:
        alerts.append("stratified_kfold needs a target; plain k-fold is used.")
        return 0
    row = _class_counts(df, target).agg(
        F.min("_n").alias("least"), F.count_if(col(target).isNull()).alias("gaps")).first()
    if row["gaps"]:
        raise ValueError(f"Target '{target}' has missing values; clean it before splitting.")
    if row["least"] < 2:
        alerts.append(f"The smallest class of '{target}' has one row; plain k-fold is used.")
        return 0
    return row["least"]


def _usable_classes(df, target, task_type, alerts) -> bool:
    if not target or task_type == "regression":
        return False
    row = _class_counts(df, target).agg(
        F.min("_n").alias("least"), F.count_if(col(target).isNull()).alias("gaps")).first()
    if row["gaps"] or row["least"] < 2:
        alerts.append(f"Holdout is not stratified: '{target}' has missing or single-row classes.")
        return False
    return True


def _class_offsets(df, target, k):
    """Where each class starts dealing, so that fold totals stay even: rows of the classes
    before it, mod k. One row per class."""
    before = Window.orderBy(target).rowsBetween(Window.unboundedPreceding, -1)
    return _class_counts(df, target).select(
        target, (F.coalesce(F.sum("_n").over(before), F.lit(0)) % k).alias("_start"))


def _stratified_folds(df, key, target, n, k, seed, shuffle):
    ranked = _ranked(df, key, [target], n, seed, shuffle, [target])
    return ranked.join(_class_offsets(df, target, k), target).select(
        key, ((F.col("rank") + F.col("_start")) % k).cast("int").alias("fold"))


def _group_folds(df, key, group, n_splits, seed, shuffle, alerts):
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    n_groups = sizes.count()
    if n_groups < 2:
        raise ValueError(f"group_kfold needs at least 2 groups, found {n_groups}.")
    k = _bounded(n_splits, n_groups, "group_kfold", alerts)
    if shuffle:
        ranked = hash_rank(sizes.select(group), group, n_groups, seed)
        assigned = ranked.select(group, (F.col("rank") % k).cast("int").alias("fold"))
    else:
        assigned = _balanced_groups(sizes, group, n_groups, k)
    # Equi-join on the group; with few groups Spark broadcasts, a hot group is split by AQE.
    own = assigned.withColumnRenamed(group, "_group")
    return df.select(key, group).join(own, col(group).eqNullSafe(F.col("_group"))).select(key, "fold"), k


def _balanced_groups(sizes, group, n_groups, k):
    """Groups by falling size (ties by hash) are dealt back and forth over the folds."""
    by_size = sizes.withColumn("_order", (-F.col("_n")).cast("double"))
    heads = running_totals(by_size.groupBy("_order").agg(F.count(F.lit(1)).alias("_c"))
                           .withColumn("_all", F.lit(0)), ["_all"], "_order", {"_first": "_c"})
    ranked = hash_rank(by_size.select(group, "_order"), group, n_groups, 0, ["_order"])
    position = ranked.join(heads.select("_order", "_first"), "_order").withColumn(
        "_p", F.col("rank") + F.col("_first"))
    turn, slot = F.floor(F.col("_p") / k), F.col("_p") % k
    return position.select(group, F.when(turn % 2 == 0, slot).otherwise(k - 1 - slot)
                           .cast("int").alias("fold"))


def _moment(df, time_column):
    dtype = dtype_of(df, time_column)
    c = col(time_column)
    if is_temporal(dtype):
        return F.unix_micros(c.cast("timestamp"))
    return F.unix_micros(to_moment(c.cast("string")))


def time_ranks(df: DataFrame, key: str, time_column: str, n: int, seed: int, cuts: list[int]):
    """Rows before each cut rank, as (moment, hash, key) bounds: one row per cut.

    Times are counted first (copies of a time meet map-side); only the rows of the times that
    a cut falls into are ranked, by hash, so a time shared by many rows is no single task.
    """
    rows = df.select(col(key).alias(key), _moment(df, time_column).alias("_t"))
    counts = rows.groupBy("_t").agg(F.count(F.lit(1)).alias("_c")).withColumn("_all", F.lit(0))
    totals = running_totals(counts.withColumn("_d", F.col("_t").cast("double")), ["_all"], "_d",
                            {"_before": "_c"})
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("cut"), F.lit(r).cast("long").alias("rank"))
                                 for i, r in enumerate(cuts)]))
    hit = (totals.select("_t", "_c", "_before", wanted.alias("w"))
           .filter((F.col("w.rank") >= F.col("_before")) & (F.col("w.rank") < F.col("_before") + F.col("_c")))
           .select("_t", F.col("w.cut").alias("cut"), (F.col("w.rank") - F.col("_before")).alias("_m")))
    hit = hit.collect()  # one row per cut
    times = sorted({r["_t"] for r in hit})
    tied = hash_rank(rows.filter(F.col("_t").isin(times)), key, n, seed, ["_t"])
    bounds = {}
    marks = F.lit(False)
    for r in hit:
        marks = marks | ((F.col("_t") == r["_t"]) & (F.col("rank") == r["_m"]))
    found = {(r["_t"], r["rank"]): (r["_h"], r["_k"]) for r in tied.filter(marks).select(
        "_t", "rank", hash_order(seed, col(key)).alias("_h"), col(key).alias("_k")).collect()}
    for r in hit:
        bounds[r["cut"]] = (r["_t"], *found[(r["_t"], r["_m"])])
    return rows, bounds


def _time_folds(df, key, time_column, n, k, seed):
    if df.filter(_moment(df, time_column).isNull()).limit(1).count():
        raise ValueError(f"'{time_column}' has values that are no date; clean it before time_split.")
    t = n // (k + 1)
    # Fold i tests ranks [n - (k - i) t, n - (k - i - 1) t) and trains on all lower ranks.
    cuts = [n - (k - i) * t for i in range(k)]
    rows, bounds = time_ranks(df, key, time_column, n, seed, cuts)
    hashed = rows.withColumn("_h", hash_order(seed, col(key)))
    here = F.struct(F.col("_t"), F.col("_h"), col(key))
    kind = dtype_of(df, key)
    block = F.lit(0)  # 0: before the first test block; i + 1: in the test block of fold i
    for i in range(k):
        moment, h, v = bounds[i]
        block = block + (here >= F.struct(F.lit(moment), F.lit(h), F.lit(v).cast(kind))).cast("int")
    memberships = F.array_compact(F.array(*[
        F.when(F.col("_block") == i + 1, F.struct(F.lit(i).alias("fold"), F.lit("test").alias("part")))
        .when(F.col("_block") <= i, F.struct(F.lit(i).alias("fold"), F.lit("train").alias("part")))
        for i in range(k)]))
    return hashed.withColumn("_block", block).select(
        col(key), F.explode(memberships).alias("m")).select(col(key), "m.fold", "m.part")


def _holdout(df, key, target, n, test_size, seed, shuffle):
    n_test = math.ceil(n * test_size)
    if not target:
        ranked = _ranked(df, key, [], n, seed, shuffle)
        test = F.col("rank") < n_test if shuffle else F.col("rank") >= n - n_test
    else:
        ranked = _ranked(df, key, [target], n, seed, shuffle, [target])
        # Largest remainder: whole shares first, the rest to the largest fractions.
        share = F.col("_n") * F.lit(n_test) / F.lit(n)
        counts = _class_counts(df, target).select(
            target, F.floor(share).alias("_q"), (share - F.floor(share)).alias("_f"))
        order = Window.orderBy(F.desc("_f"), F.asc(target))
        left = F.lit(n_test) - F.sum("_q").over(Window.partitionBy())
        quota = counts.select(target, (F.col("_q") + (F.row_number().over(order) <= left).cast("int"))
                              .alias("_quota"))
        ranked = ranked.join(quota, target)
        test = F.col("rank") < F.col("_quota")
    return ranked.select(key, F.lit(0).alias("fold"),
                         F.when(test, "test").otherwise("train").alias("part"))


# -- checks and summary ----------------------------------------------------------------

def contamination(parts: DataFrame, key: str) -> DataFrame:
    """(fold, value) of keys on both sides of a fold; empty if all is well."""
    return (parts.groupBy("fold", col(key).cast("string").alias("value"))
            .agg(F.count_if(F.col("part") == "train").alias("a"),
                 F.count_if(F.col("part") == "test").alias("b"))
            .filter("a > 0 AND b > 0").select("fold", "value"))


def group_contamination(parts: DataFrame, df: DataFrame, key: str, group: str) -> DataFrame:
    """(fold, value) of groups on both sides of a fold."""
    named = parts.join(df.select(key, group), key)
    return contamination(named.select("fold", "part", group), group)


def unknown_rows(table: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Keys a fold table names that the data does not have."""
    return table.select(key).join(df.select(key), key, "left_anti").distinct()


def check_folds(folds: Folds, df: DataFrame | None = None, group: str | None = None) -> None:
    if folds.table.limit(1).count() == 0:
        raise ValueError("There are no folds.")
    if folds.explicit and contamination(folds.table, folds.key).limit(1).count():
        raise ValueError("A row is in the training and the test part of a fold.")
    if not folds.explicit and folds.table.groupBy(folds.key).agg(
            F.count_distinct("fold").alias("n")).filter("n > 1").limit(1).count():
        raise ValueError("A row is tested in more than one fold.")
    if df is not None:
        if unknown_rows(folds.table, df, folds.key).limit(1).count():
            raise ValueError("The folds name rows the table does not have.")
        if group:
            mixed = (group_contamination(folds.table, df, folds.key, group) if folds.explicit else
                     folds.table.join(df.select(folds.key, group), folds.key).groupBy(group)
                     .agg(F.count_distinct("fold").alias("n")).filter("n > 1"))
            if mixed.limit(1).count():
                raise ValueError("A group is in the training and the test part of a fold.")


def fold_summary(folds: Folds) -> DataFrame:
    """(fold, n_train, n_test, flags, seed); k-fold rows are counted once, not k times."""
    if folds.explicit:
        counts = folds.table.groupBy("fold").agg(
            F.count_if(F.col("part") == "train").alias("n_train"),
            F.count_if(F.col("part") == "test").alias("n_test"))
    else:
        counts = folds.table.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test")).select(
            "fold", (F.lit(folds.n_samples) - F.col("n_test")).alias("n_train"), "n_test")
    return counts.select("fold", "n_train", "n_test", F.lit(folds.stratified).alias("stratified"),
                         F.lit(folds.grouped).alias("grouped"), F.lit(folds.temporal).alias("temporal"),
                         F.lit(folds.seed).alias("seed"))

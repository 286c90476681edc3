"""Column expressions shared by the operators; all of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.FloatType, T.DoubleType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def col(name: str) -> Column:
    """A column by its exact name, dots, backticks and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_textual(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, TEMPORAL)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NULL is the only missing value downstream: NaN in floating columns becomes NULL."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, FLOATING)}
    if not floating:
        return df
    return df.select([
        F.when(F.isnan(col(c)), None).otherwise(col(c)).alias(c) if c in floating else col(c)
        for c in df.columns
    ])


def percent(part: Column, whole: Column) -> Column:
    """round(100 * part / whole, 3); 0 when there is nothing to divide by."""
    return F.when(whole > 0, F.round(F.lit(100.0) * part / whole, 3)).otherwise(F.lit(0.0))


def finite(c: Column) -> Column:
    """NULL instead of NaN or an infinity."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def corrected_skewness(c: Column, n: Column) -> Column:
    """Sample (bias-corrected) skewness; NULL for n <= 2 or without spread."""
    g1 = F.skewness(c)
    return F.when((n > 2) & (F.stddev_samp(c) > 0),
                  g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def corrected_kurtosis(c: Column, n: Column) -> Column:
    """Sample (bias-corrected) excess kurtosis; NULL for n < 4 or without spread."""
    g2 = F.kurtosis(c)
    d = n.cast("double")
    return F.when(
        (n > 3) & (F.stddev_samp(c) > 0),
        (d - 1) / F.nullif((d - 2) * (d - 3), F.lit(0.0)) * ((d + 1) * g2 + 6))


def fingerprint(columns: list[str]) -> Column:
    """128 bits per row. A NULL mask is hashed along, since ``xxhash64`` skips NULLs."""
    mask = F.concat(*[F.when(col(c).isNull(), "1").otherwise("0") for c in columns])
    cols = [col(c) for c in columns]
    return F.struct(F.xxhash64(mask, *cols).alias("h1"),
                    F.xxhash64(F.lit("second"), mask, *cols).alias("h2"))


def strip(c: Column) -> Column:
    """Cut white space (tabs and line ends included) at both ends; nothing left is missing."""
    return F.nullif(F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", ""), F.lit(""))


def to_number(c: Column) -> Column:
    """The number a string spells, else NULL ('nan' is no number)."""
    d = c.try_cast("double")
    return F.when(F.isnan(d), None).otherwise(d)


def to_moment(c: Column) -> Column:
    """The moment a string spells in one of the common layouts, else NULL."""
    t = F.trim(c)
    iso = F.when(t.rlike(r"^\d{4}(-\d{1,2}(-\d{1,2}([ T]\d{1,2}:\d{2}.*)?)?)?$"),
                 t.try_cast("timestamp"))
    rest = [
        F.when(t.rlike(pattern), F.try_to_timestamp(t, F.lit(layout)))
        for pattern, layout in (
            (r"^\d{8}$", "yyyyMMdd"),
            (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
            (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
            (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"),
            (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-y"),
            (r"^[A-Za-z]{3} \d{1,2},? \d{4}$", "MMM d[,] y"),
            (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM y"),
        )
    ]
    # Only strings with a digit can be dates; others skip the layouts.
    return F.when(t.rlike(r"\d"), F.coalesce(iso, *rest))


def as_text(c: Column, dtype: T.DataType) -> Column:
    """A value as text, as categories are reported."""
    return c if is_textual(dtype) else c.cast("string")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def melt(df: DataFrame, columns: list[str], as_type: str = "string",
         keep: list[str] | None = None) -> DataFrame:
    """(column, value) rows; the explode feeds a partial aggregate in the same stage."""
    keep = keep or []
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast(as_type).alias("value")) for c in columns
    ])
    return (df.select(*[col(k) for k in keep], F.explode(pairs).alias("p"))
              .select(*[col(k) for k in keep], "p.column", "p.value"))


def stack_aggregates(df: DataFrame, entries: list[tuple[str, dict[str, Column]]]) -> DataFrame:
    """One global aggregate for all entries, then one output row per entry.

    ``entries`` is a list of (label, {name: aggregate}); every dict has the same names.
    """
    aggregates, structs = [], []
    for i, (label, values) in enumerate(entries):
        fields = [F.lit(label).alias("column")]
        for name, expression in values.items():
            key = f"a{i}_{name}"
            aggregates.append(expression.alias(key))
            fields.append(F.col(key).alias(name))
        structs.append(F.struct(*fields))
    return df.agg(*aggregates).select(F.inline(F.array(*structs)))


def hash_order(seed: int, key: Column) -> Column:
    """The shuffle order of the library: md5 of seed and key, the same in every SQL engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))

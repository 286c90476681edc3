"""Sources, profile and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import profile as P
from tablewright.operators import quality as Q
from tablewright.queries.base import (
    GAPPY_LINEITEM, PRICED_LINEITEM, gappy_lineitem, longs, priced_lineitem, rounded, scratch, table)
from tablewright.sources import tables as S

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f
    return register


def unpivoted(columns, template: str, source: str) -> str:
    """One SELECT per column, stacked; {c} is the column."""
    return " union all ".join(template.format(c=c, source=source) for c in columns)


# -- sources ---------------------------------------------------------------------------

@query("source_csv", """select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal,
  c_mktsegment from customer""")
def source_csv(spark, d):
    path = scratch(spark, "customer_csv")
    S.write_table(table(spark, d, "customer"), path, "csv")
    return S.load(spark, "csv", path)


@query("source_csv_missing", """select o_orderkey, case when o_custkey % 3 = 0 then null else o_orderstatus end
  as o_orderstatus, case when o_custkey % 4 = 0 then null else o_totalprice end as o_totalprice from orders""")
def source_csv_missing(spark, d):
    path = scratch(spark, "orders_csv")
    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 3 == 0, "N/A").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_custkey") % 4 == 0, "NaN").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"))
    S.write_table(o, path, "csv")
    return S.load(spark, "csv", path)


@query("source_parquet", "select * from supplier")
def source_parquet(spark, d):
    return S.load(spark, "parquet", f"{d}/supplier.parquet")


@query("source_dataframe", "select n_name, r_name from nation join region on n_regionkey = r_regionkey")
def source_dataframe(spark, d):
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return S.load(spark, dataframe=joined.select("n_name", "r_name"))


@query("source_preview", "select * from customer order by c_custkey limit 15")
def source_preview(spark, d):
    return S.preview(table(spark, d, "customer"), "c_custkey")


@query("sink_roundtrip", "select p_partkey, p_brand, p_retailprice from part")
def sink_roundtrip(spark, d):
    path = scratch(spark, "part")
    S.write_table(table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice"), path,
                  partition_by=["p_brand"])
    return S.load(spark, "parquet", path).select("p_partkey", "p_brand", "p_retailprice")


# -- profile ---------------------------------------------------------------------------

@query("profile_size", "select count(*) as n_rows, cast(11 as bigint) as n_cols from lineitem")
def profile_size(spark, d):
    return longs(P.table_size(table(spark, d, "lineitem")), "n_cols")


GAPS = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus"]


@query("profile_missing", unpivoted(GAPS, """select '{c}' as "column", count(*) - count({c}) as n_missing,
  round(100.0::double * (count(*) - count({c})) / count(*), 3) as pct_missing from {source}""", GAPPY_LINEITEM))
def profile_missing(spark, d):
    return P.missing(gappy_lineitem(spark, d))


@query("profile_missing_cells", "select cast(sum(n) as bigint) as n_missing_cells from (" + unpivoted(
    GAPS, "select count(*) - count({c}) as n from {source}", GAPPY_LINEITEM) + ")")
def profile_missing_cells(spark, d):
    return P.missing_cells(gappy_lineitem(spark, d))


@query("profile_cardinality", unpivoted(
    GAPS, """select '{c}' as "column", count(distinct {c}) as n_unique from {source}""", GAPPY_LINEITEM))
def profile_cardinality(spark, d):
    return P.cardinality(gappy_lineitem(spark, d))


ORDERS = {"o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "", "o_totalprice": "numeric",
          "o_orderdate": "datetime", "o_orderpriority": "", "day": "", "clerk": "", "always": ""}
ORDERS_SQL = """(select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
  strftime(o_orderdate, '%Y-%m-%d') as day, 'Clerk ' || o_orderkey as clerk, 'same' as always from orders)"""


def typed_orders(spark, d):
    return table(spark, d, "orders").select(
        "*", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.concat(F.lit("Clerk "), F.col("o_orderkey")).alias("clerk"), F.lit("same").alias("always"))


def _type_sql(c: str, kind: str) -> str:
    if kind:
        rule = f"case when count(distinct {c}) <= 1 then 'constant' else '{kind}' end"
    else:
        rule = f"""case when count(distinct {c}) <= 1 then 'constant'
          when avg(case when try_cast({c} as timestamp) is not null then 1.0 else 0.0 end) >= 0.9 then 'datetime'
          when avg(length({c})) >= 40 or (count(distinct {c}) / count(*) >= 0.5 and avg(length({c})) > 1)
          then 'text' else 'categorical' end"""
    return f"""select '{c}' as "column", {rule} as inferred_type, count(distinct {c}) as n_unique,
      count(distinct {c}) <= 1 as is_constant, count(distinct {c}) = count(*) and count({c}) = count(*) as is_id_like
      from {ORDERS_SQL}"""


@query("profile_types", " union all ".join(_type_sql(c, k) for c, k in ORDERS.items()))
def profile_types(spark, d):
    return P.profile_table(typed_orders(spark, d)).select(
        "column", "inferred_type", "n_unique", "is_constant", "is_id_like")


STATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
STATS_SQL = """select '{c}' as "column", count({c}) as n, round(avg({c}), 4) as mean,
  round(stddev_samp({c}), 4) as std, round(min({c}), 4) as min, round(quantile_cont({c}, 0.25), 4) as p25,
  round(quantile_cont({c}, 0.5), 4) as p50, round(quantile_cont({c}, 0.75), 4) as p75, round(max({c}), 4) as max,
  count(*) filter ({c} = 0) as n_zeros, count(*) filter ({c} < 0) as n_negative,
  round(skewness({c}), 4) as skewness, round(kurtosis({c}), 4) as kurtosis from {source}"""
FOUR = dict.fromkeys(("mean", "std", "min", "p25", "p50", "p75", "max", "skewness", "kurtosis"), 4)


@query("profile_numeric", unpivoted(STATS, STATS_SQL, GAPPY_LINEITEM))
def profile_numeric(spark, d):
    return rounded(P.numeric_stats(gappy_lineitem(spark, d), STATS), **FOUR)


@query("profile_numeric_selected", unpivoted(["o_totalprice", "o_custkey"], STATS_SQL, "orders"))
def profile_numeric_selected(spark, d):
    """The same statistics by rank selection, the way of tables too large for one state."""
    return rounded(P.numeric_stats(table(spark, d, "orders"), ["o_totalprice", "o_custkey"], max_cells=0), **FOUR)


@query("profile_datetime", """select 'o_orderdate' as "column", strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') as min,
  strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') as max from orders union all
  select 'day', strftime(min(o_orderdate), '%Y-%m-%dT00:00:00'), strftime(max(o_orderdate), '%Y-%m-%dT00:00:00')
  from orders""")
def profile_datetime(spark, d):
    return P.datetime_stats(typed_orders(spark, d), ["o_orderdate", "day"])


CATEGORIES = ["p_brand", "p_type", "p_size"]


@query("profile_top_values", """select "column", rank, value, count, round(100.0::double * count / n_valid, 3) as pct
  from (select *, row_number() over (partition by "column" order by count desc, value) as rank,
    cast(sum(count) over (partition by "column") as bigint) as n_valid from (""" + unpivoted(
    CATEGORIES, """select '{c}' as "column", cast({c} as varchar) as value, count(*) as count from {source}
    where {c} is not null group by 2""", "part") + ")) where rank <= 10")
def profile_top_values(spark, d):
    return longs(P.top_values(table(spark, d, "part"), CATEGORIES), "rank")


@query("profile_rare_counts", """select "column", count(*) filter (count < 0.02 * n_valid) as n_rare_categories
  from (select *, sum(count) over (partition by "column") as n_valid from (""" + unpivoted(
    CATEGORIES, """select '{c}' as "column", cast({c} as varchar) as value, count(*) as count from {source}
    where {c} is not null group by 2""", "part") + ")) group by 1")
def profile_rare_counts(spark, d):
    return P.rare_counts(table(spark, d, "part"), CATEGORIES, 0.02)


@query("profile_duplicates", """select count(*) as n_rows, count(*) - (select count(*) from
  (select distinct text, lang from documents)) as n_duplicate_rows, round(100.0::double * (count(*) -
  (select count(*) from (select distinct text, lang from documents))) / count(*), 3) as pct_duplicate_rows
  from documents""")
def profile_duplicates(spark, d):
    return P.duplicates(table(spark, d, "documents"), ["text", "lang"])


PAIRS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net_price", "scaled_quantity"]


@query("profile_correlations", "select a, b, round(r, 4) as pearson from (" + " union all ".join(
    f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from {PRICED_LINEITEM}"
    for i, a in enumerate(PAIRS) for b in PAIRS[i + 1:]) + ") where abs(r) >= 0.95")
def profile_correlations(spark, d):
    return P.high_correlations(priced_lineitem(spark, d), PAIRS)


@query("profile_target", """with c as (select toxic as label, count(*) as n from labels group by 1)
  select 'n_missing' as measure, cast(null as varchar) as label, 0.0::double as value, 'classification' as kind
  union all select 'pct_missing', null, 0.0, 'classification'
  union all select 'count', cast(label as varchar), n, 'classification' from c
  union all select 'pct', cast(label as varchar), round(100.0::double * n / (select sum(n) from c), 3), 'classification' from c
  union all select 'n_classes', null, count(*), 'classification' from c
  union all select 'imbalance_ratio', null, round(max(n)::double / min(n), 3), 'classification' from c
  union all (select 'minority_class', cast(label as varchar), null, 'classification' from c order by n, label limit 1)
  union all (select 'majority_class', cast(label as varchar), null, 'classification' from c order by n desc, label limit 1)""")
def profile_target(spark, d):
    return P.profile_target(table(spark, d, "labels"), "toxic", "classification")


@query("profile_target_numeric", """with s as (select count(o_totalprice) as n, avg(o_totalprice) as m,
  stddev_samp(o_totalprice) as sd, min(o_totalprice) as lo, max(o_totalprice) as hi,
  quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) as q, count(*) filter (o_totalprice = 0) as z,
  count(*) filter (o_totalprice < 0) as neg, skewness(o_totalprice) as sk, kurtosis(o_totalprice) as ku from orders)
  select measure, round(value, 4) as value from (
  select 'n_missing' as measure, 0.0::double as value union all select 'pct_missing', 0.0
  union all select 'n', n from s union all select 'mean', m from s union all select 'std', sd from s
  union all select 'min', lo from s union all select 'p25', q[1] from s union all select 'p50', q[2] from s
  union all select 'p75', q[3] from s union all select 'max', hi from s union all select 'n_zeros', z from s
  union all select 'n_negative', neg from s union all select 'skewness', sk from s union all select 'kurtosis', ku from s)""")
def profile_target_numeric(spark, d):
    return rounded(P.profile_target(table(spark, d, "orders"), "o_totalprice").select("measure", "value"), value=4)


@query("profile_alerts", f"""with t as {ORDERS_SQL} select 'constant_column' as alert, 'always' as "column", 1.0::double as value
  union all select 'id_like_column', 'o_orderkey', count(*) from t
  union all select 'id_like_column', 'clerk', count(*) from t
  union all select 'id_like_column', 'total_cents', count(*) from t having count(distinct o_totalprice * 100) = count(*)
  union all select 'high_missing', 'discount', round(100.0::double * count(*) filter (o_custkey % 3 > 0) / count(*), 3) from t
  union all select 'correlated_with_target', 'total_cents', round(corr(o_totalprice, o_totalprice * 100), 4) from t""")
def profile_alerts(spark, d):
    o = typed_orders(spark, d).select(
        "o_orderkey", "o_totalprice", "o_orderpriority", "clerk", "always",
        F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey") % 30).alias("discount"),
        (F.col("o_totalprice") * 100).alias("total_cents"))
    return P.profile_alerts(o, "o_totalprice", task_type="regression")


@query("profile_alert_imbalance", """select 'imbalanced_target' as alert, 'big' as "column",
  round(greatest(a, b)::double / least(a, b), 3) as value from (select count(*) filter (l_quantity = 50) as a,
  count(*) filter (l_quantity <> 50) as b from lineitem)""")
def profile_alert_imbalance(spark, d):
    t = table(spark, d, "lineitem").select("l_extendedprice", (F.col("l_quantity") == 50).alias("big"))
    found = P.profile_alerts(t, "big", task_type="classification")
    return found.filter(F.col("alert") == "imbalanced_target")


@query("profile_content_hash")
def profile_content_hash(spark, d):
    return P.content_hash(table(spark, d, "orders"))


# -- quality ---------------------------------------------------------------------------

@query("quality_missing", f"""select * from ({ORACLE['profile_missing']}) where n_missing > 0""")
def quality_missing(spark, d):
    return Q.missing_columns(gappy_lineitem(spark, d))


@query("quality_rare", """select "column", value, count from (select *, sum(count) over (partition by "column") as n_valid
  from (""" + unpivoted(["p_brand", "p_size"], """select '{c}' as "column", cast({c} as varchar) as value,
  count(*) as count from {source} group by 2""", "part") + ")) where count < 0.02 * n_valid")
def quality_rare(spark, d):
    return Q.rare_categories(table(spark, d, "part"), ["p_brand", "p_size"], 0.02)


SKEWED_EVENTS = """(select event_id, value, value * value as squared, cast(props->>'$.k' as double) as k from events)"""


def skewed_events(spark, d):
    return table(spark, d, "events").select(
        "event_id", "value", (F.col("value") * F.col("value")).alias("squared"),
        F.get_json_object("props", "$.k").cast("double").alias("k"))


FENCE_SQL = """select '{c}' as "column", count(*) filter ({c} < lo or {c} > hi) as n,
  round(100.0::double * count(*) filter ({c} < lo or {c} > hi) / count(*), 3) as pct, round(any_value(lo), 6) as lower,
  round(any_value(hi), 6) as upper from {source}, (select q[1] - 1.5 * (q[2] - q[1]) as lo,
  q[2] + 1.5 * (q[2] - q[1]) as hi from (select quantile_cont({c}, [0.25, 0.75]) as q from {source}))"""


@query("quality_outliers", "select * from (" + unpivoted(["value", "squared", "k"], FENCE_SQL, SKEWED_EVENTS) + ") where n > 0")
def quality_outliers(spark, d):
    return Q.outliers(skewed_events(spark, d), ["value", "squared", "k"])


@query("quality_report", """with t as (select p_partkey, p_brand, p_size, nullif(p_size, 7) as size2, p_retailprice,
    'x' as fixed, case when p_size < 3 then null else p_size % 2 end as target from part)
  select 'missing' as finding, 'size2' as "column", cast(null as varchar) as value, count(*) - count(size2) as n,
    round(100.0::double * (count(*) - count(size2)) / count(*), 3) as pct from t
  union all select 'missing', 'target', null, count(*) - count(target), round(100.0::double * (count(*) - count(target)) / count(*), 3) from t
  union all select 'target_missing', 'target', null, count(*) - count(target), round(100.0::double * (count(*) - count(target)) / count(*), 3) from t
  union all select 'duplicate_rows', null, null, 0, 0.0
  union all select 'constant_column', 'fixed', null, 1, null
  union all select 'rare_category', 'p_brand', p_brand, count(*), null from t group by p_brand
    having count(*) < 0.03 * (select count(*) from t)""")
def quality_report(spark, d):
    p = table(spark, d, "part").select(
        "p_partkey", "p_brand", "p_size", F.expr("nullif(p_size, 7)").alias("size2"), "p_retailprice",
        F.lit("x").alias("fixed"), F.expr("case when p_size < 3 then null else p_size % 2 end").alias("target"))
    return Q.quality_report(p, "target", 0.03).select("finding", "column", "value", "n", "pct")

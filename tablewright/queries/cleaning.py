"""Cleaning and features."""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import functions as F

from tablewright.operators import clean as C
from tablewright.operators import features as X
from tablewright.operators.profile import column_facts
from tablewright.queries.base import (
    GAPPY_LINEITEM, PRICED_LINEITEM, gappy_lineitem, longs, priced_lineitem, rounded, table)
from tablewright.queries.profiling import SKEWED_EVENTS, skewed_events

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f
    return register


# Nothing but the step under test: every other step of the cleaning is off.
OFF = dict(normalize_strings=False, coerce_numeric_strings=False, drop_constant=False,
           drop_column_missing_fraction=2.0, numeric_imputation="none", categorical_imputation="none",
           rare_category_strategy="none", outlier_strategy="none", drop_duplicates=False)


def only(df, target=None, **on):
    return C.Cleaner.of(target, **{**OFF, **on}).fit(df).transform(df)


PADDED = r"""(select doc_id, case doc_id % 5 when 0 then '  ' || lang || E' \t' when 1 then '   ' when 2 then lang || E'\n'
  else lang end as lang, source from documents)"""


def padded(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(
        "case doc_id % 5 when 0 then concat('  ', lang, ' \\t') when 1 then '   ' when 2 then concat(lang, '\\n') "
        "else lang end").alias("lang"), "source")


@query("clean_strip_blank", f"""select doc_id, source,
  nullif(regexp_replace(regexp_replace(lang, '^\\s+', ''), '\\s+$', ''), '') as lang from {PADDED}""")
def clean_strip_blank(spark, d):
    return only(padded(spark, d), normalize_strings=True)


@query("clean_coerce_numeric", """select event_id, try_cast(case when event_id % 50 = 0 then 'bad'
  else props->>'$.k' end as double) as k, case when event_id % 3 = 0 then 'x' else props->>'$.k' end as mixed from events""")
def clean_coerce_numeric(spark, d):
    k = F.get_json_object("props", "$.k")
    e = table(spark, d, "events").select(
        "event_id", F.when(F.col("event_id") % 50 == 0, "bad").otherwise(k).alias("k"),
        F.when(F.col("event_id") % 3 == 0, "x").otherwise(k).alias("mixed"))
    return only(e, coerce_numeric_strings=True)


@query("clean_drop_missing_target", "select o_orderkey, nullif(o_orderstatus, 'P') as status from orders where o_orderstatus <> 'P'")
def clean_drop_missing_target(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("status"))
    return only(o, "status")


@query("clean_drop_constant", "select s_suppkey, s_acctbal from supplier")
def clean_drop_constant(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.lit("a").alias("always"),
                                           F.lit(None).cast("int").alias("never"))
    return only(s, drop_constant=True)


@query("clean_impossible_ranges", """select p_partkey, case when p_size < 5 or p_size > 40 then null else p_size end as p_size,
  case when p_retailprice > 1500 then null else p_retailprice end as p_retailprice from part""")
def clean_impossible_ranges(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return only(p, impossible_ranges={"p_size": {"min": 5, "max": 40}, "p_retailprice": {"max": 1500}})


@query("clean_drop_empty_columns", "select o_orderkey, case when o_custkey % 3 < 2 then o_totalprice end as often from orders")
def clean_drop_empty_columns(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 3 < 2, F.col("o_totalprice")).alias("often"),
        F.when(F.col("o_custkey") % 3 < 1, F.col("o_totalprice")).alias("seldom"))
    return only(o, drop_column_missing_fraction=0.6)


LINE_KEYS = ["l_orderkey", "l_linenumber"]


def _imputed(how: str) -> str:
    return f"""select l_orderkey, l_linenumber, round(coalesce(l_discount, (select {how}(l_discount) from {GAPPY_LINEITEM})), 6)
      as l_discount, round(coalesce(l_tax, (select {how}(l_tax) from {GAPPY_LINEITEM})), 6) as l_tax from {GAPPY_LINEITEM}"""


@query("clean_impute_median", _imputed("median"))
def clean_impute_median(spark, d):
    df = gappy_lineitem(spark, d).select(*LINE_KEYS, "l_discount", "l_tax")
    return rounded(only(df, numeric_imputation="median"), l_discount=6, l_tax=6)


@query("clean_impute_mean", _imputed("avg"))
def clean_impute_mean(spark, d):
    df = gappy_lineitem(spark, d).select(*LINE_KEYS, "l_discount", "l_tax")
    return rounded(only(df, numeric_imputation="mean"), l_discount=6, l_tax=6)


@query("clean_impute_constant", f"""select l_orderkey, l_linenumber, coalesce(l_tax, 0) as l_tax,
  coalesce(l_returnflag, '__missing__') as l_returnflag from {GAPPY_LINEITEM}""")
def clean_impute_constant(spark, d):
    df = gappy_lineitem(spark, d).select(*LINE_KEYS, "l_tax", "l_returnflag")
    return only(df, numeric_imputation="constant", categorical_imputation="constant")


@query("clean_impute_mode", f"""select l_orderkey, l_linenumber, coalesce(l_returnflag, (select l_returnflag
  from {GAPPY_LINEITEM} where l_returnflag is not null group by 1 order by count(*) desc, 1 limit 1)) as l_returnflag
  from {GAPPY_LINEITEM}""")
def clean_impute_mode(spark, d):
    df = gappy_lineitem(spark, d).select(*LINE_KEYS, "l_returnflag")
    return only(df, categorical_imputation="most_frequent")


@query("clean_group_rare", """with c as (select p_brand, count(*) as n from part group by 1)
  select p_partkey, case when n < 0.04 * (select sum(n) from c) then '__rare__' else p_brand end as p_brand
  from part join c using (p_brand)""")
def clean_group_rare(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    return only(p, rare_category_strategy="group", rare_category_threshold=0.04)


BOUNDS = f"""(select round(q[1] - 1.5 * (q[2] - q[1]), 6) as lo, round(q[2] + 1.5 * (q[2] - q[1]), 6) as hi
  from (select quantile_cont(squared, [0.25, 0.75]) as q from {SKEWED_EVENTS}))"""


@query("clean_clip", f"""select event_id, round(least(greatest(squared, lo), hi), 6) as squared from {SKEWED_EVENTS}, {BOUNDS}""")
def clean_clip(spark, d):
    e = skewed_events(spark, d).select("event_id", "squared")
    return rounded(only(e, outlier_strategy="clip"), squared=6)


@query("clean_remove_outliers", f"""select event_id, squared from {SKEWED_EVENTS}, {BOUNDS} where squared between lo and hi""")
def clean_remove_outliers(spark, d):
    return only(skewed_events(spark, d).select("event_id", "squared"), outlier_strategy="remove")


@query("clean_removed_by_column", f"""with b as (select v.lo as vlo, v.hi as vhi, s.lo as slo, s.hi as shi from
  (select round(q[1] - 1.5 * (q[2] - q[1]), 6) as lo, round(q[2] + 1.5 * (q[2] - q[1]), 6) as hi
   from (select quantile_cont(value, [0.25, 0.75]) as q from events)) v, {BOUNDS} s)
  select "column", count(*) as rows from (select case when squared < slo or squared > shi then 'squared'
    when value < vlo or value > vhi then 'value' end as "column" from {SKEWED_EVENTS}, b) where "column" is not null group by 1""")
def clean_removed_by_column(spark, d):
    e = skewed_events(spark, d).select("squared", "value")
    model = C.Cleaner.of(**{**OFF, "outlier_strategy": "remove"}).fit(e)
    limits = {c: tuple(v) for c, v in model.steps["remove"].items()}
    return C.removed_by_column(e, limits)


@query("clean_drop_duplicates", "select distinct lang, source from documents")
def clean_drop_duplicates(spark, d):
    return only(table(spark, d, "documents").select("lang", "source"), drop_duplicates=True)


ACTIONS = f"""with t as {GAPPY_LINEITEM}, r as (select l_returnflag as v, count(*) as n from t where l_returnflag is not null group by 1)
  select 'drop_constant_column' as operation, 'fixed' as "column", cast(null as bigint) as rows
  union all select 'coerce_impossible_to_nan', 'l_quantity', count(*) from t where l_quantity > 45
  union all select 'median_imputation', 'l_quantity', count(*) from t where l_quantity > 45
  union all select 'median_imputation', 'l_discount', count(*) from t where l_discount is null
  union all select 'median_imputation', 'l_tax', count(*) from t where l_tax is null
  union all select 'most_frequent_imputation', 'l_returnflag', count(*) from t where l_returnflag is null"""


def _cleaned(spark, d):
    df = gappy_lineitem(spark, d).select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_returnflag",
                                         F.lit(1).alias("fixed"))
    return df, C.Cleaner.of(impossible_ranges={"l_quantity": {"max": 45}}, drop_duplicates=False).fit(df)


@query("clean_actions", ACTIONS)
def clean_actions(spark, d):
    _, model = _cleaned(spark, d)
    return model.actions(spark).select("operation", "column", "rows")


@query("clean_alerts", f"""with whole as {GAPPY_LINEITEM}, t as (select * from whole where l_quantity <= 45) select alert, "column", value from (
  select 'heavily_imputed' as alert, 'l_tax' as "column", round(100.0::double * count(*) filter (l_tax is null) / count(*), 3) as value from t
  union all select 'heavily_imputed', 'l_discount', round(100.0::double * count(*) filter (l_discount is null) / count(*), 3) from t)
  where value >= 20 union all select 'missing_left', 'l_returnflag', count(*) from t where l_returnflag is null
  union all select 'missing_target_rows_dropped', 'small', count(*) from whole where l_quantity > 45""")
def clean_alerts(spark, d):
    df = gappy_lineitem(spark, d).select(
        "l_tax", "l_returnflag", "l_discount", F.expr("case when l_quantity <= 45 then l_quantity end").alias("small"))
    model = C.Cleaner.of("small", categorical_imputation="none", drop_duplicates=False).fit(df)
    return model.alerts(spark)


@query("clean_summary", """select 'before' as side, count(*) as n_rows, cast(3 as bigint) as n_cols from documents
  union all select 'after', count(*), 2 from (select distinct lang, source from documents)""")
def clean_summary(spark, d):
    df = table(spark, d, "documents").select("lang", "source", F.lit(0).alias("zero"))
    model = C.Cleaner.of(rare_category_strategy="none").fit(df)
    return longs(model.summary(df).select("side", "n_rows", "n_cols"), "n_cols")


@query("clean_reapply", """with early as (select * from events where ts < timestamp '2024-01-16'),
  late as (select * from events where ts >= timestamp '2024-01-16') select event_id, coalesce(nullif(value, 0),
  (select median(nullif(value, 0)) from early)) as value, coalesce(case when event_id % 7 > 0 then event_type end,
  (select case when event_id % 7 > 0 then event_type end as v from early where event_id % 7 > 0 group by 1
   order by count(*) desc, 1 limit 1)) as event_type from late""")
def clean_reapply(spark, d):
    e = table(spark, d, "events").select("ts", "event_id", F.expr("nullif(value, 0)").alias("value"),
                                         F.expr("case when event_id % 7 > 0 then event_type end").alias("event_type"))
    early, late = (e.filter(c).drop("ts") for c in ("ts < '2024-01-16'", "ts >= '2024-01-16'"))
    return C.Cleaner.of(rare_category_strategy="none", drop_duplicates=False).fit(early).transform(late)


# -- features --------------------------------------------------------------------------

def encoded(df, keep, groups, **options):
    encoder = X.TableEncoder(groups=json.dumps(groups), options=json.dumps(options))
    return encoder.fit(df).encode_columns(df, keep)


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


def _scaled(centre: str, scale: str, source: str = "lineitem") -> str:
    parts = ", ".join(f"round(({c} - (select {centre.format(c=c)} from {source})) / (select {scale.format(c=c)} from {source}), 6) as {c}"
                      for c in NUMBERS)
    return f"select l_partkey, {parts} from {source}"


def _numbers(spark, d, scaling):
    df = encoded(table(spark, d, "lineitem"), ["l_partkey"], {"numeric": NUMBERS}, scaling=scaling)
    return rounded(df, **dict.fromkeys(NUMBERS, 6))


@query("feat_standard", _scaled("avg({c})", "stddev_pop({c})"))
def feat_standard(spark, d):
    return _numbers(spark, d, "standard")


@query("feat_minmax", _scaled("min({c})", "max({c}) - min({c})"))
def feat_minmax(spark, d):
    return _numbers(spark, d, "minmax")


@query("feat_robust", _scaled("median({c})", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def feat_robust(spark, d):
    return _numbers(spark, d, "robust")


def _filled(how: str) -> str:
    parts = ", ".join(f"round(coalesce({c}, (select {how.format(c=c)} from t)), 6) as {c}" for c in ("l_discount", "l_tax"))
    return f"with t as {GAPPY_LINEITEM} select l_partkey, {parts} from t"


@query("feat_impute", _filled("median({c})"))
def feat_impute(spark, d):
    df = encoded(gappy_lineitem(spark, d), ["l_partkey"], {"numeric": ["l_discount", "l_tax"]}, scaling="none")
    return rounded(df, l_discount=6, l_tax=6)


@query("feat_interactions", "select l_partkey, l_quantity, l_discount, l_tax, " + ", ".join(
    f'round({a} * {b}, 6) as "{a} {b}"' for a, b in combinations(["l_quantity", "l_discount", "l_tax"], 2)) + " from lineitem")
def feat_interactions(spark, d):
    names = ["l_quantity", "l_discount", "l_tax"]
    df = encoded(table(spark, d, "lineitem"), ["l_partkey"], {"numeric": names}, scaling="none", add_interactions=True)
    return rounded(df, **{f"{a} {b}": 6 for a, b in combinations(names, 2)})


@query("feat_onehot", """select o_orderkey, case when coalesce(s, m) = 'F' then 1.0::double else 0.0 end as s_F,
  case when coalesce(s, m) = 'O' then 1.0::double else 0.0 end as s_O from (select o_orderkey, nullif(o_orderstatus, 'P') as s,
  (select o_orderstatus from orders where o_orderstatus <> 'P' group by 1 order by count(*) desc, 1 limit 1) as m from orders)""")
def feat_onehot(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("s"))
    return encoded(o, ["o_orderkey"], {"onehot": ["s"]})


@query("feat_onehot_limited", """with r as (select o_orderpriority as p, row_number() over (order by count(*) desc, o_orderpriority) as i
  from orders group by 1) select feature, cast(sum(hit) as bigint) as n from (
  select 'o_orderpriority_' || p as feature, count(*) as hit from orders join r on p = o_orderpriority where i <= 2 group by 1
  union all select 'o_orderpriority_infrequent', count(*) from orders join r on p = o_orderpriority where i > 2) group by 1""")
def feat_onehot_limited(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    wide = encoded(o, ["o_orderkey"], {"onehot": ["o_orderpriority"]}, one_hot_max_categories=3)
    names = [c for c in wide.columns if c != "o_orderkey"]
    return wide.agg(*[F.sum(F.col(f"`{c}`")).cast("long").alias(c) for c in names]).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("n")) for c in names])))


@query("feat_ordinal", """select p_partkey, cast(dense_rank() over (order by p_brand) - 1 as double) as p_brand from part""")
def feat_ordinal(spark, d):
    return encoded(table(spark, d, "part"), ["p_partkey"], {"ordinal": ["p_brand"]}, categorical_encoding="ordinal")


@query("feat_ordinal_unknown", """with known as (select p_brand, row_number() over (order by p_brand) - 1 as code from
  (select distinct p_brand from part where p_size > 45 and p_brand < 'Brand#4')) select p_partkey,
  cast(coalesce(code, -1) as double) as p_brand from part left join known using (p_brand)""")
def feat_ordinal_unknown(spark, d):
    p = table(spark, d, "part")
    encoder = X.TableEncoder(groups=json.dumps({"ordinal": ["p_brand"]}))
    model = encoder.fit(p.filter("p_size > 45 AND p_brand < 'Brand#4'"))
    return model.encode_columns(p, ["p_partkey"])


@query("feat_datetime", """select event_id, year(ts)::double as ts__year, month(ts)::double as ts__month, day(ts)::double as ts__day,
  (isodow(ts) - 1)::double as ts__dayofweek, hour(ts)::double as ts__hour, quarter(ts)::double as ts__quarter,
  case when isodow(ts) >= 6 then 1.0::double else 0.0 end as ts__is_weekend from events""")
def feat_datetime(spark, d):
    return encoded(table(spark, d, "events"), ["event_id"], {"datetime": ["ts"]})


@query("feat_text_stats", r"""select doc_id, length(text)::double as text__char_len,
  len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::double as text__n_words from documents""")
def feat_text_stats(spark, d):
    return encoded(table(spark, d, "documents"), ["doc_id"], {"text": ["text"]})


TFIDF = r"""with tok as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) as term from documents),
  top as (select term, count(*) as tf, count(distinct doc_id) as df from tok group by 1 order by 2 desc, 1 limit 50),
  idf as (select term, tf, df, ln((1 + (select count(*) from documents)) / (1.0::double + df)) + 1 as idf from top)"""


@query("feat_tfidf_terms", TFIDF + " select term, tf, df, round(idf, 6) as idf from idf")
def feat_tfidf_terms(spark, d):
    return rounded(X.tfidf_terms(table(spark, d, "documents"), "text"), idf=6)


@query("feat_tfidf", TFIDF + """, w as (select doc_id, term, count(*) * any_value(idf) as w from tok join idf using (term) group by 1, 2)
  select doc_id, term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from w""")
def feat_tfidf(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = X.TableEncoder(groups=json.dumps({"text": ["text"]}), options=json.dumps({"text_strategy": "tfidf"})).fit(docs)
    return rounded(model.term_weights(docs, "doc_id"), weight=6)


@query("feat_groups", """select * from (values ('c_acctbal', 'numeric'), ('c_mktsegment', 'onehot'), ('c_nationkey', 'numeric'))
  as t("column", "group")""")
def feat_groups(spark, d):
    c = table(spark, d, "customer")
    facts = column_facts(c).collect()
    groups = json.loads(X.feature_encoder(c.drop("c_name"), None, [r for r in facts if r["column"] != "c_name"])
                        .getOrDefault("groups"))
    return spark.createDataFrame([(x, g) for g, xs in groups.items() for x in xs], "column string, group string")


@query("feat_names", """select * from (values (0::bigint, 'o_totalprice'), (1, 'o_orderstatus_F'), (2, 'o_orderstatus_O'),
  (3, 'o_orderstatus_P'), (4, 'o_orderdate__year'), (5, 'o_orderdate__month'), (6, 'o_orderdate__day'),
  (7, 'o_orderdate__dayofweek'), (8, 'o_orderdate__hour'), (9, 'o_orderdate__quarter'), (10, 'o_orderdate__is_weekend'))
  as t(position, feature)""")
def feat_names(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    model = X.feature_encoder(o).fit(o)
    return spark.createDataFrame(list(enumerate(model.feature_names())), "position long, feature string")


@query("feat_leakage", f"""select 'fit_on_training_rows_only' as alert, cast(null as varchar) as "column", cast(null as double) as value
  union all select 'scaling_learns_from_data', null, null
  union all select 'correlated_with_target', 'net_price', round(corr(l_extendedprice, net_price), 4) from {PRICED_LINEITEM}""")
def feat_leakage(spark, d):
    df = priced_lineitem(spark, d)
    return X.leakage_alerts(df, "l_extendedprice", df.columns)


@query("feat_vector")
def feat_vector(spark, d):
    o = table(spark, d, "orders")
    return X.feature_encoder(o, "o_totalprice").fit(o).transform(o).select("o_orderkey", F.col("features").cast("string").alias("features"))

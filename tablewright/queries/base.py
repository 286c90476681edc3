"""What the registered queries share: tables, derived inputs and SQL pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.exprs import col
from tablewright.session import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    return shared_path(spark, label)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Named columns rounded; every other column as it is."""
    return df.select([F.round(col(c), digits[c]).alias(c) if c in digits else col(c) for c in df.columns])


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.select([col(c).cast("long").alias(c) if c in names else col(c) for c in df.columns])


# -- inputs derived by a rule both engines share ---------------------------------------

def gappy_lineitem(spark, d) -> DataFrame:
    """lineitem with missing values: no zero discount or tax, no returns flag 'N' on 'O'."""
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.expr("nullif(l_discount, 0)").alias("l_discount"), F.expr("nullif(l_tax, 0)").alias("l_tax"),
        F.expr("case when l_linestatus = 'O' and l_returnflag = 'N' then null else l_returnflag end")
        .alias("l_returnflag"), "l_linestatus")


GAPPY_LINEITEM = """(select l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice,
  nullif(l_discount, 0) as l_discount, nullif(l_tax, 0) as l_tax,
  case when l_linestatus = 'O' and l_returnflag = 'N' then null else l_returnflag end as l_returnflag,
  l_linestatus from lineitem)"""


def priced_lineitem(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_price"),
        (F.col("l_quantity") * 3.0 + 1.0).alias("scaled_quantity"))


PRICED_LINEITEM = """(select l_quantity, l_extendedprice, l_discount, l_tax,
  l_extendedprice * (1 - l_discount) as net_price, l_quantity * 3.0 + 1.0 as scaled_quantity from lineitem)"""


def scored_events(spark, d) -> DataFrame:
    """Out-of-fold rows of two rules on events: label, prediction and a tied score."""
    e = table(spark, d, "events")
    rules = F.inline(F.array(
        F.struct(F.lit("by_value").alias("model"), (F.floor("value") % 100 / 100.0).alias("score")),
        F.struct(F.lit("by_user").alias("model"), ((F.col("user_id") * 7) % 50 / 50.0).alias("score"))))
    return e.select(F.col("event_id").alias("key"), (F.col("user_id") % 5).cast("int").alias("fold"),
                    (F.col("event_type") == "error").cast("int").alias("label"), rules).withColumn(
        "prediction", (F.col("score") >= 0.3).cast("int"))


SCORED_EVENTS = """(select *, case when score >= 0.3 then 1 else 0 end as prediction from (
  select event_id as key, cast(user_id % 5 as int) as fold,
    case when event_type = 'error' then 1 else 0 end as label, 'by_value' as model,
    cast(floor(value) as bigint) % 100 / 100.0::double as score from events
  union all
  select event_id, cast(user_id % 5 as int), case when event_type = 'error' then 1 else 0 end,
    'by_user', (user_id * 7) % 50 / 50.0::double from events))"""


def rated_orders(spark, d) -> DataFrame:
    """Three-class rows on orders with a predicted class and one score per class."""
    o = table(spark, d, "orders")
    bucket = (F.col("o_custkey") + F.col("o_orderkey")) % 4
    pick = F.when(bucket == 0, "F").when(bucket == 1, "O").when(bucket == 2, "P").otherwise(F.col("o_orderstatus"))
    return o.select(
        F.col("o_orderkey").alias("key"), F.lit("rule").alias("model"),
        (F.col("o_orderkey") % 5).cast("int").alias("fold"), F.col("o_orderstatus").alias("label"),
        pick.alias("prediction"),
        F.array(*[(F.col("o_custkey") % m / float(m)) for m in (11, 7, 5)]).alias("scores"))


RATED_ORDERS = """(select o_orderkey as key, 'rule' as model, cast(o_orderkey % 5 as int) as fold,
  o_orderstatus as label, case (o_custkey + o_orderkey) % 4 when 0 then 'F' when 1 then 'O' when 2 then 'P'
  else o_orderstatus end as prediction, o_custkey % 11 / 11.0::double as s1, o_custkey % 7 / 7.0::double as s2,
  o_custkey % 5 / 5.0::double as s3 from orders)"""


def predicted_prices(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.lit("linear").alias("model"), (F.col("l_orderkey") % 5).cast("int").alias("fold"),
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 2000 + 100).alias("prediction"))


PREDICTED_PRICES = """(select 'linear' as model, cast(l_orderkey % 5 as int) as fold,
  l_extendedprice as label, l_quantity * 2000 + 100 as prediction from lineitem)"""


def fold_results(spark, d) -> DataFrame:
    """A results table from events: model = event type, fold = user mod 5."""
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 5).cast("int").alias("fold")).agg(
        F.map_from_arrays(F.array(F.lit("rmse"), F.lit("r2")), F.array(
            F.round(F.avg("value"), 6),
            F.round(F.avg(F.get_json_object("props", "$.k").cast("double")) / 100, 6))).alias("metrics"),
        F.round(F.count(F.lit(1)) / 1000.0, 3).alias("fit_seconds")).withColumn("status", F.lit("ok"))


FOLD_RESULTS = """(select event_type as model, cast(user_id % 5 as int) as fold, round(avg(value), 6) as rmse,
  round(avg(cast(props->>'$.k' as double)) / 100, 6) as r2, round(count(*) / 1000.0, 3)::double as fit_seconds
  from events group by all)"""

# t(0.975) with 4 degrees of freedom, for the interval of five folds.
T_975_4 = "2.7764451051977987"


def agent_events(spark, d) -> DataFrame:
    """events in the shape of the record table agent_events."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("experiment_id"),
        F.concat(F.lit("agent_"), F.substring("event_type", 1, 1)).alias("agent_name"), "event_type",
        F.lit(None).cast("string").alias("input_json"), F.col("props").alias("output_json"),
        F.concat(F.lit("Value "), F.col("value").cast("decimal(18,2)").cast("string")).alias("rationale"),
        F.col("ts").cast("timestamp").alias("created_at"))


AGENT_EVENTS = """(select event_id as id, cast(user_id as varchar) as experiment_id,
  'agent_' || substring(event_type, 1, 1) as agent_name, event_type, props as output_json,
  'Value ' || cast(cast(value as decimal(18,2)) as varchar) as rationale, ts as created_at from events)"""

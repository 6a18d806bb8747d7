"""Queries over the warehouse tables and events: ``QUERIES`` and ``ORACLE_SQL`` by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import disc_price, exact, money, money_of, naive_hour
from millrace.operators.relational import as_of_latest, keys_without, rank_within, top_k, visits, with_subtotals
from millrace.sources import read_table
from millrace.streaming import hourly_counts


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and averages of shipped lines by flag and status."""
    shipped = read_table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-09-02").cast("timestamp_ntz"))
    return shipped.groupBy("l_returnflag", "l_linestatus").agg(
        money(exact(F.col("l_quantity"))).alias("sum_qty"),
        money(exact(F.col("l_extendedprice"))).alias("sum_base"),
        money(disc_price()).alias("sum_disc"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count("*").alias("n"),
    )


def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of nations and segments, with subtotals."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", disc_price().alias("revenue"))
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # lines meet orders in their own sum first, so that later joins carry one row an order
    by_order = lines.groupBy("l_orderkey").agg(F.sum("revenue").alias("revenue"))
    joined = (
        by_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return with_subtotals(joined, ["n_name", "c_mktsegment"], money(F.col("revenue")).alias("revenue"), F.count("*").alias("n_orders"))


def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten customers of the highest spend."""
    spend = read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(money(exact(F.col("o_totalprice"))).alias("spend"))
    return top_k(spend, 10, F.desc("spend"), F.asc("o_custkey"))


def best_in_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three customers of each nation with the highest balance."""
    customers = read_table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return rank_within(customers, "c_nationkey", 3, F.desc("c_acctbal"), F.asc("c_custkey"))


def orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that have no line."""
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"))
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"))
    return keys_without(orders, lines, "orderkey")


def signups_without_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with the days on which they signed up and did not buy."""
    events = read_table(spark, sf_dir, "events")
    users = lambda kind: events.where(F.col("event_type") == kind).select("user_id", F.to_date("ts").alias("day"))
    return users("signup").subtract(users("purchase"))


def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type, by the function that also runs on a stream."""
    return hourly_counts(read_table(spark, sf_dir, "events"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of each user: events no more than 30 minutes apart."""
    events = read_table(spark, sf_dir, "events").select("user_id", "ts", "value")
    found = visits(events, "user_id", "ts", "30 minutes", F.count("*").alias("n"), F.sum(exact(F.col("value"))).alias("value"))
    return found.select("user_id", "visit", "began", "ended", "n", money_of(F.col("value")).alias("value"))


def props_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON field k by event type and day hour."""
    events = read_table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"), naive_hour("ts").alias("hour"))
    return events.groupBy("event_type", "hour").agg(F.sum("k").alias("sum_k"), F.countDistinct("k").alias("n_k"))


def last_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the last click of its user before it."""
    events = read_table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    clicks = events.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    return as_of_latest(bought, clicks, "user_id", "ts", "click_ts", "click_id")


QUERIES = {
    f.__name__: f
    for f in (pricing_summary, revenue_by_nation, top_customers, best_in_nation, orders_without_lines, signups_without_purchase, events_by_hour, sessions, props_by_type, last_click)
}

ORACLE_SQL = {
    "pricing_summary": """
        select l_returnflag, l_linestatus, round(sum(cast(l_quantity as decimal(12,2))), 2)::double as sum_qty, round(sum(cast(l_extendedprice as decimal(12,2))), 2)::double as sum_base,
               round(sum(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(6,2)))), 2)::double as sum_disc, round(avg(l_discount), 6) as avg_disc, count(*) as n
        from lineitem where l_shipdate <= timestamp '2001-09-02' group by l_returnflag, l_linestatus""",
    "revenue_by_nation": """
        with by_order as (select l_orderkey, sum(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(6,2)))) as revenue from lineitem group by l_orderkey)
        select n_name, c_mktsegment, round(sum(revenue), 2)::double as revenue, count(*) as n_orders
        from by_order join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
        group by rollup (n_name, c_mktsegment)""",
    "top_customers": """
        select o_custkey, round(sum(cast(o_totalprice as decimal(12,2))), 2)::double as spend from orders group by o_custkey order by spend desc, o_custkey limit 10""",
    "best_in_nation": """
        select c_nationkey, c_custkey, c_acctbal, cast(rank as integer) as rank from (
          select c_nationkey, c_custkey, c_acctbal, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as rank from customer)
        where rank <= 3""",
    "orders_without_lines": "select o_orderkey as orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)",
    "signups_without_purchase": """
        select user_id, cast(ts as date) as day from events where event_type = 'signup' except select user_id, cast(ts as date) from events where event_type = 'purchase'""",
    "events_by_hour": """
        select date_trunc('hour', ts) as hour, event_type, count(*) as n from events group by all""",
    "sessions": """
        with marked as (select *, coalesce((ts - lag(ts) over w > interval 30 minutes)::int, 1) as opens from events window w as (partition by user_id order by ts, event_id)),
        numbered as (select *, cast(sum(opens) over (partition by user_id order by ts, event_id) as bigint) as visit from marked)
        select user_id, visit, min(ts) as began, max(ts) as ended, count(*) as n, round(sum(cast(value as decimal(12,2))), 2)::double as value from numbered group by user_id, visit""",
    "props_by_type": """
        select event_type, date_trunc('hour', ts) as hour, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as sum_k,
               count(distinct cast(json_extract_string(props, '$.k') as bigint)) as n_k from events group by all""",
    "last_click": """
        with both_sides as (
          select user_id, event_id, ts, 1 as side, null::bigint as click from events where event_type = 'purchase'
          union all select user_id, null, ts, 0, event_id from events where event_type = 'click')
        select user_id, event_id, ts, last_click_id from (
          select *, last_value(click ignore nulls) over (partition by user_id order by ts, side, click rows between unbounded preceding and current row) as last_click_id from both_sides)
        where side = 1""",
}

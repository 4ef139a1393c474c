"""Graphs over the relational tables: edges (src, dst, weight), one for each pair of vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import canonical, lightest_parallel, typed

SUPPLIER_IDS, ORDER_IDS = 1_000_000, 10_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of customer and supplier of a line item; the cheapest line is the weight."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_extendedprice").alias("weight"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("src"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("dst"))
    placed = orders.join(customers, "o_custkey").select("l_orderkey", "src")
    return canonical(lines.join(placed, "l_orderkey").join(suppliers, "l_suppkey").select("src", "dst", "weight"))


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From part to supplier; supplier ids are shifted. Parts beyond the shift share ids with suppliers, so the first end may be the larger one, or both the same, and an edge and its mirror are two."""
    lines = table(spark, sf_dir, "lineitem")
    return lightest_parallel(typed(lines.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + SUPPLIER_IDS).alias("dst"), F.col("l_extendedprice").alias("weight"))))


def user_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of consecutive events. The order is one over all events, so the last event of each hour is handed over to the next hour that has any."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").cast("long").alias("user_id"), "value")
    hour = F.date_trunc("hour", "ts")
    w = Window.partitionBy("hour").orderBy("ts", "event_id")
    hours = events.withColumn("hour", hour).groupBy("hour").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    # one row for each hour of the table's time span
    nexts = hours.select("hour", F.lead("first").over(Window.orderBy("hour")).alias("after"))
    hops = events.withColumn("hour", hour).withColumn("next", F.lead("user_id").over(w)).join(nexts, "hour").select(
        F.col("user_id").alias("src"), F.coalesce("next", "after").alias("dst"), F.col("value").alias("weight")
    )
    return canonical(hops.filter("dst IS NOT NULL"))


def order_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and their orders: a forest of stars."""
    orders = table(spark, sf_dir, "orders")
    return canonical(orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + ORDER_IDS).alias("dst"), F.col("o_totalprice").alias("weight")))


SQL = {
    "nation_trade": """SELECT least(c_nationkey, s_nationkey)::BIGINT AS src, greatest(c_nationkey, s_nationkey)::BIGINT AS dst, min(l_extendedprice) AS weight
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
 WHERE c_nationkey <> s_nationkey GROUP BY 1, 2""",
    "part_supplier": "SELECT l_partkey::BIGINT AS src, (1000000 + l_suppkey)::BIGINT AS dst, min(l_extendedprice) AS weight FROM lineitem GROUP BY 1, 2",
    "user_hops": """SELECT src, dst, min(w) AS weight FROM (SELECT least(user_id, nu)::BIGINT AS src, greatest(user_id, nu)::BIGINT AS dst, value AS w
 FROM (SELECT user_id, value, lead(user_id) OVER (ORDER BY ts, event_id) AS nu FROM events) WHERE nu IS NOT NULL AND user_id <> nu) GROUP BY 1, 2""",
    "order_forest": "SELECT o_custkey::BIGINT AS src, (10000000 + o_orderkey)::BIGINT AS dst, min(o_totalprice) AS weight FROM orders GROUP BY 1, 2",
}

"""Adapters from the benchmark tables to the domain, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _named_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", "r_name")


def obs_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations by region and ship day, one for each metric: the day's largest value."""
    items, supplier = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier")
    places = supplier.join(_named_region(spark, sf_dir), supplier["s_nationkey"] == F.col("n_nationkey")).select("s_suppkey", "r_name")
    metric = F.when(F.col("l_returnflag") == "A", "demand").when(F.col("l_returnflag") == "N", "net_generation").otherwise("wholesale_price")
    value = F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice") / F.col("l_quantity")).otherwise(F.col("l_quantity"))
    rows = items.join(places, items["l_suppkey"] == places["s_suppkey"]).groupBy(F.col("r_name").alias("entity_id"), metric.alias("metric_id"), F.to_date("l_shipdate").alias("day")).agg(F.max(value).alias("value"))
    return rows.withColumns({"period_start": F.col("day").cast("timestamp"), "period_precision": F.lit("date"), "ord": F.lit(0).cast("long")})


OBS_DAILY = """obs AS (
  SELECT r_name AS entity_id, CASE l_returnflag WHEN 'A' THEN 'demand' WHEN 'N' THEN 'net_generation' ELSE 'wholesale_price' END AS metric_id, CAST(l_shipdate AS DATE) AS day,
    max(CASE WHEN l_returnflag = 'R' THEN l_extendedprice / l_quantity ELSE l_quantity END) AS value, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS period_start, 0 AS ord
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
)"""


def obs_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations from events: seven entities, three event types as metrics, others dropped."""
    ev = read(spark, sf_dir, "events")
    metric = F.when(F.col("event_type") == "view", "demand").when(F.col("event_type") == "click", "net_generation").when(F.col("event_type") == "purchase", "wholesale_price")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    rows = ev.where(F.col("event_type").isin("view", "click", "purchase"))
    return rows.select(F.concat(F.lit("R"), (F.col("user_id") % 7).cast("string")).alias("entity_id"), metric.alias("metric_id"), F.to_date("ts").alias("day"), F.col("value"), hour.alias("period_start"), F.lit("instant").alias("period_precision"), F.col("event_id").alias("ord"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"))


OBS_HOURLY = """obs AS (
  SELECT 'R' || (user_id % 7) AS entity_id, CASE event_type WHEN 'view' THEN 'demand' WHEN 'click' THEN 'net_generation' ELSE 'wholesale_price' END AS metric_id,
    CAST(ts AS DATE) AS day, value, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS period_start, event_id AS ord, 'e' || event_id AS id
  FROM events WHERE event_type IN ('view', 'click', 'purchase')
)"""


def obs_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with the event type as entity, under both metrics that a complete day needs."""
    ev = read(spark, sf_dir, "events")
    base = ev.select(F.col("event_type").alias("entity_id"), F.to_date("ts").alias("day"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("period_start"))
    return base.withColumn("metric_id", F.explode(F.array(F.lit("demand"), F.lit("net_generation"))))


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue projects from orders: status, dates and capacity."""
    orders, customer, items = (read(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    places = customer.join(_named_region(spark, sf_dir), customer["c_nationkey"] == F.col("n_nationkey")).select("c_custkey", "r_name")
    shipped = items.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    status = F.when(F.col("o_orderstatus") == "P", "active").when(F.col("o_orderstatus") == "O", "withdrawn").otherwise("operational")
    rows = orders.join(places, orders["o_custkey"] == places["c_custkey"]).join(shipped, orders["o_orderkey"] == shipped["l_orderkey"], "left")
    return rows.select(F.col("r_name").alias("region_id"), status.alias("status"), F.to_date("o_orderdate").alias("request_date"), F.when(F.col("o_orderstatus") == "F", F.to_date("last")).alias("operation_date"), F.col("o_totalprice").alias("capacity_mw"))


QUEUE = """queue AS (
  SELECT r_name AS region_id, CASE o_orderstatus WHEN 'P' THEN 'active' WHEN 'O' THEN 'withdrawn' ELSE 'operational' END AS status,
    CAST(o_orderdate AS DATE) AS request_date, CASE WHEN o_orderstatus = 'F' THEN CAST(last AS DATE) END AS operation_date, o_totalprice AS capacity_mw
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
)"""


def capex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filed spending from orders: a company for each customer."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("cik:"), F.lpad(F.col("o_custkey").cast("string"), 10, "0")).alias("entity_id"), F.lit("capex").alias("metric_id"), F.to_date("o_orderdate").alias("period_end"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("vintage"))


def value_chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges region -> nation -> supplier; some suppliers have no node, some edges loop."""
    region, nation, supplier = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    r = region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.lit("power").alias("stage"))
    n = nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.lit("network").alias("stage"))
    s = supplier.where("s_suppkey % 10 <> 3").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.lit("compute").alias("stage"))
    nodes = r.unionByName(n).unionByName(s)
    rn = nation.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("source"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("target"))
    ns = supplier.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("target"))
    loops = supplier.where("s_suppkey % 25 = 7").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("target"))
    key = F.col("s_suppkey")
    step = F.when(key % 30 == 3, key - 2).otherwise(key + 1)  # rings of three suppliers
    rings = supplier.where("s_suppkey % 30 IN (1, 2, 3)").select(F.concat(F.lit("s"), key.cast("string")).alias("source"), F.concat(F.lit("s"), step.cast("string")).alias("target"))
    return nodes, rn.unionByName(ns).unionByName(loops).unionByName(rings)

"""Raw payloads written from the benchmark tables, so that queries go through the readers of files.

Payloads lie in the folder that all executors share. Pages hold a fixed span
of days or keys, so no document grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import shared_folder

#: Hubs that stand for the regions of the daily table.
HUB_OF = {"AFRICA": "ERCOT North", "AMERICA": "Indiana Hub", "ASIA": "Mass Hub", "EUROPE": "Palo Verde", "MIDDLE EAST": "NP-15"}
DAYS_A_PAGE = 14


def _documents(rows: DataFrame, page, document) -> str:
    """One file for each page, with the JSON object that ``document`` makes of its rows."""
    path = shared_folder(rows.sparkSession)
    pages = rows.groupBy(page.alias("page")).agg(F.to_json(document, {"ignoreNullFields": "false"}).alias("value"))
    pages.repartition("page").write.partitionBy("page").text(path)
    return path


def operating(hourly: DataFrame) -> str:
    """Pages of hourly demand and generation; a third series comes along."""
    named = {"demand": "Demand", "net_generation": "Net generation", "wholesale_price": "Interchange"}
    kind = F.create_map(*(F.lit(x) for pair in named.items() for x in pair))
    rows = hourly.groupBy("entity_id", "metric_id", "day", "period_start").agg(F.max("value").alias("value"))
    row = F.struct(F.date_format("period_start", "yyyy-MM-dd'T'HH").alias("period"), F.col("entity_id").alias("respondent"), kind[F.col("metric_id")].alias("type-name"), F.col("value").cast("string").alias("value"))
    body = F.struct(F.count("*").cast("string").alias("total"), F.collect_list(row).alias("data"))
    return _documents(rows, F.floor(F.unix_date("day") / DAYS_A_PAGE), F.struct(body.alias("response")))


def balance(hourly: DataFrame) -> str:
    """Bulk files with demand and generation of an hour in one line."""
    cell = lambda m: F.max(F.when(F.col("metric_id") == m, F.col("value")))
    rows = hourly.groupBy(F.col("entity_id").alias("Balancing Authority"), F.date_format("period_start", "M/d/yyyy h:mm:ss a").alias("UTC Time at End of Hour")).agg(cell("demand").alias("Demand (MW)"), cell("net_generation").alias("Net Generation (MW)"))
    path = shared_folder(hourly.sparkSession)
    rows.write.option("header", True).csv(path)
    return path


def wholesale(daily: DataFrame) -> str:
    """Files of daily high prices by hub."""
    hub = F.create_map(*(F.lit(x) for pair in HUB_OF.items() for x in pair))
    rows = daily.where("metric_id = 'wholesale_price'").select(hub[F.col("entity_id")].alias("Price hub"), F.date_format("day", "M/d/yyyy").alias("Delivery start date"), F.col("value").alias("High price $/MWh"))
    path = shared_folder(daily.sparkSession)
    rows.write.option("header", True).csv(path)
    return path


def signal_documents(long: DataFrame, key: str) -> str:
    """Documents of given signals from (entity_id, as_of, name, value, confidence) and a number that pages them."""
    one = long.groupBy(key, "entity_id", "as_of").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("value", "confidence")))).alias("signals"))
    row = F.struct(F.col("entity_id").alias("region_id"), F.col("as_of").cast("string").alias("as_of"), "signals")
    return _documents(one, F.floor(F.col(key) / 1000), F.struct(F.collect_list(row).alias("regions")))

"""Queue projects, capital spending and keyed merges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCOUNTED = ("active", "withdrawn", "operational", "suspended")


def queue_benchmark(projects: DataFrame) -> DataFrame:
    """One row per region from (region_id, status, request_date, operation_date, capacity_mw); figures rounded to 4 places."""
    is_ = lambda s: F.col("status") == s
    done = is_("operational") & F.col("operation_date").isNotNull()
    years = F.when(done, F.datediff("operation_date", "request_date") / 365.25)
    return projects.groupBy("region_id").agg(
        F.count("*").alias("sample_size"),
        F.count_if(is_("active")).alias("active_project_count"),
        F.round(F.coalesce(F.sum(F.when(is_("active"), F.col("capacity_mw").cast("decimal(24,6)"))).cast("double"), F.lit(0.0)), 4).alias("active_capacity_mw"),
        F.round(F.try_divide(F.count_if(is_("withdrawn")), F.count_if(F.col("status").isin(*ACCOUNTED))), 4).alias("withdrawal_rate"),
        F.count_if(done).alias("operational_project_count"),
        F.round(F.median(years), 4).alias("median_years_request_to_operation"),
    )


def project_documents(projects: DataFrame) -> DataFrame:
    """(project): each project as a JSON object, dates in ISO form, an open operation date as null."""
    return projects.select(F.to_json(F.struct("region_id", "status", F.col("request_date").cast("string").alias("request_date"), F.col("operation_date").cast("string").alias("operation_date"), "capacity_mw"), {"ignoreNullFields": "false"}).alias("project"))


def check_projects(projects: DataFrame) -> DataFrame:
    """``projects``, failing on a blank region or status or a negative capacity."""
    bad = (F.trim("region_id") == "") | (F.trim("status") == "") | (F.col("capacity_mw") < 0)
    return projects.where(F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("invalid queue project"))).otherwise(F.lit(True)))


def capex_trend(obs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Latest and prior filed spending of each company and the change in per cent; of equal period ends the later row is the later."""
    w = Window.partitionBy("entity_id").orderBy(F.desc("period_end"), F.desc("ord"))
    rows = obs.where(F.col("metric_id") == "capex").withColumn("k", F.row_number().over(w)).where("k <= 2")
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    out = rows.groupBy("entity_id").agg(at(1, "value").alias("latest_value"), at(1, "period_end").alias("latest_period_end"), at(1, "vintage").alias("latest_vintage"), at(2, "value").alias("prior_value"), at(2, "period_end").alias("prior_period_end"))
    change = F.when(F.col("prior_value") != 0, (F.col("latest_value") / F.col("prior_value") - 1) * 100)
    out = out.withColumn("change_vs_prior_pct", F.round(change, 4))
    if labels is None:
        return out.withColumn("company", F.col("entity_id"))
    return out.join(labels.select("entity_id", "label"), "entity_id", "left").withColumn("company", F.coalesce("label", "entity_id")).drop("label")


def company_labels(spark, companies: Mapping[str, str]) -> DataFrame:
    return spark.createDataFrame([(f"cik:{cik.zfill(10)}", name) for name, cik in companies.items()], "entity_id string, label string")


def last_by_key(rows: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Keyed merge of pages: the last row of a key wins and keeps the first one's place (``position``)."""
    picked = F.max_by(F.struct(*values), order).alias("last")
    return rows.groupBy(*keys).agg(picked, F.min(order).alias("position")).select(*keys, "position", "last.*")


def zone_mean(rows: DataFrame, zones: Sequence[str], zone: str = "zone", at: str = "period_start", value: str = "value") -> DataFrame:
    """(period_start, value, zones): unweighted mean over the supported zones."""
    return rows.where(F.col(zone).isin(*zones) & F.col(value).isNotNull()).groupBy(at).agg(F.avg(F.col(value)).alias("value"), F.count("*").alias("zones"))


def unpivot_metrics(rows: DataFrame, ids: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Wide columns to (ids, metric_id, value) rows; null cells are dropped."""
    wide = rows.select(*ids, *(F.col(c).cast("double").alias(m) for c, m in columns.items()))
    return wide.unpivot(list(ids), list(columns.values()), "metric_id", "value").where(F.col("value").isNotNull())


def sparkline(points: DataFrame, width: float = 160.0, height: float = 40.0, base: float = 46.0) -> DataFrame:
    """(entity_id, as_of, x, y): a path scaled to the entity's range; a flat or single value lies on the base."""
    w = Window.partitionBy("entity_id")
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy("as_of")) - 1
    low, high = F.min("pressure").over(w), F.max("pressure").over(w)
    scale: Column = F.when(high > low, high - low).otherwise(1.0)
    return points.select("entity_id", "as_of", F.coalesce(F.try_divide(k.cast("double"), (n - 1).cast("double")), F.lit(0.0)).alias("__x"), ((F.col("pressure") - low) / scale).alias("__y")).select("entity_id", "as_of", (F.col("__x") * width).alias("x"), (F.lit(base) - F.col("__y") * height).alias("y"))

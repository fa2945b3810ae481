"""Component signals as relations over (entity_id, day).

Every frame is trailing or same-day, so a point-in-time cut never changes a
value: each signal is computed once for all days instead of once for each
date that is scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clamp, coverage
from ..schema import DemandConfig, PriceConfig, SupplyConfig


def daily_peaks(obs: DataFrame, metric: str | None = None) -> DataFrame:
    """(entity_id, [metric_id,] day, peak): the day's largest value, aggregated map-side first."""
    if metric:
        return obs.where(F.col("metric_id") == metric).groupBy("entity_id", "day").agg(F.max("value").alias("peak"))
    return obs.groupBy("entity_id", "metric_id", "day").agg(F.max("value").alias("peak"))


def trailing(days: int) -> Window:
    """The previous ``days`` observed days (rows, not calendar days) of an entity, without the current one."""
    return Window.partitionBy("entity_id").orderBy("day").rowsBetween(-days, -1)


def demand_signal(obs: DataFrame, config: DemandConfig = DemandConfig()) -> DataFrame:
    """(entity_id, day, peak, baseline, n, value, confidence) where history suffices.

    Growth over a zero baseline is null rather than an error.
    """
    w = trailing(config.baseline_days)
    peaks = daily_peaks(obs, "demand").withColumns({"baseline": F.avg("peak").over(w), "n": F.count("peak").over(w)})
    return peaks.where(F.col("n") >= config.min_baseline_days).withColumns({"value": demand_value(F.col("peak"), F.col("baseline"), config), "confidence": coverage(F.col("n"), config.baseline_days)})


def demand_value(peak: Column, baseline: Column, config: DemandConfig) -> Column:
    return clamp((F.try_divide(peak, baseline) - 1.0) * 100.0 / config.full_growth_pct * 100.0)


def last_rows(obs: DataFrame, metric: str) -> DataFrame:
    """(entity_id, day, period_start, precision, value): of equal periods the last input row wins."""
    return obs.where(F.col("metric_id") == metric).groupBy("entity_id", "day", "period_start", "period_precision").agg(F.max_by("value", "ord").alias("value"))


def aligned_hours(obs: DataFrame) -> DataFrame:
    """(entity_id, day, period_start, demand, generation) for periods that both metrics have."""
    keys = ["entity_id", "day", "period_start", "period_precision"]
    left = last_rows(obs, "demand").withColumnRenamed("value", "demand")
    right = last_rows(obs, "net_generation").withColumnRenamed("value", "generation")
    return left.join(right, keys).drop("period_precision")


def supply_signal(obs: DataFrame, config: SupplyConfig = SupplyConfig()) -> DataFrame:
    """(entity_id, day, hours, worst_headroom, value, confidence); hours counts all overlaps, headroom only positive demand."""
    headroom = F.when(F.col("demand") > 0, (F.col("generation") - F.col("demand")) / F.col("demand") * 100.0)
    days = aligned_hours(obs).groupBy("entity_id", "day").agg(F.count("*").alias("hours"), F.min(headroom).alias("worst_headroom"))
    value = clamp(100.0 - F.col("worst_headroom") / config.full_headroom_pct * 100.0)
    return days.where(F.col("worst_headroom").isNotNull()).withColumns({"value": value, "confidence": coverage(F.col("hours"), config.expected_hours)})


def price_signal(obs: DataFrame, config: PriceConfig = PriceConfig()) -> DataFrame:
    """(entity_id, day, peak, n, value, confidence) for every price day; value is null where history is short.

    The percentile counts ties and only looks back. Rows with a short history
    stay, because the latest price day counts even if it can't be ranked.
    """
    w = trailing(config.baseline_days)
    peaks = daily_peaks(obs, "wholesale_price").withColumns({"before": F.collect_list("peak").over(w), "n": F.count("peak").over(w)})
    below = F.size(F.filter("before", lambda x: x <= F.col("peak")))
    enough = F.col("n") >= config.min_baseline_days
    return peaks.withColumns({"value": F.when(enough, below / F.col("n") * 100.0), "confidence": F.when(enough, coverage(F.col("n"), config.baseline_days))}).drop("before")


def latest_on_or_before(grid: DataFrame, table: DataFrame, columns: list[str], day: str = "day", as_of: str = "as_of") -> DataFrame:
    """``grid`` (entity_id, as_of) with ``columns`` of the entity's last row of ``table`` up to that day, however old.

    A backward as-of join in one shuffle: both sides go through one window
    ordered by day, rows of the grid behind those of their own day.
    """
    payload = F.struct(F.col(day).alias("asof_day"), *columns)
    facts = table.select("entity_id", F.col(day).alias("at"), F.lit(0).alias("side"), payload.alias("payload"))
    asked = grid.select("entity_id", F.col(as_of).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(facts.schema["payload"].dataType).alias("payload"))
    w = Window.partitionBy("entity_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = facts.unionByName(asked).withColumn("payload", F.last("payload", ignorenulls=True).over(w)).where("side = 1")
    return found.select("entity_id", F.col("at").alias(as_of), "payload.*")


def lineage(obs: DataFrame, as_of: Column, metric: str) -> DataFrame:
    """(entity_id, observation_ids) of the rows of a metric up to a day, in input order; for one exported date."""
    rows = obs.where((F.col("metric_id") == metric) & (F.col("day") <= as_of))
    return rows.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("observation_ids"))


def lineage_rows(obs: DataFrame, grid: DataFrame, metric: str) -> DataFrame:
    """(entity_id, as_of, ord, id) of all rows of a metric up to the days of a small ``grid`` (entity_id, as_of); no array grows with the history."""
    rows = obs.where(F.col("metric_id") == metric).select("entity_id", "day", "ord", "id")
    return rows.join(F.broadcast(grid.select("entity_id", "as_of")), "entity_id").where(F.col("day") <= F.col("as_of")).select("entity_id", "as_of", "ord", "id")

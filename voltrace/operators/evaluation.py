"""Hindcast, rank correlation, sensitivity and history, all from one score relation."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import durable
from ..schema import WEIGHT_SETS, DemandConfig, PriceConfig, ScoreConfig
from . import scoring, signals

#: Means of rounded figures often lie halfway between two roundings; this sends them all up, whatever the summation order.
TIE = 1e-9


def month_grid(obs: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """(as_of): the last day with demand in each month, from the first of the start's month."""
    days = obs.where(F.col("metric_id") == "demand")
    if start:
        days = days.where(F.col("day") >= start.replace(day=1))
    if end:
        days = days.where(F.col("day") <= end)
    return days.groupBy(F.trunc("day", "month").alias("month")).agg(F.max("day").alias("as_of")).select("as_of")


def history_days(obs: DataFrame, dates: DataFrame) -> DataFrame:
    """(as_of, days): distinct observed days before each date, over all entities and metrics."""
    days = obs.select("day").distinct()
    # few dates against distinct days only; the days are counted before they are joined
    counted = days.withColumn("seen", F.count("*").over(Window.partitionBy(F.lit(0)).orderBy("day")))
    on = counted["day"] < dates["as_of"]
    return dates.join(counted, on, "left").groupBy("as_of").agg(F.coalesce(F.max("seen"), F.lit(0)).cast("long").alias("days"))


def entities(obs: DataFrame, regions: Sequence[str] | None = None) -> DataFrame:
    if regions is None:
        return obs.select("entity_id").distinct()
    return obs.sparkSession.createDataFrame([(r,) for r in regions], "entity_id string")


def backtest_rows(obs: DataFrame, dates: DataFrame, regions: Sequence[str] | None = None, horizons: Sequence[int] = (30, 90), config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """One row per entity, date and horizon: the score then, and at the later date, rounded to 4 places.

    The later score is a full one at that date; it may rest on price alone.
    """
    ok = history_days(obs, dates).where(F.col("days") >= config.minimum_history_days).select("as_of")
    starts = entities(obs, regions).crossJoin(F.broadcast(ok))  # regions by months
    steps = F.explode(F.array(*(F.lit(h) for h in horizons)))
    later = starts.withColumn("horizon_days", steps).withColumn("as_of_later", F.date_add("as_of", F.col("horizon_days")))
    grid = starts.unionByName(later.select("entity_id", F.col("as_of_later").alias("as_of"))).distinct()
    # regions by dates, used on both sides of the join below
    scored = durable(scoring.scores(obs, grid, config).select("entity_id", "as_of", "pressure", "confidence"))
    then = scored.select("entity_id", F.col("as_of").alias("as_of_later"), F.col("pressure").alias("future"))
    rows = later.join(scored, ["entity_id", "as_of"]).join(then, ["entity_id", "as_of_later"])
    return rows.select("entity_id", "as_of", F.col("horizon_days").cast("int").alias("horizon_days"), F.round("pressure", 4).alias("signal_pressure"), F.round("future", 4).alias("future_pressure"), F.round(F.col("future") - F.col("pressure"), 4).alias("future_delta"), F.round("confidence", 4).alias("signal_confidence"))


def rank_correlation(rows: DataFrame, left: str, right: str, by: str, **more: Column) -> DataFrame:
    """(by, n, rho) and aggregates ``more`` of the same pass: Spearman with average ranks for ties; 0 if either side doesn't vary, null for a single row."""

    def average_rank(c: str):
        return F.rank().over(Window.partitionBy(by).orderBy(c)) + (F.count("*").over(Window.partitionBy(by, c)) - 1) / 2.0

    r = rows.withColumns({"x": average_rank(left), "y": average_rank(right)})
    rho = F.coalesce(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")), F.lit(0.0))
    return r.groupBy(by).agg(F.count("*").alias("n"), F.when(F.count("*") > 1, rho).alias("rho"), *(c.alias(k) for k, c in more.items()))


def backtest_summary(rows: DataFrame, horizons: Sequence[int] = (30, 90)) -> DataFrame:
    """(horizon_days, observations, spearman_rank_correlation, mean_future_delta), also for horizons without rows."""
    wanted = rows.sparkSession.createDataFrame([(int(h),) for h in horizons], "horizon_days int")
    found = rank_correlation(rows, "signal_pressure", "future_pressure", "horizon_days", mean=F.avg("future_delta"))
    out = wanted.join(found, "horizon_days", "left")
    return out.select("horizon_days", F.coalesce("n", F.lit(0)).cast("long").alias("observations"), F.round("rho", 4).alias("spearman_rank_correlation"), F.round(F.col("mean") + TIE, 4).alias("mean_future_delta"))


def score_history(obs: DataFrame, dates: DataFrame, regions: Sequence[str] | None = None, config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Scores and components of every entity at every date, without a history gate."""
    return scoring.scores(obs, entities(obs, regions).crossJoin(F.broadcast(dates)), config)


def sensitivity_scenarios(obs: DataFrame, as_of: DataFrame, regions: Sequence[str] | None = None, demand_windows: Sequence[int] = (14, 28, 56), price_windows: Sequence[int] = (90, 365), weight_sets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """(entity_id, demand_baseline_days, price_baseline_days, weight_set, pressure) at the one date of ``as_of``.

    Baselines of every length come from the same window over the same peaks;
    supply doesn't depend on the scenario and is computed once.
    """
    grid = entities(obs, regions).crossJoin(F.broadcast(as_of))
    keys = ["entity_id", "as_of"]
    wide = grid.join(signals.supply_signal(obs).select("entity_id", F.col("day").alias("as_of"), F.col("value").alias("supply_tightness")), keys, "left")
    peaks = signals.daily_peaks(obs, "demand")
    for n in demand_windows:
        w = signals.trailing(n)
        config = DemandConfig(n, min(7, n))
        value = F.when(F.count("peak").over(w) >= config.min_baseline_days, signals.demand_value(F.col("peak"), F.avg("peak").over(w), config))
        peaks = peaks.withColumn(f"d{n}", value)
    wide = wide.join(peaks.drop("peak").withColumnRenamed("day", "as_of"), keys, "left")
    prices = signals.daily_peaks(obs, "wholesale_price")
    for n in price_windows:
        w = signals.trailing(n)
        config = PriceConfig(n, min(30, n))
        seen = F.count("peak").over(w)
        prices = prices.withColumns({"__before": F.collect_list("peak").over(w), "__n": seen}).withColumn(f"p{n}", F.when(F.col("__n") >= config.min_baseline_days, F.size(F.filter("__before", lambda x: x <= F.col("peak"))) / F.col("__n") * 100.0)).drop("__before", "__n")
    wide = wide.join(signals.latest_on_or_before(grid, prices, [f"p{n}" for n in price_windows]).drop("asof_day"), keys, "left")
    cases = []
    for d in demand_windows:
        for p in price_windows:
            for name, weights in (weight_sets or WEIGHT_SETS).items():
                values = {"demand_pressure": F.col(f"d{d}"), "supply_tightness": F.col("supply_tightness"), "price_stress": F.col(f"p{p}"), "execution_friction": F.lit(None).cast("double")}
                pressure = F.round(scoring.pressure_of(weights, values), 4)
                cases.append(F.struct(F.lit(d).alias("demand_baseline_days"), F.lit(p).alias("price_baseline_days"), F.lit(name).alias("weight_set"), pressure.alias("pressure")))
    return wide.select("entity_id", F.inline(F.array(*cases)))


def sensitivity_summary(scenarios: DataFrame) -> DataFrame:
    """(entity_id, scenario_count, min, max, mean and range of pressure) over scenarios that could be scored."""
    p = F.col("pressure")
    return scenarios.groupBy("entity_id").agg(F.count(p).alias("scenario_count"), F.min(p).alias("min_pressure"), F.max(p).alias("max_pressure"), F.round(F.avg(p) + TIE, 4).alias("mean_pressure"), F.round(F.max(p) - F.min(p), 4).alias("pressure_range"))

"""Missing-aware weighted score."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import display_name, pressure_band
from ..schema import COMPONENT_WEIGHTS, ScoreConfig, checked_weights
from . import signals


def pressure_of(weights: Mapping[str, float] | None = None, values: Mapping[str, Column] | None = None) -> Column:
    """Weighted mean of the components that are there; null if none with a weight is.

    ``values`` gives the components where they aren't columns of their names.
    """
    w = checked_weights(weights)
    total, present = F.lit(0.0), F.lit(0.0)
    for name, weight in w.items():
        value = F.col(name) if values is None else values[name]
        there = value.isNotNull()
        total = total + F.when(there, F.lit(float(weight)) * value).otherwise(0.0)
        present = present + F.when(there, F.lit(float(weight))).otherwise(0.0)
    return F.try_divide(total, present)


def confidence_of(weights: Mapping[str, float] | None = None) -> Column:
    """Confidence over all weight, so that what is missing lowers it."""
    w = checked_weights(weights)
    total = F.lit(0.0)
    for name, weight in w.items():
        total = total + F.when(F.col(name).isNotNull(), F.lit(float(weight)) * F.col(f"{name}_confidence")).otherwise(0.0)
    return total / F.lit(float(sum(w.values())))


def missing_of() -> Column:
    return F.filter(F.array(*(F.when(F.col(n).isNull(), F.lit(n)) for n in COMPONENT_WEIGHTS)), lambda x: x.isNotNull())


def combine(components: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Add pressure, confidence and missing_components; rows without any component are dropped."""
    out = components.withColumns({"pressure": pressure_of(weights), "confidence": confidence_of(weights), "missing_components": missing_of()})
    return out.where(F.col("pressure").isNotNull())


def components(obs: DataFrame, grid: DataFrame, config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """``grid`` (entity_id, as_of) with every component's value and confidence, null where there is none.

    Demand and supply need the day itself, price takes the latest day up to it.
    """
    d = signals.demand_signal(obs, config.demand).select("entity_id", F.col("day").alias("as_of"), F.col("value").alias("demand_pressure"), F.col("confidence").alias("demand_pressure_confidence"))
    s = signals.supply_signal(obs, config.supply).select("entity_id", F.col("day").alias("as_of"), F.col("value").alias("supply_tightness"), F.col("confidence").alias("supply_tightness_confidence"))
    p = signals.latest_on_or_before(grid, signals.price_signal(obs, config.price), ["value", "confidence"])
    p = p.select("entity_id", "as_of", F.col("value").alias("price_stress"), F.col("confidence").alias("price_stress_confidence"))
    none = F.lit(None).cast("double")
    return p.join(d, ["entity_id", "as_of"], "left").join(s, ["entity_id", "as_of"], "left").withColumns({"execution_friction": none, "execution_friction_confidence": none})


def scores(obs: DataFrame, grid: DataFrame, config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """(entity_id, as_of, components, pressure, confidence, missing_components) where anything can be scored."""
    return combine(components(obs, grid, config), config.weights)


def contributions(scored: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """(entity_id, as_of, ordinal, name, value, weight, contribution, confidence): contributions aren't rescaled."""
    w = checked_weights(weights)
    rows = F.array(*(F.struct(F.lit(k).alias("ordinal"), F.lit(n).alias("name"), F.col(n).alias("value"), F.lit(float(v)).alias("weight"), F.when(F.col(n).isNotNull(), F.lit(float(v)) * F.col(n)).otherwise(0.0).alias("contribution"), F.coalesce(F.col(f"{n}_confidence"), F.lit(0.0)).alias("confidence")) for k, (n, v) in enumerate(w.items())))
    return scored.select("entity_id", "as_of", F.inline(rows))


def from_signals(long: DataFrame) -> DataFrame:
    """Wide components from (entity_id, as_of, name, value, confidence); a repeated or unknown name is an error."""
    names = list(COMPONENT_WEIGHTS)
    bad = F.when(F.count("*") != F.countDistinct("name"), F.raise_error(F.lit("duplicate component"))).when(F.count_if(~F.col("name").isin(names)) > 0, F.raise_error(F.lit("unknown component")))
    cols = [c for n in names for c in (F.max(F.when(F.col("name") == n, F.col("value"))).alias(n), F.max(F.when((F.col("name") == n) & F.col("value").isNotNull(), F.col("confidence"))).alias(f"{n}_confidence"))]
    return long.groupBy("entity_id", "as_of").agg(*cols, bad.alias("__bad")).where(F.col("__bad").isNull()).drop("__bad")


def ranked(scored: DataFrame) -> DataFrame:
    """Highest pressure first, ties by id."""
    return scored.orderBy(F.desc("pressure"), "entity_id")


def insights(scored: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """(entity_id, as_of, title, finding, caveat) in words."""
    w = checked_weights(weights)
    parts = F.filter(F.array(*(F.when(F.col(n).isNotNull(), F.struct((-F.lit(float(v)) * F.col(n)).alias("k"), F.lit(n).alias("name"))) for n, v in w.items())), lambda x: x.isNotNull())
    leaders = F.array_join(F.transform(F.slice(F.array_sort(parts), 1, 2), lambda x: display_name(x["name"])), " and ")
    gaps = F.array_join(F.transform("missing_components", display_name), ", ")
    percent = F.format_string("%.0f%%", F.bround(F.col("confidence") * 100, 0))
    caveat = F.when(F.size("missing_components") > 0, F.concat(gaps, F.lit(" is missing; confidence is "), percent, F.lit("."))).otherwise(F.concat(F.lit("All components are present; confidence is "), percent, F.lit(".")))
    return scored.select(
        "entity_id", "as_of",
        F.concat(F.upper("entity_id"), F.lit(": "), pressure_band(F.col("pressure")), F.lit(" infrastructure pressure")).alias("title"),
        F.concat(leaders, F.lit(" are the leading pressure contributors.")).alias("finding"),
        caveat.alias("caveat"),
    )

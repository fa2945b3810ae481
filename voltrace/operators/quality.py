"""Row contracts, duplicates, coverage and release gates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import finite, trimmed
from ..schema import EVIDENCE_KINDS

METRICS = ("demand", "net_generation", "wholesale_price")


def row_violations(obs: DataFrame) -> DataFrame:
    """``obs`` with ``violations``: the names of the contracts that a row breaks, in a fixed order."""
    present = set(obs.columns)
    checks = [(f"blank_{c}", trimmed(F.col(c)).isNull()) for c in ("id", "metric_id", "entity_id", "unit", "vintage") if c in present]
    checks.append(("value_not_finite", ~finite(F.col("value"))))
    if {"period_start", "period_end"} <= present:
        checks += [("no_period", F.col("period_start").isNull() | F.col("period_end").isNull()), ("period_reversed", F.col("period_start") > F.col("period_end"))]
    if "kind" in present:
        checks.append(("unknown_kind", ~F.coalesce(F.col("kind").isin(*EVIDENCE_KINDS), F.lit(False))))
    if "source" in present:
        url = F.col("source.url")
        checks += [("blank_source", trimmed(F.col("source.id")).isNull() | trimmed(F.col("source.publisher")).isNull()), ("source_url", ~F.coalesce(url.rlike("^https?://[^/]+"), F.lit(False)))]
    return obs.withColumn("violations", F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks)), lambda x: x.isNotNull()))


def require_valid(obs: DataFrame) -> DataFrame:
    """``obs``, failing the job on the first row that breaks a contract."""
    checked = row_violations(obs)
    return checked.where(F.when(F.size("violations") > 0, F.raise_error(F.concat(F.lit("invalid observation: "), F.array_join("violations", ", ")))).otherwise(F.lit(True))).drop("violations")


def duplicates(obs: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of key values that occur more than once; prices, which several hubs share, don't count."""
    return obs.where(F.col("metric_id") != "wholesale_price").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def coverage(obs: DataFrame, start: dt.date, end: dt.date, regions: Sequence[str] | None = None) -> DataFrame:
    """(entity_id, demand_days, net_generation_days, wholesale_price_days, first_date, last_date) within the window, for regions without rows too."""
    inside = obs.where(F.col("day").between(F.lit(start), F.lit(end)))
    # days are made distinct first, so that the counts need no expansion
    days = inside.groupBy("entity_id", "metric_id", "day").agg(F.lit(1).alias("one"))
    counts = [F.count_if(F.col("metric_id") == m).alias(f"{m}_days") for m in METRICS]
    out = days.groupBy("entity_id").agg(*counts, F.min("day").alias("first_date"), F.max("day").alias("last_date"))
    if regions is None:
        return out
    wanted = obs.sparkSession.createDataFrame([(r,) for r in regions], "entity_id string")
    return wanted.join(out, "entity_id", "left").fillna(0, [f"{m}_days" for m in METRICS])


def gate_violations(obs: DataFrame, start: dt.date, end: dt.date, regions: Sequence[str] | None = None, min_metric_days: int = 365, min_price_days: int = 90, price_regions: Sequence[str] | None = None, keys: Sequence[str] = ("metric_id", "entity_id", "period_start")) -> DataFrame:
    """(ordinal, violation) in a fixed order: duplicates, then regions in the order given (else by name); empty if the release gates pass."""
    if start > end or min_metric_days <= 0 or min_price_days <= 0:
        raise ValueError("invalid window or minimum")
    found = coverage(obs, start, end, regions)
    priced = F.lit(True) if price_regions is None else F.col("entity_id").isin(*price_regions)
    needs = [(1, "demand", min_metric_days, F.lit(True)), (2, "net_generation", min_metric_days, F.lit(True)), (3, "wholesale_price", min_price_days, priced)]
    rows = F.array(*(F.when(ask & (F.col(f"{m}_days") < n), F.struct(F.lit(k).alias("k"), F.concat_ws(":", "entity_id", F.lit(m), F.lit("insufficient_history")).alias("violation"))) for k, m, n, ask in needs))
    place = F.col("entity_id") if regions is None else F.lpad(F.array_position(F.lit(list(regions)), F.col("entity_id")).cast("string"), 6, "0")
    short = found.select("entity_id", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("r")).select(F.concat(F.lit("2:"), place, F.lit(":"), F.col("r.k").cast("string")).alias("ordinal"), "r.violation")

    def any_of(d: DataFrame, ordinal: str, name: str) -> DataFrame:
        return d.limit(1).select(F.lit(ordinal).alias("ordinal"), F.lit(name).alias("violation"))

    out = any_of(duplicates(obs, *keys), "1", "duplicate_observation_keys").unionByName(short)
    return any_of(duplicates(obs, "id"), "0", "duplicate_observation_ids").unionByName(out) if "id" in obs.columns else out


def complete_days(obs: DataFrame, regions: Sequence[str] | None = None, hours: int = 24, metrics: Sequence[str] = ("demand", "net_generation")) -> DataFrame:
    """(day): days on which every region has that many distinct periods of every metric."""
    rows = obs.where(F.col("metric_id").isin(*metrics))
    if regions is not None:
        rows = rows.where(F.col("entity_id").isin(*regions))
        need = F.lit(len(regions) * len(metrics))
        full = rows.groupBy("entity_id", "metric_id", "day").agg(F.countDistinct("period_start").alias("n")).where(F.col("n") >= hours)
        return full.groupBy("day").agg(F.count("*").alias("k")).where(F.col("k") == need).select("day")
    need = rows.select(F.countDistinct("entity_id").alias("e"))
    full = rows.groupBy("entity_id", "metric_id", "day").agg(F.countDistinct("period_start").alias("n")).where(F.col("n") >= hours)
    return full.groupBy("day").agg(F.count("*").alias("k")).crossJoin(F.broadcast(need)).where(F.col("k") == F.col("e") * len(metrics)).select("day")

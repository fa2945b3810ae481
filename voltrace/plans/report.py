"""Report payload and page: small frames are collected here and nowhere before."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import benchmarks, quality, scoring, signals
from ..schema import COMPONENT_WEIGHTS, DemandConfig, PriceConfig, ScoreConfig

METRIC_OF = {"demand_pressure": "demand", "supply_tightness": "net_generation", "price_stress": "wholesale_price"}


def unavailable(wanted: DataFrame, scored: DataFrame) -> DataFrame:
    """(entity_id, reason): the reason is null for regions that have a score."""
    have = scored.select("entity_id").distinct().withColumn("has", F.lit(True))
    return wanted.join(have, "entity_id", "left").select("entity_id", F.when(F.col("has").isNull(), "no usable component").alias("reason"))


def regions_json(scored: DataFrame) -> DataFrame:
    """One row with the regions of a report as JSON, highest pressure first; figures rounded, component values not."""
    parts = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value"), F.lit(w).alias("weight"), F.round(F.when(F.col(n).isNotNull(), F.lit(w) * F.col(n)).otherwise(0.0), 4).alias("contribution"), F.coalesce(F.col(f"{n}_confidence"), F.lit(0.0)).alias("confidence")) for n, w in COMPONENT_WEIGHTS.items()))
    row = F.struct((-F.col("pressure")).alias("k"), "entity_id", F.struct(F.col("entity_id").alias("region_id"), F.col("as_of").cast("string").alias("as_of"), F.round("pressure", 4).alias("pressure"), F.round("confidence", 4).alias("confidence"), "missing_components", parts.alias("components")).alias("region"))
    return scored.agg(F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["region"]), {"ignoreNullFields": "false"}).alias("regions"))


def strict_score(obs: DataFrame, entity_id: str, as_of: dt.date) -> dict[str, Any]:
    """Score of one entity at one date with a price minimum of four days; any missing component is an error."""
    config = ScoreConfig(price=PriceConfig(min_baseline_days=4), demand=DemandConfig())
    grid = obs.sparkSession.createDataFrame([(entity_id, as_of)], "entity_id string, as_of date")
    row = scoring.components(obs.where(F.col("entity_id") == entity_id), grid, config)
    found = scoring.combine(row).collect()
    missing = [n for n in METRIC_OF if not found or found[0][n] is None]
    if missing:
        raise ValueError(f"no {missing[0]} for {entity_id} on {as_of}")
    return found[0].asDict()


def build_report(obs: DataFrame, capex: DataFrame | None, regions: Sequence[str], labels: Mapping[str, str], generated_at: dt.datetime, as_of: dt.date | None = None, analysis: Mapping[str, object] | None = None) -> dict[str, Any]:
    """Report of all regions at ``as_of``, by default the latest day that is complete for all of them."""
    spark = obs.sparkSession
    if as_of is None:
        as_of = quality.complete_days(obs, regions).agg(F.max("day")).first()[0]
        if as_of is None:
            raise ValueError("no complete common day")
    wanted = spark.createDataFrame([(r,) for r in regions], "entity_id string")
    scored = scoring.scores(obs, wanted.withColumn("as_of", F.lit(as_of)))
    payload = json.loads(regions_json(scored).first()[0] or "[]")
    ids = {m: {r.entity_id: list(r.observation_ids) for r in signals.lineage(obs.where(F.col("entity_id").isin(*regions)), F.lit(as_of), m).collect()} for m in METRIC_OF.values()} if "id" in obs.columns else {}
    for region in payload:
        for part in region["components"]:
            part["observation_ids"] = ids.get(METRIC_OF.get(part["name"], ""), {}).get(region["region_id"], []) if part["value"] is not None else []
    gone = [{"region_id": r.entity_id, "reason": r.reason} for r in unavailable(wanted, scored).where("reason IS NOT NULL").orderBy("entity_id").collect()]
    companies = []
    if capex is not None:
        named = benchmarks.capex_trend(capex, benchmarks.company_labels(spark, labels))
        companies = [{k: v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else v for k, v in r.asDict().items()} for r in named.orderBy("company").collect()]
    return {"schema_version": 1, "generated_at": generated_at.isoformat(), "dataset_status": "partial" if gone else "complete", "regions": payload, "unavailable_regions": gone, "companies": companies, **(analysis or {})}

"""Compositions of whole runs: ingest to a snapshot, a report from one, and the validation bundle."""

from __future__ import annotations

import datetime as dt
import json
import shutil
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..operators import benchmarks, evaluation, quality
from ..schema import DEFAULT_COMPANIES, DEFAULT_REGIONS, OBSERVATIONS, PRICE_REGIONS, ScoreConfig
from ..sources import SOURCES, http
from . import page, report, snapshot
from .snapshot import Artifact


@dataclass(frozen=True)
class RefreshConfig:
    output: Path
    snapshot_id: str
    generated_at: dt.datetime
    start: dt.date
    end: dt.date
    user_agent: str
    regions: tuple[str, ...] = DEFAULT_REGIONS
    companies: Mapping[str, str] | None = None
    balance_csvs: tuple[Path, ...] = ()
    wholesale_csv: Path | None = None
    zone_zips: tuple[Path, ...] = ()
    api_key: str | None = None

    def __post_init__(self) -> None:
        if not self.user_agent.strip() or not self.snapshot_id.strip() or not self.regions or self.start > self.end:
            raise ValueError("refresh needs a user agent, an id, regions and a date range")


def _artifact(staging: Path, path: Path, source: str, rows: int, at: dt.datetime) -> Artifact:
    ident, url, _ = SOURCES[source]
    return Artifact(str(path.relative_to(staging)), ident, url, at.isoformat(), rows, snapshot.sha256_path(path))


def refresh(spark: SparkSession, config: RefreshConfig, pages: Callable[[], Iterator[Mapping[str, Any]]] | None = None, facts: Callable[[str], Mapping[str, Any]] | None = None) -> Path:
    """Fetch or copy the raw files, read them into observations, and publish both as one snapshot.

    Balance files stand in for the paged interface if given; prices and zone
    archives are added. A company without supported filings has no rows.
    """
    at = config.generated_at
    pages = pages or (lambda: http.pages(lambda offset: http.hourly_url(config.regions, config.start, config.end, offset, api_key=config.api_key)))
    facts = facts or (lambda cik: http.get_json(http.facts_url(cik), config.user_agent))

    def fill(staging: Path) -> list[Artifact]:
        found, artifacts = [], []

        def copy(path: Path, folder: str) -> str:
            target = staging / "raw" / folder / path.name
            target.parent.mkdir(parents=True, exist_ok=True)
            shutil.copyfile(path, target)
            return str(target)

        if config.balance_csvs:
            paths = [copy(p, "balance") for p in config.balance_csvs]
            found.append(sources.read_balance(spark, paths, config.regions, at))
            artifacts += [_artifact(staging, Path(p), "balance", 0, at) for p in paths]
        else:
            paths = http.save_pages(staging / "raw" / "operating", pages())
            artifacts += [_artifact(staging, Path(p), "operating", len(json.loads(Path(p).read_text())["response"]["data"]), at) for p in paths]
            found.append(sources.read_operating(spark, paths, at))
        if config.wholesale_csv:
            path = copy(config.wholesale_csv, "wholesale")
            found.append(prices := sources.read_wholesale(spark, path, at))
            artifacts.append(_artifact(staging, Path(path), "wholesale", prices.count(), at))
        for zipped in config.zone_zips:
            path = copy(zipped, "zones")
            found.append(zones := sources.read_zone_archives(spark, path, at))
            artifacts.append(_artifact(staging, Path(path), "zones", zones.count(), at))
        # sources keep their order: each one's ordinals lie above those of the one before
        placed = [f.withColumn("ord", F.col("ord") + F.lit(k << 56)) for k, f in enumerate(found)]
        everything = placed[0]
        for more in placed[1:]:
            everything = everything.unionByName(more)
        artifacts.append(snapshot.write_observations(everything, staging, "observations", *SOURCES["operating"][:2], at))
        filed = spark.createDataFrame([], OBSERVATIONS)
        for k, (name, cik) in enumerate(sorted((config.companies or DEFAULT_COMPANIES).items())):
            path = staging / "raw" / "facts" / f"{name.lower().replace(' ', '-')}.json"
            snapshot.write_json(path, facts(cik))
            artifacts.append(_artifact(staging, path, "facts", 1, at))
            rows = sources.read_company_facts(spark, str(path), cik, at)
            try:
                rows.write.format("noop").mode("overwrite").save()  # every column of the few rows
            except Exception as error:
                if not sources.is_unusable_filing(error):
                    raise
                continue
            filed = filed.unionByName(rows.withColumn("ord", F.col("ord") + F.lit(k << 40)))
        artifacts.append(snapshot.write_observations(filed, staging, "capex", *SOURCES["facts"][:2], at))
        return artifacts

    return snapshot.publish(config.output, config.snapshot_id, at, fill)


def report_from_snapshot(spark: SparkSession, path: Path, regions: Sequence[str] = DEFAULT_REGIONS, companies: Mapping[str, str] = DEFAULT_COMPANIES, analysis: Mapping[str, object] | None = None) -> dict[str, Any]:
    """Report of the latest day that is complete for all regions of a snapshot."""
    at = dt.datetime.fromisoformat(str(snapshot.read_manifest(path)["generated_at"]))
    return report.build_report(snapshot.read_observations(spark, path, "observations"), snapshot.read_observations(spark, path, "capex"), regions, companies, at, analysis=analysis)


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    plain = lambda v: v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else v
    return [{k: plain(v) for k, v in r.asDict(recursive=True).items()} for r in df.collect()]


def validation_bundle(obs: DataFrame, regions: Sequence[str], start: dt.date, end: dt.date, projects: DataFrame | None = None, config: ScoreConfig = ScoreConfig(), price_regions: Sequence[str] = PRICE_REGIONS) -> dict[str, Any]:
    """Everything a report adds to the scores: gates, hindcast, sensitivity at the last date, history, queue benchmark."""
    dates = evaluation.month_grid(obs, start, end)
    violations = [r.violation for r in quality.gate_violations(obs, start, end, regions, price_regions=price_regions).orderBy("ordinal").collect()]
    repeated = {name: [":".join(str(r[c]) for c in keys) for r in quality.duplicates(obs, *keys).orderBy(*keys).collect()] if set(keys) <= set(obs.columns) else [] for name, keys in (("duplicate_observation_ids", ("id",)), ("duplicate_observation_keys", ("metric_id", "entity_id", "period_start")))}
    cover = [{"region_id": r.entity_id, "metric_days": {m: r[f"{m}_days"] for m in quality.METRICS}, "first_date": r.first_date and r.first_date.isoformat(), "last_date": r.last_date and r.last_date.isoformat()} for r in sorted(quality.coverage(obs, start, end, regions).collect(), key=lambda r: list(regions).index(r.entity_id))]
    tested = evaluation.backtest_rows(obs, dates, regions, config=config)
    out: dict[str, Any] = {
        "validation": {"schema_version": 1, "required_price_regions": list(price_regions), **repeated, "window": {"start": start.isoformat(), "end": end.isoformat()}, "observation_count": obs.count(), "coverage": cover, "passed": not violations, "violations": violations},
        "backtest": {"method": "score then against score later", "rows": _rows(tested.orderBy("entity_id", "as_of", "horizon_days")), "summaries": _rows(evaluation.backtest_summary(tested).orderBy("horizon_days"))},
    }
    history: dict[str, list[dict[str, Any]]] = {r: [] for r in regions}
    for r in evaluation.score_history(obs, dates, regions, config).orderBy("as_of").collect():
        history[r.entity_id].append({"as_of": r.as_of.isoformat(), "pressure": round(r.pressure, 4), "confidence": round(r.confidence, 4)})
    out["history"] = [{"region_id": r, "points": p} for r, p in history.items()]
    scenarios = evaluation.sensitivity_scenarios(obs, dates.agg(F.max("as_of").alias("as_of")), regions)
    summary = evaluation.sensitivity_summary(scenarios).withColumnRenamed("entity_id", "region_id").orderBy("region_id")
    out["sensitivity"] = {"scenario_count": 18, "region_summary": _rows(summary)} if dates.limit(1).count() else {"scenario_count": 0, "region_summary": []}
    if projects is not None:
        out["interconnection_benchmark"] = {"regions": _rows(benchmarks.queue_benchmark(projects).orderBy("region_id"))}
    return out


def queue_document(path: Path | None) -> dict[str, Any]:
    """A prepared queue benchmark as the report shows it; without a file it is empty."""
    if path is None:
        return {"schema_version": 1, "regions": []}
    held = json.loads(path.read_text(encoding="utf-8"))
    about = {k: held.get(k) for k in ("dataset_as_of", "source")}
    return {"schema_version": held.get("schema_version", 1), **about, "regions": held.get("benchmark", [])}


def write_report(payload: Mapping[str, Any], folder: Path) -> None:
    """The report as JSON and as a page, each written atomically."""
    snapshot.write_json(folder / "report.json", payload)
    snapshot.write_text(folder / "report.html", page.render_html(payload))


def balance_periods(start: dt.date, end: dt.date) -> list[str]:
    """Names of the half-year balance files of a range, as published: year and half."""
    out = []
    for year in range(start.year, end.year + 1):
        for name, a, b in (("Jan_Jun", 1, 6), ("Jul_Dec", 7, 12)):
            if dt.date(year, a, 1) <= end and dt.date(year, b, 28) >= start:
                out.append(f"{year}_{name}")
    return out

"""Registered queries of the analytics operators and the SQL they are compared with."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hub_region, pressure_band, slug
from ..operators import benchmarks, evaluation, graph, quality, scoring, signals
from ..schema import COMPONENT_WEIGHTS, HUB_PREFIXES, HUB_REGIONS, WEIGHT_SETS
from .. import sources
from ..functions.tables import durable
from . import payloads, report, views
from .views import OBS_DAILY, OBS_HOURLY, QUEUE

#: When the payloads count as read.
_READ_AT = dt.datetime(2026, 1, 1)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily observations as a table: plans that need several signals scan ``lineitem`` once."""
    return durable(views.obs_daily(spark, sf_dir))


# SQL that several queries share
def _window(n: int) -> str:
    return f"(PARTITION BY entity_id ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


_CLAMP = "CASE WHEN {0} IS NULL THEN NULL ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, {0})) END"
PEAKS = "peaks AS (SELECT entity_id, metric_id, day, max(value) AS peak FROM obs GROUP BY ALL)"


def _demand(n: int = 28, least: int = 7, name: str = "demand") -> str:
    value = _CLAMP.format("((peak / nullif(baseline, 0)) - 1.0::DOUBLE) * 100.0::DOUBLE / 20.0::DOUBLE * 100.0::DOUBLE")
    return f"""{name}_w AS (SELECT entity_id, day, peak, avg(peak) OVER {_window(n)} AS baseline, count(*) OVER {_window(n)} AS n FROM peaks WHERE metric_id = 'demand'),
{name} AS (SELECT entity_id, day, peak, baseline, n, {value} AS value, least(1.0::DOUBLE, n / {n}.0::DOUBLE) AS confidence FROM {name}_w WHERE n >= {least})"""


LAST = "last_rows AS (SELECT entity_id, metric_id, day, period_start, arg_max(value, ord) AS value FROM obs GROUP BY ALL)"
ALIGNED = """aligned AS (SELECT d.entity_id, d.day, d.period_start, d.value AS demand, g.value AS generation FROM last_rows d JOIN last_rows g
  ON d.metric_id = 'demand' AND g.metric_id = 'net_generation' AND d.entity_id = g.entity_id AND d.day = g.day AND d.period_start = g.period_start)"""
SUPPLY = f"""supply_w AS (SELECT entity_id, day, count(*) AS hours, min(CASE WHEN demand > 0 THEN (generation - demand) / demand * 100.0::DOUBLE END) AS worst_headroom FROM aligned GROUP BY ALL),
supply AS (SELECT entity_id, day, hours, worst_headroom, {_CLAMP.format("100.0::DOUBLE - worst_headroom / 20.0::DOUBLE * 100.0::DOUBLE")} AS value, least(1.0::DOUBLE, hours / 24.0::DOUBLE) AS confidence FROM supply_w WHERE worst_headroom IS NOT NULL)"""


def _price(n: int = 365, least: int = 30, name: str = "price") -> str:
    return f"""{name}_n AS (SELECT entity_id, day, peak, row_number() OVER (PARTITION BY entity_id ORDER BY day) AS k FROM peaks WHERE metric_id = 'wholesale_price'),
{name}_c AS (SELECT a.entity_id, a.day, a.peak, count(b.k) AS n, count(b.k) FILTER (WHERE b.peak <= a.peak) AS below FROM {name}_n a LEFT JOIN {name}_n b ON a.entity_id = b.entity_id AND b.k < a.k AND b.k >= a.k - {n} GROUP BY ALL),
{name} AS (SELECT entity_id, day, peak, n, CASE WHEN n >= {least} THEN below / n::DOUBLE * 100.0::DOUBLE END AS value, CASE WHEN n >= {least} THEN least(1.0::DOUBLE, n / {n}.0::DOUBLE) END AS confidence FROM {name}_c)"""


SIGNALS = ",\n".join((OBS_DAILY, PEAKS, _demand(), LAST, ALIGNED, SUPPLY, _price()))
MONTHS = "months AS (SELECT max(day) AS as_of FROM obs WHERE metric_id = 'demand' GROUP BY date_trunc('month', day))"
REGIONS = "regions AS (SELECT DISTINCT entity_id FROM obs)"
GRID = "grid AS (SELECT entity_id, as_of FROM regions, months)"


def _weighted(weights: dict[str, float], columns: dict[str, str]) -> str:
    names = [n for n in weights if n in columns]
    top = "0.0::DOUBLE" + "".join(f" + CASE WHEN {columns[n]} IS NULL THEN 0.0::DOUBLE ELSE {weights[n]}::DOUBLE * {columns[n]} END" for n in names)
    low = "0.0::DOUBLE" + "".join(f" + CASE WHEN {columns[n]} IS NULL THEN 0.0::DOUBLE ELSE {weights[n]}::DOUBLE END" for n in names)
    return f"(({top}) / nullif({low}, 0.0::DOUBLE))"


_COLUMNS = {"demand_pressure": "demand_pressure", "supply_tightness": "supply_tightness", "price_stress": "price_stress"}


def _scores(grid: str = "grid") -> str:
    conf = "0.0::DOUBLE" + "".join(f" + CASE WHEN {n} IS NULL THEN 0.0::DOUBLE ELSE {COMPONENT_WEIGHTS[n]}::DOUBLE * {n}_confidence END" for n in _COLUMNS)
    total = float(sum(COMPONENT_WEIGHTS.values()))
    return f"""components AS (SELECT g.entity_id, g.as_of, d.value AS demand_pressure, d.confidence AS demand_pressure_confidence, s.value AS supply_tightness, s.confidence AS supply_tightness_confidence, p.value AS price_stress, p.confidence AS price_stress_confidence
  FROM {grid} g LEFT JOIN demand d ON g.entity_id = d.entity_id AND g.as_of = d.day LEFT JOIN supply s ON g.entity_id = s.entity_id AND g.as_of = s.day ASOF LEFT JOIN price p ON g.entity_id = p.entity_id AND g.as_of >= p.day),
scores AS (SELECT *, {_weighted(COMPONENT_WEIGHTS, _COLUMNS)} AS pressure, ({conf}) / {total!r}::DOUBLE AS confidence,
  array_to_string(list_filter([CASE WHEN demand_pressure IS NULL THEN 'demand_pressure' END, CASE WHEN supply_tightness IS NULL THEN 'supply_tightness' END, CASE WHEN price_stress IS NULL THEN 'price_stress' END, 'execution_friction'], lambda x: x IS NOT NULL), ',') AS missing
  FROM components WHERE demand_pressure IS NOT NULL OR supply_tightness IS NOT NULL OR price_stress IS NOT NULL)"""


SCORES = ",\n".join((SIGNALS, MONTHS, REGIONS, GRID, _scores()))


def _grid(obs: DataFrame) -> DataFrame:
    return evaluation.entities(obs).crossJoin(F.broadcast(evaluation.month_grid(obs)))  # regions by months


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _daily(spark, sf_dir)
    return scoring.scores(obs, _grid(obs))


# signals
@query(f"WITH {OBS_DAILY}, {PEAKS} SELECT entity_id, metric_id, day, peak FROM peaks")
def daily_peaks(spark, sf_dir):
    return signals.daily_peaks(views.obs_daily(spark, sf_dir))


@query(f"WITH {OBS_DAILY}, {PEAKS}, {_demand()} SELECT entity_id, day, peak, baseline, n, value, confidence FROM demand")
def demand_pressure(spark, sf_dir):
    return signals.demand_signal(views.obs_daily(spark, sf_dir))


@query(f"WITH {OBS_HOURLY}, {LAST}, {ALIGNED} SELECT entity_id, day, period_start, demand, generation FROM aligned")
def aligned_hours(spark, sf_dir):
    out = signals.aligned_hours(views.obs_hourly(spark, sf_dir))
    return out.withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))


@query(f"WITH {OBS_HOURLY}, {LAST}, {ALIGNED}, {SUPPLY} SELECT entity_id, day, hours, worst_headroom, value, confidence FROM supply")
def supply_tightness(spark, sf_dir):
    return signals.supply_signal(views.obs_hourly(spark, sf_dir))


@query(f"WITH {OBS_DAILY}, {PEAKS}, {_price()} SELECT entity_id, day, peak, n, value, confidence FROM price")
def price_percentile(spark, sf_dir):
    return signals.price_signal(views.obs_daily(spark, sf_dir))


@query(f"WITH {OBS_DAILY}, {PEAKS}, {_price()}, {MONTHS}, {REGIONS}, {GRID} SELECT g.entity_id, g.as_of, p.day AS asof_day, p.peak, p.value FROM grid g ASOF LEFT JOIN price p ON g.entity_id = p.entity_id AND g.as_of >= p.day")
def price_asof(spark, sf_dir):
    obs = _daily(spark, sf_dir)
    return signals.latest_on_or_before(_grid(obs), signals.price_signal(obs), ["peak", "value"])


# scores
@query(f"WITH {SCORES} SELECT entity_id, as_of, demand_pressure, supply_tightness, price_stress, pressure, confidence, missing FROM scores")
def regional_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("entity_id", "as_of", "demand_pressure", "supply_tightness", "price_stress", "pressure", "confidence", F.array_join("missing_components", ",").alias("missing"))


@query(f"WITH {SCORES} SELECT entity_id, as_of, pressure, row_number() OVER (PARTITION BY as_of ORDER BY pressure DESC, entity_id) AS place FROM scores")
def ranked_regions(spark, sf_dir):
    from pyspark.sql import Window

    return _scored(spark, sf_dir).select("entity_id", "as_of", "pressure", F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc("pressure"), "entity_id")).cast("long").alias("place"))


@query(f"WITH {SCORES}, names AS (SELECT * FROM (VALUES {', '.join(f'({k}, {n!r}, {w}::DOUBLE)' for k, (n, w) in enumerate(COMPONENT_WEIGHTS.items()))}) t(ordinal, name, weight)), cells AS (SELECT *, CASE name WHEN 'demand_pressure' THEN demand_pressure WHEN 'supply_tightness' THEN supply_tightness WHEN 'price_stress' THEN price_stress END AS value, CASE name WHEN 'demand_pressure' THEN demand_pressure_confidence WHEN 'supply_tightness' THEN supply_tightness_confidence WHEN 'price_stress' THEN price_stress_confidence END AS c FROM scores, names) SELECT entity_id, as_of, CAST(ordinal AS INTEGER) AS ordinal, name, value, weight, CASE WHEN value IS NULL THEN 0.0::DOUBLE ELSE weight * value END AS contribution, coalesce(c, 0.0::DOUBLE) AS confidence FROM cells")
def score_components(spark, sf_dir):
    return scoring.contributions(_scored(spark, sf_dir))


@query(f"WITH {SCORES} SELECT entity_id, as_of, pressure, CASE WHEN pressure >= 70 THEN 'high' WHEN pressure >= 45 THEN 'moderate' ELSE 'low' END AS band FROM scores")
def pressure_bands(spark, sf_dir):
    return _scored(spark, sf_dir).select("entity_id", "as_of", "pressure", pressure_band(F.col("pressure")).alias("band"))


@query(
    f"""WITH {SCORES}, parts AS (SELECT entity_id, as_of, u.name, u.c, row_number() OVER (PARTITION BY entity_id, as_of ORDER BY u.c DESC, u.name) AS k FROM scores,
  unnest([{{'name': 'demand_pressure', 'c': 0.35::DOUBLE * demand_pressure}}, {{'name': 'supply_tightness', 'c': 0.3::DOUBLE * supply_tightness}}, {{'name': 'price_stress', 'c': 0.2::DOUBLE * price_stress}}]) AS t(u) WHERE u.c IS NOT NULL),
lead AS (SELECT entity_id, as_of, string_agg(replace(name, '_', ' '), ' and ' ORDER BY k) AS leaders FROM parts WHERE k <= 2 GROUP BY ALL)
SELECT s.entity_id, s.as_of, upper(s.entity_id) || ': ' || CASE WHEN pressure >= 70 THEN 'high' WHEN pressure >= 45 THEN 'moderate' ELSE 'low' END || ' infrastructure pressure' AS title,
  leaders || ' are the leading pressure contributors.' AS finding,
  replace(replace(missing, '_', ' '), ',', ', ') || ' is missing; confidence is ' || CAST(CAST(round_even(confidence * 100, 0) AS INTEGER) AS VARCHAR) || '%.' AS caveat
FROM scores s JOIN lead l ON s.entity_id = l.entity_id AND s.as_of = l.as_of"""
)
def insight_cards(spark, sf_dir):
    return scoring.insights(_scored(spark, sf_dir))


def _given_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals by supplier as a fixture gives them; some components have no value."""
    key = F.col("s_suppkey")
    value = lambda m, none: F.when(key % none != 0, ((key * m) % 101).cast("double"))
    parts = [F.struct(F.lit(n).alias("name"), value(m, none).alias("value"), F.lit(c).alias("confidence")) for n, m, none, c in zip(COMPONENT_WEIGHTS, (7, 13, 17, 3), (1000, 5, 3, 2), (1.0, 0.5, 0.75, 0.25), strict=True)]
    rows = views.read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("s"), key.cast("string")).alias("entity_id"), F.lit(dt.date(2024, 1, 1)).alias("as_of"), F.explode(F.array(*parts)).alias("r"))
    return rows.select("s_suppkey", "entity_id", "as_of", "r.*")


_STRICT = """given AS (SELECT 's' || s_suppkey AS entity_id, CASE WHEN s_suppkey % 1000 <> 0 THEN (s_suppkey * 7) % 101 END AS d, CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey * 13) % 101 END AS s,
  CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey * 17) % 101 END AS p, CASE WHEN s_suppkey % 2 <> 0 THEN (s_suppkey * 3) % 101 END AS f FROM supplier),
parts AS (SELECT entity_id, 0.35::DOUBLE * coalesce(d, 0) + 0.3::DOUBLE * coalesce(s, 0) + 0.2::DOUBLE * coalesce(p, 0) + 0.15::DOUBLE * coalesce(f, 0) AS total,
  CASE WHEN d IS NULL THEN 0 ELSE 0.35::DOUBLE END + CASE WHEN s IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN p IS NULL THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN f IS NULL THEN 0 ELSE 0.15::DOUBLE END AS weight,
  CASE WHEN d IS NULL THEN 0 ELSE 0.35::DOUBLE END + CASE WHEN s IS NULL THEN 0 ELSE 0.15::DOUBLE END + CASE WHEN p IS NULL THEN 0 ELSE 0.15::DOUBLE END + CASE WHEN f IS NULL THEN 0 ELSE 0.0375::DOUBLE END AS confidence FROM given)
SELECT entity_id, DATE '2024-01-01' AS as_of, round(total / weight, 6) AS pressure, round(confidence, 6) AS confidence FROM parts WHERE weight > 0"""


@query(f"WITH {_STRICT}")
def strict_score(spark, sf_dir):
    """Scores from given signals of every supplier."""
    found = scoring.combine(scoring.from_signals(_given_signals(spark, sf_dir).drop("s_suppkey")))
    return found.select("entity_id", "as_of", F.round("pressure", 6).alias("pressure"), F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_STRICT}")
def signal_payload(spark, sf_dir):
    """The same scores from signal documents."""
    path = payloads.signal_documents(_given_signals(spark, sf_dir), "s_suppkey")
    found = scoring.combine(scoring.from_signals(sources.read_signals(spark, path).drop("observation_ids")))
    return found.select("entity_id", "as_of", F.round("pressure", 6).alias("pressure"), F.round("confidence", 6).alias("confidence"))


# evaluation
@query(f"WITH {OBS_DAILY}, {MONTHS} SELECT as_of FROM months")
def month_end_grid(spark, sf_dir):
    return evaluation.month_grid(views.obs_daily(spark, sf_dir))


HISTORY = "history AS (SELECT as_of, (SELECT count(DISTINCT day) FROM obs WHERE day < as_of) AS days FROM months)"


@query(f"WITH {OBS_DAILY}, {MONTHS}, {HISTORY} SELECT as_of, days FROM history")
def history_gate(spark, sf_dir):
    obs = _daily(spark, sf_dir)
    return evaluation.history_days(obs, evaluation.month_grid(obs))


BACKTEST = ",\n".join(
    (
        SIGNALS, MONTHS, REGIONS, HISTORY,
        "starts AS (SELECT entity_id, as_of, h AS horizon_days FROM regions, history, (VALUES (30), (90)) t(h) WHERE days >= 365)",
        "grid AS (SELECT DISTINCT entity_id, as_of FROM starts UNION SELECT entity_id, CAST(as_of + CAST(horizon_days AS INTEGER) AS DATE) FROM starts)",
        _scores(),
        "back AS (SELECT b.entity_id, b.as_of, CAST(b.horizon_days AS INTEGER) AS horizon_days, round(s.pressure, 4) AS signal_pressure, round(f.pressure, 4) AS future_pressure, round(f.pressure - s.pressure, 4) AS future_delta, round(s.confidence, 4) AS signal_confidence FROM starts b JOIN scores s ON b.entity_id = s.entity_id AND b.as_of = s.as_of JOIN scores f ON b.entity_id = f.entity_id AND f.as_of = CAST(b.as_of + CAST(b.horizon_days AS INTEGER) AS DATE))",
    )
)


def _backtest(spark, sf_dir):
    obs = _daily(spark, sf_dir)
    return evaluation.backtest_rows(obs, evaluation.month_grid(obs))


@query(f"WITH {BACKTEST} SELECT * FROM back")
def backtest_rows(spark, sf_dir):
    return _backtest(spark, sf_dir)


_RHO = "CASE WHEN stddev_pop(x) * stddev_pop(y) = 0 THEN 0.0::DOUBLE ELSE covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END"


@query(
    f"""WITH {BACKTEST}, ranks AS (SELECT horizon_days, future_delta, rank() OVER (PARTITION BY horizon_days ORDER BY signal_pressure) + (count(*) OVER (PARTITION BY horizon_days, signal_pressure) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY horizon_days ORDER BY future_pressure) + (count(*) OVER (PARTITION BY horizon_days, future_pressure) - 1) / 2.0::DOUBLE AS y FROM back),
hs AS (SELECT * FROM (VALUES (30), (90)) t(h))
SELECT CAST(h AS INTEGER) AS horizon_days, count(x) AS observations, round(CASE WHEN count(x) > 1 THEN {_RHO} END, 4) AS spearman_rank_correlation, round(avg(future_delta) + 1e-9::DOUBLE, 4) AS mean_future_delta FROM hs LEFT JOIN ranks ON h = horizon_days GROUP BY h"""
)
def backtest_summary(spark, sf_dir):
    return evaluation.backtest_summary(_backtest(spark, sf_dir))


@query(f"WITH {SCORES} SELECT entity_id, as_of, round(pressure, 4) AS pressure, round(confidence, 4) AS confidence, demand_pressure, supply_tightness, price_stress FROM scores")
def score_history(spark, sf_dir):
    obs = _daily(spark, sf_dir)
    return evaluation.score_history(obs, evaluation.month_grid(obs)).select("entity_id", "as_of", F.round("pressure", 4).alias("pressure"), F.round("confidence", 4).alias("confidence"), "demand_pressure", "supply_tightness", "price_stress")


_SCENARIOS = " UNION ALL ".join(
    f"SELECT g.entity_id, {d} AS demand_baseline_days, {p} AS price_baseline_days, '{name}' AS weight_set, round({_weighted(w, {'demand_pressure': 'd.value', 'supply_tightness': 's.value', 'price_stress': 'p.value'})}, 4) AS pressure FROM one g LEFT JOIN demand{d} d ON g.entity_id = d.entity_id AND g.as_of = d.day LEFT JOIN supply s ON g.entity_id = s.entity_id AND g.as_of = s.day ASOF LEFT JOIN price{p} p ON g.entity_id = p.entity_id AND g.as_of >= p.day"
    for d in (14, 28, 56)
    for p in (90, 365)
    for name, w in WEIGHT_SETS.items()
)
SENSITIVITY = ",\n".join((OBS_DAILY, PEAKS, LAST, ALIGNED, SUPPLY, *(_demand(d, min(7, d), f"demand{d}") for d in (14, 28, 56)), *(_price(p, min(30, p), f"price{p}") for p in (90, 365)), MONTHS, REGIONS, "one AS (SELECT entity_id, max(as_of) AS as_of FROM regions, months GROUP BY entity_id)", f"scenarios AS ({_SCENARIOS})"))


def _sensitivity(spark, sf_dir):
    obs = _daily(spark, sf_dir)
    return evaluation.sensitivity_scenarios(obs, evaluation.month_grid(obs).agg(F.max("as_of").alias("as_of")))


@query(f"WITH {SENSITIVITY} SELECT entity_id, CAST(demand_baseline_days AS INTEGER) AS demand_baseline_days, CAST(price_baseline_days AS INTEGER) AS price_baseline_days, weight_set, pressure FROM scenarios")
def sensitivity_scenarios(spark, sf_dir):
    return _sensitivity(spark, sf_dir)


@query(f"WITH {SENSITIVITY} SELECT entity_id, count(pressure) AS scenario_count, min(pressure) AS min_pressure, max(pressure) AS max_pressure, round(avg(pressure) + 1e-9::DOUBLE, 4) AS mean_pressure, round(max(pressure) - min(pressure), 4) AS pressure_range FROM scenarios GROUP BY entity_id")
def sensitivity_summary(spark, sf_dir):
    return evaluation.sensitivity_summary(_sensitivity(spark, sf_dir))


# quality
_FROM, _TO = dt.date(1900, 1, 1), dt.date(2100, 12, 31)
_COVERAGE = f"cover AS (SELECT entity_id, count(DISTINCT CASE WHEN metric_id = 'demand' THEN day END) AS demand_days, count(DISTINCT CASE WHEN metric_id = 'net_generation' THEN day END) AS net_generation_days, count(DISTINCT CASE WHEN metric_id = 'wholesale_price' THEN day END) AS wholesale_price_days, min(day) AS first_date, max(day) AS last_date FROM obs WHERE day BETWEEN DATE '{_FROM}' AND DATE '{_TO}' GROUP BY entity_id)"


@query(f"WITH {OBS_DAILY}, {_COVERAGE} SELECT * FROM cover")
def coverage(spark, sf_dir):
    return quality.coverage(views.obs_daily(spark, sf_dir), _FROM, _TO)


@query(f"WITH {OBS_HOURLY} SELECT metric_id, entity_id, period_start, count(*) AS n FROM obs WHERE metric_id <> 'wholesale_price' GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    out = quality.duplicates(views.obs_hourly(spark, sf_dir), "metric_id", "entity_id", "period_start")
    return out.withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))


@query(
    f"""WITH {OBS_HOURLY}, cover AS (SELECT entity_id, count(DISTINCT CASE WHEN metric_id = 'demand' THEN day END) AS demand, count(DISTINCT CASE WHEN metric_id = 'net_generation' THEN day END) AS net_generation, count(DISTINCT CASE WHEN metric_id = 'wholesale_price' THEN day END) AS wholesale_price FROM obs WHERE day BETWEEN DATE '2000-01-01' AND DATE '2030-12-31' GROUP BY entity_id),
gates AS (SELECT '2:' || entity_id || ':' || k AS ordinal, entity_id || ':' || m || ':insufficient_history' AS violation, CASE k WHEN 1 THEN demand WHEN 2 THEN net_generation ELSE wholesale_price END AS n, least FROM cover, (VALUES (1, 'demand', 30), (2, 'net_generation', 30), (3, 'wholesale_price', 30)) t(k, m, least))
SELECT ordinal, violation FROM gates WHERE n < least
UNION ALL SELECT '1', 'duplicate_observation_keys' WHERE EXISTS (SELECT 1 FROM obs WHERE metric_id <> 'wholesale_price' GROUP BY metric_id, entity_id, period_start HAVING count(*) > 1)
UNION ALL SELECT '0', 'duplicate_observation_ids' WHERE EXISTS (SELECT 1 FROM obs WHERE metric_id <> 'wholesale_price' GROUP BY id HAVING count(*) > 1)"""
)
def release_gates(spark, sf_dir):
    return quality.gate_violations(views.obs_hourly(spark, sf_dir), dt.date(2000, 1, 1), dt.date(2030, 12, 31), min_metric_days=30, min_price_days=30)


@query("""WITH full_days AS (SELECT event_type, CAST(ts AS DATE) AS day FROM events GROUP BY ALL HAVING count(DISTINCT date_trunc('hour', ts)) >= 22)
SELECT day FROM full_days GROUP BY day HAVING count(*) = (SELECT count(DISTINCT event_type) FROM events)""")
def common_complete_day(spark, sf_dir):
    """Days that are complete for every entity; 22 hours count as a full day of these events."""
    return quality.complete_days(views.obs_by_type(spark, sf_dir), hours=22)


@query(f"""WITH {OBS_HOURLY}, bad AS (SELECT ord, entity_id, CASE WHEN ord % 101 = 7 THEN 'nan'::DOUBLE WHEN ord % 103 = 5 THEN 'inf'::DOUBLE ELSE value END AS value, CASE WHEN ord % 107 = 3 THEN '  ' ELSE id END AS id FROM obs)
SELECT ord, array_to_string(list_filter([CASE WHEN trim(id) = '' THEN 'blank_id' END, CASE WHEN NOT isfinite(value) THEN 'value_not_finite' END], lambda x: x IS NOT NULL), ',') AS violations FROM bad WHERE trim(id) = '' OR NOT isfinite(value)""")
def value_contract(spark, sf_dir):
    obs = views.obs_hourly(spark, sf_dir).select("ord", "entity_id", "value", "id")
    spoiled = obs.withColumn("value", F.when(F.col("ord") % 101 == 7, float("nan")).when(F.col("ord") % 103 == 5, float("inf")).otherwise(F.col("value"))).withColumn("id", F.when(F.col("ord") % 107 == 3, "  ").otherwise(F.col("id")))
    return quality.row_violations(spoiled).where(F.size("violations") > 0).select("ord", F.array_join("violations", ",").alias("violations"))


@query(f"WITH {SCORES}, wanted AS (SELECT DISTINCT entity_id FROM obs UNION ALL SELECT 'ATLANTIS') SELECT w.entity_id, CASE WHEN s.entity_id IS NULL THEN 'no usable component' END AS reason FROM wanted w LEFT JOIN (SELECT DISTINCT entity_id FROM scores) s ON w.entity_id = s.entity_id".replace("ATLANTIS", "NOWHERE"))
def unavailable_regions(spark, sf_dir):
    obs = _daily(spark, sf_dir)
    wanted = evaluation.entities(obs).unionByName(spark.createDataFrame([("NOWHERE",)], "entity_id string"))
    return report.unavailable(wanted, scoring.scores(obs, _grid(obs)))


# benchmarks and merges
@query(
    f"""WITH {QUEUE} SELECT region_id, count(*) AS sample_size, count(*) FILTER (WHERE status = 'active') AS active_project_count, round(CAST(coalesce(sum(CAST(capacity_mw AS DECIMAL(24,6))) FILTER (WHERE status = 'active'), 0) AS DOUBLE), 4) AS active_capacity_mw,
  round(count(*) FILTER (WHERE status = 'withdrawn') / nullif(count(*), 0)::DOUBLE, 4) AS withdrawal_rate, count(*) FILTER (WHERE status = 'operational' AND operation_date IS NOT NULL) AS operational_project_count,
  round(median((operation_date - request_date) / 365.25::DOUBLE) FILTER (WHERE status = 'operational' AND operation_date IS NOT NULL), 4) AS median_years_request_to_operation FROM queue GROUP BY region_id"""
)
def queue_benchmark(spark, sf_dir):
    return benchmarks.queue_benchmark(benchmarks.check_projects(views.queue(spark, sf_dir)))


@query(
    """WITH r AS (SELECT 'cik:' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS entity_id, CAST(o_orderdate AS DATE) AS e, o_totalprice AS v, o_orderpriority AS vintage, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS k FROM orders)
SELECT a.entity_id, a.entity_id AS company, a.v AS latest_value, a.e AS latest_period_end, a.vintage AS latest_vintage, b.v AS prior_value, b.e AS prior_period_end, round(CASE WHEN b.v <> 0 THEN (a.v / b.v - 1) * 100 END, 4) AS change_vs_prior_pct FROM r a LEFT JOIN r b ON a.entity_id = b.entity_id AND b.k = 2 WHERE a.k = 1"""
)
def capex_trend(spark, sf_dir):
    return benchmarks.capex_trend(views.capex(spark, sf_dir))


_HUBS = {"Goldenrod Hub": "ERCO", "metallic": "PJM"}
_PREFIX = {"a": "MISO", "b": "CISO", "blue": "SWPP", "c": "ISNE", "m": "NYIS"}


@query(
    "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CASE "
    + " ".join(f"WHEN p_name = '{k}' THEN '{v}'" for k, v in _HUBS.items())
    + " "
    + " ".join(f"WHEN starts_with(p_name, '{k}') THEN '{v}'" for k, v in _PREFIX.items())
    + " END AS region FROM part"
)
def hub_region_map(spark, sf_dir):
    part = views.read(spark, sf_dir, "part")
    return part.select("p_partkey", slug(F.col("p_name")).alias("slug"), hub_region(F.col("p_name"), _HUBS, _PREFIX).alias("region"))


_HUB_NAMES = ("ERCOT North", "SP15 EZ Gen DA LMP Peak 7x16", "Palo Verde Peak", "Mass Hub extra", "Unknown Hub", " pjm west")


@query("SELECT p_partkey, CASE p_partkey % 6 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(_HUB_NAMES)) + " END AS hub, CASE p_partkey % 6 WHEN 0 THEN 'ERCO' WHEN 1 THEN 'CISO' WHEN 2 THEN 'SWPP' WHEN 3 THEN 'ISNE' END AS region FROM part")
def wholesale_hubs(spark, sf_dir):
    """Regions of hub names as files spell them: exact, by prefix, unknown."""
    hub = F.element_at(F.array(*(F.lit(n) for n in _HUB_NAMES)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return views.read(spark, sf_dir, "part").select("p_partkey", hub.alias("hub")).withColumn("region", hub_region(F.col("hub"), HUB_REGIONS, HUB_PREFIXES))


@query(f"WITH {OBS_HOURLY} SELECT metric_id, entity_id, period_start, max(value) AS value FROM obs WHERE metric_id <> 'wholesale_price' GROUP BY ALL")
def operating_payload(spark, sf_dir):
    """Hourly demand and generation from pages of JSON."""
    got = sources.read_operating(spark, payloads.operating(views.obs_hourly(spark, sf_dir)), _READ_AT)
    return got.select("metric_id", "entity_id", F.col("period_start").cast("timestamp_ntz").alias("period_start"), "value")


@query(f"WITH {OBS_HOURLY} SELECT metric_id, entity_id, period_start, max(value) AS value FROM obs WHERE metric_id <> 'wholesale_price' GROUP BY ALL")
def balance_csv(spark, sf_dir):
    """The same from bulk CSV files."""
    got = sources.read_balance(spark, payloads.balance(views.obs_hourly(spark, sf_dir)), [f"R{k}" for k in range(7)], _READ_AT)
    return got.select("metric_id", "entity_id", F.col("period_start").cast("timestamp_ntz").alias("period_start"), "value")


@query(f"WITH {OBS_DAILY} SELECT CASE entity_id WHEN 'AFRICA' THEN 'ERCO' WHEN 'AMERICA' THEN 'MISO' WHEN 'ASIA' THEN 'ISNE' WHEN 'EUROPE' THEN 'SWPP' ELSE 'CISO' END AS entity_id, day, value FROM obs WHERE metric_id = 'wholesale_price'")
def wholesale_csv(spark, sf_dir):
    """Daily high prices from CSV files."""
    return sources.read_wholesale(spark, payloads.wholesale(views.obs_daily(spark, sf_dir)), _READ_AT).select("entity_id", "day", "value")


@query(f"WITH {QUEUE} SELECT region_id, status, CAST(request_date AS VARCHAR) AS request_date, CAST(operation_date AS VARCHAR) AS operation_date, count(*) AS n, CAST(sum(CAST(capacity_mw AS DECIMAL(24,6))) AS DOUBLE) AS capacity_mw FROM queue GROUP BY region_id, status, request_date, operation_date")
def project_documents(spark, sf_dir):
    """Queue projects as JSON objects and back."""
    rows = benchmarks.project_documents(views.queue(spark, sf_dir)).select(F.from_json("project", "region_id string, status string, request_date string, operation_date string, capacity_mw double").alias("p")).select("p.*")
    return rows.groupBy("region_id", "status", "request_date", "operation_date").agg(F.count("*").alias("n"), F.sum(F.col("capacity_mw").cast("decimal(24,6)")).cast("double").alias("capacity_mw"))


@query(f"WITH {OBS_HOURLY} SELECT period_start, round(avg(value), 6) AS value, count(*) AS zones FROM obs WHERE metric_id = 'wholesale_price' GROUP BY period_start")
def zone_mean(spark, sf_dir):
    obs = views.obs_hourly(spark, sf_dir).where("metric_id = 'wholesale_price'")
    out = benchmarks.zone_mean(obs, [f"R{k}" for k in range(7)], zone="entity_id")
    return out.select(F.col("period_start").cast("timestamp_ntz").alias("period_start"), F.round("value", 6).alias("value"), "zones")


@query("SELECT l_orderkey, l_linenumber, l_shipdate, 'demand' AS metric_id, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_shipdate, 'net_generation', l_extendedprice FROM lineitem")
def metric_unpivot(spark, sf_dir):
    return benchmarks.unpivot_metrics(views.read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_shipdate"], {"l_quantity": "demand", "l_extendedprice": "net_generation"})


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS period, 'R' || (user_id % 7) AS respondent, event_type, min(event_id) AS position, arg_max(value, event_id) AS value, arg_max(user_id, event_id) AS user_id FROM events GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY 1, 2, 3"))
def page_merge_dedup(spark, sf_dir):
    ev = views.read(spark, sf_dir, "events").withColumns({"period": F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz"), "respondent": F.concat(F.lit("R"), (F.col("user_id") % 7).cast("string"))})
    return benchmarks.last_by_key(ev, ["period", "respondent", "event_type"], "event_id", ["value", "user_id"])


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1, 2")
def json_series(spark, sf_dir):
    ev = views.read(spark, sf_dir, "events")
    return ev.select("event_type", "event_id", F.from_json("props", "k long")["k"].alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(f"WITH daily AS (WITH {OBS_DAILY} SELECT entity_id, metric_id, day, value FROM obs), hourly AS (WITH {OBS_HOURLY} SELECT entity_id, metric_id, day, value FROM obs) SELECT entity_id, metric_id, count(*) AS n, min(day) AS first_date, max(day) AS last_date, max(value) AS most FROM (SELECT * FROM daily UNION ALL SELECT * FROM hourly) GROUP BY 1, 2")
def source_union(spark, sf_dir):
    cols = ["entity_id", "metric_id", "day", "value"]
    both = views.obs_daily(spark, sf_dir).select(cols).unionByName(views.obs_hourly(spark, sf_dir).select(cols))
    return both.groupBy("entity_id", "metric_id").agg(F.count("*").alias("n"), F.min("day").alias("first_date"), F.max("day").alias("last_date"), F.max("value").alias("most"))


@query(f"WITH {SCORES}, k AS (SELECT entity_id, as_of, pressure, row_number() OVER (PARTITION BY entity_id ORDER BY as_of) - 1 AS i, count(*) OVER (PARTITION BY entity_id) AS n, min(pressure) OVER (PARTITION BY entity_id) AS lo, max(pressure) OVER (PARTITION BY entity_id) AS hi FROM scores) SELECT entity_id, as_of, round(coalesce(i::DOUBLE / nullif(n - 1, 0)::DOUBLE, 0.0::DOUBLE) * 160.0::DOUBLE, 6) AS x, round(46.0::DOUBLE - (pressure - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1.0::DOUBLE END * 40.0::DOUBLE, 6) AS y FROM k")
def sparkline(spark, sf_dir):
    return benchmarks.sparkline(_scored(spark, sf_dir)).select("entity_id", "as_of", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# graph
_EDGES = "nodes AS (SELECT 'r' || r_regionkey AS id FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey % 10 <> 3), edges AS (SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 's' || s_suppkey, 's' || s_suppkey FROM supplier WHERE s_suppkey % 25 = 7 UNION ALL SELECT 's' || s_suppkey, 's' || (s_suppkey + 1) FROM supplier WHERE s_suppkey % 30 IN (1, 2) UNION ALL SELECT 's' || s_suppkey, 's' || (s_suppkey - 2) FROM supplier WHERE s_suppkey % 30 = 3)"


@query(f"WITH {_EDGES} SELECT DISTINCT source, target, 'unknown_node' AS problem FROM edges WHERE source NOT IN (SELECT id FROM nodes) OR target NOT IN (SELECT id FROM nodes) UNION ALL SELECT DISTINCT source, target, 'self_loop' FROM edges WHERE source = target")
def invalid_edges(spark, sf_dir):
    return graph.bad_edges(*views.value_chain(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_EDGES}, reach(a, b) AS (SELECT source, target FROM edges UNION SELECT reach.a, edges.target FROM reach JOIN edges ON reach.b = edges.source),
below AS (SELECT b AS id FROM reach WHERE a IN (SELECT a FROM reach WHERE a = b))
SELECT DISTINCT source, target FROM edges WHERE source IN (SELECT id FROM below)"""
)
def graph_acyclic(spark, sf_dir):
    """Edges left after peeling: cycles of one and of three suppliers, and what lies below them."""
    _, edges = views.value_chain(spark, sf_dir)
    return graph.cyclic_core(edges)


@query("SELECT 's' || s_suppkey AS id, 'stage' AS problem FROM supplier WHERE s_suppkey % 17 = 5 UNION ALL SELECT 's' || s_suppkey, 'duplicate' FROM supplier WHERE s_suppkey % 17 = 5 AND s_suppkey % 10 <> 3")
def invalid_nodes(spark, sf_dir):
    nodes, _ = views.value_chain(spark, sf_dir)
    again = views.read(spark, sf_dir, "supplier").where("s_suppkey % 17 = 5").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.lit("kitchen").alias("stage"))
    return graph.bad_nodes(nodes.unionByName(again))


# reports
@query()
def report_json(spark, sf_dir):
    """One row: the report of the latest month end."""
    obs = _daily(spark, sf_dir)
    latest = evaluation.month_grid(obs).agg(F.max("as_of").alias("as_of"))
    scored = scoring.scores(obs, evaluation.entities(obs).crossJoin(F.broadcast(latest)))
    return report.regions_json(scored)


@query(
    f"""WITH {OBS_HOURLY}, {PEAKS}, {_demand()}, latest AS (SELECT entity_id, max(day) AS as_of FROM demand GROUP BY entity_id)
SELECT obs.entity_id, as_of, ord, id FROM obs JOIN latest ON obs.entity_id = latest.entity_id WHERE metric_id = 'demand' AND day <= as_of"""
)
def score_lineage(spark, sf_dir):
    """Observations behind the demand component at each entity's latest scored day, a row for each."""
    obs = views.obs_hourly(spark, sf_dir)
    scored = signals.demand_signal(obs).groupBy("entity_id").agg(F.max("day").alias("as_of"))
    return signals.lineage_rows(obs, scored, "demand")

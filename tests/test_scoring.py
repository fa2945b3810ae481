import datetime as dt

import pytest
from helpers import daily, table
from pyspark.sql import functions as F

from voltrace.operators import evaluation, scoring
from voltrace.plans import report
from voltrace.schema import COMPONENT_WEIGHTS, DemandConfig, PriceConfig, ScoreConfig

DAY = dt.date(2026, 1, 1)
SIGNALS = "entity_id string, as_of date, name string, value double, confidence double"


def signals(spark, *values, entity="A", confidence=1.0):
    return spark.createDataFrame([(entity, DAY, n, v, confidence) for n, v in zip(COMPONENT_WEIGHTS, values, strict=True)], SIGNALS)


def test_weighted_score_and_missing(spark):
    got = scoring.combine(scoring.from_signals(signals(spark, 80.0, 60.0, 40.0, 20.0))).first()
    assert got.pressure == pytest.approx(57.0) and got.confidence == pytest.approx(1.0)
    got = scoring.combine(scoring.from_signals(signals(spark, 80.0, 60.0, 40.0, None))).first()
    assert got.pressure == pytest.approx(63.5294117647) and got.confidence == pytest.approx(0.85)
    assert got.missing_components == ["execution_friction"]


def test_contributions_are_not_rescaled(spark):
    rows = scoring.contributions(scoring.combine(scoring.from_signals(signals(spark, 80.0, None, 40.0, None)))).orderBy("ordinal").collect()
    assert [round(r.contribution, 6) for r in rows] == [28.0, 0.0, 8.0, 0.0]


def test_nothing_available_gives_no_row_and_custom_weights(spark):
    assert scoring.combine(scoring.from_signals(signals(spark, None, None, None, None))).count() == 0
    only = {"demand_pressure": 0.0, "supply_tightness": 0.0, "price_stress": 1.0, "execution_friction": 0.0}
    assert scoring.combine(scoring.from_signals(signals(spark, 1.0, 2.0, 100.0, None)), only).first().pressure == 100.0
    assert scoring.combine(scoring.from_signals(signals(spark, 1.0, None, None, None)), only).count() == 0


def test_duplicate_and_unknown_components_fail(spark):
    with pytest.raises(Exception, match="duplicate component"):
        scoring.from_signals(signals(spark, 1.0, 2.0, 3.0, 4.0).unionAll(signals(spark, 1.0, 2.0, 3.0, 4.0))).collect()
    with pytest.raises(Exception, match="unknown component"):
        scoring.from_signals(spark.createDataFrame([("A", DAY, "weather", 1.0, 1.0)], SIGNALS)).collect()


def test_a_missing_component_never_counts_as_zero(spark):
    full = scoring.combine(scoring.from_signals(signals(spark, 80.0, 80.0, 80.0, 80.0))).first()
    part = scoring.combine(scoring.from_signals(signals(spark, 80.0, None, None, None))).first()
    assert part.pressure == pytest.approx(full.pressure) and part.confidence < full.confidence


def pipeline_rows(entity="ERCO"):
    return daily("demand", [100] * 7 + [110], entity) + daily("net_generation", [105] * 8, entity) + daily("wholesale_price", range(10, 90, 10), entity)


def test_strict_score_of_the_reference_fixture(spark):
    obs = table(spark, pipeline_rows())
    got = report.strict_score(obs, "ERCO", dt.date(2026, 1, 8))
    assert got["pressure"] == pytest.approx(79.4117647059)
    with pytest.raises(ValueError, match="no price_stress"):
        report.strict_score(obs.where("metric_id <> 'wholesale_price'"), "ERCO", dt.date(2026, 1, 8))


def test_ranking_and_insight(spark):
    both = signals(spark, 90.0, 80.0, 70.0, 60.0, entity="b").unionAll(signals(spark, 90.0, 80.0, 70.0, 60.0, entity="a")).unionAll(signals(spark, 50.0, 50.0, 50.0, None, entity="c"))
    scored = scoring.combine(scoring.from_signals(both))
    assert [r.entity_id for r in scoring.ranked(scored).collect()] == ["a", "b", "c"]
    cards = {r.entity_id: r for r in scoring.insights(scored).collect()}
    assert cards["a"].title == "A: high infrastructure pressure" and cards["a"].finding == "demand pressure and supply tightness are the leading pressure contributors."
    assert cards["a"].caveat == "All components are present; confidence is 100%."
    assert cards["c"].title == "C: moderate infrastructure pressure" and cards["c"].caveat == "execution friction is missing; confidence is 85%."


def year(regions=("A", "B"), days=140):
    rows = []
    for k, r in enumerate(regions):
        rows += daily("demand", [100 * (k + 1) + i * (k + 1) for i in range(days)], r, dt.date(2024, 1, 1)) + daily("net_generation", [120 * (k + 1)] * days, r, dt.date(2024, 1, 1)) + daily("wholesale_price", [20 + 0.1 * i for i in range(days)], r, dt.date(2024, 1, 1))
    return rows


def test_backtest_rows_and_history_gate(spark):
    obs = table(spark, year())
    config = ScoreConfig(minimum_history_days=60)
    dates = evaluation.month_grid(obs)
    assert sorted(r.as_of for r in dates.collect()) == [dt.date(2024, 1, 31), dt.date(2024, 2, 29), dt.date(2024, 3, 31), dt.date(2024, 4, 30), dt.date(2024, 5, 19)]
    gate = {r.as_of: r.days for r in evaluation.history_days(obs, dates).collect()}
    assert gate[dt.date(2024, 2, 29)] == 59 and gate[dt.date(2024, 3, 31)] == 90
    rows = evaluation.backtest_rows(obs, dates, ("A", "B"), (30,), config).collect()
    # beyond the end of the data the later score rests on price alone and still counts
    assert len(rows) == 6 and {r.as_of for r in rows} == {dt.date(2024, 3, 31), dt.date(2024, 4, 30), dt.date(2024, 5, 19)}


def test_month_grid_starts_at_the_first_of_the_month(spark):
    obs = table(spark, year())
    got = sorted(r.as_of for r in evaluation.month_grid(obs, dt.date(2024, 2, 20), dt.date(2024, 3, 10)).collect())
    assert got == [dt.date(2024, 2, 29), dt.date(2024, 3, 10)]


def test_one_pass_equals_scoring_date_by_date(spark):
    obs = table(spark, year(days=60))
    config = ScoreConfig(demand=DemandConfig(10, 3), price=PriceConfig(20, 5))
    grid = spark.createDataFrame([(e, dt.date(2024, 1, 1) + dt.timedelta(days=d)) for e in "AB" for d in (2, 10, 30, 59, 90)], "entity_id string, as_of date")
    whole = {(r.entity_id, r.as_of): (r.pressure, r.confidence) for r in scoring.scores(obs, grid, config).collect()}
    for e, day in [("A", dt.date(2024, 1, 11)), ("B", dt.date(2024, 1, 31)), ("B", dt.date(2024, 3, 31))]:
        one = grid.where((F.col("entity_id") == e) & (F.col("as_of") == F.lit(day)))
        got = scoring.scores(obs.where(F.col("day") <= F.lit(day)), one, config).first()
        assert whole[(e, day)] == (pytest.approx(got.pressure), pytest.approx(got.confidence))


def test_spearman_ties_and_constant(spark):
    rows = spark.createDataFrame([(30, 1.0, 2.0), (30, 1.0, 1.0), (30, 2.0, 3.0), (90, 1.0, 5.0), (90, 2.0, 5.0)], "horizon_days int, signal_pressure double, future_pressure double").withColumn("future_delta", F.lit(1.0))
    got = {r.horizon_days: r for r in evaluation.backtest_summary(rows, (30, 90, 180)).collect()}
    assert got[30].spearman_rank_correlation == pytest.approx(0.866, abs=1e-4)
    assert got[90].spearman_rank_correlation == 0.0
    assert (got[180].observations, got[180].spearman_rank_correlation, got[180].mean_future_delta) == (0, None, None)


def test_sensitivity_matches_separate_scores(spark):
    obs = table(spark, year())
    as_of = spark.createDataFrame([(dt.date(2024, 5, 19),)], "as_of date")
    rows = evaluation.sensitivity_scenarios(obs, as_of).where("entity_id = 'A'").collect()
    assert len(rows) == 18
    config = ScoreConfig(demand=DemandConfig(14, 7), price=PriceConfig(90, 30))
    want = scoring.scores(obs, spark.createDataFrame([("A", dt.date(2024, 5, 19))], "entity_id string, as_of date"), config).first().pressure
    got = [r.pressure for r in rows if (r.demand_baseline_days, r.price_baseline_days, r.weight_set) == (14, 90, "baseline")]
    assert got == [pytest.approx(want, abs=1e-4)]
    summary = evaluation.sensitivity_summary(evaluation.sensitivity_scenarios(obs, as_of)).where("entity_id = 'A'").first()
    assert summary.scenario_count == 18 and summary.pressure_range == pytest.approx(summary.max_pressure - summary.min_pressure, abs=1e-4)

import datetime as dt
import random

import pytest
from helpers import daily, hourly, table
from pyspark.sql import functions as F

from voltrace.functions import clamp
from voltrace.operators import signals
from voltrace.schema import DemandConfig, PriceConfig, SupplyConfig, checked_weights


def last(df):
    return df.orderBy(F.desc("day")).first()


def test_clamp_keeps_null(spark):
    got = spark.createDataFrame([(None,), (-5.0,), (50.0,), (500.0,)], "x double").select(clamp(F.col("x")).alias("x")).collect()
    assert [r.x for r in got] == [None, 0.0, 50.0, 100.0]


def test_demand_spike_and_short_history(spark):
    got = last(signals.demand_signal(table(spark, daily("demand", [100] * 7 + [120])), DemandConfig(7, 7)))
    assert (got.value, got.confidence) == (pytest.approx(100.0), 1.0)
    got = last(signals.demand_signal(table(spark, daily("demand", [100, 110])), DemandConfig(7, 1)))
    assert (got.value, got.confidence) == (pytest.approx(50.0), pytest.approx(1 / 7))
    assert signals.demand_signal(table(spark, daily("demand", [100, 110]))).count() == 0


def test_demand_baseline_is_rows_not_days_and_zero_baseline_is_null(spark):
    got = last(signals.demand_signal(table(spark, daily("demand", [100, None, None, None, 110])), DemandConfig(2, 1)))
    assert got.baseline == 100.0 and got.n == 1
    got = last(signals.demand_signal(table(spark, daily("demand", [0, 10])), DemandConfig(2, 1)))
    assert got.value is None


def test_supply_worst_hour_partial_overlap_and_last_row(spark):
    rows = hourly("demand", [100] * 4) + hourly("net_generation", [115, 110, 105, 80])
    got = last(signals.supply_signal(table(spark, rows), SupplyConfig(4)))
    assert (got.value, got.confidence) == (100.0, 1.0)
    got = last(signals.supply_signal(table(spark, hourly("demand", [100] * 4) + hourly("net_generation", [110])), SupplyConfig(4)))
    assert (got.value, got.confidence) == (pytest.approx(50.0), 0.25)
    again = hourly("net_generation", [110])[0]
    rows = hourly("demand", [100]) + [(5, *again[1:7], 110.0), (2, *again[1:7], 500.0)]
    assert last(signals.supply_signal(table(spark, rows))).value == pytest.approx(50.0)
    assert signals.supply_signal(table(spark, hourly("demand", [100]) + hourly("net_generation", [110], first=5))).count() == 0


def test_supply_counts_hours_without_demand_only_for_confidence(spark):
    got = last(signals.supply_signal(table(spark, hourly("demand", [0, 100]) + hourly("net_generation", [50, 120])), SupplyConfig(4)))
    assert got.hours == 2 and got.value == pytest.approx(0.0)
    assert signals.supply_signal(table(spark, hourly("demand", [0]) + hourly("net_generation", [5]))).count() == 0


def test_price_percentile_ties_and_short_history(spark):
    got = last(signals.price_signal(table(spark, daily("wholesale_price", [10, 20, 30, 40, 35])), PriceConfig(4, 4)))
    assert (got.value, got.confidence) == (75.0, 1.0)
    got = last(signals.price_signal(table(spark, daily("wholesale_price", [10, 20, 20])), PriceConfig(4, 1)))
    assert got.value == 100.0
    assert last(signals.price_signal(table(spark, daily("wholesale_price", [10, 20])), PriceConfig(4, 4))).value is None


def test_price_asof_is_stale_without_limit(spark):
    obs = table(spark, daily("wholesale_price", [10, 20, 30, 40]))
    grid = spark.createDataFrame([("A", dt.date(2030, 1, 1)), ("A", dt.date(2020, 1, 1)), ("B", dt.date(2026, 1, 4))], "entity_id string, as_of date")
    got = {(r.entity_id, r.as_of.year): r.value for r in signals.latest_on_or_before(grid, signals.price_signal(obs, PriceConfig(3, 3)), ["value"]).collect()}
    assert got == {("A", 2030): 100.0, ("A", 2020): None, ("B", 2026): None}


def test_rows_in_any_order_give_the_same(spark):
    rows = daily("demand", range(50, 90)) + daily("demand", range(40, 95), "B")
    a = signals.demand_signal(table(spark, rows)).orderBy("entity_id", "day").collect()
    random.Random(3).shuffle(rows)
    assert signals.demand_signal(table(spark, rows)).orderBy("entity_id", "day").collect() == a


def test_future_rows_change_no_past_value(spark):
    rows = daily("demand", [100 + k % 5 for k in range(30)])
    short = signals.demand_signal(table(spark, rows[:20])).orderBy("day").collect()
    assert signals.demand_signal(table(spark, rows)).orderBy("day").collect()[: len(short)] == short


def test_lineage_keeps_input_order(spark):
    obs = table(spark, daily("demand", [3, 2, 1]))
    assert signals.lineage(obs, F.lit(dt.date(2026, 1, 2)), "demand").first().observation_ids == ["demand:A:2026-01-01", "demand:A:2026-01-02"]


@pytest.mark.parametrize("bad", [{}, {"demand_pressure": 1}, {"demand_pressure": -1, "supply_tightness": 1, "price_stress": 1, "execution_friction": 1}, {"demand_pressure": 0, "supply_tightness": 0, "price_stress": 0, "execution_friction": 0}])
def test_bad_weights(bad):
    with pytest.raises(ValueError):
        checked_weights(bad)


def test_bad_configs():
    for make in (lambda: DemandConfig(0), lambda: DemandConfig(5, 7), lambda: PriceConfig(10, 20), lambda: SupplyConfig(0)):
        with pytest.raises(ValueError):
            make()

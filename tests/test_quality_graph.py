import datetime as dt

import pytest
from helpers import daily, hourly, table

from voltrace.operators import benchmarks, graph, quality


def test_release_gates_pass_and_fail(spark):
    obs = table(spark, daily("demand", range(365), start=dt.date(2025, 1, 1)) + daily("net_generation", range(365), start=dt.date(2025, 1, 1)))
    window = (dt.date(2025, 1, 1), dt.date(2025, 12, 31))
    assert quality.gate_violations(obs, *window, regions=("A",), price_regions=()).count() == 0
    twice = obs.unionAll(obs.limit(1))
    got = [r.violation for r in quality.gate_violations(twice, *window, regions=("A", "Z")).orderBy("ordinal").collect()]
    assert got == ["duplicate_observation_ids", "duplicate_observation_keys", "A:wholesale_price:insufficient_history", "Z:demand:insufficient_history", "Z:net_generation:insufficient_history", "Z:wholesale_price:insufficient_history"]
    with pytest.raises(ValueError):
        quality.gate_violations(obs, window[1], window[0])


def test_row_contracts(spark):
    rows = [(0, "x", "demand", "A", dt.datetime(2026, 1, 2), dt.datetime(2026, 1, 1), float("nan"), "MW", "v", "guessed", ("s", "ftp://x", " "))]
    df = spark.createDataFrame(rows, "ord long, id string, metric_id string, entity_id string, period_start timestamp, period_end timestamp, value double, unit string, vintage string, kind string, source struct<id: string, url: string, publisher: string>")
    assert quality.row_violations(df).first().violations == ["value_not_finite", "period_reversed", "unknown_kind", "blank_source", "source_url"]
    with pytest.raises(Exception, match="invalid observation"):
        quality.require_valid(df).collect()


def test_complete_days(spark):
    rows = []
    for k in range(3):
        day = dt.date(2026, 6, 1) + dt.timedelta(days=k)
        for e in "AB":
            for m in ("demand", "net_generation"):
                rows += hourly(m, [1] * (24 if k < 2 or e == "A" else 5), e, day)
    got = sorted(r.day for r in quality.complete_days(table(spark, rows), ("A", "B")).collect())
    assert got == [dt.date(2026, 6, 1), dt.date(2026, 6, 2)]
    assert quality.complete_days(table(spark, rows), ("A", "B", "C")).count() == 0


def test_queue_benchmark(spark):
    d = dt.date
    rows = [("R", "active", d(2020, 1, 1), None, 100.0), ("R", "withdrawn", d(2020, 1, 1), None, 50.0), ("R", "operational", d(2016, 1, 1), d(2020, 1, 1), 20.0)]
    df = spark.createDataFrame(rows, "region_id string, status string, request_date date, operation_date date, capacity_mw double")
    got = benchmarks.queue_benchmark(benchmarks.check_projects(df)).first()
    assert (got.active_project_count, got.active_capacity_mw, got.withdrawal_rate, got.median_years_request_to_operation) == (1, 100.0, 0.3333, 4.0)
    with pytest.raises(Exception, match="invalid queue project"):
        benchmarks.check_projects(df.unionAll(spark.createDataFrame([("R", "active", d(2020, 1, 1), None, -1.0)], df.schema))).collect()


def test_capex_trend_ties_and_labels(spark):
    rows = [("cik:1", "capex", dt.date(2024, 12, 31), 100.0, 1, "a"), ("cik:1", "capex", dt.date(2025, 12, 31), 150.0, 2, "b"), ("cik:2", "capex", dt.date(2025, 12, 31), 7.0, 3, "c"), ("cik:3", "capex", dt.date(2025, 1, 1), 0.0, 4, "d"), ("cik:3", "capex", dt.date(2025, 1, 1), 9.0, 5, "e")]
    df = spark.createDataFrame(rows, "entity_id string, metric_id string, period_end date, value double, ord long, vintage string")
    labels = spark.createDataFrame([("cik:1", "One")], "entity_id string, label string")
    got = {r.entity_id: r for r in benchmarks.capex_trend(df, labels).collect()}
    assert got["cik:1"].change_vs_prior_pct == 50.0 and got["cik:1"].company == "One"
    assert got["cik:2"].prior_value is None and got["cik:2"].change_vs_prior_pct is None and got["cik:2"].company == "cik:2"
    assert got["cik:3"].latest_value == 9.0 and got["cik:3"].change_vs_prior_pct is None


def test_keyed_merge_keeps_the_last_value_at_the_first_place(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "a", 3.0)], "ord long, k string, v double")
    assert [(r.k, r.position, r.v) for r in benchmarks.last_by_key(df, ["k"], "ord", ["v"]).orderBy("position").collect()] == [("a", 1, 3.0), ("b", 2, 2.0)]


NODES = [("a", "A", "compute", None), ("b", "B", "power", None), ("c", "C", "network", None)]


@pytest.mark.parametrize(
    ("nodes", "edges", "problem"),
    [
        (NODES, [("a", "b"), ("b", "c"), ("a", "c"), ("a", "c")], None),
        (NODES + [NODES[0]], [], "duplicate"),
        (NODES + [("d", "D", "kitchen", None)], [], "stage"),
        (NODES, [("a", "x")], "unknown_node"),
        (NODES, [("a", "a")], "self_loop"),
        (NODES, [("a", "b"), ("b", "c"), ("c", "a")], "cycle"),
        (NODES, [], None),
    ],
)
def test_graph(spark, nodes, edges, problem):
    n = spark.createDataFrame(nodes, "id string, name string, stage string, ticker string")
    e = spark.createDataFrame([(a, b, "feeds") for a, b in edges], "source string, target string, relationship string")
    if problem is None:
        graph.validate(n, e)
    else:
        with pytest.raises(ValueError, match=problem):
            graph.validate(n, e)

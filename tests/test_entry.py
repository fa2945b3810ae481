"""Registered queries against DuckDB on the smallest tables."""

import os
from glob import glob

import pytest

import __spark_entry__ as contract
from voltrace.plans import queries as core

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no benchmark tables")


def test_names_match():
    assert set(contract.oracle_sql()) <= set(contract.queries()) and set(core.QUERIES) <= set(contract.queries())


@needs_data
def test_entry(spark):
    assert contract.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", ["demand_pressure", "supply_tightness", "price_asof", "regional_scores", "backtest_rows", "sensitivity_summary", "release_gates", "queue_benchmark", "capex_trend", "page_merge_dedup", "invalid_edges"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = core.QUERIES[name](spark, DATA).toPandas(), con.execute(core.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    cell = lambda v: "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)[:19].replace(" 00:00:00", "")
    rows = lambda df: sorted(tuple(map(cell, r)) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


@needs_data
def test_score_lineage_has_the_whole_history(spark):
    import pyarrow.parquet as pq

    events = pq.read_table(f"{DATA}/events.parquet", columns=["event_id", "event_type"]).to_pylist()
    got = core.QUERIES["score_lineage"](spark, DATA)
    assert got.columns == ["entity_id", "as_of", "ord", "id"]
    assert sorted(r.id for r in got.collect()) == sorted(f"e{r['event_id']}" for r in events if r["event_type"] == "view")

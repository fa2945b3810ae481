import datetime as dt
import json

import pytest
from helpers import daily, hourly, table

from voltrace.plans import refresh, snapshot
from voltrace.schema import ScoreConfig
from voltrace.sources import workbooks

AT = dt.datetime(2026, 7, 3, 12)


def config(tmp_path, **more):
    return refresh.RefreshConfig(tmp_path / "snapshots", "s1", AT, dt.date(2026, 6, 1), dt.date(2026, 6, 2), "me@example.org", ("ERCO",), {"One": "1", "Two": "2"}, **more)


def pages():
    rows = [{"period": f"2026-06-01T{h:02d}", "respondent": "ERCO", "type-name": kind, "value": v} for h in range(24) for kind, v in (("Demand", 100 + h), ("Net generation", 120))]
    yield {"response": {"total": "48", "data": rows[:30]}}
    yield {"response": {"total": "48", "data": rows[30:]}}


def facts(cik):
    row = {"start": "2025-01-01", "end": "2025-12-31", "filed": "2026-02-01", "accn": "x", "val": 5, "form": "10-K"}
    return {"facts": {"us-gaap": {"PaymentsToAcquirePropertyPlantAndEquipment": {"units": {"USD": [row]}}} if cik == "1" else {}}}


def test_refresh_and_report(spark, tmp_path):
    prices = tmp_path / "w.csv"
    prices.write_text("Hub,Date,High\nERCOT North,2026-06-01,92.5\n")
    path = refresh.refresh(spark, config(tmp_path, wholesale_csv=prices), pages, facts)
    manifest = snapshot.read_manifest(path)
    assert [a["row_count"] for a in manifest["artifacts"]] == [30, 18, 1, 49, 1, 1, 1] and snapshot.verify(path) == []
    got = refresh.report_from_snapshot(spark, path, ("ERCO",), {"One": "1"})
    assert got["regions"][0]["as_of"] == "2026-06-01" and got["companies"][0]["company"] == "One"
    refresh.write_report(got, tmp_path / "out")
    assert json.loads((tmp_path / "out/report.json").read_text())["dataset_status"] == "complete" and "<table" in (tmp_path / "out/report.html").read_text()
    with pytest.raises(FileExistsError):
        refresh.refresh(spark, config(tmp_path), pages, facts)


def test_failed_refresh_leaves_a_note(spark, tmp_path):
    def broken(cik):
        raise OSError("no net")

    with pytest.raises(OSError):
        refresh.refresh(spark, config(tmp_path), pages, broken)
    assert json.loads((tmp_path / "snapshots/.s1.staging/FAILED.json").read_text())["error_type"] == "OSError"
    with pytest.raises(ValueError):
        refresh.RefreshConfig(tmp_path, "s", AT, dt.date(2026, 1, 2), dt.date(2026, 1, 1), "x")


def test_validation_bundle(spark):
    rows = []
    for e in ("A", "B"):
        rows += daily("demand", [100 + k % 9 for k in range(140)], e, dt.date(2024, 1, 1)) + daily("net_generation", [130] * 140, e, dt.date(2024, 1, 1)) + daily("wholesale_price", [20 + k % 7 for k in range(140)], e, dt.date(2024, 1, 1))
    got = refresh.validation_bundle(table(spark, rows), ("A", "B"), dt.date(2024, 1, 1), dt.date(2024, 12, 31), config=ScoreConfig(minimum_history_days=60), price_regions=("A",))
    assert got["validation"]["duplicate_observation_ids"] == [] and got["validation"]["required_price_regions"] == ["A"]
    assert got["validation"]["violations"] == ["A:demand:insufficient_history", "A:net_generation:insufficient_history", "B:demand:insufficient_history", "B:net_generation:insufficient_history"]
    assert len(got["history"][0]["points"]) == 5 and len(got["sensitivity"]["region_summary"]) == 2 and [s["horizon_days"] for s in got["backtest"]["summaries"]] == [30, 90]
    assert refresh.page.render_html({"regions": (), **got}).count("<svg") == 2


def test_workbook_rows_and_periods(spark, tmp_path):
    raw = spark.createDataFrame([("Mass Hub", "2025-01-06 00:00:00", "70.5"), ("Mass Hub", None, "1"), ("Mass Hub", "2025-01-07", None)], "`Price hub` string, `Delivery start date` string, `High price $/MWh` string")
    rows = workbooks.wholesale_rows(raw)
    assert [tuple(r) for r in rows.collect()] == [("Mass Hub", "2025-01-06", "70.5")]
    workbooks.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["Hub", "Date", "High Price"]
    with pytest.raises(ValueError):
        workbooks.wholesale_rows(rows)
    assert refresh.balance_periods(dt.date(2024, 8, 1), dt.date(2025, 2, 1)) == ["2024_Jul_Dec", "2025_Jan_Jun"]


def test_queue_document(tmp_path):
    assert refresh.queue_document(None) == {"schema_version": 1, "regions": []}
    (tmp_path / "q.json").write_text(json.dumps({"source": "s", "benchmark": [{"region_id": "A"}]}))
    assert refresh.queue_document(tmp_path / "q.json") == {"schema_version": 1, "dataset_as_of": None, "source": "s", "regions": [{"region_id": "A"}]}

import datetime as dt
import json
import zipfile
from urllib.error import HTTPError

import pytest
from helpers import daily, hourly, table
from pyspark.sql import functions as F

from voltrace import sources
from voltrace.operators import quality
from voltrace.plans import page as html_page
from voltrace.plans import report, snapshot
from voltrace.sources import http
from voltrace.streaming import daily_peak_stream

AT = dt.datetime(2026, 7, 3, 12)


def page(rows, total=None):
    return {"response": {"data": rows} | ({"total": total} if total is not None else {})}


def row(period, who, kind, value, **more):
    return {"period": period, "respondent": who, "type-name": kind, "value": value} | more


def test_operating_payload(spark, tmp_path):
    rows = [row("2026-07-02T00", "ERCO", "Demand", "82500"), row("2026-07-02T01:00:00Z", "ERCO", "Demand", 83000), row("2026-07-02T00", "ERCO", "Net generation", "79000"), row("2026-07-02T00", "ERCO", "Interchange", "x"), row("2026-07-02T00", "ERCO", "Demand", "82501")]
    (tmp_path / "p0.json").write_text(json.dumps(page(rows, "5")))
    got = sources.read_operating(spark, str(tmp_path / "p0.json"), AT).orderBy("ord").collect()
    assert [(r.metric_id, r.value) for r in got] == [("demand", 82501.0), ("demand", 83000.0), ("net_generation", 79000.0)]
    assert got[0].id == "eia:demand:ERCO:2026-07-02T00:00:00Z" and got[0].unit == "MW" and got[0].day == dt.date(2026, 7, 2)
    assert quality.row_violations(sources.read_operating(spark, str(tmp_path / "p0.json"), AT)).where(F.size("violations") > 0).count() == 0
    (tmp_path / "bad.json").write_text(json.dumps(page([row("2026-07-02T00", "ERCO", "Demand", "bad")])))
    with pytest.raises(Exception, match="invalid value"):
        sources.read_operating(spark, str(tmp_path / "bad.json"), AT).collect()


def test_balance_csv(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("﻿Balancing Authority,UTC Time at End of Hour,Demand (MW),Net Generation (MW)\nERCO,01/01/2022 7:00:00 AM,2251,1986\nOTHER,01/01/2022 7:00:00 AM,1,2\nERCO,01/01/2022 8:00:00 AM,,5\nERCO,,1,1\n", encoding="utf-8")
    got = sources.read_balance(spark, str(path), ("ERCO",), AT).orderBy("period_start", "metric_id").collect()
    assert [(r.metric_id, r.value, r.period_start.hour, r.vintage) for r in got] == [("demand", 2251.0, 7, "2022-01"), ("net_generation", 1986.0, 7, "2022-01"), ("net_generation", 5.0, 8, "2022-01")]


def test_wholesale_csv(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text('Price hub,Delivery start date,High price $/MWh\nERCOT North 345KV Peak,1/6/2025,"$1,058.00"\nPJM WH Real Time Peak,2025-01-06,70.50\nUnknown Hub,2025-01-06,1\nMass Hub,2025-01-06,NA\nPalo Verde Peak,2025-01-07 00:00:00,-\n')
    got = sources.read_wholesale(spark, str(path), AT).orderBy("entity_id").collect()
    assert [(r.entity_id, r.day, r.value) for r in got] == [("ERCO", dt.date(2025, 1, 6), 1058.0), ("PJM", dt.date(2025, 1, 6), 70.5)]
    assert got[0].id == "eia:wholesale:ERCO:ercot-north-345kv-peak:2025-01-06" and got[0].quality_flags[1] == "ERCOT North 345KV Peak"


def test_zone_archive(spark, tmp_path):
    body = "Time Stamp,Name,PTID,LBMP ($/MWHr)\n01/01/2024 00:00,CAPITL,1,10\n01/01/2024 00:00,CENTRL,2,20\n01/01/2024 00:00,PJM,3,999\n01/01/2024 01:00,CAPITL,1,30\n01/01/2024 01:00,CENTRL,2,50\n01/01/2024 02:00,WEST,2,\n"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("20240101damlbmp_zone.csv", body)
        z.writestr("readme.txt", "x")
    got = sources.read_zone_archives(spark, str(tmp_path / "z.zip"), AT).orderBy("period_start").collect()
    assert [(r.value, r.kind, r.period_precision) for r in got] == [(15.0, "inferred", "local"), (40.0, "inferred", "local")]


def facts(concept, rows):
    return {"facts": {"us-gaap": {concept: {"units": {"USD": rows}}}}}


def test_company_facts(spark, tmp_path):
    r = lambda end, val: {"start": "2025-01-01", "end": end, "filed": "2026-02-01", "accn": "x", "val": val, "form": "10-K"}
    path = tmp_path / "f.json"
    path.write_text(json.dumps(facts("PaymentsToAcquirePropertyPlantAndEquipment", [r("2025-12-31", -1.2e9), r("2024-12-31", 9e8)])))
    got = sources.read_company_facts(spark, str(path), "789019", AT).orderBy("ord").collect()
    assert [x.value for x in got] == [9e8, 1.2e9] and got[1].vintage == "2026-02-01" and got[0].entity_id == "cik:0000789019"
    path.write_text(json.dumps(facts("PaymentsToAcquirePropertyPlantAndEquipmentAndIntangibleAssets", [r("2025-12-31", 5)])))
    assert sources.read_company_facts(spark, str(path), "1", AT).first().value == 5.0
    path.write_text(json.dumps(facts("Other", [])))
    with pytest.raises(Exception, match="no supported capital spending"):
        sources.read_company_facts(spark, str(path), "1", AT).collect()


def test_signal_fixture(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"regions": [{"region_id": "ercot", "as_of": "2026-01-01", "signals": {"demand_pressure": {"value": 80, "confidence": 1}, "price_stress": {"value": None, "confidence": 0}}}]}))
    got = {r.name: r.value for r in sources.read_signals(spark, str(path)).collect()}
    assert got == {"demand_pressure": 80.0, "price_stress": None}
    path.write_text(json.dumps({"regions": [{"region_id": "ercot", "as_of": "2026-01-01", "signals": {"weather": {"value": 1, "confidence": 1}}}]}))
    with pytest.raises(Exception, match="unknown component"):
        sources.read_signals(spark, str(path)).collect()


def test_queue_sheet(spark):
    rows = [("PJM ", " Active", 43831.0, None, 10.0, -30.0, None), ("PJM", "operational", 43831.0, 44197.0, 5.0, None, None), ("Elsewhere", "active", 43831.0, None, 1.0, None, None), ("PJM", "active", 20000.0, 5.0, 1.0, None, None)]
    got = sources.queue_projects(spark.createDataFrame(rows, "region string, q_status string, q_date double, on_date double, mw1 double, mw2 double, mw3 double")).collect()
    assert [(r.status, r.request_date, r.operation_date, r.capacity_mw) for r in got] == [("active", dt.date(2020, 1, 1), None, 20.0), ("operational", dt.date(2020, 1, 1), dt.date(2021, 1, 1), 5.0)]


class Answer:
    def __init__(self, payload):
        self.payload = payload

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass

    def read(self):
        return json.dumps(self.payload).encode()


def test_fetch_waits_on_429_only():
    waits, calls = [], []

    def opener(request, timeout):
        calls.append(request.full_url)
        if len(calls) == 1:
            raise HTTPError(request.full_url, 429, "slow", {"Retry-After": "7"}, None)
        if len(calls) == 2:
            raise HTTPError(request.full_url, 429, "slow", None, None)
        return Answer({"ok": 1})

    assert http.get_json("https://example.org/x", opener=opener, sleep=waits.append) == {"ok": 1} and waits == [7.0, 2.0]

    def broken(request, timeout):
        raise HTTPError(request.full_url, 500, "no", None, None)

    with pytest.raises(http.FetchError, match="500"):
        http.get_json("https://example.org/x", opener=broken, sleep=waits.append)


def test_pages_stop(tmp_path):
    def feed(*found):
        return list(http.pages(lambda offset: str(offset), lambda url, it=iter(found): next(it), lambda s: None, 2))

    a, b = page([1, 2], "3"), page([3], "3")
    assert len(feed(a, b)) == 2 and len(feed(page([1, 2]), page([3]))) == 2 and len(feed(page([1, 2]), page([]))) == 2
    with pytest.raises(http.FetchError):
        feed({"response": {}})
    assert [p.split("/")[-1] for p in http.save_pages(tmp_path, iter([a, b]))] == ["page-000000.json", "page-000001.json"]
    url = http.hourly_url(("ERCO", "PJM"), dt.date(2026, 1, 1), dt.date(2026, 1, 2), 5000, api_key="k")
    assert "offset=5000" in url and url.count("respondent") == 2 and http.facts_url("789019").endswith("CIK0000789019.json")
    assert list(http.months(dt.date(2025, 11, 5), dt.date(2026, 1, 1))) == [dt.date(2025, 11, 1), dt.date(2025, 12, 1), dt.date(2026, 1, 1)]


def test_snapshot_publish_verify_and_failure(spark, tmp_path):
    obs = table(spark, daily("demand", [1, 2, 3]))

    def fill(staging):
        return [snapshot.write_observations(obs, staging, "observations", "s", "https://x", AT)]

    path = snapshot.publish(tmp_path, "2026-07-03", AT, fill)
    assert snapshot.latest(tmp_path) == path and snapshot.verify(path) == []
    assert snapshot.read_manifest(path)["artifacts"][0]["row_count"] == 3
    assert snapshot.read_observations(spark, path, "observations").count() == 3
    part = next((path / "curated/observations").rglob("part-*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    assert snapshot.verify(path) == ["curated/observations"]
    with pytest.raises(FileExistsError):
        snapshot.publish(tmp_path, "2026-07-03", AT, fill)
    with pytest.raises(RuntimeError):
        snapshot.publish(tmp_path, "next", AT, lambda staging: (_ for _ in ()).throw(RuntimeError("no")))
    assert json.loads((tmp_path / ".next.staging/FAILED.json").read_text())["error"] == "no"
    with pytest.raises(FileExistsError):
        snapshot.publish(tmp_path, "next", AT, fill)


def test_report_and_page(spark):
    rows = []
    for k in range(9):
        day = dt.date(2026, 6, 1) + dt.timedelta(days=k)
        rows += hourly("demand", [100] * 24, "ERCO", day) + hourly("net_generation", [105] * 24, "ERCO", day)
    got = report.build_report(table(spark, rows), None, ("ERCO",), {}, AT)
    assert got["regions"][0]["as_of"] == "2026-06-09" and got["dataset_status"] == "complete"
    demand = got["regions"][0]["components"][0]
    assert demand["name"] == "demand_pressure" and len(demand["observation_ids"]) == 9 * 24
    part = report.build_report(table(spark, rows), None, ("ERCO", "PJM"), {}, AT, dt.date(2026, 6, 9), {"history": [{"region_id": "ERCO", "points": [{"pressure": 5.0}]}]})
    assert part["dataset_status"] == "partial" and part["unavailable_regions"][0]["region_id"] == "PJM"
    html = html_page.render_html(part)
    assert all(t in html for t in ("Where pressure is highest", "Projects waiting", "price stress has no data; execution friction is outside the model", "Kinds of evidence", '<rect x="0" y="47.5"', "Nothing here."))
    assert "<b>" not in html_page.render_html({"unavailable_regions": [{"region_id": "<b>", "reason": "x"}]})
    with pytest.raises(ValueError, match="no complete common day"):
        report.build_report(table(spark, rows), None, ("ERCO", "PJM"), {}, AT)


def test_daily_peak_stream(spark, tmp_path):
    table(spark, hourly("demand", [1, 5, 3])).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table(spark, []).schema).parquet(str(tmp_path / "in"))
    q = daily_peak_stream(stream).writeStream.outputMode("complete").format("memory").queryName("peaks").start()
    try:
        q.processAllAvailable()
        assert [(r.entity_id, r.peak) for r in spark.table("peaks").collect()] == [("A", 5.0)]
    finally:
        q.stop()


def test_files_keep_their_order(spark, tmp_path):
    """The later file's row comes later, however large the files are."""
    head = "Hub,Date,High\n"
    (tmp_path / "a.csv").write_text(head + "Mass Hub,2026-06-01,1\n")
    (tmp_path / "b.csv").write_text(head + "".join(f"Mass Hub,2026-06-{k % 28 + 1:02d},{k}\n" for k in range(500)))
    (tmp_path / "c.csv").write_text(head + "Mass Hub,2026-06-01,3\n")
    got = sources.read_wholesale(spark, [str(tmp_path / f"{n}.csv") for n in "bca"], AT).orderBy("ord").collect()
    assert [r.value for r in got] == [1.0, *map(float, range(500)), 3.0]


def test_observation_document(spark, tmp_path):
    rows = [row(f"2026-07-02T{h:02d}", "ERCO", "Demand", h) for h in range(5)]
    (tmp_path / "p.json").write_text(json.dumps(page(rows, "5")))
    obs = sources.read_operating(spark, str(tmp_path / "p.json"), AT)
    snapshot.write_document(obs, tmp_path / "out/obs.json")
    held = json.loads((tmp_path / "out/obs.json").read_text())
    assert held["schema_version"] == 1 and held["observations"][1]["period_start"].startswith("2026-07-02T01:00:00")
    back = snapshot.read_document(spark, tmp_path / "out/obs.json")
    cols = [c for c in obs.columns if c != "ord"]
    assert back.select(cols).orderBy("period_start").collect() == obs.select(cols).orderBy("period_start").collect()
    (tmp_path / "other.json").write_text('{"schema_version": 9, "observations": []}')
    with pytest.raises(Exception, match="unsupported observation document"):
        snapshot.read_document(spark, tmp_path / "other.json").collect()


def test_waits_and_page_places():
    error = HTTPError("u", 429, "slow", {"Retry-After": "2.5"}, None)
    assert http.asked_wait(error, 9.0) == 2.5 and http.asked_wait(HTTPError("u", 429, "slow", {"Retry-After": "soon"}, None), 9.0) == 9.0
    asked = []
    found = {0: [1, 2], 3: [3], 6: []}
    list(http.pages(lambda offset: str(asked.append(offset) or offset), lambda url: page(found[int(url)], 4), lambda s: None, length=3))
    assert asked == [0, 3, 6]


def test_unusable_filings(spark, tmp_path):
    (tmp_path / "facts").mkdir()
    path = tmp_path / "facts/x.json"
    path.write_text('{"facts": {"us-gaap": {}}}')
    with pytest.raises(Exception) as none:
        sources.read_company_facts(spark, str(path), "1", AT).collect()
    assert sources.is_unusable_filing(none.value)
    with pytest.raises(Exception) as gone:
        sources.read_company_facts(spark, str(tmp_path / "facts/none.json"), "1", AT).collect()
    assert not sources.is_unusable_filing(gone.value)

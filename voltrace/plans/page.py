"""A report as one static page without outside resources.

The page is a list of panels; a panel whose part of the report is missing says
so. Pressure is drawn as bars on the fixed scale of 0 to 100, so that the
histories of all regions can be compared by eye.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from html import escape
from typing import Any

STYLE = "body{font:15px/1.4 system-ui,sans-serif;margin:0 auto;max-width:62rem;padding:1rem}dl{display:grid;grid-template-columns:max-content 1fr;gap:.2rem 1rem}table{width:100%;border-spacing:0}td{border-top:1px solid #ccd;padding:.3rem}th{text-align:left}aside{background:#eef;padding:.5rem;margin:.5rem 0}svg{background:#f6f6fa;display:block}rect{fill:#357}"
#: What a component's absence means, by whether the engine has a model for it.
UNMODELLED = frozenset({"execution_friction"})
KINDS = {"observed": "as the source reports it", "estimated": "from a model or scenario", "inferred": "our reading of other figures"}
BAR, TALL = 6, 50


def element(tag: str, *inner: str, **attributes: object) -> str:
    """Markup of one element; ``inner`` is markup already."""
    named = "".join(f' {k.rstrip("_").replace("_", "-")}="{escape(str(v))}"' for k, v in attributes.items())
    return f"<{tag}{named}>{''.join(inner)}</{tag}>"


def number(x: object, form: str = ".1f") -> str:
    return "n/a" if x is None else format(float(x), form)  # type: ignore[arg-type]


def absent(component: str) -> str:
    """In words why a component is not there."""
    return f"{component.replace('_', ' ')} " + ("is outside the model" if component in UNMODELLED else "has no data")


def grid(head: Sequence[str], rows: Iterable[Sequence[object]]) -> str:
    """A table, or nothing without rows."""
    body = [element("tr", *(element("td", escape(str(c))) for c in row)) for row in rows]
    return element("table", element("tr", *(element("th", escape(h)) for h in head)), *body) if body else ""


def bars(points: Sequence[Mapping[str, Any]]) -> str:
    """One bar for each scored date."""
    drawn = []
    for k, p in enumerate(points):
        high = TALL * min(100.0, max(0.0, float(p["pressure"]))) / 100
        drawn.append(element("rect", x=k * BAR, y=f"{TALL - high:.1f}", width=BAR - 1, height=f"{high:.1f}"))
    return element("svg", *drawn, width=BAR * len(points), height=TALL)


def region_panel(region: Mapping[str, Any]) -> str:
    facts = [("pressure", number(region["pressure"])), ("as of", region["as_of"]), ("confidence", number(region["confidence"], ".0%"))]
    facts += [(c["name"].replace("_", " "), f"{number(c['value'])} (weight {number(c['weight'], '.2f')}, {len(c.get('observation_ids') or ())} observations)") for c in region["components"] if c["value"] is not None]
    listed = "".join(element("dt", escape(str(k))) + element("dd", escape(str(v))) for k, v in facts)
    why = "; ".join(absent(c) for c in region["missing_components"])
    return element("h3", escape(str(region["region_id"]))) + element("dl", listed) + (element("aside", escape(why)) if why else "")


def panels(report: Mapping[str, Any]) -> Iterable[tuple[str, str]]:
    """(heading, markup) of every panel in page order."""
    regions = report.get("regions", ())
    ranking = grid(("Place", "Region", "Score", "Sure"), ((k + 1, r["region_id"], number(r["pressure"]), number(r["confidence"], ".0%")) for k, r in enumerate(regions)))
    yield "Where pressure is highest", ranking
    yield "Each region", "".join(map(region_panel, regions))
    yield "Regions that could not be scored", grid(("Region", "Why"), ((r["region_id"], r["reason"]) for r in report.get("unavailable_regions", ())))
    past = [h for h in report.get("history", ()) if h.get("points")]
    yield "Scores over time", "".join(element("h3", escape(f"{h['region_id']}, last {number(h['points'][-1]['pressure'])}")) + bars(h["points"]) for h in past)
    checks = report.get("validation", {})
    cover = grid(("Region", "Days of demand", "of generation", "of prices", "First", "Last"), ((c["region_id"], *(c["metric_days"].get(m, 0) for m in ("demand", "net_generation", "wholesale_price")), c.get("first_date") or "n/a", c.get("last_date") or "n/a") for c in checks.get("coverage", ())))
    verdict = ("All gates hold." if checks.get("passed") else "Gates broken: " + ", ".join(checks.get("violations", ()))) if checks else ""
    yield "Data behind the scores", (element("p", escape(verdict)) if verdict else "") + cover
    tests = report.get("backtest", {}).get("summaries", ())
    yield "Did past scores tell later ones", grid(("Days ahead", "Cases", "Spearman", "Average change"), ((s["horizon_days"], s["observations"], number(s["spearman_rank_correlation"], ".2f"), number(s["mean_future_delta"], ".2f")) for s in tests))
    spread = report.get("sensitivity", {}).get("region_summary", ())
    yield "How far settings move the score", grid(("Region", "Settings", "Lowest", "Highest", "Spread"), ((s["region_id"], s["scenario_count"], *(number(s[k]) for k in ("min_pressure", "max_pressure", "pressure_range"))) for s in spread))
    firms = report.get("companies", ())
    yield "Capital spending filed by companies", grid(("Company", "Last", "Before", "Change in %", "Filed"), ((c["company"], number(c["latest_value"], ",.0f"), number(c["prior_value"], ",.0f"), number(c["change_vs_prior_pct"]), c["latest_vintage"]) for c in firms))
    queue = report.get("interconnection_benchmark", {}).get("regions", ())
    yield "Projects waiting for a connection", grid(("Region", "Active MW", "Withdrawn", "In operation", "Years to operation"), ((q["region_id"], number(q["active_capacity_mw"], ",.0f"), number(q["withdrawal_rate"], ".1%"), q["operational_project_count"], number(q["median_years_request_to_operation"])) for q in queue))
    friction = report.get("execution_friction", ())
    yield "Signs of execution friction", element("ul", *(element("li", escape(str(e.get("summary", e) if isinstance(e, Mapping) else e))) for e in friction)) if friction else ""
    yield "Kinds of evidence", element("dl", *(element("dt", k) + element("dd", v) for k, v in KINDS.items()))
    yield "How to read this", element("p", "Scores describe what was observed; they predict nothing. A component without data takes no part in a score and lowers its confidence.")


def render_html(report: Mapping[str, Any]) -> str:
    """The page of a report."""
    said = escape(f"{report.get('dataset_status', 'unknown')}, made {report.get('generated_at', 'at an unknown time')}")
    body = element("h1", "Pressure on regional power") + element("p", said) + "".join(element("section", element("h2", h), inner or element("p", "Nothing here.")) for h, inner in panels(report))
    return "<!doctype html>" + element("html", element("head", '<meta charset="utf-8">', element("title", "Pressure on regional power"), element("style", STYLE)), element("body", body), lang="en")

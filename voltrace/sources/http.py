"""Paged and single fetches of raw payloads to files, which the readers then take up."""

from __future__ import annotations

import datetime as dt
import json
import re
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from pathlib import Path
from typing import Any
from urllib.error import HTTPError
from urllib.parse import urlencode
from urllib.request import Request, urlopen

# Endpoints and limits of the public interfaces.
HOURLY_URL = "https://api.eia.gov/v2/electricity/rto/region-data/data/"
FACTS_URL = "https://data.sec.gov/api/xbrl/companyfacts/CIK{cik}.json"
PAGE, PAUSE, TRIES, TIMEOUT = 5000, 1.0, 4, 30.0


class FetchError(RuntimeError):
    """A source could not be fetched or answered with something else than its format."""


def hourly_url(regions: Sequence[str], start: dt.date, end: dt.date, offset: int = 0, length: int = PAGE, api_key: str | None = None) -> str:
    """Address of one page, with the date range and regions filtered at the source."""
    if not regions or any(not r.strip() for r in regions) or start > end or offset < 0 or length <= 0:
        raise ValueError("invalid hourly query")
    params = [("data[]", "value"), ("frequency", "hourly"), ("start", start.isoformat()), ("end", end.isoformat()), ("offset", str(offset)), ("length", str(length))]
    params += [("facets[respondent][]", r) for r in regions] + ([("api_key", api_key)] if api_key else [])
    return f"{HOURLY_URL}?{urlencode(params)}"


def facts_url(cik: str) -> str:
    if not cik.isdigit():
        raise ValueError("cik must be digits")
    return FACTS_URL.format(cik=cik.zfill(10))


def get_json(url: str, agent: str = "", opener: Callable[..., Any] = urlopen, sleep: Callable[[float], None] = time.sleep) -> Mapping[str, Any]:
    """A JSON object; only status 429 is tried again, after the wait the server asks for."""
    headers = {"Accept": "application/json"} | ({"User-Agent": agent} if agent else {})
    for k in range(TRIES):
        try:
            with opener(Request(url, headers=headers), timeout=TIMEOUT) as response:
                found = json.loads(response.read())
            if not isinstance(found, dict):
                raise FetchError("expected a JSON object")
            return found
        except HTTPError as error:
            if error.code != 429 or k + 1 == TRIES:
                raise FetchError(f"status {error.code}") from error
            sleep(min(60.0, max(1.0, asked_wait(error, 2.0**k))))
        except (OSError, ValueError) as error:
            raise FetchError("could not fetch") from error
    raise FetchError("could not fetch")


def asked_wait(error: HTTPError, otherwise: float) -> float:
    """Seconds that an answer asks to wait, which may have a fraction."""
    said = (error.headers.get("Retry-After") if error.headers else None) or ""
    return float(said) if re.fullmatch(r"\s*[0-9]+(\.[0-9]*)?\s*", said) else otherwise


def pages(url: Callable[[int], str], get: Callable[[str], Mapping[str, Any]] = get_json, sleep: Callable[[float], None] = time.sleep, length: int = PAGE) -> Iterator[Mapping[str, Any]]:
    """Pages until one is empty, one is short and names no total, or the total is reached."""
    offset = seen = 0
    while True:
        page = get(url(offset))
        response = page.get("response")
        rows = response.get("data") if isinstance(response, dict) else None
        if not isinstance(rows, list):
            raise FetchError("a page has no list of rows")
        yield page
        total = response.get("total")
        seen += len(rows)
        if not rows or (total is None and len(rows) < length) or (total is not None and seen >= int(total)):
            return
        offset += length  # pages have fixed places, even one that came short
        sleep(PAUSE)


def save_pages(folder: Path, found: Iterator[Mapping[str, Any]]) -> list[str]:
    """Write each page to a file whose name keeps the order."""
    folder.mkdir(parents=True, exist_ok=True)
    out = []
    for k, page in enumerate(found):
        path = folder / f"page-{k:06d}.json"
        path.write_text(json.dumps(page), encoding="utf-8")
        out.append(str(path))
    return out


def months(start: dt.date, end: dt.date) -> Iterator[dt.date]:
    """First days of the months of a range."""
    at = start.replace(day=1)
    while at <= end:
        yield at
        at = (at.replace(day=28) + dt.timedelta(days=4)).replace(day=1)

"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """``x`` held within bounds; null stays null (a bare greatest/least would make it the bound)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def coverage(n: Column, full: int) -> Column:
    """Share of the full number of rows, at most 1."""
    return F.least(F.lit(1.0), n / F.lit(float(full)))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def slug(x: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one hyphen, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), F.lit("-"))


def trimmed(x: Column) -> Column:
    """Without white space at the ends; null if nothing is left."""
    out = F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.when(out != "", out)


def first_filled(columns: list[str], *names: str) -> Column:
    """The first of the named columns that exists and isn't blank."""
    found = [trimmed(F.col(f"`{n}`")) for n in names if n in columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def pressure_band(pressure: Column) -> Column:
    return F.when(pressure >= 70, "high").when(pressure >= 45, "moderate").otherwise("low")


def display_name(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table, null if the key is unknown."""
    out = F
    for k, v in table.items():
        out = out.when(key == k, v)
    return out.otherwise(F.lit(None).cast("string")) if table else F.lit(None).cast("string")


def hub_region(hub: Column, exact: dict[str, str], prefixes: dict[str, str]) -> Column:
    """Region of a price hub: by name, else by the first prefix in order."""
    out = lookup(hub, exact)
    by_prefix = F
    for k, v in prefixes.items():
        by_prefix = by_prefix.when(hub.startswith(k), v)
    return F.coalesce(out, by_prefix.otherwise(F.lit(None).cast("string")))

"""Readers that turn source files into observations with Spark's own readers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import first_filled, hub_region, slug, trimmed
from ..schema import CAPEX_CONCEPTS, COMPONENT_WEIGHTS, HUB_PREFIXES, HUB_REGIONS, NYISO_ZONES, OBSERVATIONS, QUEUE_REGIONS
from ..operators.benchmarks import last_by_key, zone_mean

# Identity of each source.
SOURCES = {
    "operating": ("eia:electricity:rto:region-data", "https://www.eia.gov/opendata/", "U.S. Energy Information Administration"),
    "balance": ("eia:930:balance", "https://www.eia.gov/electricity/gridmonitor/", "U.S. Energy Information Administration"),
    "wholesale": ("eia:wholesale", "https://www.eia.gov/electricity/wholesale/", "U.S. Energy Information Administration"),
    "zones": ("nyiso:dam-lbmp", "https://mis.nyiso.com/public/P-2Alist.htm", "New York Independent System Operator"),
    "facts": ("sec:companyfacts", "https://www.sec.gov/search-filings/edgar-application-programming-interfaces", "U.S. Securities and Exchange Commission"),
}
#: Names of a series in the operating payload, in lower case.
SERIES = {"demand": ("demand", "d"), "net_generation": ("net generation", "ng")}


def _source(name: str) -> Column:
    return F.struct(*(F.lit(v).alias(k) for k, v in zip(("id", "url", "publisher"), SOURCES[name], strict=True)))


def _iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")


def _observations(rows: DataFrame) -> DataFrame:
    """Columns in the order and with the types of the schema."""
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in OBSERVATIONS.fields))


def _required(value: Column, name: str) -> Column:
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"invalid {name}")))


#: What a company's filings can lack; such a company has no rows in a refresh.
UNUSABLE_FILINGS = ("capital spending has no USD units", "no supported capital spending", "invalid fact date", "invalid fact value", "invalid fact filing", "invalid fact accession")


def is_unusable_filing(error: Exception) -> bool:
    """Whether a job failed on what a company filed, and not on reading it."""
    said = str(error)
    return any(f"[USER_RAISED_EXCEPTION] {m}" in said for m in UNUSABLE_FILINGS)


def read_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """CSV files with a header, and ``ord``: files by name, then lines in order, however Spark packs their splits into tasks."""
    raw = spark.read.csv(paths, header=True, encoding="UTF-8").select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__from"))
    # only the short list of splits is sorted in one task
    splits = raw.select("__file", "__from").distinct().withColumn("__split", F.row_number().over(Window.orderBy("__file", "__from")).cast("long"))
    line = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = raw.withColumn("__line", line).join(F.broadcast(splits), ["__file", "__from"])
    return numbered.withColumn("ord", F.col("__split") * (1 << 33) + F.col("__line")).drop("__file", "__from", "__split", "__line")


def operating_rows(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(ord, period, respondent, type_name, type, value, unit): the payload's rows; of equal keys the last wins, at the first's place."""
    row = "period string, respondent string, `type-name` string, type string, value string, `value-units` string"
    raw = spark.read.schema(f"response struct<total: string, data: array<struct<{row.replace(' string', ': string')}>>>").json(paths, multiLine=True)
    flat = raw.select(F.input_file_name().alias("file"), F.posexplode("response.data").alias("at", "r")).select("file", "at", F.col("r.period").alias("period"), F.col("r.respondent").alias("respondent"), F.col("r.`type-name`").alias("type_name"), F.col("r.type").alias("type"), F.col("r.value").alias("value"), F.col("r.`value-units`").alias("unit"))
    # files are numbered by name, rows by their place; only the short list of files is sorted in one task
    files = raw.select(F.input_file_name().alias("file")).distinct().withColumn("number", F.row_number().over(Window.orderBy("file")).cast("long"))
    keyed = flat.join(files, "file").withColumns({"key": F.coalesce("type_name", "type"), "__ord": F.col("number") * (1 << 32) + F.col("at")})
    merged = last_by_key(keyed, ["period", "respondent", "key"], "__ord", ["type_name", "type", "value", "unit"])
    return merged.withColumnRenamed("position", "ord").drop("key")


def read_operating(spark: SparkSession, paths: str | Sequence[str], retrieved_at: dt.datetime, metrics: Sequence[str] = ("demand", "net_generation")) -> DataFrame:
    """Hourly demand and generation from operating payloads; other series are left out, a bad kept row fails the read."""
    rows = operating_rows(spark, paths)
    name = F.lower(F.coalesce("type_name", "type", F.lit("")))
    metric = F
    for m in metrics:
        metric = metric.when(name.isin(*SERIES[m]), m)
    kept = rows.withColumn("metric_id", metric.otherwise(F.lit(None).cast("string"))).where(F.col("metric_id").isNotNull())
    period = _required(F.try_to_timestamp(F.col("period")), "timestamp")
    return _observations(
        kept.withColumns(
            {
                "entity_id": _required(trimmed(F.col("respondent")), "respondent"), "period_start": period, "period_end": period, "period_precision": F.lit("instant"), "value": _required(F.col("value").try_cast("double"), "value"),
                "unit": F.coalesce("unit", F.lit("MW")), "source": _source("operating"), "retrieved_at": F.lit(retrieved_at), "vintage": _iso(F.lit(retrieved_at)), "kind": F.lit("observed"), "quality_flags": F.array(F.lit("eia_hourly_operating_data")),
            }
        ).withColumns({"id": F.concat_ws(":", F.lit("eia"), "metric_id", "entity_id", _iso(F.col("period_start"))), "day": F.to_date("period_start")})
    )


def read_balance(spark: SparkSession, paths: str | Sequence[str], regions: Sequence[str], retrieved_at: dt.datetime) -> DataFrame:
    """Bulk balance CSV: up to two observations from a row; stamps are ends of hours in UTC."""
    raw = read_csv(spark, paths)
    cell = lambda c: trimmed(F.col(f"`{c}`"))
    rows = raw.select("ord", cell("Balancing Authority").alias("entity_id"), cell("UTC Time at End of Hour").alias("stamp"), cell("Demand (MW)").alias("demand"), cell("Net Generation (MW)").alias("net_generation"))
    rows = rows.where(F.col("entity_id").isin(*regions) & F.col("stamp").isNotNull())
    long = rows.unpivot(["ord", "entity_id", "stamp"], ["demand", "net_generation"], "metric_id", "value").where(F.col("value").isNotNull())
    period = _required(F.try_to_timestamp("stamp", F.lit("M/d/yyyy h:mm:ss a")), "timestamp")
    return _observations(
        long.withColumns({"period_start": period, "period_end": period, "value": _required(F.col("value").try_cast("double"), "value"), "source": _source("balance"), "retrieved_at": F.lit(retrieved_at), "kind": F.lit("observed"), "unit": F.lit("MW"), "period_precision": F.lit("instant"), "quality_flags": F.array(F.lit("eia930_bulk_balance"))})
        .withColumns({"id": F.concat_ws(":", F.lit("eia930"), "metric_id", "entity_id", _iso(F.col("period_start"))), "vintage": F.date_format("period_start", "yyyy-MM"), "day": F.to_date("period_start")})
    )


def parse_day(text: Column) -> Column:
    """ISO date, ISO timestamp or US date."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("M/d/yyyy"))).cast("date")


def read_wholesale(spark: SparkSession, paths: str | Sequence[str], retrieved_at: dt.datetime) -> DataFrame:
    """Daily high prices of supported hubs; header names vary, blanks and dashes are left out."""
    raw = read_csv(spark, paths)
    have = raw.columns
    rows = raw.select(
        "ord",
        first_filled(have, "Hub", "Price Hub", "Price hub", "Location").alias("hub"),
        first_filled(have, "Date", "Delivery Date", "Delivery Start Date", "Delivery start date").alias("date"),
        first_filled(have, "High Price", "High", "High price $/MWh").alias("price"),
    ).withColumn("entity_id", hub_region(F.col("hub"), HUB_REGIONS, HUB_PREFIXES))
    kept = rows.where(F.col("entity_id").isNotNull() & F.col("date").isNotNull() & F.col("price").isNotNull() & ~F.col("price").isin("-", "NA", "N/A"))
    day = _required(parse_day(F.col("date")), "date")
    return _observations(
        kept.withColumns({"day": day, "value": _required(F.regexp_replace("price", "[,$]", "").try_cast("double"), "price"), "metric_id": F.lit("wholesale_price"), "unit": F.lit("USD_per_MWh"), "source": _source("wholesale"), "retrieved_at": F.lit(retrieved_at), "vintage": _iso(F.lit(retrieved_at)), "kind": F.lit("observed"), "period_precision": F.lit("date")})
        .withColumns({"period_start": F.col("day").cast("timestamp"), "period_end": F.col("day").cast("timestamp"), "id": F.concat_ws(":", F.lit("eia:wholesale"), "entity_id", slug(F.col("hub")), F.col("day").cast("string")), "quality_flags": F.array(F.lit("eia_wholesale_high_price"), F.col("hub"))})
    )


def read_zone_archives(spark: SparkSession, paths: str | Sequence[str], retrieved_at: dt.datetime) -> DataFrame:
    """Unweighted mean zone price by local hour from ZIP archives of CSV members.

    Spark has no ZIP reader: archives are read as binary files and their lines
    unpacked in Arrow batches; everything else is relational.
    """

    def unpack(batches):
        import csv
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    for name in archive.namelist():
                        if name.endswith("_zone.csv"):
                            with archive.open(name) as raw:
                                rows = list(csv.DictReader(io.TextIOWrapper(raw, encoding="utf-8-sig")))
                            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], pa.string()) for c in ("Name", "Time Stamp", "LBMP ($/MWHr)")], ["zone", "stamp", "price"])

    files = spark.read.format("binaryFile").load(paths).select("content")
    lines = files.mapInArrow(unpack, "zone string, stamp string, price string").select(*(trimmed(F.col(c)).alias(c) for c in ("zone", "stamp", "price")))
    rows = lines.where(F.col("zone").isin(*NYISO_ZONES) & F.col("stamp").isNotNull() & F.col("price").isNotNull())
    rows = rows.select("zone", _required(F.try_to_timestamp("stamp", F.lit("M/d/yyyy H:mm")), "timestamp").alias("period_start"), _required(F.col("price").try_cast("double"), "price").alias("value"))
    mean = zone_mean(rows, NYISO_ZONES)
    return _observations(
        mean.withColumns(
            {
                "ord": F.unix_timestamp("period_start"), "id": F.concat(F.lit("nyiso:wholesale:NYIS:"), F.date_format("period_start", "yyyy-MM-dd'T'HH:mm:ss")), "metric_id": F.lit("wholesale_price"), "entity_id": F.lit("NYIS"), "period_end": F.col("period_start"), "period_precision": F.lit("local"), "day": F.to_date("period_start"),
                "unit": F.lit("USD_per_MWh"), "source": _source("zones"), "retrieved_at": F.lit(retrieved_at), "vintage": F.date_format("period_start", "yyyy-MM"), "kind": F.lit("inferred"), "quality_flags": F.array(F.lit("nyiso_zone_mean_unweighted"), F.lit("nyiso_local_time")),
            }
        )
    )


def read_company_facts(spark: SparkSession, path: str, cik: str, retrieved_at: dt.datetime) -> DataFrame:
    """Filed capital spending as positive amounts; the first concept that has rows is used alone."""
    if not cik.strip():
        raise ValueError("cik is required")
    row = "struct<start: string, end: string, filed: string, accn: string, val: string, form: string>"
    concepts = ", ".join(f"`{c}`: struct<units: struct<USD: array<{row}>>>" for c in CAPEX_CONCEPTS)
    raw = spark.read.schema(f"facts struct<`us-gaap`: struct<{concepts}>>").json(path, multiLine=True)
    found = [F.col(f"facts.`us-gaap`.`{c}`") for c in CAPEX_CONCEPTS]
    usable = F
    for c in found:
        usable = usable.when(c.isNotNull() & c["units"]["USD"].isNull(), F.raise_error(F.lit("capital spending has no USD units"))).when(F.size(c["units"]["USD"]) > 0, c["units"]["USD"])
    facts = raw.select(F.posexplode(usable.otherwise(F.raise_error(F.lit("no supported capital spending")))).alias("at", "r")).select("at", "r.*")
    start, end = (_required(F.to_date(F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))), "fact date") for c in ("start", "end"))
    rows = facts.withColumns({"s": start, "e": end, "value": F.abs(_required(F.col("val").try_cast("double"), "fact value")), "vintage": _required(F.col("filed"), "fact filing"), "accn": _required(F.col("accn"), "fact accession")})
    return _observations(
        rows.withColumns(
            {
                "ord": F.row_number().over(Window.orderBy("e", "at")).cast("long"), "id": F.concat_ws(":", F.lit("sec:capex"), F.lit(cik), "accn", F.col("s").cast("string"), F.col("e").cast("string")), "metric_id": F.lit("capex"), "entity_id": F.lit(f"cik:{cik.zfill(10)}"), "period_start": F.col("s").cast("timestamp"), "period_end": F.col("e").cast("timestamp"),
                "period_precision": F.lit("date"), "day": F.col("s"), "unit": F.lit("USD"), "source": _source("facts"), "retrieved_at": F.lit(retrieved_at), "kind": F.lit("observed"), "quality_flags": F.array(F.lit("sec_xbrl"), F.coalesce("form", F.lit("unknown_form"))),
            }
        )
    )


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id, as_of, name, value, confidence, observation_ids) from a signal fixture."""
    raw = spark.read.schema("regions array<struct<region_id: string, as_of: string, signals: map<string, struct<value: double, confidence: double, observation_ids: array<string>>>>>").json(path, multiLine=True)
    rows = raw.select(F.explode("regions").alias("r")).select(_required(trimmed(F.col("r.region_id")), "region").alias("entity_id"), _required(F.to_date("r.as_of"), "date").alias("as_of"), F.explode("r.signals").alias("name", "s"))
    known = F.when(F.col("name").isin(*COMPONENT_WEIGHTS), F.col("name")).otherwise(F.raise_error(F.concat(F.lit("unknown component: "), F.col("name"))))
    value = F.when(F.col("s.value").isNull() | F.col("s.value").between(0, 100), F.col("s.value")).otherwise(F.raise_error(F.lit("component value out of range")))
    confidence = F.when(F.col("s.confidence").between(0, 1), F.col("s.confidence")).otherwise(F.raise_error(F.lit("confidence out of range")))
    return rows.select("entity_id", "as_of", known.alias("name"), value.alias("value"), confidence.alias("confidence"), F.coalesce("s.observation_ids", F.array().cast("array<string>")).alias("observation_ids"))


def queue_projects(rows: DataFrame) -> DataFrame:
    """Projects from the queue sheet's columns (region, q_status, q_date, on_date, mw1..mw3), with serial day numbers as dates."""
    from ..functions import lookup

    serial = lambda c: F.date_add(F.lit(dt.date(1899, 12, 30)), F.col(c).cast("int"))
    mw = F.lit(0.0)
    for c in ("mw1", "mw2", "mw3"):
        mw = mw + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    out = rows.select(lookup(F.trim("region"), QUEUE_REGIONS).alias("region_id"), F.lower(F.trim("q_status")).alias("status"), serial("q_date").alias("request_date"), F.when(F.col("on_date") > 1000, serial("on_date")).alias("operation_date"), F.abs(mw).alias("capacity_mw"))
    return out.where(F.col("region_id").isNotNull() & (F.year("request_date") >= 1990))

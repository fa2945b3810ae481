"""Small observation tables."""

import datetime as dt

SCHEMA = "ord long, id string, metric_id string, entity_id string, period_start timestamp, period_precision string, day date, value double"


def daily(metric, values, entity="A", start=dt.date(2026, 1, 1)):
    out = []
    for k, v in enumerate(values):
        day = start + dt.timedelta(days=k)
        if v is not None:
            out.append((k, f"{metric}:{entity}:{day}", metric, entity, dt.datetime(day.year, day.month, day.day), "date", day, float(v)))
    return out


def hourly(metric, values, entity="A", day=dt.date(2026, 1, 1), first=0):
    return [(k, f"{metric}:{entity}:{day}:{k}", metric, entity, dt.datetime(day.year, day.month, day.day, first + k), "instant", day, float(v)) for k, v in enumerate(values)]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)

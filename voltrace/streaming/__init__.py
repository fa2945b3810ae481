"""Optional incremental form of the daily peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_peak_stream(obs: DataFrame, late: str = "2 days") -> DataFrame:
    """(entity_id, metric_id, day, peak) of a stream with ``period_start``; a day closes once the watermark passes it.

    Works on batches as well. Trailing baselines are row frames, which streams
    don't have: they are recomputed from the finished peaks.
    """
    rows = obs.withWatermark("period_start", late) if obs.isStreaming else obs
    days = rows.groupBy("entity_id", "metric_id", F.window("period_start", "1 day")).agg(F.max("value").alias("peak"))
    return days.select("entity_id", "metric_id", F.to_date("window.start").alias("day"), "peak")

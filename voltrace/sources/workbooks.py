"""Workbooks, where a reader for them is installed, and the shapes they are turned into."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the price workbooks and of the queue sheet.
PRICE_COLUMNS = {"Price hub": "Hub", "Delivery start date": "Date", "High price $/MWh": "High Price"}
QUEUE_SHEET, QUEUE_HEADER, QUEUE_COLUMNS = "03. Complete Queue Data", 1, ("region", "q_status", "q_date", "on_date", "mw1", "mw2", "mw3")


def read_workbooks(spark: SparkSession, paths: Sequence[str], sheet: str | int = 0, header: int = 0) -> DataFrame:
    """Rows of Excel files as text; needs an Excel reader for pandas."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as error:
        raise RuntimeError("reading workbooks needs openpyxl") from error
    import pandas as pd

    frames = [pd.read_excel(p, sheet_name=sheet, header=header, dtype=str) for p in paths]
    return spark.createDataFrame(pd.concat(frames, ignore_index=True).astype(object).where(lambda d: d.notna(), None))


def wholesale_rows(raw: DataFrame) -> DataFrame:
    """(Hub, Date, High Price) of concatenated price workbooks, rows with a gap dropped."""
    if missing := [c for c in PRICE_COLUMNS if c not in raw.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    day = F.date_format(F.try_to_timestamp(F.col("`Delivery start date`").cast("string")), "yyyy-MM-dd")
    rows = raw.withColumn("Delivery start date", day).select(*(F.col(f"`{a}`").alias(b) for a, b in PRICE_COLUMNS.items()))
    return rows.dropna()


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").csv(path, header=True)

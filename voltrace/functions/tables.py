"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path under the session's ``spark.checkpoint.dir``; where that is unset (tests, a laptop), under the warehouse."""
    conf = spark.conf
    base = spark.sparkContext.getCheckpointDir() or conf.get("spark.checkpoint.dir", None) or conf.get("spark.sql.warehouse.dir") + "/.checkpoints"
    return f"{base}/{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once, so that plans which use it often read it instead of computing it again."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

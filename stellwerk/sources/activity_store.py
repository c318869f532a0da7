"""Stored user activity: status and snapshot are JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellwerk.schemas import ACTIVITY


def decode_activity(rows: DataFrame) -> DataFrame:
    """Status text becomes an array; '' is no snapshot."""
    return rows.withColumn("status", F.from_json("status", "array<string>")).withColumn(
        "snapshot", F.nullif("snapshot", F.lit(""))
    )


def encode_activity(rows: DataFrame) -> DataFrame:
    return rows.withColumn("status", F.to_json("status"))


def write_activity(rows: DataFrame, path: str) -> None:
    encode_activity(rows).write.mode("overwrite").parquet(path)


def read_activity(spark: SparkSession, path: str, username: str | None = None) -> DataFrame:
    """Activity of one user, or of all; the user filter reaches the scan."""
    stored = "username string, job_id string, status string, snapshot string, updated_at timestamp"
    rows = spark.read.schema(stored).parquet(path)
    if username is not None:
        rows = rows.where(F.col("username") == username)
    return decode_activity(rows).select(*ACTIVITY.fieldNames())

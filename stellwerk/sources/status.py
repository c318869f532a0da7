"""Run status per board, kept for the status page."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellwerk.operators.validate import source_status
from stellwerk.schemas import RUN_STATUS


def run_status(report: DataFrame, run_id: str, run_at: dt.datetime | str, quota: DataFrame | None = None) -> DataFrame:
    """Counters of one run with the quota of the boards that have one (api = source)."""
    rows = report.select(
        F.lit(str(run_at)).cast("timestamp").alias("run_at"),
        F.lit(run_id).alias("run_id"),
        "source",
        *[F.col(c).cast("bigint").alias(c) for c in ("loaded", "valid", "quarantined")],
        "aborted",
        "abort_reason",
    )
    kind = RUN_STATUS["quota"].dataType
    if quota is None:
        return rows.withColumn("quota", F.lit(None).cast(kind))
    fields = F.struct(*kind.fieldNames()).cast(kind)
    return rows.join(quota.select(F.col("api").alias("source"), fields.alias("quota")), "source", "left").select(
        *RUN_STATUS.fieldNames()
    )


def write_run_status(status: DataFrame, path: str) -> None:
    """At most one row per board, hence one small file."""
    status.coalesce(1).write.mode("overwrite").json(path)


def read_run_status(spark: SparkSession, path: str) -> DataFrame:
    """Every known board with label and counters; boards that did not run count 0."""
    stored = spark.read.schema(RUN_STATUS).json(path)
    extra = stored.select("source", "run_at", "quota")
    return source_status(stored).join(extra, "source", "left")

"""Request quota per API, computed from a request log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellwerk.functions.moments import day_literal, month_start

WARN_SHARE = 0.8


def quota_usage(log: DataFrame, limits: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Used calls, limit and percentage per API.

    ``log`` has (api, ts, calls), ``limits`` (api, quota_limit, monthly). Monthly APIs count from the first
    of the month, the others over their lifetime; APIs without calls appear with 0. The log shrinks
    to one row per API and month before it meets the limits.
    """
    per_month = (
        log.where(F.to_date("ts") <= day_literal(as_of))
        .groupBy("api", F.trunc("ts", "MM").alias("month"))
        .agg(F.sum("calls").alias("calls"))
    )
    counted = (~F.col("monthly")) | (F.col("month") == month_start(as_of))
    used = (
        limits.join(per_month, "api", "left")
        .groupBy("api", "quota_limit", "monthly")
        .agg(F.coalesce(F.sum(F.when(counted, F.col("calls"))), F.lit(0)).cast("bigint").alias("used"))
    )
    return used.select(
        "api",
        "used",
        "quota_limit",
        F.round(F.col("used") / F.col("quota_limit") * 100, 1).alias("percent"),
        "monthly",
        F.when(F.col("monthly"), month_start(as_of)).alias("reset_date"),
    )


def quota_flags(usage: DataFrame) -> DataFrame:
    """Is the quota used up, is it time to warn?"""
    return usage.withColumn("exhausted", F.col("used") >= F.col("quota_limit")).withColumn(
        "warn", F.col("used") >= F.col("quota_limit") * WARN_SHARE
    )

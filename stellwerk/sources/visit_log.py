"""Visit log: one pipe-delimited text line per page view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VISIT_COLUMNS = ["time", "ip", "geo", "method", "path", "status", "ua", "referrer"]


def parse_visit_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``time | ip | geo | METHOD path | status | user agent | referrer``.

    geo is one word, or the three parts country, city and provider; such lines have nine fields.
    Lines with fewer than seven fields are skipped.
    """
    parts = F.transform(F.split(column, r"\|"), lambda part: F.trim(part))
    rows = lines.select(parts.alias("p")).where(F.size("p") >= 7)
    shift = F.when(F.size("p") >= 9, F.lit(2)).otherwise(F.lit(0))

    def field(position: int) -> Column:
        return F.get("p", shift + position)

    request = field(3)
    has_method = request.rlike(r"^[A-Z]+ ")
    return rows.select(
        F.get("p", 0).alias("time"),
        F.get("p", 1).alias("ip"),
        F.when(shift == 2, F.array_join(F.slice("p", 3, 3), " | ")).otherwise(F.get("p", 2)).alias("geo"),
        F.when(has_method, F.split_part(request, F.lit(" "), F.lit(1))).alias("method"),
        F.when(has_method, F.regexp_replace(request, r"^[A-Z]+ ", "")).otherwise(request).alias("path"),
        field(4).alias("status"),
        field(5).alias("ua"),
        field(6).alias("referrer"),
    )


def read_visit_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_visit_lines(spark.read.text(path))

"""Star schema: company, location and date dimensions, job and skill facts.

Foreign keys are hashes of the natural keys, so facts get them by computing the hash instead of
joining the dimensions: no shuffle of the fact rows, and the unknown company cannot become a hot key.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellwerk.functions.keys import company_id, company_key, filled_location, location_id
from stellwerk.functions.moments import day_literal
from stellwerk.schemas import UNKNOWN

DATE_START = "2023-01-01"

# Weekday names, Sunday first.
WEEKDAYS = ["Sonntag", "Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag"]

FACT_JOBS = [
    "job_id",
    "source",
    "source_id",
    "company_id",
    "location_id",
    "title",
    "description",
    "category",
    "contract_type",
    "contract_time",
    "salary_min",
    "salary_max",
    "salary_mid",
    "currency",
    "posted_at",
    "fetched_at",
    "skills",
    "url",
]


def build_dim_company(staging: DataFrame) -> DataFrame:
    """One row per normalised company; the smallest spelling represents it."""
    return (
        staging.where(F.col("company").isNotNull())
        .groupBy(company_key(F.col("company_norm")).alias("company_norm"))
        .agg(F.min("company").alias("company"))
        .select(company_id(F.col("company_norm")).alias("company_id"), "company", "company_norm")
    )


def build_dim_location(staging: DataFrame) -> DataFrame:
    """Distinct (city, state, region) with missing parts filled."""
    city, state, region = filled_location(F.col("city"), F.col("state"), F.col("region"))
    places = staging.select(city.alias("city"), state.alias("state"), region.alias("region")).distinct()
    return places.select(
        location_id(F.col("city"), F.col("state"), F.col("region")).alias("location_id"), "city", "state", "region"
    )


def build_dim_date(spark: SparkSession, end: dt.date | str, start: dt.date | str = DATE_START) -> DataFrame:
    """Calendar from ``start`` to ``end``, both included."""
    days = spark.range(1).select(F.explode(F.sequence(day_literal(start), day_literal(end))).alias("date"))
    weekday = F.dayofweek("date") - 1
    return days.select(
        "date",
        F.year("date").alias("year"),
        F.quarter("date").alias("quarter"),
        F.month("date").alias("month"),
        F.weekofyear("date").alias("iso_week"),
        F.dayofmonth("date").alias("day"),
        weekday.alias("weekday_no"),
        F.get(F.array(*[F.lit(name) for name in WEEKDAYS]), weekday).alias("weekday"),
    )


def default_calendar_end(as_of: dt.date) -> dt.date:
    return as_of + dt.timedelta(days=30)


def build_fact_jobs(staging: DataFrame, dim_company: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Postings with foreign keys; further staging columns named in ``keep`` pass through.

    A posting that names a company finds it in the dimension by construction. One without a company
    points to the unknown company if that row exists, else to nothing: a join against that single
    row (company keys are unique) decides it.
    """
    unknown = dim_company.where(F.col("company_norm") == UNKNOWN).select(
        F.col("company_norm").alias("__key"), F.col("company_id").alias("__unknown_id")
    )
    keyed = staging.withColumn("__company_key", company_key(F.col("company_norm")))
    city, state, region = filled_location(F.col("city"), F.col("state"), F.col("region"))
    return (
        keyed.join(F.broadcast(unknown), F.col("__company_key") == F.col("__key"), "left")
        .withColumn(
            "company_id",
            F.when(F.col("company").isNotNull(), company_id(F.col("__company_key"))).otherwise(F.col("__unknown_id")),
        )
        .withColumn("location_id", location_id(city, state, region))
        .select(*FACT_JOBS, *keep)
    )


def build_fact_skills(staging: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per posting and skill with the number of mentions in its skill array.

    Staging holds each job id once, so the count is a per-row computation and needs no shuffle.
    """
    weighted = F.transform(
        F.array_distinct("skills"),
        lambda skill: F.struct(
            skill.alias("skill"),
            F.size(F.filter("skills", lambda other: other == skill)).cast("bigint").alias("weight"),
        ),
    )
    return staging.select("job_id", *keep, F.explode(weighted).alias("s")).select("job_id", "s.skill", "s.weight", *keep)


def build_gold(staging: DataFrame, calendar_end: dt.date | str) -> dict[str, DataFrame]:
    """The five gold tables, lazily, from one staging frame."""
    dim_company = build_dim_company(staging)
    return {
        "fact_jobs": build_fact_jobs(staging, dim_company),
        "fact_skills": build_fact_skills(staging),
        "dim_company": dim_company,
        "dim_location": build_dim_location(staging),
        "dim_date": build_dim_date(staging.sparkSession, calendar_end),
    }

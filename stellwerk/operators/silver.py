"""Silver projection: normalised text, resolved place, salary midpoint, category, skills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk.functions.text import blank_to_null, lower_trim
from stellwerk.operators.dedup import dedup_bronze, dedup_stored_bronze, is_stored
from stellwerk.operators.skills import STANDARD_TAXONOMY, Skill, extract_skills


def _segment(segments: Column, position: int) -> Column:
    """1-based element; '' and positions past the end are NULL."""
    return blank_to_null(F.get(segments, position - 1))


def resolve_city(city: Column, segments: Column, location: Column) -> Column:
    return F.coalesce(city, _segment(segments, 3), _segment(segments, 2), location)


def resolve_state(state: Column, segments: Column, region: Column) -> Column:
    return F.coalesce(state, _segment(segments, 2), region)


def salary_mid(low: Column, high: Column) -> Column:
    """Mean of both ends, else the one that is known."""
    return F.coalesce((low + high) / 2.0, low, high)


def category(label: Column, tag: Column) -> Column:
    return F.coalesce(label, tag)


def project_silver(df: DataFrame, taxonomy: Sequence[Skill] = STANDARD_TAXONOMY) -> DataFrame:
    """Bronze columns to silver columns; a ``run_day`` column passes through."""
    c = F.col
    return df.select(
        "job_id",
        "source",
        "source_id",
        "title",
        F.lower(F.trim("title")).alias("title_norm"),
        "description",
        "company",
        lower_trim(c("company")).alias("company_norm"),
        resolve_city(c("city"), c("location_segments"), c("location")).alias("city"),
        resolve_state(c("state"), c("location_segments"), c("region")).alias("state"),
        "region",
        "salary_min",
        "salary_max",
        salary_mid(c("salary_min"), c("salary_max")).alias("salary_mid"),
        "currency",
        "contract_type",
        "contract_time",
        category(c("category_label"), c("category_tag")).alias("category"),
        "posted_at",
        "fetched_at",
        extract_skills(c("description"), taxonomy).alias("skills"),
        "url",
        "dedup_key",
        *([c("run_day")] if "run_day" in df.columns else []),
    )


def bronze_to_silver(
    bronze: DataFrame,
    taxonomy: Sequence[Skill] = STANDARD_TAXONOMY,
    scope: Sequence[str] = ("run_day",),
    tie_breakers: Sequence[Column] | None = None,
) -> DataFrame:
    """Deduplicate each day, then project; skills are searched in surviving rows only."""
    unique = (dedup_stored_bronze if is_stored(bronze) else dedup_bronze)(bronze, scope, tie_breakers)
    return project_silver(unique, taxonomy)

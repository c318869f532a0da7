"""Identity of postings, companies and locations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stellwerk.functions.text import norm_text
from stellwerk.schemas import COUNTRY, UNKNOWN


def _digest24(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(24))


def job_id(source: Column, source_id: Column) -> Column:
    """Primary key of a posting."""
    return _digest24(F.concat(source, F.lit(":"), source_id))


def dedup_key(title: Column, company: Column) -> Column:
    """Same title at the same company on any board, in any city."""
    return _digest24(F.concat(norm_text(title), F.lit("|"), norm_text(company)))


def company_key(company_norm: Column) -> Column:
    return F.coalesce(F.nullif(company_norm, F.lit("")), F.lit(UNKNOWN))


def company_id(key: Column) -> Column:
    return F.md5(key)


def filled_location(city: Column, state: Column, region: Column) -> tuple[Column, Column, Column]:
    return (
        F.coalesce(city, F.lit(UNKNOWN)),
        F.coalesce(state, F.lit(UNKNOWN)),
        F.coalesce(region, F.lit(COUNTRY)),
    )


def location_id(city: Column, state: Column, region: Column) -> Column:
    """Expects the three filled parts."""
    return F.md5(F.concat(city, F.lit("|"), state, F.lit("|"), region))

"""Timestamps as the boards write them, and calendar arithmetic relative to a given day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:?\d{2}(:?\d{2}(\.\d+)?)?)?\s?(Z|[+-]\d{2}:?\d{2})?)?$"


def parse_iso(text: Column) -> Column:
    """ISO date or date-time, with or without offset; naive values are UTC, anything else NULL."""
    return F.when(text.rlike(_ISO), text.try_cast("timestamp"))


def parse_iso_or_epoch(text: Column) -> Column:
    """ISO text or whole epoch seconds; 0 counts as missing."""
    seconds = F.nullif(F.when(text.rlike(r"^-?\d+$"), text.try_cast("bigint")), F.lit(0))
    in_range = seconds.between(-62135596800, 253402300799)
    return F.when(in_range, F.timestamp_seconds(seconds)).otherwise(parse_iso(text))


def parse_day_or_second(text: Column) -> Column:
    """First 19 characters as yyyy-MM-ddTHH:mm:ss or yyyy-MM-dd."""
    head = F.substring(text, 1, 19)
    return F.coalesce(
        F.try_to_timestamp(head, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        F.try_to_timestamp(head, F.lit("yyyy-MM-dd")),
    )


def parse_mislabelled_berlin(text: Column) -> Column:
    """Berlin local time carrying a wrong Z or offset: drop the marker, then convert to UTC."""
    naive = F.regexp_replace(text, r"Z$|[+-]\d{2}:?\d{2}$", "")
    return F.to_utc_timestamp(parse_iso(naive), "Europe/Berlin")


def day_literal(day: dt.date | str) -> Column:
    return F.lit(str(day)).cast("date")


def trailing_start(as_of: dt.date | str, days: int) -> Column:
    """The day ``days`` before ``as_of``."""
    return F.date_sub(day_literal(as_of), int(days))


def month_start(as_of: dt.date | str) -> Column:
    return F.trunc(day_literal(as_of), "MM")

"""From adapter output to one keyed posting frame."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk.functions import keys
from stellwerk.schemas import SOURCE_NAMES, SOURCES


def source_priority(source: Column) -> Column:
    """Priority of a board; nine constants, so a literal map serves better than a join."""
    pairs = [F.lit(item) for name, priority, _ in SOURCES for item in (name, priority)]
    return F.try_element_at(F.create_map(*pairs), source)


def with_keys(df: DataFrame) -> DataFrame:
    """Add job_id, dedup_key and source_priority."""
    return df.withColumns(
        {
            "job_id": keys.job_id(F.col("source"), F.col("source_id")),
            "dedup_key": keys.dedup_key(F.col("title"), F.col("company")),
            "source_priority": source_priority(F.col("source")),
        }
    )


def unify_sources(frames: Iterable[DataFrame]) -> DataFrame:
    """Stack the boards by column name and add the keys."""
    return with_keys(reduce(DataFrame.unionByName, frames))


def parse_source_list(text: str | None) -> list[str]:
    """Comma list of boards: trimmed, lower case, unknown names ignored; None means all."""
    if text is None:
        return list(SOURCE_NAMES)
    wanted = {part.strip().lower() for part in text.split(",")}
    return [name for name in SOURCE_NAMES if name in wanted]


def filter_sources(df: DataFrame, enabled: str | Sequence[str] | None) -> DataFrame:
    names = parse_source_list(enabled) if enabled is None or isinstance(enabled, str) else list(enabled)
    return df.where(F.col("source").isin(names))


def filter_categories(df: DataFrame, wanted: Sequence[str] | None) -> DataFrame:
    """Only the wanted search categories; none given keeps all.

    Landing lines that could not be read have no category and stay, to be quarantined; a broken posting of
    another category goes with its page.
    """
    if not wanted:
        return df
    keep = F.coalesce(F.col("search_category").isin(list(wanted)), F.lit(False))
    if "intact" not in df.columns:
        return df.where(keep)
    return df.where(keep | (~F.col("intact") & F.col("search_category").isNull()))

"""Intermediate tables of a job, in the shared folder while they are needed."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame

from stellwerk.operators import dedup
from stellwerk.session import checkpoint_root
from stellwerk.sources.versions import drop_folder


@contextmanager
def written_once(rows: DataFrame, name: str) -> Iterator[DataFrame]:
    """Rows that several tables are derived from, as files in the shared folder while they are needed."""
    spark = rows.sparkSession
    folder = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        rows.write.option("compression", "zstd").parquet(folder)
        yield spark.read.schema(rows.schema).parquet(folder)
    finally:
        drop_folder(spark, folder)


@contextmanager
def kept_by(stored: DataFrame, rule: Callable[[DataFrame], DataFrame]) -> Iterator[DataFrame]:
    """The stored rows a rule keeps. Their positions are written first, so that the rows can be fetched without a shuffle."""
    with ExitStack() as written:

        def once(rows: DataFrame) -> DataFrame:
            return written.enter_context(written_once(rows, "kept"))

        files = once(dedup.numbered_files(stored))
        if dedup.few_enough(files):
            kept = dedup.with_names(_kept(dedup.with_numbers(stored, files), rule, once), files)
        else:
            kept = dedup.kept_positions(stored, rule)
        yield dedup.fetched(stored, once(kept), stored=True)


def _kept(rows: DataFrame, rule: Callable[[DataFrame], DataFrame], once: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Positions of the rows a rule keeps.

    The steps that look for repeats are taken one by one: rows alone with their key are found by its hash, and only the
    others are shuffled with all columns that settle which of them stays. Too many bitmaps for every executor end this.
    """
    if not isinstance(rule, dedup.Rules):
        return dedup.kept_positions(rows, rule)
    left = named = rule.named(rows)
    for key, step in rule.steps:
        alone = once(dedup.alone_positions(left, key))
        if not dedup.few_enough(alone):
            return dedup.kept_positions(rows, rule)
        kept = once(dedup.either(alone, dedup.kept_positions(dedup.without(left, alone), step)))
        if not dedup.few_enough(kept):
            return dedup.kept_positions(rows, rule)
        left = dedup.within(named, kept)
    return dedup.kept_positions(left, rule.rest)

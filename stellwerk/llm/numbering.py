"""Dense numbers for the rows of a table, without a global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk.llm.columnar import stored

_PART_BITS = 33  # of monotonically_increasing_id: the row's place within its partition


def numbered(rows: DataFrame, name: str, order: Sequence[Column] = ()) -> DataFrame:
    """The rows, written once, with ``number`` 0, 1, 2 ... without gaps.

    With ``order`` the numbers follow it: the rows are range-partitioned and sorted within partitions, and
    each partition starts where the counts of those before it end. Only these counts, one for each
    partition, go through the driver. Ties are numbered in any order. A column ``number`` must not exist.
    """
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # Written before it is counted: the places must not change when a task is repeated.
    placed = stored(rows.withColumn("number", F.monotonically_increasing_id()), name)
    part = F.shiftright("number", _PART_BITS)
    counts = placed.groupBy(part.alias("part")).count().orderBy("part").collect()
    start, starts = 0, []
    for row in counts:
        starts.append((row["part"], start))
        start += row["count"]
    first = placed.sparkSession.createDataFrame(starts, "part bigint, first bigint")
    place = F.col("number").bitwiseAND(F.lit((1 << _PART_BITS) - 1))
    # One row for each partition of the write, a number that the settings bound.
    return (
        placed.withColumn("part", part)
        .join(F.broadcast(first), "part")
        .withColumn("number", F.col("first") + place)
        .drop("part", "first")
    )

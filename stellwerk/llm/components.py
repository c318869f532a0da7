"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellwerk.llm.columnar import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of ``a, b`` edges; no edges, no rows.

    Each round hangs the larger neighbours of a node on its smallest one, then a node and its smaller
    neighbours on the smallest of those, until nothing changes: the logarithm of the longest path in
    rounds. Every minimum is taken before the shuffle, so a hub with a third of all edges costs one row
    per task; rounds end in written tables, so a lost executor repeats one round at most.
    """
    links = stored(_distinct(edges.select("a", "b")), "links")
    state = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = _distinct(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")))
        large = stored(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
        links = stored(_distinct(small), "links")
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _distinct(edges: DataFrame) -> DataFrame:
    """Each edge once, the larger node first, no loops."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

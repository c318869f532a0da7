"""Tasks stay small when a session has few shuffle partitions: their number does not bound what one of them holds."""

from pyspark.sql import functions as F

from stellwerk.operators import dedup
from stellwerk.session import configure


def largest_share(rows):
    """Rows of the fullest partition, of all, and the number of partitions."""
    sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    return max(sizes), sum(sizes), len(sizes)


def test_tasks_follow_the_bytes_not_the_sessions_partitions(spark):
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize"]
    before = {n: spark.conf.get(n) for n in names}
    try:
        configure(spark)
        # Two partitions, and 64 KB in place of 16 MB for a task.
        for name, value in zip(names, ("2", "64k", "64k")):
            spark.conf.set(name, value)
        rows = spark.range(0, 120_000, 1, 8).select(
            (F.col("id") % 60_000).alias("source_id"), F.lit("muse").alias("source"), F.sha2(F.col("id").cast("string"), 256).alias("text"), F.col("id").alias("fetched_at")
        )
        unique = dedup.dedup_latest(rows, (), [F.asc("text")])
        most, all_rows, parts = largest_share(unique)
        assert all_rows == 60_000 and unique.agg(F.min("fetched_at")).first()[0] == 60_000
        assert parts > 20 and most < all_rows / 20
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)

"""Session settings every job relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# UTC keeps naive source dates, date truncation and day partitions stable wherever the job runs.
# AQE coalesces small shuffle partitions and splits skewed ones. Sizes are those of compressed columns or
# rows, which take ten to forty times as much in memory once strings are built from them: small tasks sort
# there, larger ones would spill whole rows to disk. Partitions that a window or a sort reads are only ever joined up
# to that size, not cut: shuffles start with 400, so that 6 GB keep to it whatever number the session has. More would make
# the blocks of a small task too short to be compressed well.
# A job is many queries, most of which end in a written table: their shuffle files go when they end, not when the driver's
# garbage is collected, so the disk holds one query's shuffles and not the whole job's.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "16m",
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stellwerk")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


_own_folders: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for written intermediate tables that every executor can reach.

    ``spark.checkpoint.dir`` names it. Only a session on one machine may leave it unset and gets a folder of
    its own, because there all tasks see the same disk.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="stellwerk-")
    return _own_folders[context.applicationId]

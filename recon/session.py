"""Session defaults for comparison jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every comparison relies on. UTC keeps timestamp text stable; the
# adaptive settings coalesce small shuffles, turn joins against small runtime
# inputs into broadcasts, and split skewed join partitions.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Plans here are wide; recording a call site for each expression doubles the time to build them.
    "spark.sql.dataFrameQueryContext.enabled": "false",
}


def build_session(app: str = "recon", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the defaults above; `conf` uses dotted names via dict unpacking."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session zone to UTC, so both sides print timestamps alike."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


# Shuffle partition size to aim at, and limits for the number of partitions.
PARTITION_BYTES = 128 * 1024 * 1024
MOST_PARTITIONS = 200_000


def shuffle_partitions_for(total_bytes: int, least: int) -> int:
    """Partitions for a shuffle of `total_bytes`."""
    return max(least, min(MOST_PARTITIONS, -(-total_bytes // PARTITION_BYTES)))


def size_shuffles(spark: SparkSession, total_bytes: int) -> int:
    """Set the shuffle partitions for comparing `total_bytes` of compared columns (both sides together).

    Adaptive execution merges small partitions but never makes more than were
    asked for, so the number has to be large enough for large tables.
    """
    n = shuffle_partitions_for(total_bytes, spark.sparkContext.defaultParallelism)
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return n

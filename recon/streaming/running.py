"""Running results over streams of differences or of compared rows (ST1, ST2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_counts(differences: DataFrame) -> DataFrame:
    """ST1: differences per type so far. State is one row per type."""
    return differences.groupBy("difference_type").agg(F.count(F.lit(1)).alias("n"))


def windowed_match_rate(
    rows: DataFrame, ts: str, *, window: str, lag: str, is_different: str = "is_different"
) -> DataFrame:
    """ST2: match rate per window; rows later than `lag` behind the newest are dropped.

    The watermark plays the part of the replication-lag allowance: a window is
    final once it is older than `lag`, and its state is then freed.
    """
    if dict(rows.dtypes)[ts] != "timestamp":
        rows = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    counted = (
        rows.withWatermark(ts, lag)
        .groupBy(F.window(ts, window).alias("w"))
        .agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(is_different).alias("differences"))
    )
    return counted.select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        "total_rows",
        "differences",
        (1 - F.col("differences") / F.col("total_rows")).alias("match_rate"),
    )


def run_to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available into Parquet files and stop; restarts continue from the checkpoint."""
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def run_latest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process everything available, replacing the table at `path` with the newest totals of each batch."""

    def replace_totals(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = (
        stream.writeStream.outputMode("complete")
        .foreachBatch(replace_totals)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query

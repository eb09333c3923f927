"""Several comparisons in one go."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recon.plans.compare import Options, compare
from recon.sources.side import TableSide

LAYOUT = "name string, status string, rows_A bigint, rows_B bigint, diff_keys bigint, match_rate double, error string"


def batch_compare(
    spark: SparkSession, pairs: Mapping[str, tuple[TableSide, TableSide]], options: Options | None = None
) -> DataFrame:
    """One row per comparison; a failing one is recorded and does not stop the rest.

    The loop is over comparisons; the rows of each are processed by the executors.
    """
    rows = []
    for name, (a, b) in pairs.items():
        try:
            s = compare(a, b, options).stats.first()
            rows.append((name, "completed", s.rows_A, s.rows_B, s.diff_keys, s.match_rate, None))
        except Exception as e:  # noqa: BLE001  (any failure belongs to its own comparison)
            rows.append((name, "failed", None, None, None, None, f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(rows, LAYOUT)


def batch_totals(results: DataFrame) -> DataFrame:
    """Successes and failures of a batch."""
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "completed").alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )

"""Queries over stored comparison results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recon.operators.cooldown import fired_alerts as fired_alerts  # H10
from recon.operators.grading import grade

# Size of the latest-runs view, health limit in percent, trend gap.
LATEST = 100
UNHEALTHY_RATE = 10
HISTORY_FIELDS = [
    "comparison_id",
    "source_table",
    "target_table",
    "algorithm",
    "start_time",
    "end_time",
    "execution_time_seconds",
    "rows_compared",
    "match_rate",
    "created_at",
]


def history(
    summary: DataFrame,
    *,
    source_table: str | None = None,
    target_table: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    limit: int = 100,
    offset: int = 0,
) -> DataFrame:
    """H1: past comparisons, newest first, filtered and paged."""
    rows = summary
    for test, wanted in (
        (lambda v: F.col("source_table") == v, source_table),
        (lambda v: F.col("target_table") == v, target_table),
        (lambda v: F.col("start_time") >= F.lit(v).cast("timestamp_ntz"), start),
        (lambda v: F.col("start_time") <= F.lit(v).cast("timestamp_ntz"), end),
    ):
        if wanted is not None:
            rows = rows.where(test(wanted))
    rows = rows.select(*[c for c in HISTORY_FIELDS if c in rows.columns])
    return rows.orderBy(F.col("start_time").desc(), "comparison_id").offset(offset).limit(limit)


def status_totals(tables: DataFrame, schemas: DataFrame) -> DataFrame:
    """H3: totals by kind of comparison and status."""
    both = tables.select(F.lit("table").alias("kind"), "status").unionByName(
        schemas.select(F.lit("schema").alias("kind"), "status")
    )
    return both.groupBy("kind").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "running")],
    )


def daily_activity(*summaries: DataFrame) -> DataFrame:
    """H4: comparisons per day over all given histories."""
    stamps = [s.select("created_at") for s in summaries]
    rows = stamps[0]
    for s in stamps[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("comparisons"))


def run_times(summary: DataFrame, kind: str = "table") -> DataFrame:
    """H4: average, shortest and longest run of completed comparisons."""
    seconds = F.col("execution_time_seconds")
    return summary.where((F.col("status") == "completed") & seconds.isNotNull()).agg(
        F.lit(kind).alias("kind"),
        F.avg(seconds).cast("double").alias("avg_seconds"),
        F.min(seconds).cast("double").alias("min_seconds"),
        F.max(seconds).cast("double").alias("max_seconds"),
    )


def per_table(summary: DataFrame) -> DataFrame:
    """H5: completed comparisons rolled up per source table."""
    return (
        summary.where(F.col("status") == "completed")
        .groupBy("source_table")
        .agg(
            F.count(F.lit(1)).alias("comparison_count"),
            F.sum("rows_compared").alias("total_rows"),
            F.sum("rows_different").alias("total_differences"),
            F.avg("match_rate").cast("double").alias("avg_match_rate"),
            F.avg("execution_time_seconds").cast("double").alias("avg_execution_time"),
        )
    )


def per_schema_pair(summary: DataFrame) -> DataFrame:
    """H5: completed schema comparisons per pair of schemas."""
    return (
        summary.where(F.col("status") == "completed")
        .groupBy("source_schema", "target_schema")
        .agg(
            F.count(F.lit(1)).alias("comparison_count"),
            F.avg("execution_time_seconds").cast("double").alias("avg_time"),
        )
    )


def per_difference_type(*details: DataFrame) -> DataFrame:
    """H5: stored differences per type."""
    rows = details[0].select("difference_type")
    for d in details[1:]:
        rows = rows.unionByName(d.select("difference_type"))
    return rows.groupBy("difference_type").agg(F.count(F.lit(1)).alias("n"))


def latest_graded(summary: DataFrame, n: int = LATEST) -> DataFrame:
    """H6: the latest runs with their quality grade (match_rate in percent)."""
    cols = ["comparison_id", "source_table", "target_table", "start_time", "match_rate"]
    return (
        summary.orderBy(F.col("start_time").desc(), "comparison_id")
        .limit(n)
        .select(*cols, grade(F.col("match_rate") / 100, "history").alias("match_quality"))
    )


def export_history(tables: DataFrame, schemas: DataFrame) -> DataFrame:
    """H7: table and schema histories in one list; schema runs have no row counts."""
    t = tables.select(
        "comparison_id",
        F.lit("table").alias("comparison_type"),
        "source_table",
        "target_table",
        "status",
        "start_time",
        "execution_time_seconds",
        "rows_different",
        "rows_compared",
        "created_at",
    )
    s = schemas.select(
        "comparison_id",
        F.lit("schema").alias("comparison_type"),
        F.col("source_schema").alias("source_table"),
        F.col("target_schema").alias("target_table"),
        "status",
        "start_time",
        "execution_time_seconds",
        F.col("total_differences").alias("rows_different"),
        "created_at",
    )
    return t.unionByName(s, allowMissingColumns=True)


def fail_stuck(summary: DataFrame, now: datetime, hours: int, statuses: tuple[str, ...] = ("running", "pending")) -> DataFrame:
    """H8: runs in one of the statuses for longer than `hours` become failed, with a reason."""
    limit = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(hours)} HOURS")
    stuck = F.col("status").isin(*statuses) & (F.col("created_at") < limit)
    reason = F.concat(F.lit("no end within the allowed hours, last seen "), F.col("status"))
    message = F.col("error_message") if "error_message" in summary.columns else F.lit(None).cast("string")
    return summary.withColumns(
        {"error_message": F.when(stuck, reason).otherwise(message), "status": F.when(stuck, "failed").otherwise(F.col("status"))}
    )


def doomed(summary: DataFrame, *, failed: bool = False, now: datetime | None = None, days: int | None = None) -> DataFrame:
    """Ids to delete: all, only failed ones, or those older than `days`."""
    rows = summary
    if failed:
        rows = rows.where(F.col("status") == "failed")
    elif days is not None:
        rows = rows.where(F.col("created_at") < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS"))
    return rows.select("comparison_id")


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of comparisons that stay."""
    return rows.join(ids, "comparison_id", "left_anti")


def metric_rollup(metrics: DataFrame, since: datetime | None = None) -> DataFrame:
    """H9: count, average, extremes and latest value of every metric."""
    rows = metrics if since is None else metrics.where(F.col("recorded_at") >= F.lit(since).cast("timestamp_ntz"))
    v = F.col("metric_value")
    return rows.groupBy("metric_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(v), 2).alias("avg"),
        F.round(F.min(v), 2).alias("min"),
        F.round(F.max(v), 2).alias("max"),
        F.round(F.max_by(v, "recorded_at"), 2).alias("last"),
    )


def success_rate(summary: DataFrame) -> DataFrame:
    """H9: runs, successes, success rate in percent and health of a period."""
    n = summary.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "completed").alias("successful"),
    )
    rate = F.when(F.col("total") > 0, F.col("successful") / F.col("total") * 100).otherwise(F.lit(0.0))
    errors = F.when(F.col("total") > 0, (F.col("total") - F.col("successful")) / F.col("total") * 100).otherwise(F.lit(0.0))
    return n.withColumns({"success_rate": F.round(rate, 4), "health": health(errors)})


def health(error_rate: Column) -> Column:
    return F.when(error_rate == 0, "healthy").when(error_rate < UNHEALTHY_RATE, "warning").otherwise("unhealthy")


def quality_trend(summary: DataFrame) -> DataFrame:
    """Each completed run against the previous run of the same table pair.

    One pair may own most of the history, so runs are ordered within days, and
    the first run of a day looks up the last run of the day before it in a list
    with one row per pair and day.
    """
    pair = ["source_table", "target_table"]
    order = ["start_time", "comparison_id"]
    runs = summary.where(F.col("status") == "completed").withColumn("day", F.to_date("start_time"))
    within = Window.partitionBy(*pair, "day")
    runs = runs.withColumns(
        {
            "same_day": F.lag("match_rate").over(within.orderBy(*order)),
            "at": F.row_number().over(within.orderBy(*order)),
            "of": F.count(F.lit(1)).over(within),
        }
    )
    closing = runs.where(F.col("at") == F.col("of")).select(
        *pair,
        "day",
        F.lag("match_rate").over(Window.partitionBy(*pair).orderBy("day")).alias("day_before"),
    )
    joined = runs.join(closing, [*pair, "day"], "left")
    previous = F.when(F.col("at") == 1, F.col("day_before")).otherwise(F.col("same_day"))
    change = F.col("match_rate") - previous
    direction = (
        F.when(previous.isNull(), "first").when(change > 0, "improving").when(change < 0, "degrading").otherwise("stable")
    )
    return joined.select("comparison_id", *pair, "match_rate", previous.alias("previous_rate"), direction.alias("trend"))

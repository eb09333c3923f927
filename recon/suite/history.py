"""Checks: stored results over time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from recon.operators import history as hs
from recon.plans.lineage import scratch_path
from recon.sources.store import ResultStore
from recon.suite.inputs import HISTORY, METRICS, SCHEMA_HISTORY, derive, sql
from recon.suite.registry import check

H = f"WITH h AS ({sql(HISTORY, 'orders')}), s AS ({sql(SCHEMA_HISTORY, 'events')}) "


def tables(spark, sf):
    return derive(spark, sf, "orders", HISTORY)


def schemas(spark, sf):
    return derive(spark, sf, "events", SCHEMA_HISTORY)


@check(
    "H1_history",
    H
    + """SELECT comparison_id, source_table, target_table, algorithm, start_time, end_time, execution_time_seconds, rows_compared, match_rate, created_at
    FROM h WHERE source_table = '1-URGENT' AND start_time >= TIMESTAMP '1996-01-01' AND start_time <= TIMESTAMP '1999-01-01'
    ORDER BY start_time DESC, comparison_id LIMIT 30 OFFSET 10""",
)
def history(spark, sf):
    return hs.history(
        tables(spark, sf), source_table="1-URGENT", start=datetime(1996, 1, 1), end=datetime(1999, 1, 1), limit=30, offset=10
    )


@check(
    "H3_status_totals",
    H
    + """, u AS (SELECT 'table' AS kind, status FROM h UNION ALL SELECT 'schema', status FROM s)
    SELECT kind, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
      count(*) FILTER (WHERE status = 'running') AS running FROM u GROUP BY kind""",
)
def status_totals(spark, sf):
    return hs.status_totals(tables(spark, sf), schemas(spark, sf))


@check(
    "H4_daily_activity",
    H + "SELECT CAST(created_at AS DATE) AS day, count(*) AS comparisons FROM (SELECT created_at FROM h UNION ALL SELECT created_at FROM s) GROUP BY 1",
)
def daily(spark, sf):
    return hs.daily_activity(tables(spark, sf), schemas(spark, sf))


@check(
    "H4_run_times",
    H
    + """SELECT 'table' AS kind, round(avg(execution_time_seconds), 6) AS avg_seconds, min(execution_time_seconds) AS min_seconds,
    max(execution_time_seconds) AS max_seconds FROM h WHERE status = 'completed'
    UNION ALL SELECT 'schema', round(avg(execution_time_seconds), 6), min(execution_time_seconds), max(execution_time_seconds) FROM s WHERE status = 'completed'""",
)
def run_times(spark, sf):
    both = hs.run_times(tables(spark, sf)).unionByName(hs.run_times(schemas(spark, sf), "schema"))
    return both.withColumn("avg_seconds", F.round("avg_seconds", 6))


@check(
    "H5_per_table",
    H
    + """SELECT source_table, count(*) AS comparison_count, CAST(sum(rows_compared) AS BIGINT) AS total_rows, CAST(sum(rows_different) AS BIGINT) AS total_differences,
    round(avg(match_rate), 6) AS avg_match_rate, round(avg(execution_time_seconds), 6) AS avg_execution_time FROM h WHERE status = 'completed' GROUP BY source_table""",
)
def per_table(spark, sf):
    out = hs.per_table(tables(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_match_rate", "avg_execution_time")})


@check(
    "H5_per_schema_pair",
    H
    + """SELECT source_schema, target_schema, count(*) AS comparison_count, round(avg(execution_time_seconds), 6) AS avg_time FROM s
    WHERE status = 'completed' GROUP BY 1, 2""",
)
def per_schema_pair(spark, sf):
    return hs.per_schema_pair(schemas(spark, sf)).withColumn("avg_time", F.round("avg_time", 6))


@check(
    "H5_per_difference_type",
    H + "SELECT status AS difference_type, count(*) AS n FROM (SELECT status FROM h UNION ALL SELECT status FROM s) GROUP BY 1",
)
def per_type(spark, sf):
    t, s = (x.select(F.col("status").alias("difference_type")) for x in (tables(spark, sf), schemas(spark, sf)))
    return hs.per_difference_type(t, s)


@check(
    "H6_latest_graded",
    H
    + """SELECT comparison_id, source_table, target_table, start_time, match_rate, CASE WHEN match_rate >= 99.5 THEN 'Excellent' WHEN match_rate >= 95 THEN 'Good'
      WHEN match_rate >= 90 THEN 'Fair' ELSE 'Poor' END AS match_quality FROM h ORDER BY start_time DESC, comparison_id LIMIT 100""",
)
def latest(spark, sf):
    return hs.latest_graded(tables(spark, sf))


@check(
    "H7_export",
    H
    + """SELECT comparison_id, 'table' AS comparison_type, source_table, target_table, status, start_time, execution_time_seconds, rows_different, rows_compared, created_at FROM h
    UNION ALL SELECT comparison_id, 'schema', source_schema, target_schema, status, start_time, execution_time_seconds, total_differences, NULL, created_at FROM s""",
)
def export(spark, sf):
    return hs.export_history(tables(spark, sf), schemas(spark, sf))


@check(
    "H8_fail_stuck",
    H
    + """SELECT comparison_id, CASE WHEN status IN ('running', 'pending') AND created_at < TIMESTAMP '1999-01-01' - INTERVAL 48 HOUR THEN 'failed' ELSE status END AS status,
    CASE WHEN status IN ('running', 'pending') AND created_at < TIMESTAMP '1999-01-01' - INTERVAL 48 HOUR THEN concat('no end within the allowed hours, last seen ', status) END AS error_message
    FROM h""",
)
def stuck(spark, sf):
    return hs.fail_stuck(tables(spark, sf), datetime(1999, 1, 1), 48).select("comparison_id", "status", "error_message")


@check(
    "H9_metric_rollup",
    f"""WITH m AS ({sql(METRICS, 'events')})
    SELECT metric_name, count(*) AS n, round(avg(metric_value), 2) AS avg, round(min(metric_value), 2) AS min, round(max(metric_value), 2) AS max,
      round(arg_max(metric_value, recorded_at), 2) AS last FROM m WHERE recorded_at >= TIMESTAMP '2024-01-10' GROUP BY metric_name""",
)
def metric_rollup(spark, sf):
    return hs.metric_rollup(derive(spark, sf, "events", METRICS), datetime(2024, 1, 10))


@check(
    "H9_success_rate",
    H
    + """SELECT total, successful, round(successful / total * 100, 4) AS success_rate, CASE WHEN total = successful THEN 'healthy'
      WHEN (total - successful) / total * 100 < 10 THEN 'warning' ELSE 'unhealthy' END AS health
    FROM (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS successful FROM h)""",
)
def success(spark, sf):
    return hs.success_rate(tables(spark, sf))


CHECK_TICKS = """SELECT event_type AS rule, date_trunc('HOUR', ts) AS checked_at, CAST(max(value) > 150 AS BOOLEAN) AS fires
FROM {t} GROUP BY event_type, date_trunc('HOUR', ts)"""


@check(
    "H10_cooldown",
    f"""WITH RECURSIVE c AS ({sql(CHECK_TICKS, 'events')}), d AS (SELECT rule, CAST(checked_at AS TIMESTAMP) AS t FROM c WHERE fires),
    f AS (SELECT rule, min(t) AS t FROM d GROUP BY rule
      UNION ALL SELECT f.rule, (SELECT min(d.t) FROM d WHERE d.rule = f.rule AND d.t >= f.t + INTERVAL 5 HOUR) FROM f WHERE f.t IS NOT NULL)
    SELECT rule, t AS fired_at FROM f WHERE t IS NOT NULL""",
)
def cooldown(spark, sf):
    return hs.fired_alerts(derive(spark, sf, "events", CHECK_TICKS), 5 * 3600)


@check(
    "H11_quality_trend",
    H
    + """, t AS (SELECT *, lag(match_rate) OVER (PARTITION BY source_table, target_table ORDER BY start_time, comparison_id) AS previous_rate
      FROM h WHERE status = 'completed')
    SELECT comparison_id, source_table, target_table, match_rate, previous_rate, CASE WHEN previous_rate IS NULL THEN 'first'
      WHEN match_rate > previous_rate THEN 'improving' WHEN match_rate < previous_rate THEN 'degrading' ELSE 'stable' END AS trend FROM t""",
)
def trend(spark, sf):
    return hs.quality_trend(tables(spark, sf))


@check(
    "S12_retention",
    H + "SELECT comparison_id, status FROM h WHERE NOT (created_at < TIMESTAMP '2000-01-01' - INTERVAL 365 DAY)",
)
def retention(spark, sf):
    h = tables(spark, sf)
    gone = hs.doomed(h, now=datetime(2000, 1, 1), days=365)
    return hs.without(h, gone).select("comparison_id", "status")


@check("S12_retention_failed", H + "SELECT comparison_id, status FROM h WHERE status <> 'failed'")
def retention_failed(spark, sf):
    h = tables(spark, sf)
    return hs.without(h, hs.doomed(h, failed=True)).select("comparison_id", "status")


@check(
    "S12_clear",
    H
    + """, k AS (SELECT * FROM h WHERE status <> 'failed' AND NOT (created_at < TIMESTAMP '2000-01-01' - INTERVAL 365 DAY))
    SELECT 'comparison_summary' AS stored, comparison_id, status FROM k
    UNION ALL SELECT 'performance_metrics', comparison_id, status FROM k""",
)
def clear(spark, sf):
    """Failed and old runs leave the store with all they stored; compaction keeps what stands."""
    h = tables(spark, sf)
    store = ResultStore(spark, scratch_path(spark, "store"))
    store.save("comparison_summary", None, h)
    store.save("performance_metrics", None, h.select("comparison_id", F.lit("status").alias("metric_name"), F.col("status").alias("metric_unit")))
    store.clear(kind="table", failed=True)
    store.clear(kind="table", now=datetime(2000, 1, 1), days=365)
    store.compact(("comparison_summary", "performance_metrics"))
    kept = store.read("comparison_summary").select(F.lit("comparison_summary").alias("stored"), "comparison_id", "status")
    metrics = store.read("performance_metrics").select(F.lit("performance_metrics"), "comparison_id", "metric_unit")
    return kept.union(metrics)

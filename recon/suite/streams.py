"""Checks: streaming runs, whose final state equals the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from recon.operators.joindiff import compare_by_key
from recon.plans.lineage import scratch_path
from recon.streaming.cooldown import fire_with_cooldown
from recon.streaming.running import run_latest, run_to_files, running_counts, windowed_match_rate
from recon.suite.differences import EVENT_PAIR, event_sides
from recon.suite.history import CHECK_TICKS
from recon.suite.inputs import derive, sql
from recon.suite.registry import check


def _stream_of(spark, df, name):
    """The rows of a frame as a file stream."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


KIND = "CASE WHEN b.event_id IS NULL THEN 'missing_in_target' WHEN a.event_id IS NULL THEN 'missing_in_source' ELSE 'value_different' END"


@check(
    "ST1_running_counts",
    EVENT_PAIR
    + f"""SELECT {KIND} AS difference_type, count(*) AS n FROM a FULL OUTER JOIN b ON a.event_id = b.event_id
    WHERE a.event_id IS NULL OR b.event_id IS NULL OR a.value IS DISTINCT FROM b.value GROUP BY 1""",
)
def running(spark, sf):
    from recon.operators.grading import typed_differences

    differences = typed_differences(compare_by_key(*event_sides(spark, sf, ["value"]))).select("event_id", "difference_type")
    out = scratch_path(spark, "counts")
    run_latest(running_counts(_stream_of(spark, differences, "differences")), out, scratch_path(spark, "checkpoint"))
    return spark.read.parquet(out)


@check(
    "ST2_windowed_match_rate",
    EVENT_PAIR
    + """, m AS (SELECT a.ts, a.value IS DISTINCT FROM b.value AS d FROM a JOIN b ON a.event_id = b.event_id),
    w AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, count(*) AS total_rows, count(*) FILTER (WHERE d) AS differences FROM m GROUP BY 1)
    SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, total_rows, differences, 1 - differences / total_rows AS match_rate FROM w
    WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM m) - INTERVAL 2 HOUR""",
)
def windowed(spark, sf):
    c = compare_by_key(*event_sides(spark, sf, ["value", "ts"]))
    value = [p[0] for p in c.pairs].index("value")
    at = [p[0] for p in c.pairs].index("ts")
    rows = c.matched.where(c.in_both()).select(F.col(f"a{at}").alias("ts"), c.differs(value).alias("is_different"))
    stream = _stream_of(spark, rows, "compared")
    out = scratch_path(spark, "windows")
    run_to_files(windowed_match_rate(stream, "ts", window="1 day", lag="2 hours"), out, scratch_path(spark, "checkpoint"))
    return spark.read.parquet(out)


@check(
    "ST3_cooldown",
    f"""WITH RECURSIVE c AS ({sql(CHECK_TICKS, 'events')}), d AS (SELECT rule, CAST(checked_at AS TIMESTAMP) AS t FROM c WHERE fires),
    f AS (SELECT rule, min(t) AS t FROM d GROUP BY rule
      UNION ALL SELECT f.rule, (SELECT min(d.t) FROM d WHERE d.rule = f.rule AND d.t >= f.t + INTERVAL 7 HOUR) FROM f WHERE f.t IS NOT NULL)
    SELECT rule, t AS fired_at FROM f WHERE t IS NOT NULL""",
)
def cooldown(spark, sf):
    ticks = derive(spark, sf, "events", CHECK_TICKS)
    out = scratch_path(spark, "fired")
    run_to_files(fire_with_cooldown(_stream_of(spark, ticks, "ticks"), 7 * 3600), out, scratch_path(spark, "checkpoint"))
    return spark.read.parquet(out).select("rule", F.col("fired_at").cast("timestamp_ntz").alias("fired_at"))

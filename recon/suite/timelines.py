"""Checks: timelines and samples."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from recon.operators import sampling as sp
from recon.operators import timeline as tl
from recon.operators.joindiff import compare_by_key
from recon.plans.compare import Options, compare
from recon.suite.differences import EVENT_PAIR, event_sides
from recon.suite.inputs import EVENTS_A, derive, table
from recon.suite.matching import MATCHED, compared, sides
from recon.suite.registry import check

# Width in seconds by the range of the table, as a CASE chain.
WIDTH = """CASE WHEN ideal < 60 THEN 60 WHEN ideal < 3600 THEN greatest(5, floor(ideal / 60 / 5) * 5) * 60
  WHEN ideal < 86400 THEN floor(ideal / 3600) * 3600 WHEN ideal < 604800 THEN floor(ideal / 86400) * 86400
  WHEN ideal < 2592000 THEN 604800 WHEN ideal < 31536000 THEN 2592000 ELSE 31536000 END"""


def buckets_sql(target: int) -> str:
    return f"""r AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM a),
    w AS (SELECT lo, hi, CAST({WIDTH} AS BIGINT) * 1000000 AS w FROM (SELECT *, (hi - lo) / 1000000.0 / {target} AS ideal FROM r)),
    n AS (SELECT *, CAST(ceil((hi - lo) / w) AS BIGINT) AS n FROM w),
    k AS (SELECT bucket, lo + bucket * w AS s, least(lo + (bucket + 1) * w, hi) AS e, w FROM n, range(0, 100000) t(bucket) WHERE bucket < n) """


@check("L1_bucket_width", EVENT_PAIR + "," + buckets_sql(20) + "SELECT w // 1000000 AS width_seconds, n AS buckets FROM n")
def bucket_width(spark, sf):
    b = tl.make_buckets(derive(spark, sf, "events", EVENTS_A), "ts")
    rows = derive(spark, sf, "events", EVENTS_A)
    return rows.agg(
        F.lit(int(b.width.total_seconds())).cast("bigint").alias("width_seconds"),
        (F.max(b.number(F.col("ts"))) + 1).alias("buckets"),
    )


BUCKET_LABEL = """CASE WHEN w >= 31536000000000 THEN strftime(make_timestamp(s), '%Y') WHEN w >= 2419200000000 THEN strftime(make_timestamp(s), '%Y-%m')
  WHEN w >= 86400000000 THEN strftime(make_timestamp(s), '%Y-%m-%d') WHEN w >= 3600000000 THEN strftime(make_timestamp(s), '%Y-%m-%d %H:00')
  ELSE strftime(make_timestamp(s), '%Y-%m-%d %H:%M') END"""


@check(
    "L2_buckets",
    EVENT_PAIR + "," + buckets_sql(200) + f"SELECT bucket, make_timestamp(s) AS bucket_start, make_timestamp(e) AS bucket_end, {BUCKET_LABEL} AS label FROM k",
)
def buckets(spark, sf):
    return tl.make_buckets(derive(spark, sf, "events", EVENTS_A), "ts", 200).frame(spark)


for unit, width in (("hour", timedelta(hours=3)), ("day", timedelta(days=1)), ("month", timedelta(days=30)), ("year", timedelta(days=365))):

    @check(
        f"L3_histogram_{unit}",
        f"""SELECT CAST(date_trunc('{unit}', o_orderdate) AS TIMESTAMP) AS time_bucket, count(*) AS n_rows, min(o_orderdate) AS min_time,
        max(o_orderdate) AS max_time FROM orders GROUP BY 1""",
    )
    def histogram(spark, sf, width=width):
        return tl.histogram(table(spark, sf, "orders"), "o_orderdate", width)


TIMELINE = (
    EVENT_PAIR
    + ","
    + buckets_sql(20)
    + """, m AS (SELECT a.event_id AS ia, b.event_id AS ib, epoch_us(a.ts) AS ta, epoch_us(b.ts) AS tb,
      a.value IS DISTINCT FROM b.value OR a.ts IS DISTINCT FROM b.ts AS d FROM a FULL OUTER JOIN b ON a.event_id = b.event_id),
    p AS (SELECT *, CASE WHEN ta BETWEEN lo AND hi THEN least((ta - lo) // w, n - 1) END AS ba,
      CASE WHEN tb BETWEEN lo AND hi THEN least((tb - lo) // w, n - 1) END AS bb FROM m, n),
    q AS (SELECT ba AS bucket, 'a' AS kind FROM p UNION ALL SELECT bb, 'b' FROM p
      UNION ALL SELECT coalesce(ba, bb), CASE WHEN ib IS NULL THEN 't' WHEN ia IS NULL THEN 's' WHEN d THEN 'v' END FROM p),
    g AS (SELECT bucket, count(*) FILTER (WHERE kind = 'a') AS rows_a, count(*) FILTER (WHERE kind = 'b') AS rows_b,
      count(*) FILTER (WHERE kind = 't') AS missing_in_target, count(*) FILTER (WHERE kind = 's') AS missing_in_source,
      count(*) FILTER (WHERE kind = 'v') AS value_differences FROM q WHERE bucket IS NOT NULL GROUP BY bucket),
    """
    + f"""t AS (SELECT k.bucket, make_timestamp(s) AS bucket_start, make_timestamp(e) AS bucket_end, {BUCKET_LABEL} AS label,
      coalesce(rows_a, 0) AS rows_a, coalesce(rows_b, 0) AS rows_b, coalesce(missing_in_target, 0) AS missing_in_target,
      coalesce(missing_in_source, 0) AS missing_in_source, coalesce(value_differences, 0) AS value_differences,
      greatest(coalesce(rows_a, 0), coalesce(rows_b, 0)) AS total_rows,
      coalesce(missing_in_target, 0) + coalesce(missing_in_source, 0) + coalesce(value_differences, 0) AS differences
      FROM k LEFT JOIN g ON k.bucket = g.bucket),
    tt AS (SELECT *, CASE WHEN total_rows > 0 THEN 1 - differences / total_rows ELSE 1.0::DOUBLE END AS match_rate FROM t) """
)


def timeline_of(spark, sf, target=20):
    a, b = event_sides(spark, sf, ["value", "ts"])
    return tl.timeline(compare_by_key(a, b), "ts", tl.make_buckets(a.df, "ts", target))


@check("L4_timeline", TIMELINE + "SELECT * FROM tt")
def timeline(spark, sf):
    return timeline_of(spark, sf)


@check(
    "L5_report",
    TIMELINE
    + """SELECT count(*) AS total_time_periods, round(avg(match_rate) * 100, 2) AS average_match_rate, min(bucket_start) AS range_start,
    max(bucket_end) AS range_end FROM tt""",
)
def report(spark, sf):
    return tl.report(timeline_of(spark, sf))


@check(
    "L5_worst_periods",
    TIMELINE + "SELECT label, bucket_start, round(match_rate * 100, 2) AS match_rate, differences FROM tt ORDER BY tt.match_rate, bucket_start LIMIT 5",
)
def worst(spark, sf):
    return tl.worst_periods(timeline_of(spark, sf))


@check(
    "L6_patterns",
    TIMELINE
    + """, i AS (SELECT *, row_number() OVER (ORDER BY bucket_start) AS i, row_number() OVER (ORDER BY bucket_start DESC) AS z, count(*) OVER () AS n FROM tt),
    tr AS (SELECT avg(match_rate) FILTER (WHERE z <= 3) AS recent,
      avg(match_rate) FILTER (WHERE CASE WHEN n >= 6 THEN z BETWEEN 4 AND 6 ELSE i <= 3 END) AS older, count(*) AS n FROM i HAVING count(*) >= 3),
    lo AS (SELECT i, i - lag(i) OVER (ORDER BY i) AS gap FROM i WHERE match_rate < 0.9),
    f AS (SELECT gap AS first_gap FROM lo WHERE gap IS NOT NULL ORDER BY i LIMIT 1)
    SELECT CASE WHEN recent > older THEN 'improving_quality' ELSE 'degrading_quality' END AS pattern,
      CASE WHEN abs(recent - older) > 0.1 THEN 'high' ELSE 'medium' END AS confidence, n FROM tr WHERE abs(recent - older) > 0.05
    UNION ALL SELECT 'periodic_issues', 'medium', first_gap FROM f WHERE (SELECT bool_and(abs(gap - first_gap) <= 1) FROM lo WHERE gap IS NOT NULL)
    UNION ALL SELECT 'data_gaps', NULL, count(*) FROM tt WHERE total_rows = 0 HAVING count(*) > 0""",
)
def patterns(spark, sf):
    return tl.patterns(timeline_of(spark, sf))


@check(
    "L7_labels",
    """SELECT event_id, strftime(ts, '%Y') AS by_year, strftime(ts, '%Y-%m') AS by_month, strftime(ts, '%Y-%m-%d') AS by_day,
    strftime(ts, '%Y-%m-%d %H:00') AS by_hour, strftime(ts, '%Y-%m-%d %H:%M') AS by_minute FROM events""",
)
def labels(spark, sf):
    widths = {"year": timedelta(days=365), "month": timedelta(days=30), "day": timedelta(days=7), "hour": timedelta(hours=2), "minute": timedelta(minutes=5)}
    shown = [F.date_format("ts", tl.label_layout(w)).alias(f"by_{n}") for n, w in widths.items()]
    return table(spark, sf, "events").select("event_id", *shown)


SHARE = "('0x' || substr(md5(concat('42|', CAST(o_orderkey AS VARCHAR))), 21, 12))::BIGINT / 281474976710656::DOUBLE"


@check("M1_percent_sample", f"SELECT * FROM orders WHERE {SHARE} < 0.1")
def percent_sample(spark, sf):
    return sp.percent_sample(table(spark, sf, "orders"), 10.0, ["o_orderkey"])


@check("M2_fixed_sample", "SELECT * FROM orders ORDER BY md5(concat('42|', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 100")
def fixed_sample(spark, sf):
    return sp.fixed_sample(table(spark, sf, "orders"), 100, ["o_orderkey"])


@check("M2_hashed_sample", "SELECT * FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100")
def hashed_sample(spark, sf):
    return sp.hashed_sample(table(spark, sf, "orders"), ["o_orderkey"], 100)


@check("M3_key_sample", "SELECT * FROM orders WHERE o_orderkey % 10 = 0")
def key_sample(spark, sf):
    return sp.key_sample(table(spark, sf, "orders"), ["o_orderkey"], sp.modulus(percent=10))


@check(
    "M3_compound_key_sample",
    """SELECT conv_id, turn, role FROM conversations
    WHERE ('0x' || substr(md5(concat(CAST(conv_id AS VARCHAR), '|', CAST(turn AS VARCHAR))), 21, 12))::BIGINT % 3 = 0""",
)
def compound_key_sample(spark, sf):
    return sp.key_sample(table(spark, sf, "conversations"), ["conv_id", "turn"], sp.modulus(percent=30)).select("conv_id", "turn", "role")


@check(
    "M4_sample_size",
    """WITH n AS (SELECT 'lineitem' AS name, count(*) AS n_rows FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders
      UNION ALL SELECT 'events', count(*) FROM events)
    SELECT name, n_rows, CAST(ceil(9604 / (1 + 9603 / n_rows)) AS BIGINT) AS at_one_percent,
      CAST(ceil(385 / (1 + 384 / n_rows)) AS BIGINT) AS at_five_percent FROM n""",
)
def sample_size(spark, sf):
    out = None
    for name in ("lineitem", "orders", "events"):
        t = table(spark, sf, name)
        n = t.count()
        one = t.agg(
            F.lit(name).alias("name"),
            F.count(F.lit(1)).alias("n_rows"),
            F.lit(sp.sample_size(n)).cast("bigint").alias("at_one_percent"),
            F.lit(sp.sample_size(n, margin=0.05)).cast("bigint").alias("at_five_percent"),
        )
        out = one if out is None else out.unionByName(one)
    return out


INFERENCE = (
    MATCHED
    + """, s AS (SELECT count(*) FILTER (WHERE coalesce(a0, b0) % 10 = 0 AND d0 + d1 + d2 > 0) AS k,
      greatest(count(*) FILTER (WHERE a0 % 10 = 0), count(*) FILTER (WHERE b0 % 10 = 0)) AS n, greatest(count(a0), count(b0)) AS total FROM f),
    p AS (SELECT *, k / n AS p, sqrt(k / n * (1 - k / n) / n) AS se FROM s)
    SELECT k AS sample_differences, n AS sample_size, total AS population_size, round(p, 9) AS sample_proportion, round(se, 9) AS standard_error,
      round(1.96 * se, 9) AS margin_of_error, round(greatest(0, p - 1.96 * se), 9) AS ci_low, round(least(1, p + 1.96 * se), 9) AS ci_high,
      CAST(floor(p * total) AS BIGINT) AS estimated_differences, CAST(floor(greatest(0, p - 1.96 * se) * total) AS BIGINT) AS estimated_low,
      CAST(floor(least(1, p + 1.96 * se) * total) AS BIGINT) AS estimated_high, round(total / n, 9) AS extrapolation_factor FROM p"""
)


@check("M5_inference", INFERENCE)
def inference(spark, sf):
    c = compared(spark, sf)
    kept = F.pmod(F.coalesce("a0", "b0"), F.lit(10)) == 0
    counts = c.matched.agg(
        F.count_if(kept & c.is_different()).alias("sample_differences"),
        F.greatest(F.count_if(kept & F.col("in_a")), F.count_if(kept & F.col("in_b"))).alias("sample_size"),
        F.greatest(F.count("in_a"), F.count("in_b")).alias("population_size"),
    )
    out = sp.infer(counts)
    real = ["sample_proportion", "standard_error", "margin_of_error", "ci_low", "ci_high", "extrapolation_factor"]
    return out.withColumns({r: F.round(r, 9) for r in real})


@check("M5_sampled_compare", INFERENCE)
def sampled_compare(spark, sf):
    """The inference that a sampled comparison carries."""
    out = compare(*sides(spark, sf), Options(assume_unique_key=True, sample_percent=10)).inference
    real = ["sample_proportion", "standard_error", "margin_of_error", "ci_low", "ci_high", "extrapolation_factor"]
    return out.withColumns({r: F.round(r, 9) for r in real})


@check(
    "M6_systematic",
    """SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS rn FROM conversations) WHERE rn % 7 = 0""",
)
def systematic(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return sp.systematic_sample(t, ["conv_id", "turn"], 7)


@check(
    "M7_stratified",
    f"SELECT * FROM orders WHERE {SHARE} < CASE o_orderstatus WHEN 'F' THEN 0.1 WHEN 'O' THEN 0.2 WHEN 'P' THEN 0.5 ELSE 0 END",
)
def stratified(spark, sf):
    shares = {"F": 0.1, "O": 0.2, "P": 0.5}
    return sp.stratified_sample(table(spark, sf, "orders"), "o_orderstatus", shares, ["o_orderkey"])


@check(
    "M7_stratified_fixed",
    """SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS r FROM events)
    WHERE r <= 15""",
)
def stratified_fixed(spark, sf):
    return sp.stratified_fixed(table(spark, sf, "events"), "event_type", ["event_id"], 15).select("event_id", "event_type")

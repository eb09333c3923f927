"""Checks: counts, rates, grades, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from recon.operators import grading as gr
from recon.operators.joindiff import side_stats, with_scores
from recon.suite.differences import COUNTS
from recon.suite.inputs import HISTORY, ORDERS_A, ORDERS_B, derive, sql
from recon.suite.matching import MATCHED, compared, sides
from recon.suite.registry import check

S = MATCHED + f", s AS (SELECT {COUNTS} FROM f), t AS (SELECT *, greatest(\"rows_A\", \"rows_B\") AS larger FROM s) "


@check(
    "A2_side_stats",
    f"""WITH a AS ({sql(ORDERS_A, 'orders')}), b AS ({sql(ORDERS_B, 'orders')})
    SELECT 'a' AS side, count(*) AS count, CAST(sum(o_totalprice) AS DOUBLE) AS sum_o_totalprice, CAST(sum(o_custkey) AS DOUBLE) AS sum_o_custkey FROM a
    UNION ALL SELECT 'b', count(*), CAST(sum(o_totalprice) AS DOUBLE), CAST(sum(o_custkey) AS DOUBLE) FROM b""",
)
def stats_of_sides(spark, sf):
    a, b = sides(spark, sf, ["o_totalprice", "o_custkey", "o_orderstatus"])
    return side_stats(a).withColumn("side", F.lit("a")).unionByName(side_stats(b).withColumn("side", F.lit("b")))


@check(
    "A3_diff_stats",
    S
    + """SELECT "rows_A", "rows_B", "exclusive_A", "exclusive_B", updated, unchanged, total, total AS diff_keys, total + updated AS diff_rows,
    1 - CAST(unchanged AS DOUBLE) / larger AS diff_percent, 1 - CAST(total AS DOUBLE) / larger AS match_rate,
    1 - CAST(total + updated AS DOUBLE) / larger AS legacy_match_rate FROM t""",
)
def diff_stats(spark, sf):
    return compared(spark, sf).diff_stats()


@check("A4_stats_dictionary", S + "SELECT \"rows_A\", \"rows_B\", \"exclusive_A\", \"exclusive_B\", updated, unchanged, total FROM s")
def stats(spark, sf):
    return compared(spark, sf).stats()


@check(
    "A5_column_counts",
    MATCHED
    + """SELECT 'o_orderkey' AS column_name, CAST(sum(d0) AS BIGINT) AS diff_count, CAST(0 AS BIGINT) AS values_changed FROM f
    UNION ALL SELECT 'o_totalprice', CAST(sum(d1) AS BIGINT), count(*) FILTER (WHERE NOT xa AND NOT xb AND d1 = 1) FROM f
    UNION ALL SELECT 'o_orderstatus', CAST(sum(d2) AS BIGINT), count(*) FILTER (WHERE NOT xa AND NOT xb AND d2 = 1) FROM f""",
)
def column_counts(spark, sf):
    return compared(spark, sf).column_counts()


@check(
    "A10_rating",
    S
    + """, r AS (SELECT 1 - CAST(total AS DOUBLE) / larger AS rate FROM t)
    SELECT round(rate * 100, 2) AS match_percentage, CASE WHEN rate > 0.95 THEN 'Good' WHEN rate > 0.8 THEN 'Fair' ELSE 'Poor' END AS rating,
      'Failed' AS rating_with_ignored FROM r""",
)
def rating(spark, sf):
    s = compared(spark, sf).diff_stats()
    good = gr.rated(s).withColumnRenamed("rating", "usual")
    both = gr.rated(good, ignored_compared_columns=1)
    return both.select("match_percentage", F.col("usual").alias("rating"), F.col("rating").alias("rating_with_ignored"))


GRADES = {
    "letters": "CASE WHEN r >= 0.99 THEN 'A' WHEN r >= 0.95 THEN 'B' WHEN r >= 0.9 THEN 'C' ELSE 'D' END",
    "report": "CASE WHEN r >= 0.99 THEN 'Excellent' WHEN r >= 0.95 THEN 'Good' WHEN r >= 0.9 THEN 'Fair' ELSE 'Poor' END",
    "history": "CASE WHEN r >= 0.995 THEN 'Excellent' WHEN r >= 0.95 THEN 'Good' WHEN r >= 0.9 THEN 'Fair' ELSE 'Poor' END",
    "service": "CASE WHEN r > 0.95 THEN 'Good' WHEN r > 0.8 THEN 'Fair' ELSE 'Poor' END",
}


@check(
    "A11_grade_scales",
    f"""WITH h AS ({sql(HISTORY, 'orders')}), r AS (SELECT comparison_id, match_rate / 100 AS r FROM h)
    SELECT comparison_id, {', '.join(f'{text} AS {name}' for name, text in GRADES.items())} FROM r""",
)
def grade_scales(spark, sf):
    rate = F.col("match_rate") / 100
    return derive(spark, sf, "orders", HISTORY).select("comparison_id", *[gr.grade(rate, s).alias(s) for s in GRADES])


@check(
    "A12_completeness",
    S + 'SELECT round(CAST(least("rows_A", "rows_B") AS DOUBLE) / larger * 100, 2) AS completeness FROM t',
)
def completeness(spark, sf):
    return compared(spark, sf).stats().select(gr.completeness(F.col("rows_A"), F.col("rows_B")).alias("completeness"))


@check(
    "A13_breakdown",
    S
    + """SELECT 'missing_in_target' AS difference_type, "exclusive_A" AS n, round(CAST("exclusive_A" AS DOUBLE) / larger * 100, 2) AS percentage FROM t
    UNION ALL SELECT 'missing_in_source', "exclusive_B", round(CAST("exclusive_B" AS DOUBLE) / larger * 100, 2) FROM t
    UNION ALL SELECT 'value_different', updated, round(CAST(updated AS DOUBLE) / larger * 100, 2) FROM t""",
)
def breakdown(spark, sf):
    return gr.difference_breakdown(compared(spark, sf).stats())


@check(
    "A13_typed_differences",
    MATCHED
    + """SELECT coalesce(a0, b0) AS o_orderkey, CASE WHEN xa THEN 'missing_in_target' WHEN xb THEN 'missing_in_source' ELSE 'value_different' END
      AS difference_type, CASE WHEN xa OR xb THEN '' ELSE concat_ws(',', CASE WHEN d1 = 1 THEN 'o_totalprice' END, CASE WHEN d2 = 1 THEN 'o_orderstatus' END) END AS columns
    FROM f WHERE d0 + d1 + d2 > 0""",
)
def typed(spark, sf):
    d = gr.typed_differences(compared(spark, sf))
    return d.select("o_orderkey", "difference_type", F.concat_ws(",", "differing_columns").alias("columns"))


@check(
    "A15_alerts",
    S
    + """, r AS (SELECT *, 1 - CAST(total AS DOUBLE) / larger AS rate, CAST(total AS DOUBLE) / larger AS gap FROM t)
    SELECT 'warning' AS alert_type, CASE WHEN rate < 0.9 THEN 'high' ELSE 'medium' END AS severity, 'match_rate' AS metric, rate AS value, 0.98::DOUBLE AS threshold
      FROM r WHERE rate < 0.98
    UNION ALL SELECT 'warning', CASE WHEN gap > 0.1 THEN 'high' ELSE 'medium' END, 'difference_rate', gap, 0.02::DOUBLE FROM r WHERE gap > 0.02
    UNION ALL SELECT 'error', 'high', 'missing_rows', CAST("exclusive_A" AS DOUBLE), 10::DOUBLE FROM r WHERE "exclusive_A" > 10""",
)
def alert_rows(spark, sf):
    return gr.alerts(
        compared(spark, sf).diff_stats(), {"min_match_rate": 0.98, "max_difference_rate": 0.02, "max_missing_rows": 10}
    )


@check(
    "A16_filter_types",
    MATCHED
    + """SELECT coalesce(a0, b0) AS o_orderkey, CASE WHEN xa THEN 'missing_in_target' ELSE 'missing_in_source' END AS difference_type
    FROM f WHERE xa OR xb""",
)
def filter_types(spark, sf):
    d = gr.typed_differences(compared(spark, sf))
    return gr.pick_fields(
        gr.filter_types(d, ["missing_in_target", "missing_in_source"]), ["o_orderkey", "difference_type", "unknown"]
    )


@check(
    "A17_throughput",
    f"""WITH h AS ({sql(HISTORY, 'orders')})
    SELECT comparison_id, CAST(round(CAST(rows_compared / greatest(execution_time_seconds, 1) AS DECIMAL(38,6)), 2) AS DOUBLE) AS rows_per_second FROM h""",
)
def throughput(spark, sf):
    return derive(spark, sf, "orders", HISTORY).select(
        "comparison_id", gr.throughput(F.col("rows_compared"), F.col("execution_time_seconds")).alias("rows_per_second")
    )


@check(
    "Q4_advice",
    S
    + """SELECT concat("exclusive_A", ' rows did not arrive in the target: look for a failed or filtered load') AS recommendation FROM t WHERE "exclusive_A" > 0
    UNION ALL SELECT concat("exclusive_B", ' rows are in the target alone: look for missed deletes or double loads') FROM t WHERE "exclusive_B" > 0
    UNION ALL SELECT concat(updated, ' keys carry other values: start with the columns that differ most') FROM t WHERE updated > 0
    UNION ALL SELECT 'under 95 % of the keys agree: check the load before it is published' FROM t WHERE 1 - CAST(total AS DOUBLE) / larger < 0.95
    UNION ALL SELECT 'under 90 % of the keys agree: rebuild the target from its source' FROM t WHERE 1 - CAST(total AS DOUBLE) / larger < 0.9""",
)
def advice(spark, sf):
    return gr.advice(with_scores(compared(spark, sf).stats()))

"""Checks: column profiles and the classification of differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from recon.operators import classify as cl
from recon.operators import profile as pf
from recon.operators.hashdiff import key_counts
from recon.operators.joindiff import compare_by_key
from recon.plans.compare import Options, compare
from recon.plans.lineage import scratch_path
from recon.sources.side import side
from recon.suite.differences import EVENT_PAIR, event_sides
from recon.suite.inputs import EVENTS_A, EVENTS_B, LINES_A, LINES_B, derive, sql
from recon.suite.registry import check


def _number(t: str, c: str, cast: str) -> str:
    return f"""SELECT '{c}' AS column_name, count(*) AS total_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count,
      CAST(CAST(min({c}) AS {cast}) AS VARCHAR) AS min_value, CAST(CAST(max({c}) AS {cast}) AS VARCHAR) AS max_value,
      round(avg(CAST({c} AS DOUBLE)), 4) AS avg_value, CAST(NULL AS DOUBLE) AS avg_length,
      round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50,
      round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75 FROM {t}"""


def _text(t: str, c: str) -> str:
    return f"""SELECT '{c}', count(*), count(*) - count({c}), count(DISTINCT {c}), NULL, NULL, NULL, round(avg(length({c})), 4), NULL, NULL, NULL FROM {t}"""


def _time(t: str, c: str) -> str:
    return f"""SELECT '{c}', count(*), count(*) - count({c}), count(DISTINCT {c}), strftime(min({c}), '%Y-%m-%d %H:%M:%S.%f'),
      strftime(max({c}), '%Y-%m-%d %H:%M:%S.%f'), NULL, NULL, NULL, NULL, NULL FROM {t}"""


def profile_sql(t: str) -> str:
    return " UNION ALL ".join(
        [_number(t, "user_id", "BIGINT"), _number(t, "value", "DECIMAL(38,2)"), _text(t, "event_type"), _text(t, "props"), _time(t, "ts")]
    )


COLUMNS = ["user_id", "value", "event_type", "props", "ts"]


def profiled(spark, sf, text):
    return pf.column_profile(derive(spark, sf, "events", text), COLUMNS)


SHOWN = "column_name, total_count, null_count, unique_count, min_value, max_value, avg_value, avg_length, p25, p50, p75"
RATES = """CASE WHEN total_count > 0 THEN null_count / total_count * 100 ELSE 0 END AS null_rate,
  CASE WHEN total_count > 0 THEN unique_count / total_count ELSE 0 END AS cardinality"""


@check("A6_column_profile", EVENT_PAIR + profile_sql("b"))
def column_profile(spark, sf):
    p = profiled(spark, sf, EVENTS_B)
    rounded = {c: F.round(c, 4) for c in ("avg_value", "avg_length")} | {c: F.round(c, 6) for c in ("p25", "p50", "p75")}
    return p.withColumns(rounded).select(*[c.strip() for c in SHOWN.split(",")])


@check(
    "A7_rates",
    EVENT_PAIR + f", p AS ({profile_sql('b')}) SELECT column_name, round(null_rate, 6) AS null_rate, round(cardinality, 6) AS cardinality FROM (SELECT *, {RATES} FROM p)",
)
def rates(spark, sf):
    p = profiled(spark, sf, EVENTS_B)
    return p.select("column_name", F.round("null_rate", 6).alias("null_rate"), F.round("cardinality", 6).alias("cardinality"))


@check(
    "A8_value_distribution",
    EVENT_PAIR + "SELECT user_id AS value, count(*) AS n FROM b GROUP BY user_id ORDER BY n DESC, value NULLS LAST LIMIT 100",
)
def value_distribution(spark, sf):
    return pf.value_distribution(derive(spark, sf, "events", EVENTS_B), "user_id")


@check(
    "A8_folded_distribution",
    EVENT_PAIR
    + """, d AS (SELECT user_id AS value, count(*) AS n FROM b GROUP BY user_id),
    r AS (SELECT CAST(row_number() OVER (ORDER BY n DESC, value NULLS LAST) AS INTEGER) AS rank, value, n, count(*) OVER () AS total_unique_values FROM d)
    SELECT * FROM r WHERE rank <= 20""",
)
def folded_distribution(spark, sf):
    return pf.folded_distribution(derive(spark, sf, "events", EVENTS_B), "user_id")


COMPARE = (
    EVENT_PAIR
    + f""", pa AS (SELECT *, {RATES} FROM ({profile_sql('a')})), pb AS (SELECT *, {RATES} FROM ({profile_sql('b')})),
    c AS (SELECT pa.column_name, abs(pa.null_rate - pb.null_rate) AS ng, abs(pa.cardinality - pb.cardinality) AS cg,
      abs(pa.avg_value - pb.avg_value) / greatest(abs(pa.avg_value), 0.0001) * 100 AS ag,
      pa.min_value AS mina, pb.min_value AS minb, pa.max_value AS maxa, pb.max_value AS maxb
      FROM pa JOIN pb ON pa.column_name = pb.column_name),
    r AS (SELECT column_name, 'common' AS presence, ng > 1 AS null_rate_differs, ng > 10 AS null_rate_warning, cg > 0.1 AS cardinality_differs,
      coalesce(mina <> minb, false) AS min_differs, coalesce(mina IS NOT NULL AND minb IS NOT NULL AND maxa <> maxb, false) AS max_differs,
      coalesce(ag > 5, false) AS avg_differs, round(ng, 2) AS null_rate_gap, round(ag, 2) AS avg_gap_percent FROM c) """
)


@check("A9_compare_profiles", COMPARE + "SELECT * FROM r")
def compare_profiles(spark, sf):
    return pf.compare_profiles(profiled(spark, sf, EVENTS_A), profiled(spark, sf, EVENTS_B))


@check(
    "A9_profile_summary",
    COMPARE
    + """SELECT count(*) AS total_columns, count(*) FILTER (WHERE null_rate_differs OR cardinality_differs OR min_differs OR max_differs OR avg_differs)
      AS columns_with_differences, 0::BIGINT AS missing_columns, 0::BIGINT AS extra_columns, count(*) FILTER (WHERE null_rate_warning) AS warnings FROM r""",
)
def profile_summary(spark, sf):
    return pf.profile_summary(pf.compare_profiles(profiled(spark, sf, EVENTS_A), profiled(spark, sf, EVENTS_B)))


@check(
    "A14_quality_scores",
    EVENT_PAIR
    + f""", p AS (SELECT column_name, 100 - null_rate AS quality_score FROM (SELECT *, {RATES} FROM ({profile_sql('b')})))
    SELECT column_name, round(quality_score, 6) AS quality_score FROM p UNION ALL SELECT '*', round(avg(quality_score), 6) FROM p""",
)
def quality_scores(spark, sf):
    return pf.quality_scores(profiled(spark, sf, EVENTS_B)).withColumn("quality_score", F.round("quality_score", 6))


CELL_COLUMNS = ["value", "event_type", "ts", "props"]
CLASSIFIED = (
    EVENT_PAIR
    + """, m AS (SELECT a.event_id, a.value AS va, b.value AS vb, a.event_type AS ea, b.event_type AS eb, a.ts AS ta, b.ts AS tb, a.props AS pa, b.props AS pb
      FROM a JOIN b ON a.event_id = b.event_id),
    v AS (SELECT event_id, va, vb, abs(CAST(va AS DOUBLE) - CAST(vb AS DOUBLE)) AS gap,
      greatest(abs(CAST(va AS DOUBLE)), abs(CAST(vb AS DOUBLE))) AS larger FROM m WHERE va IS DISTINCT FROM vb),
    c AS (SELECT event_id, 'value' AS column_name,
        CASE WHEN (va IS NULL) <> (vb IS NULL) THEN 'null_mismatch' WHEN gap <= 0.05 THEN 'precision_difference' ELSE 'value_mismatch' END AS difference_type,
        CASE WHEN (va IS NULL) <> (vb IS NULL) THEN 'critical' WHEN gap <= 0.05 THEN 'info'
          WHEN CASE WHEN larger > 0 THEN gap / larger ELSE gap END > 0.1 THEN 'high'
          WHEN CASE WHEN larger > 0 THEN gap / larger ELSE gap END > 0.01 THEN 'medium' ELSE 'low' END AS severity,
        CAST(va AS VARCHAR) AS source_value, CAST(vb AS VARCHAR) AS target_value FROM v
      UNION ALL SELECT event_id, 'event_type', CASE WHEN lower(ea) = lower(eb) THEN 'case_difference' WHEN trim(ea) = trim(eb) THEN 'whitespace_difference'
          ELSE 'value_mismatch' END, CASE WHEN lower(ea) = lower(eb) THEN 'medium' WHEN trim(ea) = trim(eb) THEN 'low' ELSE 'medium' END, ea, eb
        FROM m WHERE ea IS DISTINCT FROM eb
      UNION ALL SELECT event_id, 'ts', 'date_format_difference', 'medium', strftime(ta, '%Y-%m-%d %H:%M:%S.%f'), strftime(tb, '%Y-%m-%d %H:%M:%S.%f')
        FROM m WHERE ta <> tb
      UNION ALL SELECT event_id, 'props', 'value_mismatch', 'medium', pa, pb FROM m WHERE pa <> pb) """
)


def classified(spark, sf):
    c = compare_by_key(*event_sides(spark, sf, CELL_COLUMNS))
    return cl.classify_cells(c, numeric_tolerance=0.05, null_is_critical=True)


@check("Q1_classify_cells", CLASSIFIED + "SELECT * FROM c")
def classify_cells(spark, sf):
    return classified(spark, sf)


@check(
    "Q2_classify_duplicates",
    f"""WITH a AS ({sql(LINES_A, 'lineitem')}), b AS ({sql(LINES_B, 'lineitem')}),
    u AS (SELECT l_orderkey, l_linenumber, 1 AS ia, 0 AS ib FROM a UNION ALL SELECT l_orderkey, l_linenumber, 0, 1 FROM b),
    k AS (SELECT l_orderkey, l_linenumber, CAST(sum(ia) AS BIGINT) AS n_a, CAST(sum(ib) AS BIGINT) AS n_b FROM u GROUP BY 1, 2)
    SELECT l_orderkey AS k0, l_linenumber AS k1, n_a, n_b, CASE WHEN n_a > n_b THEN 'missing_in_target' ELSE 'missing_in_source' END AS difference_type,
      'high' AS severity FROM k WHERE n_a > 1 OR n_b > 1""",
)
def classify_duplicates(spark, sf):
    keys = ("l_orderkey", "l_linenumber")
    counts = key_counts(side(derive(spark, sf, "lineitem", LINES_A), keys, []), side(derive(spark, sf, "lineitem", LINES_B), keys, []))
    return cl.classify_duplicates(counts)


# Lines by their order alone, so keys repeat: equal lines cancel, the others pair in the order of their values.
ALIGNED = f"""WITH a AS (SELECT l_orderkey, l_partkey, l_quantity, l_returnflag FROM ({sql(LINES_A, 'lineitem')})),
 b AS (SELECT l_orderkey, l_partkey, l_quantity, l_returnflag FROM ({sql(LINES_B, 'lineitem')})),
 g AS (SELECT l_orderkey AS k, l_partkey AS p, l_quantity AS q, l_returnflag AS r, CAST(sum(s) AS BIGINT) AS d
       FROM (SELECT *, 1 AS s FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY 1, 2, 3, 4 HAVING sum(s) <> 0),
 x AS (SELECT k, p, q, r, d > 0 AS in_a, unnest(range(abs(d))) AS i FROM g),
 n AS (SELECT *, row_number() OVER (PARTITION BY in_a, k ORDER BY p NULLS FIRST, q NULLS FIRST, r NULLS FIRST) AS place FROM x),
 m AS (SELECT coalesce(y.k, z.k) AS k, y.k IS NULL AS xb, z.k IS NULL AS xa, y.p AS pa, y.q AS qa, y.r AS ra, z.p AS pb, z.q AS qb, z.r AS rb
       FROM (FROM n WHERE in_a) y FULL JOIN (FROM n WHERE NOT in_a) z ON y.k = z.k AND y.place = z.place) """
NUMBER_LEVEL = """'value_mismatch' AS difference_type, CASE WHEN abs({0}a - {0}b) / greatest(abs({0}a), abs({0}b)) > 0.1 THEN 'high'
  WHEN abs({0}a - {0}b) / greatest(abs({0}a), abs({0}b)) > 0.01 THEN 'medium' ELSE 'low' END AS severity,
  CAST({0}a AS VARCHAR) AS source_value, CAST({0}b AS VARCHAR) AS target_value FROM m WHERE NOT xa AND NOT xb AND {0}a <> {0}b"""


def repeated(spark, sf, **options):
    columns = ["l_partkey", "l_quantity", "l_returnflag"]
    a, b = (side(derive(spark, sf, "lineitem", t), "l_orderkey", columns) for t in (LINES_A, LINES_B))
    return compare(a, b, Options(algorithm="rows", **options))


@check(
    "Q1_repeated_keys",
    ALIGNED
    + f"""SELECT k AS l_orderkey, 'l_partkey' AS column_name, {NUMBER_LEVEL.format('p')}
    UNION ALL SELECT k, 'l_quantity', {NUMBER_LEVEL.format('q')}
    UNION ALL SELECT k, 'l_returnflag', CASE WHEN ra IS NULL OR rb IS NULL THEN 'null_mismatch' ELSE 'value_mismatch' END,
      CASE WHEN ra IS NULL OR rb IS NULL THEN 'high' ELSE 'medium' END, ra, rb FROM m WHERE NOT xa AND NOT xb AND ra IS DISTINCT FROM rb""",
)
def classify_repeated(spark, sf):
    return repeated(spark, sf).classification


@check(
    "A5_repeated_keys",
    ALIGNED
    + """SELECT count(*) FILTER (WHERE NOT xa AND NOT xb) AS paired, count(*) FILTER (WHERE xa) AS only_a, count(*) FILTER (WHERE xb) AS only_b,
      count(*) FILTER (WHERE NOT xa AND NOT xb AND pa <> pb) AS l_partkey, count(*) FILTER (WHERE NOT xa AND NOT xb AND qa <> qb) AS l_quantity,
      count(*) FILTER (WHERE NOT xa AND NOT xb AND ra IS DISTINCT FROM rb) AS l_returnflag FROM m""",
)
def counts_repeated(spark, sf):
    c = repeated(spark, sf).compared
    return c.matched.agg(
        F.count_if(c.in_both()).alias("paired"),
        F.count_if(c.only_a()).alias("only_a"),
        F.count_if(c.only_b()).alias("only_b"),
        *[F.count_if(c.in_both() & c.differs(i)).alias(c.pairs[i][0]) for i in c.value_positions],
    )


@check(
    "S7_details_repeated_keys",
    ALIGNED
    + """, j AS (SELECT *, concat('{"l_orderkey":', k, '}') AS row_key,
       concat('{"l_orderkey":"', k, '","l_partkey":"', pa, '","l_quantity":"', qa, '"', CASE WHEN ra IS NOT NULL THEN concat(',"l_returnflag":"', ra, '"') ELSE '' END, '}') AS ja,
       concat('{"l_orderkey":"', k, '","l_partkey":"', pb, '","l_quantity":"', qb, '"', CASE WHEN rb IS NOT NULL THEN concat(',"l_returnflag":"', rb, '"') ELSE '' END, '}') AS jb FROM m)
    SELECT row_key, 'value_different' AS difference_type, 'medium' AS severity, 'l_partkey' AS column_name, CAST(pa AS VARCHAR) AS source_value,
      CAST(pb AS VARCHAR) AS target_value FROM j WHERE NOT xa AND NOT xb AND pa <> pb
    UNION ALL SELECT row_key, 'value_different', 'medium', 'l_quantity', CAST(qa AS VARCHAR), CAST(qb AS VARCHAR) FROM j WHERE NOT xa AND NOT xb AND qa <> qb
    UNION ALL SELECT row_key, 'value_different', 'medium', 'l_returnflag', coalesce(ra, ''), coalesce(rb, '') FROM j
      WHERE NOT xa AND NOT xb AND ra IS DISTINCT FROM rb
    UNION ALL SELECT row_key, 'missing_in_target', 'high', NULL, ja, '' FROM j WHERE xa
    UNION ALL SELECT row_key, 'missing_in_source', 'high', NULL, '', jb FROM j WHERE xb""",
)
def details_repeated(spark, sf):
    store = repeated(spark, sf).save(scratch_path(spark, "store"), "one")
    return store.read("difference_details").select("row_key", "difference_type", "severity", "column_name", "source_value", "target_value")


@check(
    "Q3_summary",
    CLASSIFIED
    + """SELECT 'type' AS grouping, '' AS column_name, difference_type AS label, count(*) AS n FROM c GROUP BY difference_type
    UNION ALL SELECT 'severity', '', severity, count(*) FROM c GROUP BY severity
    UNION ALL SELECT 'column', column_name, difference_type, count(*) FROM c GROUP BY column_name, difference_type""",
)
def summary(spark, sf):
    return cl.summary(classified(spark, sf))


@check("Q3_critical", CLASSIFIED + "SELECT * FROM c WHERE severity = 'critical'")
def critical(spark, sf):
    return cl.critical_cells(classified(spark, sf))


@check(
    "Q4_recommendations",
    CLASSIFIED
    + """, n AS (SELECT count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE difference_type = 'null_mismatch') AS nulls,
      count(*) FILTER (WHERE difference_type IN ('case_difference', 'whitespace_difference')) AS texts, count(*) AS total FROM c)
    SELECT 'critical issues need attention' AS rule, critical AS n FROM n WHERE critical > 0
    UNION ALL SELECT 'review data completeness', nulls FROM n WHERE nulls > 0
    UNION ALL SELECT 'consider data normalization', texts FROM n WHERE texts > 0
    UNION ALL SELECT 'consider reviewing data pipeline', total FROM n WHERE total > 100""",
)
def recommendations(spark, sf):
    return cl.recommendations(classified(spark, sf))

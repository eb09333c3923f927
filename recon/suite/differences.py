"""Checks: the comparison algorithms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from recon.functions.predicates import CompareRules
from recon.operators import hashdiff as hd
from recon.operators import joindiff as jd
from recon.plans.batch import batch_compare
from recon.plans.compare import Options, compare
from recon.plans.release import release_diff
from recon.sources.side import side
from recon.suite.inputs import (
    CUSTOMERS_A,
    CUSTOMERS_RELEASE,
    EVENTS_A,
    EVENTS_B,
    LINES_A,
    LINES_B,
    TURNS_A,
    TURNS_B,
    derive,
    sql,
)
from recon.suite.matching import MATCHED, SIGNED, compared, sides
from recon.suite.registry import check

COUNTS = """count(a0) AS "rows_A", count(b0) AS "rows_B", count(*) FILTER (WHERE xa) AS "exclusive_A",
  count(*) FILTER (WHERE xb) AS "exclusive_B", count(*) FILTER (WHERE NOT xa AND NOT xb AND d1 + d2 > 0) AS updated,
  count(a0) - count(*) FILTER (WHERE xa) - count(*) FILTER (WHERE NOT xa AND NOT xb AND d1 + d2 > 0) AS unchanged,
  count(*) FILTER (WHERE xa OR xb OR d1 + d2 > 0) AS total"""


@check("D1_join_diff_stats", MATCHED + f"SELECT {COUNTS} FROM f")
def join_diff_stats(spark, sf):
    return jd.join_diff(*sides(spark, sf)).stats()


@check("D2_hash_diff", MATCHED + SIGNED)
def hash_diff(spark, sf):
    return hd.hash_diff(*sides(spark, sf))


TURN_SIGNED = f"""WITH a AS ({sql(TURNS_A, 'conversations')}), b AS ({sql(TURNS_B, 'conversations')}),
 same AS (SELECT conv_id, turn FROM (SELECT * FROM a INTERSECT SELECT * FROM b))
 SELECT '-' AS sign, CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text FROM a
   WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM same)
 UNION ALL SELECT '+', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), role, text FROM b
   WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM same)"""


@check("D2_hash_diff_compound", TURN_SIGNED)
def hash_diff_compound(spark, sf):
    a = side(derive(spark, sf, "conversations", TURNS_A), ("conv_id", "turn"))
    b = side(derive(spark, sf, "conversations", TURNS_B), ("conv_id", "turn"))
    return hd.hash_diff(a, b, factor=8, threshold=64)


ROWSET = f"""WITH a AS ({sql(LINES_A, 'lineitem')}), b AS ({sql(LINES_B, 'lineitem')}),
 ka AS (SELECT l_orderkey, l_linenumber, count(*) n, min(l_partkey) p, min(l_quantity) q, min(l_returnflag) r FROM a GROUP BY 1, 2),
 kb AS (SELECT l_orderkey, l_linenumber, count(*) n, min(l_partkey) p, min(l_quantity) q, min(l_returnflag) r FROM b GROUP BY 1, 2),
 hit AS (SELECT coalesce(ka.l_orderkey, kb.l_orderkey) AS o, coalesce(ka.l_linenumber, kb.l_linenumber) AS l
         FROM ka FULL OUTER JOIN kb ON ka.l_orderkey = kb.l_orderkey AND ka.l_linenumber = kb.l_linenumber
         WHERE coalesce(ka.n, 0) <> 1 OR coalesce(kb.n, 0) <> 1 OR ka.p IS DISTINCT FROM kb.p
            OR ka.q IS DISTINCT FROM kb.q OR ka.r IS DISTINCT FROM kb.r) """


@check(
    "D3_rowset_diff",
    ROWSET
    + """SELECT '-' AS sign, CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
      CAST(l_partkey AS VARCHAR) AS l_partkey, CAST(l_quantity AS VARCHAR) AS l_quantity, l_returnflag
    FROM a JOIN hit ON l_orderkey = o AND l_linenumber = l
    UNION ALL SELECT '+', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
      CAST(l_quantity AS VARCHAR), l_returnflag FROM b JOIN hit ON l_orderkey = o AND l_linenumber = l""",
)
def rowset_diff(spark, sf):
    keys = ("l_orderkey", "l_linenumber")
    return hd.rowset_diff(side(derive(spark, sf, "lineitem", LINES_A), keys), side(derive(spark, sf, "lineitem", LINES_B), keys))


@check(
    "D3_rowset_diff_hot_keys",
    f"""WITH a AS ({sql(LINES_A, 'lineitem')}), b AS ({sql(LINES_B, 'lineitem')})
    SELECT '-' AS sign, l_returnflag, CAST(l_orderkey AS VARCHAR) AS l_orderkey FROM a
    UNION ALL SELECT '+', l_returnflag, CAST(l_orderkey AS VARCHAR) FROM b""",
)
def rowset_hot(spark, sf):
    a = side(derive(spark, sf, "lineitem", LINES_A), "l_returnflag", ["l_orderkey"])
    b = side(derive(spark, sf, "lineitem", LINES_B), "l_returnflag", ["l_orderkey"])
    return hd.rowset_diff(a, b)


# The same orders with other types: a finer scale, timestamps for dates, and a wider key.
TYPED_A = "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) AS price, CAST(o_orderdate AS DATE) AS day, o_orderstatus FROM {t}"
TYPED_B = """SELECT CAST(o_orderkey AS DECIMAL(20,0)) AS o_orderkey,
  CAST(CASE WHEN o_orderkey % 89 = 0 THEN o_totalprice + 1 WHEN o_orderkey % 83 = 0 THEN o_totalprice + 0.001
       ELSE o_totalprice END AS DECIMAL(14,3)) AS price,
  CASE WHEN o_orderkey % 61 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 1 HOUR
       ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS day, o_orderstatus
FROM {t} WHERE o_orderkey % 97 <> 0"""
MIXED = f"""WITH a AS ({sql(TYPED_A, 'orders')}), b AS ({sql(TYPED_B, 'orders')}),
 j AS (SELECT a.o_orderkey AS k, b.o_orderkey IS NULL AS gone FROM a LEFT JOIN b ON a.o_orderkey = b.o_orderkey
       WHERE b.o_orderkey IS NULL OR a.price <> CAST(b.price AS DECIMAL(12,2)) OR CAST(a.day AS TIMESTAMP) <> b.day
          OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus)
 SELECT '-' AS sign, CAST(k AS VARCHAR) AS o_orderkey FROM j UNION ALL SELECT '+', CAST(k AS VARCHAR) FROM j WHERE NOT gone"""


def mixed_sides(spark, sf):
    return tuple(side(derive(spark, sf, "orders", t), "o_orderkey") for t in (TYPED_A, TYPED_B))


@check("J1_mixed_types", MIXED)
def join_mixed(spark, sf):
    return jd.join_diff(*mixed_sides(spark, sf)).signed_rows().select("sign", "o_orderkey")


@check("D2_mixed_types", MIXED)
def hash_mixed(spark, sf):
    return hd.hash_diff(*mixed_sides(spark, sf)).select("sign", "o_orderkey")


@check("D3_mixed_types", MIXED)
def rowset_mixed(spark, sf):
    return hd.rowset_diff(*mixed_sides(spark, sf)).select("sign", "o_orderkey")


# Customers by a UUID that one side spells in upper case.
UUID_OF = (
    "concat(substr(md5(c_name), 1, 8), '-', substr(md5(c_name), 9, 4), '-', substr(md5(c_name), 13, 4), '-', "
    "substr(md5(c_name), 17, 4), '-', substr(md5(c_name), 21, 12))"
)
NAMED_A = f"SELECT {UUID_OF} AS id, {UUID_OF} AS ref, c_acctbal, c_custkey FROM {{t}}"
NAMED_B = f"""SELECT upper({UUID_OF}) AS id, concat(' ', upper({UUID_OF})) AS ref,
  CASE WHEN c_custkey % 31 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_custkey
FROM {{t}} WHERE c_custkey % 37 <> 0"""
UUID_SIGNED = f"""WITH a AS ({sql(NAMED_A, 'customer')}), b AS ({sql(NAMED_B, 'customer')}),
 j AS (SELECT a.id, b.id IS NULL AS gone FROM a LEFT JOIN b ON a.id = lower(b.id) WHERE b.id IS NULL OR a.c_acctbal <> b.c_acctbal)
 SELECT '-' AS sign, id FROM j UNION ALL SELECT '+', id FROM j WHERE NOT gone"""


def uuid_sides(spark, sf):
    forms = (("id", "uuid"), ("ref", "uuid"))
    return tuple(side(derive(spark, sf, "customer", t), "id", text_forms=forms) for t in (NAMED_A, NAMED_B))


@check("N5_uuid_join", UUID_SIGNED)
def uuid_join(spark, sf):
    return jd.join_diff(*uuid_sides(spark, sf)).signed_rows().select("sign", "id")


@check("D2_uuid_keys", UUID_SIGNED)
def uuid_hash(spark, sf):
    return hd.hash_diff(*uuid_sides(spark, sf)).select("sign", "id")


@check("C14_applied_to_compare", UUID_SIGNED)
def uuid_found(spark, sf):
    """UUID columns found by looking at all their values, keys and others, with no form given."""
    a, b = (side(derive(spark, sf, "customer", t), "id") for t in (NAMED_A, NAMED_B))
    return compare(a, b, Options(detect_text_forms=True, assume_unique_key=True)).diff.select("sign", "id")


@check("D2_uuid_ranges", UUID_SIGNED)
def uuid_ranges(spark, sf):
    """UUID keys in ranges of their normal form, over several levels."""
    return hd.hash_diff(*uuid_sides(spark, sf), factor=4, threshold=16).select("sign", "id")


@check("C14_with_nulls", UUID_SIGNED)
def uuid_found_with_nulls(spark, sf):
    """NULLs do not keep a column from being seen as UUIDs."""
    a, b = (
        side(derive(spark, sf, "customer", t).withColumn("ref", F.expr("CASE WHEN c_custkey % 5 <> 0 THEN ref END")), "id")
        for t in (NAMED_A, NAMED_B)
    )
    found = [
        compare(a, b, Options(detect_text_forms=True, assume_unique_key=True, algorithm=how)).diff.select("sign", "id")
        for how in ("join", "hash", "rows")
    ]
    return found[0].intersectAll(found[1]).intersectAll(found[2])


# Customers by name, and orders by a time.
TEXT_A = "SELECT c_name, CAST(c_acctbal AS DECIMAL(12,2)) AS c_acctbal FROM {t}"
TEXT_B = """SELECT concat(c_name, CASE WHEN c_custkey % 41 = 0 THEN '!' ELSE '' END) AS c_name,
  CAST(CASE WHEN c_custkey % 31 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS DECIMAL(12,2)) AS c_acctbal
FROM {t} WHERE c_custkey % 37 <> 0"""


@check(
    "D2_text_keys",
    f"""WITH a AS ({sql(TEXT_A, 'customer')}), b AS ({sql(TEXT_B, 'customer')})
    SELECT '-' AS sign, c_name, CAST(c_acctbal AS VARCHAR) AS c_acctbal FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT '+', c_name, CAST(c_acctbal AS VARCHAR) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def hash_text(spark, sf):
    return hd.hash_diff(*(side(derive(spark, sf, "customer", t), "c_name") for t in (TEXT_A, TEXT_B)), factor=4, threshold=16)


AT = "TIMESTAMP '2020-01-01 00:00:00' + INTERVAL '1' SECOND * (o_orderkey * 7919 % 100000007)"
TIME_A = f"SELECT {AT} AS t_at, o_orderkey, o_custkey FROM {{t}}"
TIME_B = f"""SELECT {AT} AS t_at, o_orderkey, CASE WHEN o_orderkey % 89 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey
FROM {{t}} WHERE o_orderkey % 97 <> 0"""


@check(
    "D2_time_keys",
    f"""WITH a AS ({sql(TIME_A, 'orders')}), b AS ({sql(TIME_B, 'orders')})
    SELECT '-' AS sign, strftime(t_at, '%Y-%m-%d %H:%M:%S.%f') AS t_at, CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey
      FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT '+', strftime(t_at, '%Y-%m-%d %H:%M:%S.%f'), CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR)
      FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def hash_time(spark, sf):
    timed = (side(derive(spark, sf, "orders", t), ("t_at", "o_orderkey")) for t in (TIME_A, TIME_B))
    return hd.hash_diff(*timed, factor=8, threshold=64)


# A whole number against a fraction.
WHOLE_A = "SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS v, CAST(o_custkey AS BIGINT) AS w FROM {t}"
WHOLE_B = """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 89 = 0 THEN o_custkey + 0.4 ELSE o_custkey END AS DECIMAL(14,2)) AS v,
  CAST(CASE WHEN o_orderkey % 83 = 0 THEN o_custkey + 0.25 ELSE o_custkey END AS DOUBLE) AS w FROM {t}"""


@check(
    "C15_integer_against_decimal",
    """WITH hit AS (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM orders WHERE o_orderkey % 89 = 0 OR o_orderkey % 83 = 0)
    SELECT algorithm, sign, o_orderkey FROM hit, (VALUES ('join'), ('hash'), ('rows')) a(algorithm), (VALUES ('-'), ('+')) s(sign)""",
)
def integer_against_decimal(spark, sf):
    a, b = (side(derive(spark, sf, "orders", t), "o_orderkey") for t in (WHOLE_A, WHOLE_B))
    parts = [
        compare(a, b, Options(algorithm=how, assume_unique_key=True)).diff.select(F.lit(how).alias("algorithm"), "sign", "o_orderkey")
        for how in ("join", "hash", "rows")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@check("D3_uuid_keys", UUID_SIGNED)
def uuid_rows(spark, sf):
    return hd.rowset_diff(*uuid_sides(spark, sf)).select("sign", "id")


# Keys spread over nearly the whole range of a bigint, as hashed keys are.
WIDE = "CAST(o_orderkey * 7919 % 2147483647 - 1073741823 AS BIGINT) * 8000000000"
WIDE_A = f"SELECT {WIDE} AS k, CAST(o_totalprice AS DECIMAL(12,2)) AS price FROM {{t}}"
WIDE_B = f"""SELECT {WIDE} AS k, CAST(CASE WHEN o_orderkey % 89 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS DECIMAL(12,2)) AS price
FROM {{t}} WHERE o_orderkey % 97 <> 0"""


@check(
    "D2_wide_keys",
    f"""WITH a AS ({sql(WIDE_A, 'orders')}), b AS ({sql(WIDE_B, 'orders')}),
    j AS (SELECT a.k, a.price AS pa, b.price AS pb FROM a LEFT JOIN b ON a.k = b.k WHERE a.price IS DISTINCT FROM b.price)
    SELECT '-' AS sign, CAST(k AS VARCHAR) AS k, CAST(pa AS VARCHAR) AS price FROM j
    UNION ALL SELECT '+', CAST(k AS VARCHAR), CAST(pb AS VARCHAR) FROM j WHERE pb IS NOT NULL""",
)
def hash_wide(spark, sf):
    return hd.hash_diff(*(side(derive(spark, sf, "orders", t), "k") for t in (WIDE_A, WIDE_B)), factor=8, threshold=64)


@check(
    "D3_rowset_stats",
    f"""WITH a AS ({sql(LINES_A, 'lineitem')}), b AS ({sql(LINES_B, 'lineitem')}),
    ka AS (SELECT l_orderkey, l_linenumber, count(*) n, min(l_partkey) p, min(l_quantity) q, min(l_returnflag) r FROM a GROUP BY 1, 2),
    kb AS (SELECT l_orderkey, l_linenumber, count(*) n, min(l_partkey) p, min(l_quantity) q, min(l_returnflag) r FROM b GROUP BY 1, 2),
    k AS (SELECT coalesce(ka.n, 0) na, coalesce(kb.n, 0) nb, ka.p IS DISTINCT FROM kb.p OR ka.q IS DISTINCT FROM kb.q
          OR ka.r IS DISTINCT FROM kb.r AS d
          FROM ka FULL OUTER JOIN kb ON ka.l_orderkey = kb.l_orderkey AND ka.l_linenumber = kb.l_linenumber)
    SELECT CAST(sum(na) AS BIGINT) AS "rows_A", CAST(sum(nb) AS BIGINT) AS "rows_B",
      CAST(coalesce(sum(CASE WHEN nb = 0 THEN na END), 0) AS BIGINT) AS "exclusive_A",
      CAST(coalesce(sum(CASE WHEN na = 0 THEN nb END), 0) AS BIGINT) AS "exclusive_B",
      count(*) FILTER (WHERE na = 1 AND nb = 1 AND d) AS updated, count(*) FILTER (WHERE na = 1 AND nb = 1 AND NOT d) AS unchanged,
      count(*) FILTER (WHERE na > 0 AND nb > 0 AND NOT (na = 1 AND nb = 1)) AS duplicated FROM k""",
)
def rowset_stats(spark, sf):
    keys = ("l_orderkey", "l_linenumber")
    return hd.rowset_stats(side(derive(spark, sf, "lineitem", LINES_A), keys), side(derive(spark, sf, "lineitem", LINES_B), keys))


D4_PICK = '"rows_A", "rows_B", "exclusive_A", "exclusive_B", updated'


@check(
    "D4_auto_algorithm",
    MATCHED
    + f""", u AS (SELECT {COUNTS} FROM f), la AS ({sql(LINES_A, 'lineitem')}), lb AS ({sql(LINES_B, 'lineitem')}),
    ka AS (SELECT l_orderkey, l_linenumber, count(*) n, min(l_partkey) p, min(l_quantity) q, min(l_returnflag) r FROM la GROUP BY 1, 2),
    kb AS (SELECT l_orderkey, l_linenumber, count(*) n, min(l_partkey) p, min(l_quantity) q, min(l_returnflag) r FROM lb GROUP BY 1, 2),
    k AS (SELECT coalesce(ka.n, 0) na, coalesce(kb.n, 0) nb, ka.p IS DISTINCT FROM kb.p OR ka.q IS DISTINCT FROM kb.q
          OR ka.r IS DISTINCT FROM kb.r AS d
          FROM ka FULL OUTER JOIN kb ON ka.l_orderkey = kb.l_orderkey AND ka.l_linenumber = kb.l_linenumber)
    SELECT 'join' AS algorithm, {D4_PICK} FROM u UNION ALL SELECT 'hash', {D4_PICK} FROM u
    UNION ALL SELECT 'rows', CAST(sum(na) AS BIGINT), CAST(sum(nb) AS BIGINT), CAST(coalesce(sum(CASE WHEN nb = 0 THEN na END), 0) AS BIGINT),
      CAST(coalesce(sum(CASE WHEN na = 0 THEN nb END), 0) AS BIGINT), count(*) FILTER (WHERE na = 1 AND nb = 1 AND d) FROM k""",
)
def auto_algorithm(spark, sf):
    keys = ("l_orderkey", "l_linenumber")
    unique = compare(*sides(spark, sf))
    repeated = compare(side(derive(spark, sf, "lineitem", LINES_A), keys), side(derive(spark, sf, "lineitem", LINES_B), keys))
    across = compare(*sides(spark, sf), same_system=False)
    named = [(r.algorithm, r.stats) for r in (unique, repeated, across)]
    frames = [s.select(F.lit(a).alias("algorithm"), "rows_A", "rows_B", "exclusive_A", "exclusive_B", "updated") for a, s in named]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def bisect_sql(factor: int, levels: int, threshold: int) -> str:
    parts, previous = [], None
    for level in range(1, levels + 1):
        run = factor ** (levels - level)
        body = f"""SELECT {level} AS level, seg // {run} AS segment_id, min(lo) + (seg // {run}) * min(w) * {run} AS lo,
          CASE WHEN (seg // {run} + 1) * {run} > {factor**levels - 1} THEN min(hi) ELSE min(lo) + (seg // {run} + 1) * min(w) * {run} END AS hi,
          count(*) FILTER (WHERE side = 'a') AS rows_a, count(*) FILTER (WHERE side = 'b') AS rows_b,
          CAST(sum(CASE WHEN side = 'a' THEN n END) AS VARCHAR) AS checksum_a,
          CAST(sum(CASE WHEN side = 'b' THEN n END) AS VARCHAR) AS checksum_b FROM seg GROUP BY seg // {run}"""
        where = "" if previous is None else f" WHERE segment_id // {factor} IN (SELECT segment_id FROM p{level - 1})"
        parts.append(
            f"l{level} AS (SELECT *, checksum_a IS DISTINCT FROM checksum_b OR rows_a <> rows_b AS is_diff FROM ({body}){where}), "
            f"p{level} AS (SELECT segment_id FROM l{level} WHERE is_diff AND greatest(rows_a, rows_b) >= {threshold})"
        )
        previous = level
    union = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(1, levels + 1))
    md5 = "('0x' || substr(md5(t), 21, 12))::BIGINT - 140737488355327"
    text = "concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_totalprice AS VARCHAR), coalesce(o_orderstatus, '<null>'))"
    from recon.suite.inputs import ORDERS_A, ORDERS_B

    return f"""WITH a AS ({sql(ORDERS_A, 'orders')}), b AS ({sql(ORDERS_B, 'orders')}),
      u AS (SELECT 'a' AS side, o_orderkey AS k, {text} AS t FROM a UNION ALL SELECT 'b', o_orderkey, {text} FROM b),
      r AS (SELECT min(k) AS lo, max(k) + 1 AS hi FROM u), w AS (SELECT lo, hi, (hi - lo + 1) // {factor**levels} AS w FROM r),
      seg AS (SELECT side, {md5} AS n, lo, hi, w, least((k - lo) // w, {factor**levels - 1}) AS seg FROM u, w),
      {", ".join(parts)} {union}"""


@check("D5_bisect_report", bisect_sql(8, 3, 500))
def bisect(spark, sf):
    out = hd.bisect_report(*sides(spark, sf), factor=8, threshold=500, levels=3)
    return out.withColumns({c: F.col(c).cast("string") for c in ("checksum_a", "checksum_b")})


@check(
    "D6_any_change",
    MATCHED
    + """, c AS (SELECT sum(('0x' || substr(md5(concat_ws('|', CAST(a0 AS VARCHAR), CAST(a1 AS VARCHAR), coalesce(a2, '<null>'))), 21, 12))::BIGINT
         - 140737488355327) FILTER (WHERE a0 IS NOT NULL) AS ca,
      sum(('0x' || substr(md5(concat_ws('|', CAST(b0 AS VARCHAR), CAST(b1 AS VARCHAR), coalesce(b2, '<null>'))), 21, 12))::BIGINT
         - 140737488355327) FILTER (WHERE b0 IS NOT NULL) AS cb, count(a0) AS na, count(b0) AS nb FROM f)
    SELECT na AS "rows_A", nb AS "rows_B", CAST(ca AS VARCHAR) AS "checksum_A", CAST(cb AS VARCHAR) AS "checksum_B",
      ca = cb AND na = nb AS is_equal FROM c""",
)
def any_change(spark, sf):
    out = hd.tables_equal(*sides(spark, sf))
    return out.withColumns({c: F.col(c).cast("string") for c in ("checksum_A", "checksum_B")})


@check("D7_first_differences", MATCHED + f"SELECT * FROM ({SIGNED}) ORDER BY o_orderkey, sign DESC LIMIT 20")
def first_differences(spark, sf):
    return hd.ordered_diff(compared(spark, sf).signed_rows(), ["o_orderkey"], 20)


EVENT_PAIR = f"WITH a AS ({sql(EVENTS_A, 'events')}), b AS ({sql(EVENTS_B, 'events')}) "


def event_sides(spark, sf, columns):
    return (
        side(derive(spark, sf, "events", EVENTS_A), "event_id", columns, name="events"),
        side(derive(spark, sf, "events", EVENTS_B), "event_id", columns, name="events_b"),
    )


@check(
    "D8_json_suppression",
    EVENT_PAIR
    + """SELECT '-' AS sign, CAST(a.event_id AS VARCHAR) AS event_id, a.props FROM a LEFT JOIN b ON a.event_id = b.event_id
      WHERE b.event_id IS NULL OR replace(a.props, ': ', ':') IS DISTINCT FROM replace(b.props, ': ', ':')
    UNION ALL SELECT '+', CAST(b.event_id AS VARCHAR), b.props FROM b LEFT JOIN a ON a.event_id = b.event_id
      WHERE a.event_id IS NULL OR replace(a.props, ': ', ':') IS DISTINCT FROM replace(b.props, ': ', ':')""",
)
def json_suppression(spark, sf):
    rules = CompareRules(json_mode="semantic", json_columns=frozenset({"props"}))
    return hd.rowset_diff(*event_sides(spark, sf, ["props"]), rules=rules)


@check(
    "D8_suppressed_count",
    EVENT_PAIR
    + """SELECT 'props' AS column_name, count(*) AS suppressed FROM a JOIN b ON a.event_id = b.event_id
    WHERE a.props <> b.props AND replace(a.props, ': ', ':') = replace(b.props, ': ', ':')""",
)
def suppressed(spark, sf):
    return hd.suppressed_json_columns(jd.compare_by_key(*event_sides(spark, sf, ["props"])), ["props"])


@check(
    "D9_incremental",
    EVENT_PAIR
    + """, wa AS (SELECT * FROM a WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'),
      wb AS (SELECT * FROM b WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20')
    SELECT count(wa.event_id) AS "rows_A", count(wb.event_id) AS "rows_B", count(*) FILTER (WHERE wb.event_id IS NULL) AS "exclusive_A",
      count(*) FILTER (WHERE wa.event_id IS NULL) AS "exclusive_B",
      count(*) FILTER (WHERE wa.event_id = wb.event_id AND (wa.value IS DISTINCT FROM wb.value OR wa.ts <> wb.ts)) AS updated,
      count(*) FILTER (WHERE wa.event_id = wb.event_id AND wa.value IS NOT DISTINCT FROM wb.value AND wa.ts = wb.ts) AS unchanged,
      count(*) FILTER (WHERE wa.event_id IS NULL OR wb.event_id IS NULL OR wa.value IS DISTINCT FROM wb.value OR wa.ts <> wb.ts) AS total
    FROM wa FULL OUTER JOIN wb ON wa.event_id = wb.event_id""",
)
def incremental(spark, sf):
    window = dict(update_column="ts", min_update=datetime(2024, 1, 10), max_update=datetime(2024, 1, 20))
    a = side(derive(spark, sf, "events", EVENTS_A), "event_id", ["value"], **window)
    b = side(derive(spark, sf, "events", EVENTS_B), "event_id", ["value"], **window)
    return jd.join_diff(a, b).stats()


RELEASE_SQL = f"""WITH a AS ({sql(CUSTOMERS_A, 'customer')}), b AS ({sql(CUSTOMERS_RELEASE, 'customer')}),
 m AS (SELECT a.c_custkey ka, b.c_custkey kb, a.c_name IS DISTINCT FROM b.c_name d1, a.c_mktsegment IS DISTINCT FROM b.c_mktsegment d2
       FROM a FULL OUTER JOIN b ON a.c_custkey = b.c_custkey) """


@check(
    "D10_release_summary",
    RELEASE_SQL
    + """SELECT count(ka) AS total_prod, count(kb) AS total_dev, count(*) FILTER (WHERE ka IS NULL) AS added,
      count(*) FILTER (WHERE kb IS NULL) AS removed, count(*) FILTER (WHERE ka = kb AND (d1 OR d2)) AS different,
      count(*) FILTER (WHERE ka = kb AND NOT d1 AND NOT d2) AS unchanged FROM m""",
)
def release_summary(spark, sf):
    return _release(spark, sf).summary()


@check(
    "D10_release_values",
    RELEASE_SQL
    + """SELECT 'c_name' AS column_name, count(*) FILTER (WHERE ka = kb AND d1) AS values_changed FROM m
    UNION ALL SELECT 'c_mktsegment', count(*) FILTER (WHERE ka = kb AND d2) FROM m""",
)
def release_values(spark, sf):
    return _release(spark, sf).values_changed()


def _release(spark, sf):
    prod, dev = derive(spark, sf, "customer", CUSTOMERS_A), derive(spark, sf, "customer", CUSTOMERS_RELEASE)
    return release_diff(prod, dev, ["c_custkey"])


@check(
    "D11_batch",
    MATCHED
    + f""", u AS (SELECT {COUNTS} FROM f), ea AS ({sql(EVENTS_A, 'events')}), eb AS ({sql(EVENTS_B, 'events')}),
    e AS (SELECT count(ea.event_id) AS na, count(eb.event_id) AS nb, count(*) FILTER (WHERE ea.event_id IS NULL OR eb.event_id IS NULL
      OR ea.value IS DISTINCT FROM eb.value) AS d FROM ea FULL OUTER JOIN eb ON ea.event_id = eb.event_id)
    SELECT 'orders' AS name, 'completed' AS status, "rows_A", "rows_B", total AS diff_keys,
      1 - CAST(total AS DOUBLE) / greatest("rows_A", "rows_B") AS match_rate FROM u
    UNION ALL SELECT 'events', 'completed', na, nb, d, 1 - CAST(d AS DOUBLE) / greatest(na, nb) FROM e
    UNION ALL SELECT 'null keys', 'failed', NULL, NULL, NULL, NULL""",
)
def batch(spark, sf):
    a, b = sides(spark, sf)
    null_keyed = side(a.df.selectExpr("nullif(o_orderkey, 0) o_orderkey", "o_orderstatus"), "o_orderkey")
    pairs = {
        "orders": (a, b),
        "events": event_sides(spark, sf, ["value"]),
        "null keys": (null_keyed, null_keyed),
    }
    return batch_compare(spark, pairs, Options(assume_unique_key=True)).drop("error")

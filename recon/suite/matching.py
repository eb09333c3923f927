"""Checks: matching rows by key, and the health of keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from recon.operators import joindiff as jd
from recon.operators import keys as k
from recon.operators.hashdiff import hash_diff
from recon.operators.output import cell_table, row_json
from recon.sources.side import side
from recon.suite.inputs import (
    LINES_A,
    LINES_B,
    NULLKEYS_A,
    NULLKEYS_B,
    ORDERS_A,
    ORDERS_B,
    TURNS_A,
    TURNS_B,
    derive,
    sql,
    table,
)
from recon.suite.registry import check

COLUMNS = ["o_totalprice", "o_orderstatus"]


def sides(spark, sf, columns=COLUMNS):
    return (
        side(derive(spark, sf, "orders", ORDERS_A), "o_orderkey", columns, name="orders"),
        side(derive(spark, sf, "orders", ORDERS_B), "o_orderkey", columns, name="orders_b"),
    )


def compared(spark, sf, columns=COLUMNS, **options):
    return jd.compare_by_key(*sides(spark, sf, columns), **options)


# Matched rows by position, as the SQL side sees them.
MATCHED = f"""WITH a AS ({sql(ORDERS_A, 'orders')}), b AS ({sql(ORDERS_B, 'orders')}),
m AS (SELECT a.o_orderkey AS a0, b.o_orderkey AS b0, a.o_totalprice AS a1, b.o_totalprice AS b1,
             a.o_orderstatus AS a2, b.o_orderstatus AS b2
      FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey),
f AS (SELECT *, b0 IS NULL AS xa, a0 IS NULL AS xb,
             CASE WHEN a0 IS DISTINCT FROM b0 THEN 1 ELSE 0 END AS d0,
             CASE WHEN a1 IS DISTINCT FROM b1 THEN 1 ELSE 0 END AS d1,
             CASE WHEN a2 IS DISTINCT FROM b2 THEN 1 ELSE 0 END AS d2 FROM m) """

FLAT = """SELECT xa AS is_exclusive_a, xb AS is_exclusive_b, d0 AS is_diff_o_orderkey, d1 AS is_diff_o_totalprice,
  d2 AS is_diff_o_orderstatus, CAST(a0 AS VARCHAR) AS o_orderkey_a, CAST(b0 AS VARCHAR) AS o_orderkey_b,
  CAST(a1 AS VARCHAR) AS o_totalprice_a, CAST(b1 AS VARCHAR) AS o_totalprice_b, a2 AS o_orderstatus_a, b2 AS o_orderstatus_b
  FROM f """
DIFFERENT = "WHERE d0 + d1 + d2 > 0"

SIGNED = """SELECT '-' AS sign, CAST(a0 AS VARCHAR) AS o_orderkey, CAST(a1 AS VARCHAR) AS o_totalprice, a2 AS o_orderstatus
  FROM f WHERE d0 + d1 + d2 > 0 AND NOT xb
  UNION ALL SELECT '+', CAST(b0 AS VARCHAR), CAST(b1 AS VARCHAR), b2 FROM f WHERE d0 + d1 + d2 > 0 AND NOT xa"""


@check("J1_outer_compare", MATCHED + FLAT + DIFFERENT)
def outer_compare(spark, sf):
    return compared(spark, sf).diff_rows()


@check("J1_all_rows", MATCHED + FLAT)
def all_rows(spark, sf):
    return compared(spark, sf).all_rows()


NULLKEY_SQL = f"""WITH a AS ({sql(NULLKEYS_A, 'customer')}), b AS ({sql(NULLKEYS_B, 'customer')}),
a1 AS (SELECT *, 1 AS here FROM a), b1 AS (SELECT *, 1 AS here FROM b)
SELECT b1.here IS NULL AS is_exclusive_a, a1.here IS NULL AS is_exclusive_b,
  CASE WHEN a1.c_custkey IS DISTINCT FROM b1.c_custkey THEN 1 ELSE 0 END AS is_diff_c_custkey,
  CASE WHEN a1.c_mktsegment IS DISTINCT FROM b1.c_mktsegment THEN 1 ELSE 0 END AS is_diff_c_mktsegment,
  CAST(a1.c_custkey AS VARCHAR) AS c_custkey_a, CAST(b1.c_custkey AS VARCHAR) AS c_custkey_b,
  a1.c_mktsegment AS c_mktsegment_a, b1.c_mktsegment AS c_mktsegment_b
FROM a1 FULL OUTER JOIN b1 ON a1.c_custkey = b1.c_custkey
WHERE a1.here IS NULL OR b1.here IS NULL OR a1.c_mktsegment IS DISTINCT FROM b1.c_mktsegment"""


@check("J1_null_keys", NULLKEY_SQL)
def null_keys(spark, sf):
    a = side(derive(spark, sf, "customer", NULLKEYS_A), "c_custkey", ["c_mktsegment"])
    b = side(derive(spark, sf, "customer", NULLKEYS_B), "c_custkey", ["c_mktsegment"])
    return jd.compare_by_key(a, b).diff_rows()


@check(
    "J1_compound_keys",
    f"""WITH a AS ({sql(TURNS_A, 'conversations')}), b AS ({sql(TURNS_B, 'conversations')})
    SELECT b.conv_id IS NULL AS is_exclusive_a, a.conv_id IS NULL AS is_exclusive_b,
    CASE WHEN a.conv_id IS DISTINCT FROM b.conv_id THEN 1 ELSE 0 END AS is_diff_conv_id,
    CASE WHEN a.turn IS DISTINCT FROM b.turn THEN 1 ELSE 0 END AS is_diff_turn,
    CASE WHEN a.role IS DISTINCT FROM b.role THEN 1 ELSE 0 END AS is_diff_role,
    CASE WHEN a.text IS DISTINCT FROM b.text THEN 1 ELSE 0 END AS is_diff_text,
    CAST(a.conv_id AS VARCHAR) AS conv_id_a, CAST(b.conv_id AS VARCHAR) AS conv_id_b,
    CAST(a.turn AS VARCHAR) AS turn_a, CAST(b.turn AS VARCHAR) AS turn_b, a.role AS role_a, b.role AS role_b,
    a.text AS text_a, b.text AS text_b
    FROM a FULL OUTER JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn
    WHERE a.conv_id IS NULL OR b.conv_id IS NULL OR a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text""",
)
def compound(spark, sf):
    a = side(derive(spark, sf, "conversations", TURNS_A), ("conv_id", "turn"))
    b = side(derive(spark, sf, "conversations", TURNS_B), ("conv_id", "turn"))
    return jd.compare_by_key(a, b).diff_rows()


@check(
    "J2_emulated_outer",
    f"""WITH a AS ({sql(ORDERS_A, 'orders')}), b AS ({sql(ORDERS_B, 'orders')})
    SELECT a.o_orderkey AS key_a, a.o_orderstatus AS status_a, b.o_orderkey AS key_b, b.o_orderstatus AS status_b
    FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey""",
)
def emulated(spark, sf):
    a, b = (s.rows().select("o_orderkey", "o_orderstatus") for s in sides(spark, sf))
    return jd.emulated_outer(a, b, ["o_orderkey"]).toDF("key_a", "status_a", "key_b", "status_b")


@check("J3_signed_rows", MATCHED + SIGNED)
def signed(spark, sf):
    return compared(spark, sf).signed_rows()


@check(
    "J5_exclusive_rows",
    f"""WITH a AS ({sql(ORDERS_A, 'orders')}), b AS ({sql(ORDERS_B, 'orders')})
    SELECT 'A' AS side, o_orderkey, o_orderstatus FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)
    UNION ALL SELECT 'B', o_orderkey, o_orderstatus FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)""",
)
def exclusive(spark, sf):
    a, b = sides(spark, sf, ["o_orderstatus"])
    return jd.only_left(a, b).withColumn("side", F.lit("A")).unionByName(jd.only_left(b, a).withColumn("side", F.lit("B")))


@check(
    "J6_keys_on_both",
    f"""WITH a AS ({sql(ORDERS_A, 'orders')}), b AS ({sql(ORDERS_B, 'orders')})
    SELECT o_orderkey, o_orderstatus FROM a WHERE o_orderkey IN (SELECT o_orderkey FROM b)""",
)
def both(spark, sf):
    return jd.both_sides(*sides(spark, sf, ["o_orderstatus"]))


@check(
    "K1_duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
)
def duplicates(spark, sf):
    return k.duplicate_keys(side(table(spark, sf, "lineitem"), ("l_orderkey", "l_linenumber"), []))


@check(
    "K2_null_keys",
    f"WITH a AS ({sql(NULLKEYS_A, 'customer')}) SELECT c_custkey, c_name FROM a WHERE c_custkey IS NULL",
)
def null_key_rows(spark, sf):
    return k.null_key_rows(side(derive(spark, sf, "customer", NULLKEYS_A), "c_custkey", ["c_name"]))


@check("K5_exclusive_count", MATCHED + "SELECT count(*) AS exclusive_count FROM f WHERE xa OR xb")
def exclusive_count(spark, sf):
    return compared(spark, sf).exclusive_count()


@check(
    "K5_exclusive_sample",
    MATCHED
    + """SELECT CAST(a0 AS VARCHAR) AS o_orderkey_a, CAST(b0 AS VARCHAR) AS o_orderkey_b, CAST(a1 AS VARCHAR) AS o_totalprice_a,
    CAST(b1 AS VARCHAR) AS o_totalprice_b, a2 AS o_orderstatus_a, b2 AS o_orderstatus_b FROM f WHERE xa OR xb
    ORDER BY md5(CAST(coalesce(a0, b0) AS VARCHAR)), coalesce(a0, b0) LIMIT 10""",
)
def exclusive_sample(spark, sf):
    return compared(spark, sf).exclusive_sample()


@check(
    "K5_random_exclusive_sample",
    MATCHED
    + """SELECT CAST(a0 AS VARCHAR) AS o_orderkey_a, CAST(b0 AS VARCHAR) AS o_orderkey_b, CAST(a1 AS VARCHAR) AS o_totalprice_a,
      CAST(b1 AS VARCHAR) AS o_totalprice_b, a2 AS o_orderstatus_a, b2 AS o_orderstatus_b FROM f WHERE xa OR xb
    ORDER BY md5(concat('11|', CAST(coalesce(a0, b0) AS VARCHAR))), coalesce(a0, b0) LIMIT 10""",
)
def random_exclusive_sample(spark, sf):
    return compared(spark, sf).exclusive_sample(seed=11)


@check(
    "K6_key_health",
    f"""WITH a AS ({sql(LINES_A, 'lineitem')}), b AS ({sql(LINES_B, 'lineitem')}),
    ka AS (SELECT l_orderkey k, count(*) n FROM a GROUP BY 1), kb AS (SELECT l_orderkey k, count(*) n FROM b GROUP BY 1)
    SELECT 'A' AS side, CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(CASE WHEN k IS NULL THEN n ELSE 0 END) AS BIGINT) AS nulls,
      CAST(sum(CASE WHEN k IS NOT NULL THEN n - 1 ELSE 0 END) AS BIGINT) AS dupes, count(k) AS distincts,
      count(*) FILTER (WHERE k NOT IN (SELECT k FROM kb)) AS exclusives FROM ka
    UNION ALL SELECT 'B', CAST(sum(n) AS BIGINT), CAST(sum(CASE WHEN k IS NULL THEN n ELSE 0 END) AS BIGINT),
      CAST(sum(CASE WHEN k IS NOT NULL THEN n - 1 ELSE 0 END) AS BIGINT), count(k),
      count(*) FILTER (WHERE k NOT IN (SELECT k FROM ka)) FROM kb""",
)
def key_health(spark, sf):
    return k.key_health(
        side(derive(spark, sf, "lineitem", LINES_A), "l_orderkey", []),
        side(derive(spark, sf, "lineitem", LINES_B), "l_orderkey", []),
    )


@check(
    "K6_column_match",
    MATCHED
    + """SELECT 'o_totalprice' AS column_name, avg(CASE WHEN d1 = 1 THEN 0.0 ELSE 100.0 END::DOUBLE) AS match_percent,
      CAST(sum(d1) AS BIGINT) AS rows_with_differences FROM f WHERE NOT xa AND NOT xb
    UNION ALL SELECT 'o_orderstatus', avg(CASE WHEN d2 = 1 THEN 0.0 ELSE 100.0 END::DOUBLE), CAST(sum(d2) AS BIGINT)
    FROM f WHERE NOT xa AND NOT xb""",
)
def column_match(spark, sf):
    return k.column_match(compared(spark, sf))


@check(
    "K4_assume_unique",
    MATCHED
    + """SELECT count(a0) AS "rows_A", count(b0) AS "rows_B", count(*) FILTER (WHERE xa) AS "exclusive_A", count(*) FILTER (WHERE xb) AS "exclusive_B",
      count(*) FILTER (WHERE NOT xa AND NOT xb AND d1 + d2 > 0) AS updated, count(*) FILTER (WHERE d0 + d1 + d2 = 0) AS unchanged,
      count(*) FILTER (WHERE d0 + d1 + d2 > 0) AS total FROM f""",
)
def assume_unique(spark, sf):
    return jd.join_diff(*sides(spark, sf), validate_unique_key=False).stats()


@check(
    "K8_empty_side",
    f"""WITH a AS ({sql(ORDERS_A, 'orders')})
    SELECT '-' AS sign, CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_totalprice AS VARCHAR) AS o_totalprice, o_orderstatus FROM a""",
)
def empty_side(spark, sf):
    a, b = sides(spark, sf)
    return hash_diff(a, side(b.df, "o_orderkey", COLUMNS, where="o_orderkey < 0"))


@check("K7_row_count", "SELECT count(*) AS n_rows FROM orders WHERE o_orderkey >= 50")
def row_count(spark, sf):
    return k.row_count(side(table(spark, sf, "orders"), "o_orderkey", [], min_key=(50,)))


@check(
    "D12_cell_table",
    MATCHED
    + """, g AS (SELECT *, CASE WHEN xa THEN 'dataset1' WHEN xb THEN 'dataset2' ELSE 'diff' END AS grp FROM f WHERE d0 + d1 + d2 > 0)
    SELECT coalesce(a0, b0) AS o_orderkey, grp AS "group", 'o_orderkey' AS column_name, true AS is_pk, d0 = 1 AS is_diff,
      CAST(a0 AS VARCHAR) AS dataset1, CAST(b0 AS VARCHAR) AS dataset2 FROM g
    UNION ALL SELECT coalesce(a0, b0), grp, 'o_totalprice', false, d1 = 1, CAST(a1 AS VARCHAR), CAST(b1 AS VARCHAR) FROM g
    UNION ALL SELECT coalesce(a0, b0), grp, 'o_orderstatus', false, d2 = 1, a2, b2 FROM g""",
)
def cells_flat(spark, sf):
    return cell_table(compared(spark, sf))


CELL_PAIR = "json_object('isPK', {pk}, 'isDiff', {d} = 1, 'dataset1', {a}, 'dataset2', {b})"
CELL_ONE = "json_object('isPK', {pk}, 'value', {v})"


def _object(cell: str, rows: list[dict]) -> str:
    names = ["o_orderkey", "o_totalprice", "o_orderstatus"]
    return "CAST(json_object(" + ", ".join(f"'{n}', {cell.format(**r)}" for n, r in zip(names, rows)) + ") AS VARCHAR)"


TEXTS = [[f"CAST({s}0 AS VARCHAR)", f"CAST({s}1 AS VARCHAR)", f"{s}2"] for s in "ab"]
PKS = ["true", "false", "false"]


@check(
    "D12_row_json",
    MATCHED
    + f"""SELECT coalesce(a0, b0) AS o_orderkey, CASE WHEN xa THEN 'dataset1' WHEN xb THEN 'dataset2' ELSE 'diff' END AS "group",
      CASE WHEN xa THEN {_object(CELL_ONE, [dict(pk=p, v=v) for p, v in zip(PKS, TEXTS[0])])}
        WHEN xb THEN {_object(CELL_ONE, [dict(pk=p, v=v) for p, v in zip(PKS, TEXTS[1])])}
        ELSE {_object(CELL_PAIR, [dict(pk=p, d=f'd{i}', a=TEXTS[0][i], b=TEXTS[1][i]) for i, p in enumerate(PKS)])} END AS cells
      FROM f WHERE d0 + d1 + d2 > 0""",
)
def rows_as_json(spark, sf):
    return row_json(compared(spark, sf))


@check(
    "D13_cells",
    MATCHED
    + """SELECT a0 AS o_orderkey, 'o_totalprice' AS column_name, CAST(a1 AS VARCHAR) AS source_value, CAST(b1 AS VARCHAR) AS target_value
      FROM f WHERE NOT xa AND NOT xb AND d1 = 1
    UNION ALL SELECT a0, 'o_orderstatus', a2, b2 FROM f WHERE NOT xa AND NOT xb AND d2 = 1""",
)
def cells(spark, sf):
    return compared(spark, sf).cells()

"""Checks: reading and writing."""

from __future__ import annotations

import uuid
from contextlib import suppress
from dataclasses import replace

from pyspark.sql import functions as F

from recon.operators.joindiff import compare_by_key
from recon.plans.compare import Options, compare
from recon.plans.lineage import scratch_path
from recon.sources.readers import connect_to_table, read_files, read_query
from recon.sources.side import side
from recon.sources.store import ResultStore
from recon.sources.writers import create_table_as, drop_table, export_csv, export_jsonl, insert_query, materialize_diff
from recon.suite.inputs import table
from recon.suite.matching import DIFFERENT, FLAT, MATCHED, SIGNED, compared, sides
from recon.suite.registry import check


@check("S1_connect", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def connect(spark, sf):
    return connect_to_table(spark, f"{sf}/customer.parquet", "c_custkey", "parquet", columns=["c_name", "c_mktsegment"]).rows()


FORMATS = ["parquet", "orc", "json", "csv"]


@check(
    "S2_file_formats",
    " UNION ALL ".join(
        f"""SELECT '{f}' AS fmt, count(*) AS n, sum(CAST(c_acctbal AS DECIMAL(12,2))) AS balance, CAST(max(length(c_name)) AS INTEGER) AS longest FROM customer"""
        for f in FORMATS
    ),
)
def file_formats(spark, sf):
    t, out = table(spark, sf, "customer"), None
    for fmt in FORMATS:
        path = scratch_path(spark, f"customer-{fmt}")
        t.write.format(fmt).save(path)
        back = read_files(spark, path, fmt, schema=t.schema)
        one = back.agg(
            F.lit(fmt).alias("fmt"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("c_acctbal").cast("decimal(12,2)")).cast("decimal(38,2)").alias("balance"),
            F.max(F.length("c_name")).alias("longest"),
        )
        out = one if out is None else out.unionByName(one)
    return out


PER_ORDER = "SELECT l_orderkey, count(*) AS n_lines, sum(CAST(l_quantity AS DECIMAL(12,2))) AS quantity FROM {t} %s GROUP BY l_orderkey"


@check(
    "S4_query_result",
    f"""WITH a AS ({(PER_ORDER % '').replace('{t}', 'lineitem')}), b AS ({(PER_ORDER % 'WHERE l_linenumber < 7').replace('{t}', 'lineitem')})
    SELECT count(a.l_orderkey) AS "rows_A", count(b.l_orderkey) AS "rows_B", count(*) FILTER (WHERE b.l_orderkey IS NULL) AS "exclusive_A",
      count(*) FILTER (WHERE a.l_orderkey IS NULL) AS "exclusive_B",
      count(*) FILTER (WHERE a.l_orderkey = b.l_orderkey AND (a.n_lines <> b.n_lines OR a.quantity <> b.quantity)) AS updated,
      count(*) FILTER (WHERE a.l_orderkey = b.l_orderkey AND a.n_lines = b.n_lines AND a.quantity = b.quantity) AS unchanged,
      count(*) FILTER (WHERE a.l_orderkey IS NULL OR b.l_orderkey IS NULL OR a.n_lines <> b.n_lines OR a.quantity <> b.quantity) AS total
    FROM a FULL OUTER JOIN b ON a.l_orderkey = b.l_orderkey""",
)
def query_result(spark, sf):
    t = table(spark, sf, "lineitem")
    a, b = (side(read_query(spark, PER_ORDER % w, t=t), "l_orderkey") for w in ("", "WHERE l_linenumber < 7"))
    return compare_by_key(a, b).stats()


@check("S5_materialized_diff", MATCHED + FLAT + DIFFERENT)
def materialized(spark, sf):
    return materialize_diff(compared(spark, sf), scratch_path(spark, "diff"), limit=None)


@check("S6_materialized_rows", MATCHED + FLAT)
def materialized_rows(spark, sf):
    return materialize_diff(compared(spark, sf), scratch_path(spark, "rows"), all_rows=True)


@check(
    "S7_difference_details",
    MATCHED
    + """, d AS (SELECT *, coalesce(a0, b0) AS k FROM f WHERE d0 + d1 + d2 > 0),
    j AS (SELECT *, concat('{"o_orderkey":', k, '}') AS row_key FROM d)
    SELECT row_key, 'value_different' AS difference_type, 'medium' AS severity, 'o_totalprice' AS column_name, CAST(a1 AS VARCHAR) AS source_value,
      CAST(b1 AS VARCHAR) AS target_value FROM j WHERE NOT xa AND NOT xb AND d1 = 1
    UNION ALL SELECT row_key, 'value_different', 'medium', 'o_orderstatus', coalesce(a2, ''), coalesce(b2, '') FROM j WHERE NOT xa AND NOT xb AND d2 = 1
    UNION ALL SELECT row_key, 'missing_in_target', 'high', NULL, concat('{"o_orderkey":"', a0, '","o_totalprice":"', a1, '","o_orderstatus":"', a2, '"}'), ''
      FROM j WHERE xa
    UNION ALL SELECT row_key, 'missing_in_source', 'high', NULL, '', concat('{"o_orderkey":"', b0, '","o_totalprice":"', b1, '","o_orderstatus":"', b2, '"}')
      FROM j WHERE xb""",
)
def difference_details(spark, sf):
    store = compare(*sides(spark, sf), Options(assume_unique_key=True)).save(scratch_path(spark, "store"), "one")
    shown = ["row_key", "difference_type", "severity", "column_name", "source_value", "target_value"]
    return store.read("difference_details").select(*shown)


@check(
    "S7_summary",
    MATCHED
    + """, c AS (SELECT greatest(count(a0), count(b0)) AS n, count(*) FILTER (WHERE d0 + d1 + d2 > 0) AS d FROM f)
    SELECT 'orders' AS source_table, 'orders_b' AS target_table, 'join' AS algorithm, n AS rows_compared, n - d AS rows_matched, d AS rows_different,
      CAST(round(100 * (1 - d / n), 2) AS DECIMAL(5,2)) AS match_rate, 'completed' AS status FROM c""",
)
def stored_summary(spark, sf):
    store = compare(*sides(spark, sf), Options(assume_unique_key=True)).save(scratch_path(spark, "store"), "one")
    return store.read("comparison_summary").select(
        "source_table", "target_table", "algorithm", "rows_compared", "rows_matched", "rows_different", "match_rate", "status"
    )


@check(
    "S7_failed_run",
    "SELECT 'orders' AS source_table, 'failed' AS status, true AS told, count(*) AS rows_tried FROM orders GROUP BY ALL",
)
def failed_run(spark, sf):
    """A run that breaks leaves its message behind."""
    a, b = sides(spark, sf)
    broken = replace(b, df=b.df.withColumn("o_totalprice", F.expr("CAST(raise_error('broken price') AS DECIMAL(12,2))")))
    path = scratch_path(spark, "store")
    with suppress(Exception):
        compare(a, broken, Options(assume_unique_key=True, skip_null_keys=True)).save(path, "one")
    told = ResultStore(spark, path).read("comparison_summary").select(
        "source_table", "status", F.contains("error_message", F.lit("broken price")).alias("told")
    )
    return told.join(F.broadcast(a.df.agg(F.count(F.lit(1)).alias("rows_tried"))), F.lit(True), "left")


@check(
    "S7_column_statistics",
    """WITH a AS (SELECT o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1)
    SELECT 'o_orderstatus' AS column_name, count(*) AS n_values, CAST(sum(n) AS BIGINT) AS n_rows FROM a""",
)
def stored_statistics(spark, sf):
    """The stored value distribution of a column, read back from its JSON."""
    options = Options(assume_unique_key=True, profile_columns=True)
    store = compare(*sides(spark, sf), options).save(scratch_path(spark, "store"), "one")
    mine = store.read("column_statistics").where("table_side = 'source' AND column_name = 'o_orderstatus'")
    values = F.from_json("value_distribution", "array<struct<value string, n long>>")
    return mine.select("column_name", F.explode(values).alias("v")).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_values"), F.sum("v.n").alias("n_rows")
    )


@check(
    "S9_json_lines",
    MATCHED
    + f""", g AS ({SIGNED}) SELECT concat('["', sign, '",["', o_orderkey, '","', o_totalprice, '",',
      CASE WHEN o_orderstatus IS NULL THEN 'null' ELSE concat('"', o_orderstatus, '"') END, ']]') AS value FROM g""",
)
def json_lines(spark, sf):
    path = scratch_path(spark, "jsonl")
    export_jsonl(compared(spark, sf).signed_rows(), path)
    return spark.read.text(path)


ROW_JSON = """concat('{"o_orderkey":"', {s}0, '","o_totalprice":"', {s}1, '"', CASE WHEN {s}2 IS NULL THEN '' ELSE concat(',"o_orderstatus":"', {s}2, '"') END, '}')"""


@check(
    "H2_details",
    MATCHED
    + """, d AS (SELECT *, coalesce(a0, b0) AS k FROM f WHERE d0 + d1 + d2 > 0),
    j AS (SELECT *, concat('{"o_orderkey":', k, '}') AS row_key FROM d),
    c AS (SELECT row_key, 'o_totalprice' AS column_name, 'value_different' AS difference_type FROM j WHERE NOT xa AND NOT xb AND d1 = 1
      UNION ALL SELECT row_key, 'o_orderstatus', 'value_different' FROM j WHERE NOT xa AND NOT xb AND d2 = 1
      UNION ALL SELECT row_key, NULL, CASE WHEN xa THEN 'missing_in_target' ELSE 'missing_in_source' END FROM j WHERE xa OR xb)
    SELECT * FROM c""",
)
def details(spark, sf):
    store = compare(*sides(spark, sf), Options(assume_unique_key=True)).save(scratch_path(spark, "store"), "one")
    return store.details("one")["difference_details"].select("row_key", "column_name", "difference_type")


@check(
    "S10_create_insert",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
)
def create_insert(spark, sf):
    """A table from a query, then an insert from another; read back from its folder."""
    t, path, name = table(spark, sf, "orders"), scratch_path(spark, "managed"), f"recon_{uuid.uuid4().hex}"
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    create_table_as(t.where("o_orderstatus = 'F'").select(*columns), name, path=path)
    insert_query(t.where("o_orderstatus IS DISTINCT FROM 'F'").select(*columns), name)
    drop_table(spark, name)
    return spark.read.parquet(path)


@check(
    "S9_csv",
    MATCHED
    + """SELECT CASE WHEN xa THEN 'missing_in_target' WHEN xb THEN 'missing_in_source' ELSE 'value_different' END AS type,
      concat('{"o_orderkey":', coalesce(a0, b0), '}') AS key,"""
    + f"CASE WHEN NOT xb THEN {ROW_JSON.replace('{s}', 'a')} END AS source_values, CASE WHEN NOT xa THEN {ROW_JSON.replace('{s}', 'b')} END AS target_values,"
    + """nullif(CASE WHEN xa OR xb THEN '' ELSE concat_ws(',', CASE WHEN d1 = 1 THEN 'o_totalprice' END, CASE WHEN d2 = 1 THEN 'o_orderstatus' END) END, '')
      AS differing_columns FROM f WHERE d0 + d1 + d2 > 0""",
)
def csv(spark, sf):
    path = scratch_path(spark, "csv")
    export_csv(compared(spark, sf), path)
    return spark.read.option("header", True).option("escape", '"').csv(path)

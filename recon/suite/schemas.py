"""Checks: what columns hold and how their types are named, found from the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from recon.operators import schema as sc
from recon.plans.lineage import scratch_path
from recon.sources.catalog import list_columns
from recon.sources.side import side
from recon.sources.store import ResultStore
from recon.suite.inputs import CUSTOMERS_A, CUSTOMERS_RELEASE, derive, sql, table
from recon.suite.registry import check

UUIDS = """SELECT c_custkey, concat(substr(md5(c_name), 1, 8), '-', substr(md5(c_name), 9, 4), '-', substr(md5(c_name), 13, 4), '-',
  substr(md5(c_name), 17, 4), '-', substr(md5(c_name), 21, 12)) AS uuid_lower,
  upper(concat(substr(md5(c_name), 1, 8), '-', substr(md5(c_name), 9, 4), '-', substr(md5(c_name), 13, 4), '-',
  substr(md5(c_name), 17, 4), '-', substr(md5(c_name), 21, 12))) AS uuid_upper, c_mktsegment, c_name FROM {t}"""
RX_UUID = r"^\s*[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\s*$"
RX_ALNUM = r"^[ \-0-9A-Z_a-z]+$"
TEXTS = ["uuid_lower", "uuid_upper", "c_mktsegment", "c_name"]


def _kind_sql(c: str) -> str:
    u, n = f"count(*) FILTER (WHERE regexp_matches({c}, '{RX_UUID}'))", f"count(*) FILTER (WHERE regexp_matches({c}, '{RX_ALNUM}'))"
    each = f"FILTER (WHERE regexp_matches({c}, '{RX_UUID}'))"
    return f"""SELECT '{c}' AS column_name, CASE WHEN {u} = count(*) THEN 'uuid' WHEN {u} > 0 THEN 'mixed_uuid' WHEN {n} = count(*) THEN 'alphanumeric'
      ELSE 'text' END AS kind, coalesce(bool_and({c} = lower({c})) {each}, false) AS all_lowercase,
      coalesce(bool_and({c} = upper({c})) {each}, false) AS all_uppercase FROM u"""


@check("C14_text_kinds", f"WITH u AS ({sql(UUIDS, 'customer')}) " + " UNION ALL ".join(_kind_sql(c) for c in TEXTS))
def text_kinds(spark, sf):
    return sc.text_kinds(derive(spark, sf, "customer", UUIDS), TEXTS)


# Type names found row by row, with the number of values that carry them.
TYPE_CASE = """CASE upper(regexp_replace(t, '\\(.*', '')) WHEN 'INTEGER' THEN 'INT' WHEN 'VARCHAR' THEN 'STRING' ELSE upper(regexp_replace(t, '\\(.*', '')) END"""


def _typed(spark, sf, text):
    df = derive(spark, sf, "customer", text)
    items = [F.struct(F.lit(c).alias("column_name"), F.typeof(c).alias("t"), F.col(c).isNotNull().alias("has")) for c in df.columns]
    cells = df.select(F.explode(F.array(*items)).alias("c")).select("c.*")
    return cells.groupBy("column_name", sc.normalized_type(F.col("t")).alias("type_name")).agg(F.count_if("has").alias("n_values"))


def _typed_sql(name: str, columns: list[str]) -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS column_name, typeof({c}) AS t, {c} IS NOT NULL AS has FROM {name}" for c in columns)
    return f"SELECT column_name, {TYPE_CASE} AS type_name, count(*) FILTER (WHERE has) AS n_values FROM ({parts}) GROUP BY 1, 2"


OLD = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
NEW = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment", "tier"]
SCHEMAS = f"WITH a AS ({sql(CUSTOMERS_A, 'customer')}), b AS ({sql(CUSTOMERS_RELEASE, 'customer')}) "


@check("X2_type_names", SCHEMAS + _typed_sql("a", OLD))
def type_names(spark, sf):
    return _typed(spark, sf, CUSTOMERS_A)


@check(
    "X1_schema_diff",
    SCHEMAS
    + f""", ta AS ({_typed_sql('a', OLD)}), tb AS ({_typed_sql('b', NEW)})
    SELECT coalesce(ta.column_name, tb.column_name) AS column_name, ta.type_name AS source_type, tb.type_name AS target_type,
      ta.n_values AS source_values, tb.n_values AS target_values, CASE WHEN tb.column_name IS NULL THEN 'only_in_source'
      WHEN ta.column_name IS NULL THEN 'only_in_target' ELSE 'type_changed' END AS difference_type
    FROM ta FULL OUTER JOIN tb ON ta.column_name = tb.column_name WHERE ta.type_name IS DISTINCT FROM tb.type_name""",
)
def schema_diff(spark, sf):
    old, new = _typed(spark, sf, CUSTOMERS_A), _typed(spark, sf, CUSTOMERS_RELEASE)
    frame = lambda t: t.select(F.lit("customer").alias("table_name"), "column_name", F.col("type_name").alias("data_type"))
    found = sc.schema_diff(frame(old), frame(new)).drop("table_name")
    counts = old.select("column_name", F.col("n_values").alias("source_values")).join(
        new.select("column_name", F.col("n_values").alias("target_values")), "column_name", "full_outer"
    )
    return found.join(counts, "column_name")


SOURCE_TABLES = {
    "customer": (CUSTOMERS_A, OLD),
    "region": ("SELECT r_regionkey, r_name FROM {t}", ["r_regionkey", "r_name"]),
    "part": ("SELECT p_partkey, p_name, p_size FROM {t}", ["p_partkey", "p_name", "p_size"]),
}
TARGET_TABLES = {
    "customer": (CUSTOMERS_RELEASE, NEW),
    "region": SOURCE_TABLES["region"],
    "supplier": ("SELECT s_suppkey, s_name FROM {t}", ["s_suppkey", "s_name"]),
}


def _catalog_of(spark, sf, tables):
    """Type names found in the rows of several tables."""
    out = None
    for name, (text, columns) in tables.items():
        df = derive(spark, sf, name, text)
        items = [F.struct(F.lit(c).alias("column_name"), F.typeof(c).alias("t")) for c in columns]
        cells = df.select(F.explode(F.array(*items)).alias("c")).select(F.lit(f"shop.{name}").alias("qualified"), "c.*")
        out = cells if out is None else out.unionByName(cells)
    found = out.groupBy("qualified", "column_name", sc.normalized_type(F.col("t")).alias("data_type")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.element_at(F.split("qualified", "[.]"), -1).alias("table_name"), "column_name", "data_type")


def _catalog_sql(tables) -> str:
    parts = [
        f"SELECT '{n}' AS table_name, '{c}' AS column_name, typeof({c}) AS t FROM ({sql(text, n)})"
        for n, (text, columns) in tables.items()
        for c in columns
    ]
    return f"SELECT DISTINCT table_name, column_name, {TYPE_CASE} AS type_name FROM ({' UNION ALL '.join(parts)})"


CATALOG = f"""WITH s AS ({_catalog_sql(SOURCE_TABLES)}), t AS ({_catalog_sql(TARGET_TABLES)}),
 d AS (SELECT table_name, NULL AS column_name, NULL AS source_type, NULL AS target_type, 'table_only_in_source' AS difference_type
    FROM (SELECT table_name FROM s EXCEPT SELECT table_name FROM t)
  UNION ALL SELECT table_name, NULL, NULL, NULL, 'table_only_in_target' FROM (SELECT table_name FROM t EXCEPT SELECT table_name FROM s)
  UNION ALL SELECT table_name, column_name, s.type_name, t.type_name, CASE WHEN t.type_name IS NULL THEN 'only_in_source'
      WHEN s.type_name IS NULL THEN 'only_in_target' ELSE 'type_changed' END
    FROM s FULL OUTER JOIN t USING (table_name, column_name) WHERE s.type_name IS DISTINCT FROM t.type_name
    AND table_name IN (SELECT table_name FROM s INTERSECT SELECT table_name FROM t)) """


@check("X3_catalog_diff", CATALOG + "SELECT * FROM d")
def catalog_diff(spark, sf):
    return sc.catalog_diff(_catalog_of(spark, sf, SOURCE_TABLES), _catalog_of(spark, sf, TARGET_TABLES))


@check(
    "X3_catalog_summary",
    CATALOG
    + """, n AS (SELECT count(*) FILTER (WHERE difference_type LIKE 'table_only%') AS table_differences,
      count(DISTINCT table_name) FILTER (WHERE difference_type IN ('only_in_source', 'only_in_target')) AS column_differences,
      count(DISTINCT table_name) FILTER (WHERE difference_type = 'type_changed') AS type_differences FROM d)
    SELECT *, table_differences + column_differences + type_differences AS total_differences,
      table_differences + column_differences + type_differences = 0 AS schemas_identical FROM n""",
)
def catalog_summary(spark, sf):
    return sc.catalog_summary(catalog_diff(spark, sf))


@check("S8_schema_results", CATALOG + "SELECT 'one' AS comparison_id, * FROM d WHERE column_name IS NOT NULL")
def schema_results(spark, sf):
    store = ResultStore(spark, scratch_path(spark, "schemas"))
    diff = catalog_diff(spark, sf)
    store.save("schema_table_differences", "one", diff.where("column_name IS NULL"))
    store.save("schema_column_differences", "one", diff.where("column_name IS NOT NULL"))
    store.save("schema_comparison_summary", "one", sc.catalog_summary(diff).withColumn("status", F.lit("completed")))
    return store.read("schema_column_differences").drop("created_at")


@check(
    "S3_columns",
    """SELECT table_name, column_name, position, n_values FROM (VALUES ('labels', 'doc_id', 1), ('labels', 'quality', 2), ('labels', 'toxic', 3))
      v(table_name, column_name, position), (SELECT count(*) AS n_values FROM labels)""",
)
def listed_columns(spark, sf):
    """Columns as the catalog lists them, with the number of values in each."""
    labels = table(spark, sf, "labels")
    labels.createOrReplaceTempView("labels_listed")
    counts = labels.agg(F.array(*[F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n_values")) for c in labels.columns]).alias("a"))
    counts = counts.select(F.explode("a").alias("x")).select("x.*")
    listed = list_columns(spark, "labels_listed").select(F.lit("labels").alias("table_name"), "column_name", "position")
    return listed.join(counts, "column_name").select("table_name", "column_name", "position", "n_values")


LEFT_TYPES = """SELECT event_id, CAST(ts AS TIMESTAMP_LTZ) AS ts, CAST(value AS DECIMAL(12,2)) AS value, event_type,
  map(event_type, user_id) AS tags, user_id FROM {t}"""
RIGHT_TYPES = """SELECT event_id, ts, CAST(value AS DECIMAL(14,3)) AS value, map(event_type, user_id) AS tags, user_id, event_type FROM {t}"""


def _typed_sides(spark, sf):
    columns = ["ts", "value", "tags", "event_type"]
    left, right = derive(spark, sf, "events", LEFT_TYPES), derive(spark, sf, "events", RIGHT_TYPES)
    return side(left, "event_id", columns), side(right, "event_id", columns)


@check(
    "C13_unsupported_types",
    "SELECT side, 'tags' AS column_name, count(*) AS n_values FROM events, (VALUES ('A'), ('B')) v(side) GROUP BY side",
)
def unsupported(spark, sf):
    """Columns without a normal form, and how many values they keep out of the comparison."""
    a, b = _typed_sides(spark, sf)
    return sc.affected_values(sc.unsupported_types(spark, a, b), a).select("side", "column_name", "n_values")


@check(
    "T4_zone_warnings",
    "SELECT 'ts' AS column_name, 'millisecond' AS recommended_precision, count(ts) AS n_values FROM events",
)
def zones(spark, sf):
    a, b = _typed_sides(spark, sf)
    return sc.affected_values(sc.zone_warnings(spark, a, b), a).select("column_name", "recommended_precision", "n_values")


@check(
    "X4_attribute_warnings",
    """WITH n AS (SELECT count(value) AS nv, count(ts) AS nt FROM events)
    SELECT 'value' AS column_name, 'numeric_precision' AS attribute, '12' AS source, '14' AS target, nv AS n_values FROM n
    UNION ALL SELECT 'value', 'numeric_scale', '2', '3', nv FROM n
    UNION ALL SELECT 'value', 'data_type', 'decimal(12,2)', 'decimal(14,3)', nv FROM n
    UNION ALL SELECT 'ts', 'data_type', 'timestamp', 'timestamp_ntz', nt FROM n""",
)
def attributes(spark, sf):
    a, b = _typed_sides(spark, sf)
    found = sc.attribute_warnings(sc.schema_frame(spark, a.df.schema), sc.schema_frame(spark, b.df.schema))
    return sc.affected_values(found, a)


@check(
    "X5_column_kinds",
    """SELECT column_name, kind, n_values FROM (VALUES ('event_id', 'integer'), ('ts', 'datetime'), ('value', 'float'), ('tags', 'unsupported'),
      ('event_type', 'string')) v(column_name, kind), (SELECT count(*) AS n_values FROM events)""",
)
def kinds(spark, sf):
    a, _ = _typed_sides(spark, sf)
    named = sc.schema_frame(spark, a.rows().schema).select("column_name", "kind")
    return sc.affected_values(named, a)


@check(
    "X6_layout_changes",
    """SELECT 6::BIGINT AS columns_a, 6::BIGINT AS columns_b, 0::BIGINT AS only_in_a, 0::BIGINT AS only_in_b,
      2::BIGINT AS column_type_mismatches, 3::BIGINT AS column_reorders, count(*) AS n_rows FROM events""",
)
def layout(spark, sf):
    a, b = _typed_sides(spark, sf)
    changes = sc.layout_changes(sc.schema_frame(spark, a.df.schema), sc.schema_frame(spark, b.df.schema))
    columns = changes.columns
    # The one row of changes next to the number of rows they concern.
    counted = a.rows().agg(F.count(F.lit(1)).alias("n_rows"))
    both = changes.unionByName(counted, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in [*columns, "n_rows"]])

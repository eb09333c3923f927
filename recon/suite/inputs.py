"""Inputs of the checks: the given tables and changed copies derived from them.

Each copy is one SQL text that Spark and the SQL twin both run, so
the two sides of a check always see the same data. `{t}` stands for the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORDERS_A = """
SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice,
       o_orderdate, o_orderpriority
FROM {t}"""

ORDERS_B = """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderkey % 79 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
       CAST(CASE WHEN o_orderkey % 89 = 0 THEN o_totalprice + 1
                 WHEN o_orderkey % 83 = 0 THEN o_totalprice + 0.01
                 ELSE o_totalprice END AS DECIMAL(12,2)) AS o_totalprice,
       CASE WHEN o_orderkey % 67 = 0 THEN o_orderdate + INTERVAL 1 MILLISECOND
            WHEN o_orderkey % 61 = 0 THEN o_orderdate + INTERVAL 1 HOUR
            ELSE o_orderdate END AS o_orderdate,
       CASE WHEN o_orderkey % 73 = 0 THEN lower(o_orderpriority)
            WHEN o_orderkey % 71 = 0 THEN concat(o_orderpriority, ' ')
            ELSE o_orderpriority END AS o_orderpriority
FROM {t} WHERE o_orderkey % 97 <> 0
UNION ALL
SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(12,2)), o_orderdate, o_orderpriority
FROM {t} WHERE o_orderkey % 101 = 0"""

EVENTS_A = """
SELECT event_id, ts, user_id, event_type, CAST(value AS DECIMAL(12,2)) AS value, props
FROM {t}"""

EVENTS_B = """
SELECT event_id,
       CASE WHEN event_id % 67 = 0 THEN ts + INTERVAL 1 MILLISECOND
            WHEN event_id % 61 = 0 THEN ts + INTERVAL 1 HOUR ELSE ts END AS ts,
       user_id,
       CASE WHEN event_id % 73 = 0 THEN upper(event_type)
            WHEN event_id % 71 = 0 THEN concat(event_type, ' ') ELSE event_type END AS event_type,
       CAST(CASE WHEN event_id % 89 = 0 THEN value + 1
                 WHEN event_id % 83 = 0 THEN value + 0.01
                 WHEN event_id % 79 = 0 THEN NULL ELSE value END AS DECIMAL(12,2)) AS value,
       CASE WHEN event_id % 59 = 0 THEN replace(props, ': ', ':')
            WHEN event_id % 53 = 0 THEN replace(props, 'k', 'z') ELSE props END AS props
FROM {t} WHERE event_id % 97 <> 0
UNION ALL
SELECT event_id + 10000000, ts, user_id, event_type, CAST(value AS DECIMAL(12,2)), props
FROM {t} WHERE event_id % 101 = 0"""

# Keys of this table repeat.
LINES_A = """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS DECIMAL(12,2)) AS l_quantity, l_returnflag
FROM {t}"""

LINES_B = """
SELECT l_orderkey, l_linenumber, l_partkey,
       CAST(CASE WHEN l_orderkey % 89 = 0 THEN l_quantity + 1 ELSE l_quantity END AS DECIMAL(12,2)) AS l_quantity,
       CASE WHEN l_orderkey % 79 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag
FROM {t} WHERE l_partkey % 97 <> 0"""

# Two key columns.
TURNS_A = "SELECT conv_id, turn, role, text FROM {t}"
TURNS_B = """
SELECT conv_id, turn, CASE WHEN conv_id % 13 = 0 THEN upper(role) ELSE role END AS role,
       CASE WHEN conv_id % 7 = 0 THEN concat(text, '!') ELSE text END AS text
FROM {t} WHERE (conv_id + turn) % 11 <> 0
UNION ALL
SELECT conv_id + 1000000, turn, role, text FROM {t} WHERE conv_id % 17 = 0"""

# NULL keys on both sides.
NULLKEYS_A = """
SELECT CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE c_custkey END AS c_custkey, c_name, c_mktsegment FROM {t}"""
NULLKEYS_B = """
SELECT CASE WHEN c_custkey % 10 = 4 THEN NULL ELSE c_custkey END AS c_custkey, c_name,
       CASE WHEN c_custkey % 7 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment FROM {t}"""

# Customers with a renamed, a retyped, a dropped and an added column.
CUSTOMERS_A = """
SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DECIMAL(12,2)) AS c_acctbal, c_mktsegment FROM {t}"""
CUSTOMERS_RENAMED = """
SELECT c_custkey, c_name AS full_name, c_nationkey,
       CAST(CASE WHEN c_custkey % 89 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS DECIMAL(12,2)) AS balance,
       CASE WHEN c_custkey % 31 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment
FROM {t} WHERE c_custkey % 97 <> 0"""
CUSTOMERS_RELEASE = """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey,
       CASE WHEN c_custkey % 31 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment,
       c_custkey % 5 AS tier
FROM {t} WHERE c_custkey % 97 <> 0
UNION ALL
SELECT c_custkey + 10000000, c_name, CAST(c_nationkey AS BIGINT), c_mktsegment, c_custkey % 5 FROM {t} WHERE c_custkey % 101 = 0"""

# Comparison histories, one run per order (or per event).
HISTORY = """
SELECT CAST(o_orderkey AS STRING) AS comparison_id, o_orderpriority AS source_table,
       concat(o_orderpriority, '_copy') AS target_table, 'join' AS algorithm,
       o_orderdate AS start_time, o_orderdate + INTERVAL 1 HOUR AS end_time,
       CAST(o_orderkey % 500 AS DOUBLE) / 7 AS execution_time_seconds,
       o_custkey + 1000 AS rows_compared, o_custkey % 100 AS rows_different,
       CAST(o_orderkey % 801 AS DOUBLE) / 8 AS match_rate,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
       o_orderdate AS created_at
FROM {t}"""

SCHEMA_HISTORY = """
SELECT CAST(event_id AS STRING) AS comparison_id, event_type AS source_schema, concat(event_type, '_next') AS target_schema,
       ts AS start_time, CAST(user_id AS DOUBLE) / 8 AS execution_time_seconds, user_id % 5 AS total_differences,
       CASE user_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'running' ELSE 'failed' END AS status, ts AS created_at
FROM {t}"""

METRICS = "SELECT event_type AS metric_name, value AS metric_value, ts AS recorded_at FROM {t}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, name: str, text: str) -> DataFrame:
    """Run one of the texts above on a given table."""
    return spark.sql(text, t=table(spark, sf_dir, name))


def sql(text: str, name: str) -> str:
    """The same text for the SQL side."""
    return text.replace("{t}", name)

"""Where sides come from."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from recon.sources.side import TableSide, side

FILE_FORMATS = ("parquet", "orc", "csv", "json", "avro", "text")

# JDBC driver classes and URL prefixes of the supported databases.
JDBC_DRIVERS = {
    "postgresql": ("org.postgresql.Driver", "jdbc:postgresql://"),
    "mysql": ("com.mysql.cj.jdbc.Driver", "jdbc:mysql://"),
    "oracle": ("oracle.jdbc.OracleDriver", "jdbc:oracle:thin:@//"),
    "redshift": ("com.amazon.redshift.jdbc42.Driver", "jdbc:redshift://"),
    "snowflake": ("net.snowflake.client.jdbc.SnowflakeDriver", "jdbc:snowflake://"),
    "presto": ("com.facebook.presto.jdbc.PrestoDriver", "jdbc:presto://"),
    "trino": ("io.trino.jdbc.TrinoDriver", "jdbc:trino://"),
    "bigquery": ("com.simba.googlebigquery.jdbc.Driver", "jdbc:bigquery://"),
    "databricks": ("com.databricks.client.jdbc.Driver", "jdbc:databricks://"),
    "duckdb": ("org.duckdb.DuckDBDriver", "jdbc:duckdb:"),
    "clickhouse": ("com.clickhouse.jdbc.ClickHouseDriver", "jdbc:clickhouse://"),
    "vertica": ("com.vertica.jdbc.Driver", "jdbc:vertica://"),
    "mssql": ("com.microsoft.sqlserver.jdbc.SQLServerDriver", "jdbc:sqlserver://"),
}


def read_files(spark: SparkSession, path: str, fmt: str = "parquet", schema: Any = None, **options: str) -> DataFrame:
    """A file-based table. Text formats should come with a schema, so no pass is spent on guessing it."""
    if fmt not in FILE_FORMATS:
        raise ValueError(f"unknown format {fmt!r}; expected one of {FILE_FORMATS}")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table or view."""
    return spark.table(name)


def read_query(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """The result of a query; frames are available as `{name}` in its text."""
    return spark.sql(sql, **frames) if frames else spark.sql(sql)


def jdbc_options(
    kind: str,
    location: str,
    table: str,
    *,
    partition_column: str | None = None,
    bounds: tuple[Any, Any] | None = None,
    partitions: int = 32,
    fetch_size: int = 10_000,
    **extra: str,
) -> dict[str, str]:
    """JDBC reader options; with a partition column the read is split into key ranges."""
    if kind in JDBC_DRIVERS:
        driver, prefix = JDBC_DRIVERS[kind]
    elif "driver" in extra and location.startswith("jdbc:"):
        driver, prefix = extra["driver"], ""  # any other database: full URL and driver class
    else:
        raise ValueError(f"unknown database {kind!r}; known: {', '.join(sorted(JDBC_DRIVERS))}")
    options = {
        "driver": driver,
        "url": f"{prefix}{location}",
        "dbtable": table,
        "fetchsize": str(fetch_size),
        "pushDownPredicate": "true",
        **extra,
    }
    if partition_column is not None:
        if bounds is None:
            raise ValueError("a partition column needs bounds (see read_jdbc)")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(
    spark: SparkSession, kind: str, location: str, table: str, *, partition_column: str | None = None, partitions: int = 32, **extra: str
) -> DataFrame:
    """A database table, read in parallel key ranges whose limits the database reports."""
    bounds = None
    if partition_column is not None:
        ask = f"(select min({partition_column}) lo, max({partition_column}) hi from {table}) bounds"
        row = spark.read.format("jdbc").options(**jdbc_options(kind, location, ask, **extra)).load().first()
        bounds = (row[0], row[1]) if row and row[0] is not None else None
    options = jdbc_options(
        kind,
        location,
        table,
        partition_column=partition_column if bounds else None,
        bounds=bounds,
        partitions=partitions,
        **extra,
    )
    return spark.read.format("jdbc").options(**options).load()


def connect_to_table(
    spark: SparkSession, source: str | DataFrame, keys: str | Sequence[str] = "id", fmt: str | None = None, **options: Any
) -> TableSide:
    """A side from a DataFrame, a file path (with `fmt`) or a catalog table name."""
    if isinstance(source, DataFrame):
        df = source
    elif fmt:
        df = read_files(spark, source, fmt)
    else:
        df = read_table(spark, source)
    return side(df, keys, **options)

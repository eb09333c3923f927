"""Catalog listings as DataFrames (S3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def list_tables(spark: SparkSession, database: str | None = None, pattern: str | None = None) -> DataFrame:
    """Tables and views: name, database, type, temporary or not."""
    rows = [
        (t.name, ".".join(t.namespace or []), t.tableType, t.isTemporary)
        for t in spark.catalog.listTables(database, pattern)
    ]
    return spark.createDataFrame(rows, "table_name string, database string, table_type string, is_temporary boolean")


def list_columns(spark: SparkSession, table: str, database: str | None = None) -> DataFrame:
    """Columns of a table: name, type, position, nullable."""
    rows = [
        (table, c.name, c.dataType, i, c.nullable)
        for i, c in enumerate(spark.catalog.listColumns(table, database), start=1)
    ]
    return spark.createDataFrame(
        rows, "table_name string, column_name string, data_type string, position int, nullable boolean"
    )

"""Sinks for differences and small table management."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from recon.operators.joindiff import Compared
from recon.operators.output import csv_fields, json_lines

# Fixed value: rows per insert.
INSERT_BATCH = 8_192


def materialize_diff(
    compared: Compared, path: str, *, limit: int | None = None, all_rows: bool = False, fmt: str = "parquet"
) -> DataFrame:
    """Replace the table at `path` by the differing (or all matched) rows; returns the frame read back.

    All rows are written unless a limit is asked for; it picks the first rows by key, so repeated runs write the same rows.
    """
    rows = compared.all_rows() if all_rows else compared.diff_rows()
    if limit is not None and not all_rows:
        keys = [f"{p[0]}_a" for p in compared.pairs[: compared.key_count]]
        keys += [f"{p[1]}_b" for p in compared.pairs[: compared.key_count]]
        rows = rows.orderBy(*keys).limit(limit)
    rows.write.mode("overwrite").format(fmt).save(path)
    return compared.matched.sparkSession.read.format(fmt).load(path)


def export_jsonl(diff: DataFrame, path: str) -> None:
    """Signed rows as JSON lines, written by all tasks in parallel."""
    json_lines(diff).write.mode("overwrite").text(path)


def export_csv(compared: Compared, path: str) -> None:
    """Differences as CSV with a header."""
    csv_fields(compared).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def create_table(spark: SparkSession, name: str, schema: str) -> None:
    """An empty table."""
    spark.createDataFrame([], schema).write.mode("ignore").saveAsTable(name)


def insert_rows(spark: SparkSession, name: str, rows: Iterable[Sequence[Any]], batch: int = INSERT_BATCH) -> int:
    """Append literal rows in batches; returns how many were written."""
    schema, it, total = spark.table(name).schema, iter(rows), 0
    while chunk := list(islice(it, batch)):
        spark.createDataFrame(chunk, schema).write.insertInto(name)
        total += len(chunk)
    return total


def insert_query(df: DataFrame, name: str) -> None:
    """Append a query result."""
    df.write.insertInto(name)


def create_table_as(
    df: DataFrame, name: str, keys: Sequence[str] = (), buckets: int = 0, path: str | None = None
) -> None:
    """Table from a query, kept at `path` if given. Bucketed by the keys, later comparisons on them need no shuffle."""
    writer = df.write.mode("overwrite")
    if path:
        writer = writer.option("path", path)
    if keys and buckets:
        writer = writer.bucketBy(buckets, *keys).sortBy(*keys)
    writer.saveAsTable(name)


def truncate_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE {name}")


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def temp_view(df: DataFrame, name: str) -> None:
    """Temporary table for the session."""
    df.createOrReplaceTempView(name)

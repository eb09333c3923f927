"""Register runnable checks: a Spark query, and where possible the same query in plain SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Check:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(name: str, sql: str | None = None):
    """Decorator: `sql` runs on views named like the tables and must give the same rows."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        if name in CHECKS:
            raise ValueError(f"check {name} registered twice")
        CHECKS[name] = Check(name, build, sql)
        return build

    return add

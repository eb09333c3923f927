"""Thin relational helpers for queries built by name.

The DataFrame API is the query language; these wrap only what needs a rule of
its own.
"""

from __future__ import annotations

import contextlib
import io
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recon.functions.checksum import NULL_TEXT


def concat_text(columns: Sequence[Column], sep: str = "") -> Column:
    """Concatenation that shows NULL as '<null>'."""
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit(NULL_TEXT)) for c in columns])


def choose(*branches: tuple[Column, Column], otherwise: Column | None = None) -> Column:
    """first true condition wins."""
    if not branches:
        raise ValueError("at least one branch is needed")
    out = None
    for test, value in branches:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out if otherwise is None else out.otherwise(otherwise)


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """first rows in an order (top-n per task, then merged)."""
    return df.orderBy(*order).limit(n)


def exists_in(df: DataFrame, other: DataFrame, on: Column | list[str]) -> DataFrame:
    """rows with at least one match."""
    return df.join(other, on, "left_semi")


def theta_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """J4d: join on any condition; equalities in it are still used for hashing."""
    return left.join(right, condition, how)


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows, columns matched by position."""
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def union_distinct(*frames: DataFrame) -> DataFrame:
    """Distinct rows; duplicates are dropped before the shuffle as well."""
    return union_all(*frames).distinct()


def except_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of `left` that `right` lacks.

    Both sides are made distinct first: copies of a row then collapse before
    the shuffle of the join instead of after it.
    """
    return left.distinct().subtract(right.distinct())


def intersect_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows on both sides, with copies collapsed first."""
    return left.distinct().intersect(right.distinct())


def explain_frame(df: DataFrame, mode: str = "formatted") -> DataFrame:
    """the query plan as a one-column frame."""
    spark = df.sparkSession
    text = _explain_text(df, mode)
    return spark.createDataFrame([(line,) for line in text.splitlines()], "plan string")


def _explain_text(df: DataFrame, mode: str) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode=mode)
    return out.getvalue()

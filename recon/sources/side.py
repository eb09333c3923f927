"""One side of a comparison: a DataFrame plus what to compare and which rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recon.functions.age import age_bounds
from recon.functions.normalize import normalize, uuid_text


@dataclass(frozen=True)
class TableSide:
    """A comparable segment of a table.

    Key and update bounds are half-open ``[min, max)``. All restrictions are
    plain filters, so they reach the Parquet or JDBC scan, and `rows()` selects
    only the compared columns, so the scan reads nothing else.
    """

    df: DataFrame
    keys: tuple[str, ...]
    update_column: str | None = None
    extra_columns: tuple[str, ...] = ()
    min_key: tuple[Any, ...] | None = None
    max_key: tuple[Any, ...] | None = None
    min_update: datetime | None = None
    max_update: datetime | None = None
    where: str | None = None
    case_sensitive: bool = True
    text_forms: tuple[tuple[str, str], ...] = ()
    name: str = "table"

    def __post_init__(self) -> None:
        keys = (self.keys,) if isinstance(self.keys, str) else tuple(self.keys)
        object.__setattr__(self, "keys", keys)
        object.__setattr__(self, "extra_columns", tuple(self.extra_columns))
        if not keys:
            raise ValueError("at least one key column is needed")
        if self.update_column is None and (self.min_update is not None or self.max_update is not None):
            raise ValueError("min_update/max_update need an update_column")
        if self.min_key is not None and self.max_key is not None:
            if all(lo >= hi for lo, hi in zip(self.min_key, self.max_key)):
                raise ValueError(f"the key range [{self.min_key}, {self.max_key}) holds no key")
        if self.min_update is not None and self.max_update is not None and self.min_update >= self.max_update:
            raise ValueError(f"the update window [{self.min_update}, {self.max_update}) holds no time")
        if not self.case_sensitive:
            self._adopt_schema_case()
        for c in self.columns:
            if c not in self.df.columns:
                raise ValueError(f"column {c!r} not found in {self.name}; columns: {', '.join(self.df.columns)}")

    def _adopt_schema_case(self) -> None:
        actual = {c.lower(): c for c in self.df.columns}
        fix = lambda c: c if c in self.df.columns else actual.get(c.lower(), c)
        object.__setattr__(self, "keys", tuple(fix(k) for k in self.keys))
        object.__setattr__(self, "extra_columns", tuple(fix(c) for c in self.extra_columns))
        if self.update_column:
            object.__setattr__(self, "update_column", fix(self.update_column))

    @property
    def columns(self) -> list[str]:
        """Compared columns: keys, then the update column, then the extras."""
        extras = list(self.extra_columns)
        if self.update_column and self.update_column not in extras:
            extras.insert(0, self.update_column)
        return list(self.keys) + [c for c in extras if c not in self.keys]

    @property
    def value_columns(self) -> list[str]:
        return self.columns[len(self.keys) :]

    def dtype(self, column: str) -> T.DataType:
        return self.df.schema[column].dataType

    def conditions(self) -> list[Column]:
        """Row restrictions: key range, update window, free-form filter."""
        out: list[Column] = []
        if self.min_key is not None:
            out += [F.col(k) >= F.lit(v) for k, v in zip(self.keys, self.min_key)]
        if self.max_key is not None:
            out += [F.col(k) < F.lit(v) for k, v in zip(self.keys, self.max_key)]
        if self.min_update is not None:
            out.append(F.col(self.update_column) >= F.lit(self.min_update).cast(self.dtype(self.update_column)))
        if self.max_update is not None:
            out.append(F.col(self.update_column) < F.lit(self.max_update).cast(self.dtype(self.update_column)))
        if self.where:
            out.append(F.expr(f"({self.where})"))
        return out

    def filtered(self) -> DataFrame:
        """All columns of the selected rows."""
        df = self.df
        for condition in self.conditions():
            df = df.where(condition)
        return df

    def rows(self) -> DataFrame:
        """The compared columns of the selected rows."""
        return self.filtered().select(*self.columns)

    def text(self, column: str, source: Column | None = None, **options: Any) -> Column:
        """Normal text form of a column (or of `source` standing in for it)."""
        c = F.col(column) if source is None else source
        return normalize(c, self.dtype(column), form=dict(self.text_forms).get(column), **options)

    def with_age(self, now: datetime, min_age: str | None = None, max_age: str | None = None) -> "TableSide":
        """keep rows updated between `max_age` and `min_age` before `now`."""
        low, high = age_bounds(now, min_age, max_age)
        return replace(self, min_update=low or self.min_update, max_update=high or self.max_update)

    def with_keys_between(self, low: Sequence[Any] | None, high: Sequence[Any] | None) -> "TableSide":
        return replace(self, min_key=None if low is None else tuple(low), max_key=None if high is None else tuple(high))


def side(df: DataFrame, keys: str | Sequence[str], columns: Sequence[str] | None = None, **options: Any) -> TableSide:
    """A side comparing `columns` (default: every other column) by `keys`."""
    keys = (keys,) if isinstance(keys, str) else tuple(keys)
    update = options.get("update_column")
    if columns is None:
        columns = [c for c in df.columns if c not in keys and c != update]
    return TableSide(df, keys, extra_columns=tuple(columns), **options)


def pair_form(a: TableSide, b: TableSide, ca: str, cb: str) -> str | None:
    """Text form of a column pair: the one that either side names."""
    return dict(a.text_forms).get(ca) or dict(b.text_forms).get(cb)


def raw_key(key: str) -> str:
    """Column that keeps the text of a key as it is stored, for range filters of the scan."""
    return f"__raw_{key}"


def _in_form(df: DataFrame, key: str) -> DataFrame:
    kept = df if raw_key(key) in df.columns else df.withColumn(raw_key(key), F.col(key))
    return kept.withColumn(key, uuid_text(F.col(key)))


def with_key_forms(a: TableSide, b: TableSide) -> tuple[TableSide, TableSide]:
    """Both sides with UUID keys in their normal form, so that keys equal in that form match everywhere."""
    left, right = a, b
    for ka, kb in zip(a.keys, b.keys):
        text = isinstance(a.dtype(ka), T.StringType) and isinstance(b.dtype(kb), T.StringType)
        if text and pair_form(a, b, ka, kb) == "uuid":
            left = replace(left, df=_in_form(left.df, ka))
            right = replace(right, df=_in_form(right.df, kb))
    return left, right


def check_keys(a: TableSide, b: TableSide) -> None:
    """K3: equal arity, key-able types, matching families."""
    if len(a.keys) != len(b.keys):
        raise ValueError("both sides need the same number of key columns")
    for ka, kb in zip(a.keys, b.keys):
        fa, fb = key_family(a.dtype(ka)), key_family(b.dtype(kb))
        if fa is None or fb is None:
            raise NotImplementedError(f"cannot use {ka} ({a.dtype(ka)}) / {kb} ({b.dtype(kb)}) as a key")
        if fa != fb:
            raise TypeError(f"key columns {ka} and {kb} cannot be compared: {fa} against {fb}")


def key_family(dtype: T.DataType) -> str | None:
    """Family of a key-able type, or None."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dtype, T.DecimalType):
        return "integer" if dtype.scale == 0 else "decimal"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return None

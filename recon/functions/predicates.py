"""Tolerant "is it different?" predicates: each returns a non-null boolean Column."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recon.functions.normalize import common_scale, epoch_micros, json_text, normalize, number_text, timestamp_text, uuid_text

# Accepted precision levels with their length in microseconds.
PRECISION_MICROS = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
}

# Accepted JSON comparison modes.
JSON_MODES = ("exact", "normalized", "semantic", "keys_only")

FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def distinct_from(a: Column, b: Column) -> Column:
    """NULL-safe inequality."""
    return ~a.eqNullSafe(b)


def beyond_tolerance(a: Column, b: Column, tolerance: float) -> Column:
    """Equal values are no difference, NULL on one side always is; otherwise the gap must exceed the tolerance."""
    if tolerance is None or tolerance <= 0:
        return distinct_from(a, b)
    gap = F.abs(a - b) > F.lit(tolerance)
    # NaN against NaN and infinity against itself have no gap to speak of, but are equal.
    return F.when(a.isNull() | b.isNull() | a.eqNullSafe(b), distinct_from(a, b)).otherwise(gap)


def tolerance_digits(tolerance: float) -> int:
    """Digits worth keeping for a tolerance, one more than the tolerance itself shows."""
    if tolerance <= 0:
        raise ValueError("tolerance must be positive")
    return max(0, -math.floor(math.log10(tolerance))) + 1


def round_to_tolerance(c: Column, tolerance: float) -> Column:
    return F.round(c, tolerance_digits(tolerance))


def truncate_timestamp(c: Column, precision: str) -> Column:
    """Cut a timestamp to a precision level; the result is comparable microseconds."""
    if precision not in PRECISION_MICROS:
        raise ValueError(f"unknown precision {precision!r}; expected one of {sorted(PRECISION_MICROS)}")
    micros = epoch_micros(c)
    step = PRECISION_MICROS[precision]
    return micros if step == 1 else micros - F.pmod(micros, F.lit(step))


def json_differs(a: Column, b: Column, mode: str = "normalized") -> Column:
    """Exact text, whitespace-blind, order-blind, or top-level keys only."""
    if mode not in JSON_MODES:
        raise ValueError(f"unknown JSON mode {mode!r}; expected one of {JSON_MODES}")
    if mode == "exact":
        return distinct_from(a, b)
    if mode == "keys_only":
        return distinct_from(_key_list(a), _key_list(b))
    return distinct_from(json_text(a), json_text(b))


def _key_list(c: Column) -> Column:
    return F.coalesce(F.sort_array(F.json_object_keys(c)), F.array(c))


def text_differs(a: Column, b: Column, *, ignore_case: bool = False, ignore_blanks: bool = False) -> Column:
    """Optionally blind to letter case and to leading or trailing blanks."""
    if ignore_case:
        a, b = F.lower(a), F.lower(b)
    if ignore_blanks:
        a, b = F.trim(a), F.trim(b)
    return distinct_from(a, b)


@dataclass(frozen=True)
class CompareRules:
    """How values of each kind are compared.

    Timestamps are truncated *before* the comparison (not just in the printed
    values), so a precision setting does what its name says.
    """

    float_tolerance: float | None = None
    timestamp_precision: str | None = None
    json_mode: str | None = None
    json_columns: frozenset[str] = field(default_factory=frozenset)
    ignore_case: bool = False
    ignore_blanks: bool = False
    ignored_columns: frozenset[str] = field(default_factory=frozenset)

    timestamp_digits: int | None = None
    timestamp_rounds: bool = False

    def tolerant(self, name: str, left: T.DataType, right: T.DataType) -> bool:
        """Whether a pair is compared by a gap, which is no equivalence and so has no comparable value."""
        both = isinstance(left, T.NumericType) and isinstance(right, T.NumericType)
        return bool(self.float_tolerance) and both and isinstance(left, FRACTIONAL) | isinstance(right, FRACTIONAL)

    def comparable(
        self, c: Column, name: str, own: T.DataType, other: T.DataType, form: str | None = None
    ) -> tuple[Column, T.DataType]:
        """The value of one side of a column pair that equals the other side's exactly when the pair counts as equal.

        Every algorithm compares by this value: the join tests it, row hashes and row
        sets are made of it. `name` is the column's name in A, `own` and `other` are the
        declared types of this side and the other, `form` the pair's text form.
        """
        text = T.StringType()
        variant = isinstance(own, T.VariantType)
        if self.json_mode and (name in self.json_columns or variant):
            c = F.to_json(c) if variant else c
            if self.json_mode == "exact":
                return c, text
            if self.json_mode == "keys_only":
                return F.to_json(_key_list(c)), text
            return json_text(c), text
        if isinstance(own, TEMPORAL) and isinstance(other, TEMPORAL):
            if self.timestamp_precision:
                return truncate_timestamp(c, self.timestamp_precision), T.LongType()
            if self.timestamp_digits is not None:
                return timestamp_text(c, self.timestamp_digits, self.timestamp_rounds), text
            return (c, own) if own == other else (epoch_micros(c), T.LongType())
        if isinstance(own, T.NumericType) and isinstance(other, T.NumericType):
            if own == other:
                return c, own
            scale = common_scale(own, other)
            # Integers of different widths are exact as decimals; fractions meet at the common scale.
            return number_text(c, scale or 0), text
        if isinstance(own, T.StringType) and isinstance(other, T.StringType):
            if form == "uuid":
                c = uuid_text(c)
            elif form == "json":
                c = json_text(c)
            c = F.lower(c) if self.ignore_case else c
            return (F.trim(c) if self.ignore_blanks else c), text
        if isinstance(own, (T.MapType, T.VariantType)):
            return F.to_json(c), text
        if own == other:
            return c, own
        return normalize(c, own, scale=common_scale(own, other), form=form), text

    def differs(
        self, a: Column, b: Column, name: str, left: T.DataType, right: T.DataType, form: str | None = None
    ) -> Column:
        """The predicate for one column pair, chosen by the declared types."""
        if self.tolerant(name, left, right):
            return beyond_tolerance(a, b, self.float_tolerance)
        return distinct_from(
            self.comparable(a, name, left, right, form)[0], self.comparable(b, name, right, left, form)[0]
        )

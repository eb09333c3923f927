"""Text normal forms: the same value prints the same on both sides.

Every function takes and returns a Column, keeps NULL as NULL and stays inside
whole-stage code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Default binary precision of a float column, its decimal digits
# minus the two digits left off as unreliable, and the timestamp layout.
DOUBLE_BITS = 53
FLOAT_BITS = 24
UNRELIABLE_DIGITS = 2
TIMESTAMP_LAYOUT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
DATE_LAYOUT = "yyyy-MM-dd"


def binary_digits(bits: int, spare: int = UNRELIABLE_DIGITS) -> int:
    """Decimal digits that `bits` of binary precision can carry, less `spare`."""
    return max(math.floor(bits * math.log10(2)) - spare, 0)


def default_scale(dtype: T.DataType) -> int:
    """Fraction digits shown for a numeric type when no common precision is forced."""
    if isinstance(dtype, T.DecimalType):
        return dtype.scale
    if isinstance(dtype, T.DoubleType):
        return binary_digits(DOUBLE_BITS)
    if isinstance(dtype, T.FloatType):
        return binary_digits(FLOAT_BITS)
    return 0


def number_text(c: Column, scale: int) -> Column:
    """Plain fixed-scale text, no grouping commas; the dot goes away at scale 0.

    Values no decimal can hold (NaN, infinity, huge doubles) print as they are.
    """
    return F.coalesce(c.try_cast(T.DecimalType(38, scale)).cast("string"), c.cast("string"))


def timestamp_text(c: Column, precision: int = 6, rounds: bool = False) -> Column:
    """26-character text; digits past `precision` are rounded or cut, then zero-filled."""
    if not 0 <= precision <= 6:
        raise ValueError("timestamp precision must be within 0..6")
    step = 10 ** (6 - precision)
    micros = epoch_micros(c)
    if precision == 6:
        kept = micros
    elif rounds:
        half = step // 2
        kept = (micros + F.lit(half)) - F.pmod(micros + F.lit(half), F.lit(step))
    else:
        kept = micros - F.pmod(micros, F.lit(step))
    return F.date_format(F.timestamp_micros(kept), TIMESTAMP_LAYOUT)


def epoch_micros(c: Column) -> Column:
    """Microseconds since the epoch for NTZ, LTZ or date input (session zone UTC)."""
    return F.unix_micros(c.cast("timestamp"))


def date_text(c: Column) -> Column:
    """Calendar date."""
    return F.date_format(c, DATE_LAYOUT)


def time_of_day_text(c: Column) -> Column:
    """Time of day with microseconds."""
    return F.substring(timestamp_text(c), 12, 15)


def boolean_text(c: Column) -> Column:
    """N4: '0' or '1'."""
    return c.cast("int").cast("string")


def uuid_text(c: Column) -> Column:
    """Trimmed, lower-case."""
    return F.lower(F.trim(c))


def json_text(c: Column) -> Column:
    """Canonical JSON (keys ordered, blanks gone); text that is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)


def nested_text(c: Column) -> Column:
    """Arrays and structs as JSON text."""
    return F.to_json(c)


def normalize(
    c: Column,
    dtype: T.DataType,
    *,
    scale: int | None = None,
    precision: int = 6,
    rounds: bool = False,
    form: str | None = None,
) -> Column:
    """Pick the normal form for a type; `form` ('uuid' or 'json') refines text columns."""
    if isinstance(dtype, T.BooleanType):
        return boolean_text(c)
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return number_text(c, default_scale(dtype) if scale is None else scale)
    if isinstance(dtype, T.DateType):
        return date_text(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return timestamp_text(c, precision, rounds)
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return nested_text(c)
    if isinstance(dtype, T.VariantType):
        return F.to_json(c)
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    if isinstance(dtype, T.StringType) and form == "uuid":
        return uuid_text(c)
    if isinstance(dtype, T.StringType) and form == "json":
        return json_text(c)
    return c.cast("string")


def common_scale(left: T.DataType, right: T.DataType) -> int | None:
    """The lower of two numeric scales, or None when neither side is fractional.

    Whole numbers have no digits to lose: against them the other side's scale holds, so 1 and 1.4 differ.
    """
    fractional = (T.FloatType, T.DoubleType, T.DecimalType)
    if not isinstance(left, fractional) and not isinstance(right, fractional):
        return None
    scales = default_scale(left), default_scale(right)
    whole = [isinstance(t, T.IntegralType) or isinstance(t, T.DecimalType) and t.scale == 0 for t in (left, right)]
    return max(scales) if any(whole) else min(scales)


def lowered_scale(left: T.DataType, right: T.DataType) -> int | None:
    """The common scale, if it hides digits that one of the sides can hold."""
    scale = common_scale(left, right)
    fractional = (T.FloatType, T.DoubleType, T.DecimalType)
    both = isinstance(left, fractional) and isinstance(right, fractional)
    return scale if both and scale < max(default_scale(left), default_scale(right)) else None

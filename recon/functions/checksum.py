"""Order-free checksums that agree with any engine that has MD5."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The last 12 of 32 hex digits form the integer (48 bits), shifted
# by half the range so that sums stay near zero; NULL prints as '<null>' and
# columns are joined by a bar.
HEX_DIGITS = 12
FIRST_DIGIT = 32 - HEX_DIGITS + 1
OFFSET = (2 ** (4 * HEX_DIGITS) - 1) // 2
NULL_TEXT = "<null>"
SEPARATOR = "|"

LIMB_BITS = 16
LIMB_MASK = (1 << LIMB_BITS) - 1


def row_text(texts: Sequence[Column]) -> Column:
    """The normalized row as one text; a lone column keeps its NULL."""
    if len(texts) == 1:
        return texts[0]
    return F.concat_ws(SEPARATOR, *[F.coalesce(t, F.lit(NULL_TEXT)) for t in texts])


def row_digest_text(texts: Sequence[Column]) -> Column:
    """Digest every part first, so the text stays short however wide the row is."""
    return F.concat(*[F.md5(F.coalesce(t, F.lit(NULL_TEXT))) for t in texts])


def md5_hex(text: Column) -> Column:
    """C10."""
    return F.md5(text)


def low48(text: Column) -> Column:
    """Unsigned integer of the last 12 hex digits, as bigint."""
    return F.conv(F.substring(F.md5(text), FIRST_DIGIT, HEX_DIGITS), 16, 10).cast("bigint")


def md5_number(text: Column) -> Column:
    """The signed per-row number that a checksum adds up."""
    return low48(text) - F.lit(OFFSET)


def md5_bucket(text: Column, buckets: int) -> Column:
    """Stable bucket 0..buckets-1 of a text."""
    return F.pmod(low48(text), F.lit(buckets)).cast("bigint")


def checksum_sum(number: Column) -> Column:
    """C4: exact sum of `low48` values less their offset, NULL for no rows.

    A plain bigint sum could overflow on a trillion rows, and a decimal sum
    leaves the long registers. Adding three 16-bit limbs as bigint is exact up
    to 2^47 rows and keeps partial aggregation in code-generated longs; the
    limbs are put together once per group as decimal(38,0).
    """
    wide = T.DecimalType(38, 0)
    high = F.sum(F.shiftright(number, 2 * LIMB_BITS))
    middle = F.sum(F.shiftright(number, LIMB_BITS).bitwiseAND(LIMB_MASK))
    low = F.sum(number.bitwiseAND(LIMB_MASK))
    unsigned = (
        high.cast(wide) * F.lit(1 << (2 * LIMB_BITS)).cast(T.DecimalType(11, 0))
        + middle.cast(wide) * F.lit(1 << LIMB_BITS).cast(T.DecimalType(6, 0))
        + low.cast(wide)
    )
    return (unsigned - F.count(number).cast(T.DecimalType(19, 0)) * F.lit(OFFSET).cast(T.DecimalType(15, 0))).cast(wide)


def fingerprint(columns: Sequence[tuple[Column, T.DataType]]) -> list[Column]:
    """Two independent 64-bit hashes of a row's values, for equality inside the engine only.

    NULL leaves an engine hash unchanged, so each column is preceded by its
    null flag; nested values are hashed as JSON text for the same reason.
    """
    parts: list[Column] = []
    for c, dtype in columns:
        if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
            c = F.to_json(c)
        parts += [c.isNull(), c]
    return [F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(7_919), *parts)]

"""Key-space segments and their checksums."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recon.functions.checksum import NULL_TEXT, checksum_sum, low48, md5_bucket, row_digest_text, row_text
from recon.sources.side import TableSide, key_family


# Keys within plus and minus this can be subtracted as bigint.
NARROW = 1 << 62

# More key ranges than this are picked by segment number instead.
MAX_RANGES = 64


class EmptyTableError(ValueError):
    """A key range was asked of a table without rows."""


def key_range(s: TableSide) -> DataFrame:
    """Smallest and largest value of every key column (from Parquet statistics where possible)."""
    return s.filtered().agg(*[f(k).alias(f"{n}_{k}") for k in s.keys for n, f in (("min", F.min), ("max", F.max))])


def key_bounds(s: TableSide) -> list[tuple[Any, Any]]:
    """The key range as driver values; a table without rows is an error (K8)."""
    row = key_range(s).first()
    bounds = [(row[f"min_{k}"], row[f"max_{k}"]) for k in s.keys]
    if any(lo is None for lo, _ in bounds):
        raise EmptyTableError(f"{s.name} appears to be empty")
    return bounds


def common_bounds(a: TableSide, b: TableSide) -> list[tuple[Any, Any]] | None:
    """Per key column the range covering both sides, in one job; None when both are empty."""
    n = len(a.keys)
    ends = [s.filtered().select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(s.keys)]) for s in (a, b)]
    row = ends[0].unionByName(ends[1]).agg(*[f(f"k{i}") for i in range(n) for f in (F.min, F.max)]).first()
    return None if row[0] is None else [(row[2 * i], row[2 * i + 1]) for i in range(n)]


def space_size(bounds: Sequence[tuple[int, int]]) -> int:
    """Number of key values within half-open bounds of integer keys."""
    return math.prod(hi - lo for lo, hi in bounds)


def checkpoints(start: int, end: int, count: int) -> list[int]:
    """Up to `count` evenly spaced inner split points of [start, end)."""
    size = end - start
    if count >= size:
        count = 1
    step = (size + 1) // (count + 1)
    return [p for p in range(start, end, step)][1 : count + 1] if step else []


def key_literal(n: int, wide: bool = False) -> Column:
    """An integer of any size as a literal; bigint unless it does not fit or `wide` asks for a decimal."""
    return F.lit(Decimal(n)).cast(T.DecimalType(38, 0)) if wide or not -(2**63) <= n < 2**63 else F.lit(n)


@dataclass(frozen=True)
class Axis:
    """One integer key dimension, cut into `cells` ranges of `width` values; the last takes the rest."""

    start: int
    end: int
    width: int
    cells: int

    @classmethod
    def even(cls, start: int, end: int, cells: int) -> "Axis":
        """The ranges between the `checkpoints` of [start, end)."""
        inner = checkpoints(start, end, cells - 1) if end - start > 1 and cells > 1 else []
        return cls(start, end, inner[0] - start if inner else end - start, len(inner) + 1)

    def place(self, key: Column) -> Column:
        wide = not (-NARROW < self.start and self.end < NARROW)  # differences, or keys, may not fit a bigint
        own = key.cast(T.DecimalType(38, 0)) if wide else key.cast("bigint")
        gone = own - key_literal(self.start, wide)
        steps = F.call_function("div", gone, key_literal(self.width, wide)).cast("bigint")
        inside = F.greatest(F.lit(0).cast("bigint"), F.least(steps, F.lit(self.cells - 1).cast("bigint")))
        return F.when(key.isNull(), F.lit(0).cast("bigint")).otherwise(inside)

    def low(self, cell: int) -> int | None:
        """First key of a cell; None for the first cell, which is open below (and holds NULL)."""
        return self.start + cell * self.width if cell > 0 else None

    def high(self, cell: int) -> int | None:
        """First key after a cell; None for the last cell, which is open above."""
        return self.start + (cell + 1) * self.width if cell < self.cells - 1 else None


@dataclass(frozen=True)
class Segmenter:
    """Maps a key to a segment number 0..size-1.

    Integer keys are cut into even ranges per dimension (a mesh for compound
    keys); anything else goes to an MD5 bucket of its text.
    """

    axes: tuple[Axis, ...] = ()
    buckets: int = 0

    @property
    def size(self) -> int:
        return self.buckets or math.prod(x.cells for x in self.axes)

    def segment(self, keys: Sequence[Column], texts: Sequence[Column]) -> Column:
        """Segment number of a row."""
        if self.buckets:
            return md5_bucket(F.concat_ws("|", *[F.coalesce(t, F.lit(NULL_TEXT)) for t in texts]), self.buckets)
        cell = F.lit(0).cast("bigint")
        for key, axis in zip(keys, self.axes):
            cell = cell * axis.cells + axis.place(key)
        return cell

    def of(self, s: TableSide) -> Column:
        return self.segment([F.col(k) for k in s.keys], [s.text(k) for k in s.keys])

    def box(self, number: int) -> list[tuple[int | None, int | None]]:
        """Half-open key bounds of a segment per dimension (None = open end)."""
        out = []
        for axis in reversed(self.axes):
            number, cell = divmod(number, axis.cells)
            out.append((axis.low(cell), axis.high(cell)))
        return out[::-1]

    def finer(self, factor: int) -> "Segmenter | None":
        """The same key space in `factor` times as many segments; None when it cannot be cut further."""
        if self.buckets:
            return Segmenter(buckets=self.buckets * factor)
        axis = self.axes[0]
        if len(self.axes) > 1 or axis.width < 2:
            return None
        return Segmenter((Axis.even(axis.start, axis.end, axis.cells * factor),))

    def restrict(self, s: TableSide, numbers: Sequence[int]) -> DataFrame:
        """The rows of a side that lie in the given segments.

        For one integer key, neighbouring segments join into key ranges, which
        the Parquet or JDBC scan can use to skip what lies outside. Many
        scattered segments are picked by a broadcast join instead; the caller
        bounds how many numbers there can be.
        """
        rows = s.filtered()
        if not numbers:
            return rows.where(F.lit(False))
        if not self.buckets and len(self.axes) == 1:
            runs = neighbours(numbers)
            if len(runs) <= MAX_RANGES:
                return rows.where(reduce(lambda x, y: x | y, [self._between(s, *r) for r in runs]))
            rows = rows.where(self._between(s, runs[0][0], runs[-1][1]))
        wanted = rows.sparkSession.createDataFrame([(n,) for n in numbers], "segment_id bigint")
        tagged = rows.withColumn("__segment", self.of(s))
        return tagged.join(F.broadcast(wanted), F.col("__segment") == F.col("segment_id"), "left_semi").drop("__segment")

    def _between(self, s: TableSide, first: int, last: int) -> Column:
        axis, key = self.axes[0], F.col(s.keys[0])
        low, high = axis.low(first), axis.high(last)
        test = F.lit(True) if high is None else key < key_literal(high)
        # The first segment is open below and also holds NULL keys.
        return test | key.isNull() if low is None else test & (key >= key_literal(low))


def neighbours(numbers: Sequence[int]) -> list[tuple[int, int]]:
    """Neighbouring numbers as (first, last)."""
    runs: list[tuple[int, int]] = []
    for n in sorted(numbers):
        if runs and n == runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], n)
        else:
            runs.append((n, n))
    return runs


def make_segmenter(a: TableSide, b: TableSide, segments: int) -> Segmenter | None:
    """Even segments over the keys of both sides; None when neither side has rows."""
    if any(key_family(a.dtype(k)) != "integer" for k in a.keys):
        return Segmenter(buckets=segments)
    bounds = common_bounds(a, b)
    if bounds is None:
        return None
    cells = max(int(round(segments ** (1 / len(bounds)))), 2)
    return Segmenter(tuple(Axis.even(int(lo), int(hi) + 1, cells) for lo, hi in bounds))


def uuid_segment(key: Column, segments: int) -> Column:
    """C11: even ranges of the 128-bit space, by the leading 32 bits of a UUID text."""
    head = F.conv(F.substring(F.replace(F.lower(F.trim(key)), F.lit("-"), F.lit("")), 1, 8), 16, 10).cast("bigint")
    return F.floor(head * F.lit(segments) / F.lit(2**32)).cast("bigint")


def checked_texts(s: TableSide, ignored: frozenset[str] = frozenset(), scales: dict[str, int] | None = None) -> list[Column]:
    """Normal text of every compared column that is not ignored."""
    scales = scales or {}
    return [s.text(c, scale=scales.get(c)) for c in s.columns if c not in ignored]


def table_checksum(s: TableSide, *, wide: bool = False, scales: dict[str, int] | None = None) -> DataFrame:
    """C4: row count and checksum of the whole side (`wide` digests each part first, C9)."""
    texts = checked_texts(s, scales=scales)
    text = row_digest_text(texts) if wide else row_text(texts)
    numbers = s.rows().select(low48(text).alias("n"))
    return numbers.agg(F.count(F.lit(1)).alias("n_rows"), checksum_sum(F.col("n")).alias("checksum"))


def segment_checksums(
    s: TableSide,
    segmenter: Segmenter,
    *,
    ignored: frozenset[str] = frozenset(),
    scales: dict[str, int] | None = None,
) -> DataFrame:
    """Count and checksum of every non-empty segment in one scan.

    Partial sums are combined before the shuffle, so what moves is at most
    tasks times segments small rows, whatever the table size.
    """
    texts = checked_texts(s, ignored, scales)
    rows = s.rows().select(segmenter.of(s).alias("segment_id"), low48(row_text(texts)).alias("n"))
    return rows.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_rows"), checksum_sum(F.col("n")).alias("checksum"))

"""Key ranges of about equal rows, for keys of any orderable type and number.

The cut points are quantiles of a key summary: the keys whose digest falls on a
fixed residue, with their rows. Summaries of tasks merge by adding, both
sides give one, and its size follows the wanted number of segments, not the
data. Because cut points are keys, dense regions get narrow ranges, and a range
of text, time, UUID or compound keys is a plain comparison that the scan can use.
Cut points decide where rows are compared, never whether.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recon.functions.checksum import NULL_TEXT, low48
from recon.operators.schema import UUID_PATTERN
from recon.operators.segments import MAX_RANGES, neighbours
from recon.sources.side import TableSide, pair_form, raw_key

PER_SEGMENT = 64  # expected keys of the summary for each segment
MOST_SEGMENTS = 1024


def key_digest(s: TableSide) -> Column:
    """48 bits of the key's text."""
    return low48(F.concat_ws("|", *[F.coalesce(s.text(k), F.lit(NULL_TEXT)) for k in s.keys]))


def _any(tests: Iterable[Column]) -> Column:
    return reduce(lambda x, y: x | y, tests)


def _null_key(keys: Sequence[Column]) -> Column:
    return _any(k.isNull() for k in keys)


def key_summary(sides: Sequence[TableSide], modulus: int) -> DataFrame:
    """(k0.., n): the keys whose digest is a multiple of `modulus`, with their rows on all sides together."""
    parts = []
    for s in sides:
        rows = s.filtered().where(~_null_key([F.col(k) for k in s.keys])).where(key_digest(s) % modulus == 0)
        parts.append(rows.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(s.keys)]))
    names = [f"k{i}" for i in range(len(sides[0].keys))]
    return reduce(DataFrame.unionByName, parts).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def cut_points(summary: Sequence[tuple[tuple, int]], segments: int) -> list[tuple]:
    """First keys of the segments 1, 2, ... when the rows of a summary are cut into `segments` equal parts.

    A key that fills several parts is one cut point.
    """
    total, seen, part, cuts = sum(n for _, n in summary), 0, 1, []
    for key, n in sorted(summary):
        seen += n
        if part < segments and seen * segments > part * total:
            cuts.append(key)
            part = seen * segments // total + 1
    return cuts


@dataclass(frozen=True)
class RangeSegmenter:
    """Numbers a key by the cut points that are not above it; rows with a NULL in the key are in segment 0."""

    cuts: tuple[tuple, ...]
    types: tuple[T.DataType, ...]
    rows: int = 0
    uuids: tuple[bool, ...] = ()

    @property
    def size(self) -> int:
        return len(self.cuts) + 1

    def _literal(self, i: int, value: Any) -> Column:
        return F.lit(value).cast(self.types[i])

    def segment(self, keys: Sequence[Column]) -> Column:
        """Segment number of a row, by bisection of the sorted cut points."""
        if not self.cuts:
            return F.lit(0).cast("bigint")
        names = [f"k{i}" for i in range(len(keys))]
        typed = [k.cast(t) for k, t in zip(keys, self.types)]
        if len(keys) == 1:
            probe, layout, kept = typed[0], T.StringType(), self.types[0]
            text = json.dumps([str(c[0]) for c in self.cuts])
        else:
            probe = F.struct(*[k.alias(n) for k, n in zip(typed, names)])
            layout = T.StructType([T.StructField(n, T.StringType()) for n in names])
            kept = T.StructType([T.StructField(n, t) for n, t in zip(names, self.types)])
            text = json.dumps([dict(zip(names, map(str, c))) for c in self.cuts])
        # One constant, folded once: a literal for each cut point would make the plan a thousand times as large.
        cuts = F.from_json(F.lit(text), T.ArrayType(layout)).cast(T.ArrayType(kept))
        steps = [1 << b for b in reversed(range(len(self.cuts).bit_length()))]
        found = F.aggregate(
            F.array(*[F.lit(s) for s in steps]),
            F.lit(0),
            lambda at, step: F.when(F.get(cuts, at + step - F.lit(1)) <= probe, at + step).otherwise(at),
        )
        return F.when(_null_key(keys), F.lit(0)).otherwise(found).cast("bigint")

    def of(self, s: TableSide) -> Column:
        return self.segment([F.col(k) for k in s.keys])

    def _from(self, keys: Sequence[Column], cut: tuple) -> Column:
        """key >= cut, in the order of the key columns."""
        i = len(cut) - 1
        test = keys[i] >= self._literal(i, cut[i])
        for i in reversed(range(len(cut) - 1)):
            at = self._literal(i, cut[i])
            test = (keys[i] > at) | ((keys[i] == at) & test)
        return test

    def _before(self, keys: Sequence[Column], cut: tuple) -> Column:
        """key < cut."""
        i = len(cut) - 1
        test = keys[i] < self._literal(i, cut[i])
        for i in reversed(range(len(cut) - 1)):
            at = self._literal(i, cut[i])
            test = (keys[i] < at) | ((keys[i] == at) & test)
        return test

    def between(self, s: TableSide, first: int, last: int) -> Column:
        """Rows of the segments from `first` to `last`, as comparisons of the keys."""
        keys = [F.col(k) for k in s.keys]
        low, high = self._ends(first, last)
        test = F.lit(True)
        if low is not None:
            test = test & self._from(keys, low)
        if high is not None:
            test = test & self._before(keys, high)
        # The first segment is open below and also holds NULL keys.
        return test | _null_key(keys) if low is None else test

    def around(self, s: TableSide, first: int, last: int) -> Column:
        """A range of the stored text that holds all UUIDs of the segments from `first` to `last`.

        UUID keys are compared in their normal form, which no scan knows. Upper case
        sorts before lower case, blanks before both, and "!" comes next to the blank.
        """
        raw, (low, high) = F.col(raw_key(s.keys[0])), self._ends(first, last)
        test = F.lit(True)
        if low is not None:
            test = test & (raw >= F.lit(low[0].upper()))
        if high is not None:
            test = test & (raw < F.lit(high[0] + "!" if len(high) > 1 else high[0]))
        test = test | (raw < F.lit("-"))
        return test | raw.isNull() if low is None else test

    def _ends(self, first: int, last: int) -> tuple[tuple | None, tuple | None]:
        return (self.cuts[first - 1] if first > 0 else None, self.cuts[last] if last < len(self.cuts) else None)

    def _within(self, s: TableSide, runs: Sequence[tuple[int, int]]) -> DataFrame:
        rows = s.filtered().where(_any(self.between(s, *r) for r in runs))
        if self.uuids and self.uuids[0] and raw_key(s.keys[0]) in rows.columns:
            rows = rows.where(_any(self.around(s, *r) for r in runs))
        return rows

    def restrict(self, s: TableSide, numbers: Sequence[int]) -> DataFrame:
        """The rows of a side in the given segments: few ranges as comparisons, many scattered ones by a broadcast."""
        if not numbers:
            return s.filtered().where(F.lit(False))
        runs = neighbours(numbers)
        if len(runs) <= MAX_RANGES:
            return self._within(s, runs)
        rows = self._within(s, [(runs[0][0], runs[-1][1])])
        wanted = rows.sparkSession.createDataFrame([(n,) for n in numbers], "segment_id bigint")
        tagged = rows.withColumn("__segment", self.of(s))
        return tagged.join(F.broadcast(wanted), F.col("__segment") == F.col("segment_id"), "left_semi").drop("__segment")


def rows_segmenter(a: TableSide, b: TableSide, segments: int) -> RangeSegmenter | None:
    """Ranges of about equal rows over the keys of both sides; None when neither side has rows.

    One scan of the key columns counts the rows, a second one collects the
    summary: about PER_SEGMENT keys for each of at most MOST_SEGMENTS segments.
    """
    segments = max(2, min(segments, MOST_SEGMENTS))
    forms = [pair_form(a, b, ka, kb) == "uuid" for ka, kb in zip(a.keys, b.keys)]
    facts = []
    for s in (a, b):
        plain = [F.bool_and(F.col(k).rlike(UUID_PATTERN)).alias(f"u{i}") for i, k in enumerate(s.keys) if forms[i]]
        facts.append(s.filtered().agg(F.count(F.lit(1)).alias("n"), *plain).first())
    total = sum(r.n for r in facts)
    if not total:
        return None
    uuids = tuple(f and all(r[f"u{i}"] is not False for r in facts) for i, f in enumerate(forms))
    summary = key_summary((a, b), max(1, total // (segments * PER_SEGMENT)))
    names = summary.columns[:-1]
    found = [(tuple(r[n] for n in names), r.n) for r in summary.collect()]
    types = tuple(summary.schema[n].dataType for n in names)
    return RangeSegmenter(tuple(cut_points(found, segments)), types, total, uuids)


def split_predicates(s: TableSide, segments: int) -> list[str]:
    """SQL conditions that cut one integer, text or time key into parts of about equal rows, for `predicates` of a JDBC read.

    The conditions cover every row once; NULL keys are in the first.
    """
    (key,) = s.keys
    seg = rows_segmenter(s, s, segments)

    def shown(v: Any) -> str:
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    points = [shown(c[0]) for c in seg.cuts] if seg else []
    if not points:
        return ["1 = 1"]
    inner = [f"{key} >= {lo} AND {key} < {hi}" for lo, hi in zip(points, points[1:])]
    return [f"{key} < {points[0]} OR {key} IS NULL", *inner, f"{key} >= {points[-1]}"]

"""Column profiles and their comparison."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recon.functions.normalize import default_scale, epoch_micros, normalize

# Reported percentiles, distribution sizes, comparison limits.
PERCENTILES = (0.25, 0.50, 0.75)
TOP_VALUES = 100
TOP_BOOLEANS = 10
SHOWN_VALUES = 20
NULL_RATE_GAP = 1.0
NULL_RATE_WARNING = 10.0
CARDINALITY_GAP = 0.1
AVERAGE_GAP_PERCENT = 5.0
SMALLEST_AVERAGE = 0.0001

CODE_BITS = 50
PASS_BITS = 14

TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def column_profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    approximate_distinct: bool = False,
    percentiles: Sequence[float] = PERCENTILES,
    scale: int | None = None,
) -> DataFrame:
    """One row per column with counts, extremes, average, average length, percentiles.

    One aggregate for all columns, one long table of values for the exact distinct
    counts (`approximate_distinct` trades it for a sketch), and a few counting
    passes, which run now, for exact percentiles. A sample is a sample of rows, taken by the
    caller before profiling.
    """
    columns = list(columns or df.columns)
    items, none_yet = [], F.lit(0).cast("bigint")
    for c in columns:
        dtype, v = df.schema[c].dataType, F.col(c)
        numeric, temporal = isinstance(dtype, T.NumericType), isinstance(dtype, TEMPORAL)
        distinct = F.approx_count_distinct(v) if approximate_distinct else none_yet
        shown = lambda x, dt=dtype: normalize(x, dt, scale=default_scale(dt) if scale is None else scale)
        none = F.lit(None)
        items.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(dtype.simpleString()).alias("data_type"),
                F.count(F.lit(1)).alias("total_count"),
                (F.count(F.lit(1)) - F.count(v)).alias("null_count"),
                distinct.alias("unique_count"),
                (shown(F.min(v)) if numeric or temporal else none).cast("string").alias("min_value"),
                (shown(F.max(v)) if numeric or temporal else none).cast("string").alias("max_value"),
                (F.avg(v.cast("double")) if numeric else none).cast("double").alias("avg_value"),
                (F.avg(F.length(v)) if isinstance(dtype, T.StringType) else none).cast("double").alias("avg_length"),
            )
        )
    wide = df.agg(F.array(*items).alias("all"))
    profile = wide.select(F.explode("all").alias("c")).select("c.*")
    if not approximate_distinct:
        order = profile.columns
        distinct = F.broadcast(distinct_counts(df, columns).withColumnRenamed("unique_count", "found"))  # one row per column
        profile = profile.join(distinct, "column_name", "left").withColumn("unique_count", F.coalesce("found", none_yet)).select(order)
    numbers = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    labels = [f"p{round(p * 100)}" for p in percentiles]
    if percentiles and numbers:
        ranks = exact_percentiles(df, numbers, percentiles)
        spread = ranks.groupBy("column_name").agg(
            *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(name) for p, name in zip(percentiles, labels)]
        )
        profile = profile.join(F.broadcast(spread), "column_name", "left")
    else:
        profile = profile.select("*", *[F.lit(None).cast("double").alias(name) for name in labels])
    return with_rates(profile)


def with_rates(profile: DataFrame) -> DataFrame:
    """Null rate in percent and cardinality (distinct values per row)."""
    total = F.col("total_count")
    return profile.withColumn(
        "null_rate", F.when(total > 0, F.col("null_count") / total * 100).otherwise(F.lit(0.0))
    ).withColumn("cardinality", F.when(total > 0, F.col("unique_count") / total).otherwise(F.lit(0.0)))


def ordered_code(v: Column) -> Column:
    """A bigint that orders as the double `v` does: sign, exponent, and the leading 50 bits of the fraction.

    Up to a few neighbouring doubles share a code. Codes lie within 2^62, so two of them can be subtracted.
    """
    step = F.lit(float(1 << CODE_BITS))
    size = F.abs(v)
    exponent = F.greatest(F.lit(-1074.0), F.least(F.lit(1023.0), F.floor(F.log2(size)).cast("double")))
    finite = ((size / F.pow(F.lit(2.0), exponent) - 1) * step).cast("bigint") + (exponent.cast("bigint") + 1075) * (1 << CODE_BITS)
    code = F.when(size == 0, F.lit(0)).when(size == float("inf"), F.lit(2100 << CODE_BITS)).otherwise(finite)
    return F.when(v < 0, -code).otherwise(code).cast("bigint")


@dataclass(frozen=True)
class _Part:
    """A range of codes of one column that holds wanted ranks; `below` values lie under it."""

    column: int
    lo: int
    hi: int
    below: int
    ranks: tuple[int, ...]

    @property
    def shift(self) -> int:
        return max(0, (self.hi - self.lo).bit_length() - PASS_BITS)


def order_statistics(
    df: DataFrame, columns: Sequence[str], ranks: Callable[[int], Iterable[int]]
) -> tuple[dict[str, int], dict[tuple[str, int], float]]:
    """The number of values of each numeric column, NULL and NaN left out, and those at the ranks (from 0) that `ranks` wants of so many.

    Each pass counts the values of the ranges that still hold a wanted rank in
    2^PASS_BITS buckets and goes on with the bucket of each rank, until a bucket
    holds one value. Nothing is sorted, tasks send bucket counts only, and the
    path is the same for one row or a trillion, and for one value in all rows.
    """
    base = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    sound = [F.when(~F.isnan(f"v{i}"), F.col(f"v{i}")) for i in range(len(columns))]
    base = base.select(*[v.alias(f"v{i}") for i, v in enumerate(sound)], *[ordered_code(v).alias(f"c{i}") for i, v in enumerate(sound)])
    facts = (("n", F.count), ("lo", F.min), ("hi", F.max))
    ends = base.agg(*[f(f"c{i}").alias(f"{name}{i}") for i in range(len(columns)) for name, f in facts]).first()
    sizes = {c: ends[f"n{i}"] for i, c in enumerate(columns)}
    found: dict[tuple[str, int], float] = {}
    parts = [
        _Part(i, ends[f"lo{i}"], ends[f"hi{i}"], 0, tuple(sorted(set(ranks(sizes[c])))))
        for i, c in enumerate(columns)
        if sizes[c]
    ]
    while parts:
        items = []
        for n, p in enumerate(parts):
            code, v = F.col(f"c{p.column}"), F.col(f"v{p.column}")
            # A range of one code tells its few values apart by themselves.
            bucket = F.shiftright(code, p.shift) - F.lit(p.lo >> p.shift) if p.hi > p.lo else F.lit(0).cast("bigint")
            own = v if p.hi == p.lo else F.lit(None).cast("double")
            items.append(F.when(code.between(p.lo, p.hi), F.struct(F.lit(n).alias("n"), bucket.alias("b"), own.alias("own"), v.alias("v"))))
        rows = base.select(F.explode(F.array(*items)).alias("x")).where("x IS NOT NULL").select("x.*")
        counts = rows.groupBy("n", "b", "own").agg(F.count(F.lit(1)).alias("size"), F.min("v").alias("low"), F.max("v").alias("high"))
        buckets: dict[int, list] = {}
        for r in counts.collect():
            buckets.setdefault(r.n, []).append((r.b, r.own if r.own is not None else 0.0, r.size, r.low, r.high))
        ahead = []
        for n, p in enumerate(parts):
            below, todo = p.below, list(p.ranks)
            for b, _, size, low, high in sorted(buckets[n]):
                here = tuple(r for r in todo if r < below + size)
                if here and low == high:
                    found.update({(columns[p.column], r): low for r in here})
                elif here:
                    start = ((p.lo >> p.shift) + b) << p.shift
                    ahead.append(_Part(p.column, max(p.lo, start), min(p.hi, start + (1 << p.shift) - 1), below, here))
                todo = todo[len(here) :]
                below += size
        parts = ahead
    return sizes, found


def exact_percentiles(df: DataFrame, columns: Sequence[str], percentiles: Sequence[float]) -> DataFrame:
    """Exact interpolated percentiles `(column_name, p, value)`, by selection of their neighbouring ranks; runs now."""
    sizes, found = order_statistics(
        df, columns, lambda n: [f(p * (n - 1)) for p in percentiles for f in (math.floor, math.ceil)]
    )
    rows = []
    for c, n in sizes.items():
        for p in percentiles if n else ():
            x = p * (n - 1)
            low, high = found[c, math.floor(x)], found[c, math.ceil(x)]
            rows.append((c, p, low if low == high else low + (high - low) * (x - math.floor(x))))
    return df.sparkSession.createDataFrame(rows, "column_name string, p double, value double")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact numbers of different values `(column_name, unique_count)`, NULL left out.

    All columns go through one long table of (column, value), in which tasks keep each
    value once before the shuffle; a value stands in the field of its kind.
    """
    items = []
    for n, c in enumerate(columns):
        dtype, v = df.schema[c].dataType, F.col(c)
        whole = isinstance(dtype, (T.IntegralType, T.BooleanType, *TEMPORAL))
        fraction = isinstance(dtype, (T.FloatType, T.DoubleType))
        number = epoch_micros(v) if isinstance(dtype, TEMPORAL) else v.cast("bigint")
        if isinstance(dtype, T.BinaryType):
            v = F.hex(v)
        elif isinstance(dtype, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
            v = F.to_json(v)
        fields = [
            (number if whole else F.lit(None)).cast("bigint").alias("i"),
            (v if fraction else F.lit(None)).cast("double").alias("d"),
            (F.lit(None) if whole or fraction else v).cast("string").alias("s"),
        ]
        items.append(F.when(F.col(c).isNotNull(), F.struct(F.lit(n).alias("n"), *fields)))
    cells = df.select(F.explode(F.array(*items)).alias("x")).where("x IS NOT NULL").select("x.*").distinct()
    names = F.array(*[F.lit(c) for c in columns])
    counted = cells.groupBy("n").agg(F.count(F.lit(1)).alias("unique_count"))
    return counted.select(F.get(names, F.col("n")).alias("column_name"), "unique_count")


def value_distribution(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Most frequent values (NULL included), ties by value; booleans keep at most ten."""
    dtype = df.schema[column].dataType
    if limit is None:
        limit = TOP_BOOLEANS if isinstance(dtype, T.BooleanType) else TOP_VALUES
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col("value").asc_nulls_last()).limit(limit)


def folded_distribution(df: DataFrame, column: str) -> DataFrame:
    """The 20 most frequent values next to the number of different values (NULL is one)."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("n").desc(), F.col("value").asc_nulls_last()]
    top = counts.orderBy(*order).limit(SHOWN_VALUES)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # SHOWN_VALUES rows
    total = counts.agg(F.count(F.lit(1)).alias("total_unique_values"))  # one row
    return ranked.join(F.broadcast(total), F.lit(True), "left").select("rank", "value", "n", "total_unique_values")


def distributions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A8 for the result store: per column the most frequent values with their counts, as JSON (at most TOP_VALUES each)."""
    parts = []
    for c in columns:
        top = value_distribution(df, c).select("n", F.col("value").cast("string").alias("value"))
        listed = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "value", "n")))
        texts = F.to_json(F.transform(listed, lambda v: F.struct(v["value"].alias("value"), v["n"].alias("n"))))
        parts.append(top.agg(F.lit(c).alias("column_name"), texts.alias("value_distribution")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compare_profiles(source: DataFrame, target: DataFrame) -> DataFrame:
    """Per column, which statistics differ beyond their limit; one row per column.

    Both inputs have one row per column.
    """
    fields = [c for c in source.columns if c != "column_name"]
    s = source.select("column_name", F.lit(True).alias("in_s"), *[F.col(f).alias(f"s_{f}") for f in fields])
    t = target.select("column_name", F.lit(True).alias("in_t"), *[F.col(f).alias(f"t_{f}") for f in fields])
    both = s.join(t, "column_name", "full_outer")
    present = F.col("in_s").isNotNull() & F.col("in_t").isNotNull()
    null_gap = F.abs(F.col("s_null_rate") - F.col("t_null_rate"))
    card_gap = F.abs(F.col("s_cardinality") - F.col("t_cardinality"))
    base = F.greatest(F.abs(F.col("s_avg_value")), F.lit(SMALLEST_AVERAGE))
    avg_gap = F.abs(F.col("s_avg_value") - F.col("t_avg_value")) / base * 100
    ranged = F.col("s_min_value").isNotNull() & F.col("t_min_value").isNotNull()

    def flag(c: Column) -> Column:
        return F.coalesce(present & c, F.lit(False))

    return both.select(
        "column_name",
        F.when(F.col("in_s").isNull(), "extra").when(F.col("in_t").isNull(), "missing").otherwise("common").alias("presence"),
        flag(null_gap > NULL_RATE_GAP).alias("null_rate_differs"),
        flag(null_gap > NULL_RATE_WARNING).alias("null_rate_warning"),
        flag((F.col("s_unique_count") > 0) & (F.col("t_unique_count") > 0) & (card_gap > CARDINALITY_GAP)).alias(
            "cardinality_differs"
        ),
        flag(ranged & (F.col("s_min_value") != F.col("t_min_value"))).alias("min_differs"),
        flag(ranged & ~F.col("s_max_value").eqNullSafe(F.col("t_max_value"))).alias("max_differs"),
        flag(avg_gap > AVERAGE_GAP_PERCENT).alias("avg_differs"),
        F.when(present, F.round(null_gap, 2)).alias("null_rate_gap"),
        F.when(present, F.round(avg_gap, 2)).alias("avg_gap_percent"),
    )


def profile_summary(compared: DataFrame) -> DataFrame:
    """Totals over the compared columns."""
    kinds = ["null_rate", "cardinality", "min", "max", "avg"]
    differs = any_of([F.col(f"{k}_differs") for k in kinds])
    return compared.agg(
        F.count_if(F.col("presence") != "extra").alias("total_columns"),
        F.count_if(differs).alias("columns_with_differences"),
        F.count_if(F.col("presence") == "missing").alias("missing_columns"),
        F.count_if(F.col("presence") == "extra").alias("extra_columns"),
        F.count_if("null_rate_warning").alias("warnings"),
    )


def any_of(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def quality_scores(profile: DataFrame) -> DataFrame:
    """Score of each column, `(1 - null rate) * 100`, and the table mean as `*`."""
    scored = profile.select("column_name", (100 - F.col("null_rate")).alias("quality_score"))
    mean = scored.agg(F.lit("*").alias("column_name"), F.avg("quality_score").alias("quality_score"))
    return scored.unionByName(mean)

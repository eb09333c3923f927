"""When did the differences happen?"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recon.functions.normalize import epoch_micros
from recon.operators.joindiff import Compared

# Default number of buckets, the low-quality limit, trend limits,
# list lengths.
BUCKETS = 20
LOW_RATE = 0.9
TREND_GAP = 0.05
STRONG_TREND_GAP = 0.10
WORST = 5

MINUTE, HOUR, DAY = 60, 3_600, 86_400
WEEK, MONTH, YEAR = 7 * DAY, 30 * DAY, 365 * DAY


def bucket_width(start: datetime, end: datetime, target: int = BUCKETS) -> timedelta:
    """L1: a sensible bucket width for about `target` buckets."""
    ideal = (end - start).total_seconds() / target
    if ideal < MINUTE:
        seconds = MINUTE
    elif ideal < HOUR:
        seconds = max(5, int(ideal / MINUTE / 5) * 5) * MINUTE
    elif ideal < DAY:
        seconds = int(ideal / HOUR) * HOUR
    elif ideal < WEEK:
        seconds = int(ideal / DAY) * DAY
    elif ideal < MONTH:
        seconds = WEEK
    elif ideal < YEAR:
        seconds = MONTH
    else:
        seconds = YEAR
    return timedelta(seconds=seconds)


@dataclass(frozen=True)
class Buckets:
    """Fixed-width buckets over [start, end]; the last one is cut at `end` and includes it."""

    start: datetime
    end: datetime
    width: timedelta

    @property
    def count(self) -> int:
        return max(math.ceil((self.end - self.start) / self.width), 1)

    @property
    def width_micros(self) -> int:
        return self.width // timedelta(microseconds=1)

    @property
    def start_micros(self) -> int:
        return (self.start - datetime(1970, 1, 1)) // timedelta(microseconds=1)

    @property
    def end_micros(self) -> int:
        return (self.end - datetime(1970, 1, 1)) // timedelta(microseconds=1)

    def number(self, ts: Column) -> Column:
        """Bucket number of a timestamp, NULL outside the range."""
        micros = epoch_micros(ts)
        place = F.floor((micros - F.lit(self.start_micros)) / F.lit(self.width_micros)).cast("bigint")
        inside = (micros >= F.lit(self.start_micros)) & (micros <= F.lit(self.end_micros))
        return F.when(inside, F.least(place, F.lit(self.count - 1).cast("bigint")))

    def frame(self, spark) -> DataFrame:
        """L2: one row per bucket with start, end and label."""
        begin = F.lit(self.start_micros) + F.col("id") * F.lit(self.width_micros)
        finish = F.least(begin + F.lit(self.width_micros), F.lit(self.end_micros))
        return spark.range(self.count).select(
            F.col("id").alias("bucket"),
            F.timestamp_micros(begin).cast("timestamp_ntz").alias("bucket_start"),
            F.timestamp_micros(finish).cast("timestamp_ntz").alias("bucket_end"),
            F.date_format(F.timestamp_micros(begin), label_layout(self.width)).alias("label"),
        )


def label_layout(width: timedelta) -> str:
    """Label layout for a bucket width."""
    days, seconds = width.days, width.seconds
    if days >= 365:
        return "yyyy"
    if days >= 28:
        return "yyyy-MM"
    if days >= 1:
        return "yyyy-MM-dd"
    return "yyyy-MM-dd HH:00" if seconds >= HOUR else "yyyy-MM-dd HH:mm"


def time_range(df: DataFrame, column: str) -> tuple[datetime, datetime] | None:
    """Earliest and latest timestamp (answered from Parquet statistics where possible)."""
    ts = F.col(column).cast("timestamp_ntz")
    row = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
    return None if row.lo is None else (row.lo, row.hi)


def make_buckets(df: DataFrame, column: str, target: int = BUCKETS) -> Buckets:
    """L1, L2: buckets over the range of a table."""
    found = time_range(df, column)
    if found is None:
        raise ValueError(f"no time range in {column}")
    return Buckets(*found, bucket_width(*found, target))


def histogram(df: DataFrame, column: str, width: timedelta) -> DataFrame:
    """L3: rows per calendar unit (year, month, day or hour, by bucket width)."""
    days = width.days
    unit = "year" if days >= 365 else "month" if days >= 28 else "day" if days >= 1 else "hour"
    ts = F.col(column)
    return df.groupBy(F.date_trunc(unit, ts).cast("timestamp_ntz").alias("time_bucket")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("min_time"), F.max(ts).alias("max_time")
    )


def timeline(compared: Compared, column: str, buckets: Buckets) -> DataFrame:
    """L4: rows, differences by type and match rate per bucket, empty buckets included.

    A difference is placed by the A value of the time column, or the B value
    when A has none. Total rows of a bucket are the larger side, so match rates
    are meaningful. One aggregate over the matched rows; what is joined to the
    bucket list has at most one row per bucket.
    """
    names = [ca for ca, _ in compared.pairs]
    if column not in names:
        raise ValueError(f"time column {column!r} is not among the compared columns: {', '.join(names)}")
    i = names.index(column)
    at_a, at_b = buckets.number(F.col(f"a{i}")), buckets.number(F.col(f"b{i}"))
    kind = F.when(compared.only_a(), "t").when(compared.only_b(), "s").when(compared.changed(), "v")
    # Rows fall into few (bucket, bucket, kind) classes; only those are spread out.
    classes = (
        compared.matched.select(at_a.alias("at_a"), at_b.alias("at_b"), kind.alias("kind"))
        .groupBy("at_a", "at_b", "kind")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    marks = F.array(
        F.struct(F.col("at_a").alias("bucket"), F.lit("a").alias("kind")),
        F.struct(F.col("at_b").alias("bucket"), F.lit("b").alias("kind")),
        F.struct(F.coalesce("at_a", "at_b").alias("bucket"), F.col("kind").alias("kind")),
    )
    names = {"a": "rows_a", "b": "rows_b", "t": "missing_in_target", "s": "missing_in_source", "v": "value_differences"}
    per_kind = (
        classes.select("n", F.explode(marks).alias("m"))
        .select("n", "m.*")
        .where(F.col("bucket").isNotNull() & F.col("kind").isNotNull())
        .groupBy("bucket")
        .agg(*[F.sum(F.when(F.col("kind") == code, F.col("n"))).alias(name) for code, name in names.items()])
    )
    spark = compared.matched.sparkSession
    counts = list(names.values())
    joined = buckets.frame(spark).join(per_kind, "bucket", "left").na.fill(0, counts)
    total = F.greatest("rows_a", "rows_b")
    differences = F.col("missing_in_target") + F.col("missing_in_source") + F.col("value_differences")
    return joined.select(
        "bucket",
        "bucket_start",
        "bucket_end",
        "label",
        *counts,
        total.alias("total_rows"),
        differences.alias("differences"),
        F.when(total > 0, 1 - differences / total).otherwise(F.lit(1.0)).alias("match_rate"),
    )


def report(periods: DataFrame) -> DataFrame:
    """Number of periods, average match rate in percent, covered range."""
    return periods.agg(
        F.count(F.lit(1)).alias("total_time_periods"),
        F.round(F.avg("match_rate") * 100, 2).alias("average_match_rate"),
        F.min("bucket_start").alias("range_start"),
        F.max("bucket_end").alias("range_end"),
    )


def worst_periods(periods: DataFrame, n: int = WORST) -> DataFrame:
    """The periods with the lowest match rate, earliest first among equals."""
    return (
        periods.orderBy("match_rate", "bucket_start")
        .limit(n)
        .select("label", "bucket_start", F.round(F.col("match_rate") * 100, 2).alias("match_rate"), "differences")
    )


def patterns(periods: DataFrame) -> DataFrame:
    """Trend, periodic issues and data gaps, one row per pattern found.

    Works on the bucket list (tens of rows), so the global windows are cheap.
    """
    forward = Window.orderBy("bucket_start")
    backward = Window.orderBy(F.col("bucket_start").desc())
    p = periods.withColumns(
        {"i": F.row_number().over(forward), "from_end": F.row_number().over(backward), "n": F.count(F.lit(1)).over(Window.partitionBy())}
    )
    low = F.col("match_rate") < LOW_RATE
    gaps = (
        p.where(low)
        .withColumn("gap", F.col("i") - F.lag("i").over(Window.orderBy("i")))
        .agg(F.count(F.lit(1)).alias("n_low"), F.min("gap").alias("lo"), F.max("gap").alias("hi"), F.min_by("gap", F.when(F.col("gap").isNotNull(), F.col("i"))).alias("first_gap"))
        .where((F.col("n_low") >= 2) & (F.col("hi") - F.col("first_gap") <= 1) & (F.col("first_gap") - F.col("lo") <= 1))
        .select(
            F.lit("periodic_issues").alias("pattern"),
            F.lit("medium").alias("confidence"),
            F.col("first_gap").cast("bigint").alias("n"),
        )
    )
    older = F.when(F.col("n") >= 6, F.col("from_end").between(4, 6)).otherwise(F.col("i") <= 3)
    trend = (
        p.where(F.col("n") >= 3)
        .agg(
            F.avg(F.when(F.col("from_end") <= 3, F.col("match_rate"))).alias("recent"),
            F.avg(F.when(older, F.col("match_rate"))).alias("older"),
            F.count(F.lit(1)).alias("periods"),
        )
        .where(F.abs(F.col("recent") - F.col("older")) > TREND_GAP)
        .select(
            F.when(F.col("recent") > F.col("older"), "improving_quality").otherwise("degrading_quality").alias("pattern"),
            F.when(F.abs(F.col("recent") - F.col("older")) > STRONG_TREND_GAP, "high").otherwise("medium").alias("confidence"),
            F.col("periods").cast("bigint").alias("n"),
        )
    )
    empty = (
        p.agg(F.count_if(F.col("total_rows") == 0).alias("n"))
        .where(F.col("n") > 0)
        .select(F.lit("data_gaps").alias("pattern"), F.lit(None).cast("string").alias("confidence"), "n")
    )
    return trend.unionByName(gaps).unionByName(empty)

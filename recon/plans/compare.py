"""One call from two sides to every result of a comparison."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recon.functions.names import Remapping
from recon.functions.normalize import lowered_scale
from recon.functions.predicates import CompareRules
from recon.operators import classify, grading, hashdiff, profile, timeline
from recon.operators.alignment import align_rows
from recon.operators.joindiff import Compared, compare_by_key, pair_columns, with_scores
from recon.operators.keys import DuplicateKeysError, NullKeysError, any_null, key_facts, require_sound_keys
from recon.operators.sampling import infer, key_sample, modulus
from recon.operators.schema import text_kinds, unsupported_types
from recon.plans.lineage import materialize
from recon.sources.side import TableSide, check_keys, pair_form, with_key_forms
from recon.sources.store import ResultStore, detail_rows


@dataclass(frozen=True)
class Options:
    """Settings of a comparison."""

    algorithm: str = "auto"
    rules: CompareRules = field(default_factory=CompareRules)
    remapping: Remapping | None = None
    assume_unique_key: bool = False
    skip_null_keys: bool = False
    strict_types: bool = False
    sample_percent: float | None = None
    sample_size: int | None = None
    time_column: str | None = None
    timeline_buckets: int = timeline.BUCKETS
    profile_columns: bool = False
    factor: int = hashdiff.FACTOR
    threshold: int = hashdiff.THRESHOLD
    detect_text_forms: bool = False


ALGORITHMS = ("auto", "join", "hash", "rows")


def choose_algorithm(a: TableSide, b: TableSide, options: Options, same_system: bool = True) -> tuple[str, bool]:
    """The algorithm, and whether the keys are unique.

    `auto` takes `join` for two tables of one system and `hash` across systems,
    and `rows` when keys repeat. Keys are checked by one job for both sides,
    unless the caller vouches for them.
    """
    if options.algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm must be one of {', '.join(ALGORITHMS)}")
    if options.algorithm == "rows":
        return "rows", False
    unique = True
    if options.assume_unique_key:
        require_sound_keys(a, b, unique=False, no_nulls=not options.skip_null_keys)
    else:
        for s, (nulls, most) in zip((a, b), key_facts(a, b)):
            if nulls and not options.skip_null_keys:
                raise NullKeysError(f"{s.name} has rows whose key is NULL in part or whole")
            unique = unique and most <= 1
    if options.algorithm == "auto":
        return ("rows" if not unique else "join" if same_system else "hash"), unique
    if options.algorithm == "join" and not unique:
        raise DuplicateKeysError("a join needs unique keys; use the algorithms 'hash' or 'rows'")
    return options.algorithm, unique


def sampled(a: TableSide, b: TableSide, options: Options) -> tuple[TableSide, TableSide]:
    """M3: the same keys on both sides, if a percentage or size is asked for."""
    if options.sample_percent is not None:
        m = modulus(percent=options.sample_percent)
    elif options.sample_size is not None:
        m = modulus(size=options.sample_size, total=max(s.rows().count() for s in (a, b)))
    else:
        return a, b
    return tuple(replace(s, df=key_sample(s.df, s.keys, m)) for s in (a, b))


@dataclass(frozen=True)
class ComparisonResult:
    """Lazy results of one comparison; nothing runs before a frame is used.

    The differing rows are computed once and kept on shared storage (they are
    the small part of the data); everything about differences is derived from
    them, and row counts come from the sides.
    """

    a: TableSide
    b: TableSide
    options: Options
    algorithm: str
    full: Compared | None
    rows_diff: DataFrame | None
    warnings: DataFrame
    where: tuple[str | None, str | None] = (None, None)
    whole: tuple[TableSide, TableSide] | None = None
    aligned: Compared | None = None

    @cached_property
    def inference(self) -> DataFrame:
        """M5: what the differences of a sampled comparison say about the whole tables, one row."""
        if self.whole is None:
            raise ValueError("only a sampled comparison has an inference")
        sizes = [s.rows().agg(F.count(F.lit(1)).alias("n")) for s in self.whole]
        population = sizes[0].unionByName(sizes[1]).agg(F.max("n").alias("population_size"))  # one row
        counts = self.stats.select(
            F.col("diff_keys").alias("sample_differences"), F.greatest("rows_A", "rows_B").alias("sample_size")
        )
        return infer(counts.join(F.broadcast(population), F.lit(True), "left"))

    @cached_property
    def compared(self) -> Compared:
        """The differing rows in pairs; repeated keys are paired row by row."""
        if self.full is None:
            return replace(self.aligned, matched=materialize(self.aligned.matched))
        return replace(self.full, matched=materialize(self.full.different))

    @cached_property
    def diff(self) -> DataFrame:
        """The signed rows."""
        return self.rows_diff if self.full is None else self.compared.signed_rows()

    @cached_property
    def stats(self) -> DataFrame:
        """Counts, scores and rating, one row."""
        if self.full is None:
            base = hashdiff.rowset_stats(self.a, self.b, rules=self.options.rules)
            total = F.col("exclusive_A") + F.col("exclusive_B") + F.col("updated") + F.col("duplicated")
            return grading.rated(with_scores(base.withColumn("total", total)))
        c = self.compared
        zero = F.lit(0).cast("bigint")
        names = ["rows_A", "rows_B", "exclusive_A", "exclusive_B", "updated"]

        def part(df: DataFrame, **cols) -> DataFrame:
            return df.agg(*[cols.get(n, F.max(zero)).alias(n) for n in names])

        # Rows with NULL keys were left out of the comparison, so they are no part of its counts.
        counted = (
            part(self.a.rows().where(~any_null(self.a.keys)), rows_A=F.count(F.lit(1)))
            .unionByName(part(self.b.rows().where(~any_null(self.b.keys)), rows_B=F.count(F.lit(1))))
            .unionByName(
                part(
                    c.matched,
                    exclusive_A=F.count_if(c.only_a()),
                    exclusive_B=F.count_if(c.only_b()),
                    updated=F.count_if(c.changed()),
                )
            )
        )
        one = counted.agg(*[F.sum(n).alias(n) for n in names])
        one = one.withColumn("unchanged", F.col("rows_A") - F.col("exclusive_A") - F.col("updated"))
        one = one.withColumn("total", F.col("exclusive_A") + F.col("exclusive_B") + F.col("updated"))
        return grading.rated(with_scores(one))

    @cached_property
    def cells(self) -> DataFrame:
        return self.compared.cells()

    @cached_property
    def classification(self) -> DataFrame:
        return classify.classify_cells(self.compared, numeric_tolerance=self.options.rules.float_tolerance or 0.0)

    @cached_property
    def column_counts(self) -> DataFrame:
        return self.compared.column_counts()

    def column_statistics(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Profiles of both sides and their comparison."""
        left = profile.column_profile(self.a.filtered(), self.a.columns)
        right = profile.column_profile(self.b.filtered(), self.b.columns)
        return left, right, profile.compare_profiles(left, right)

    @cached_property
    def timeline(self) -> DataFrame:
        if not self.options.time_column or self.full is None:
            raise ValueError("set time_column and compare by unique keys")
        column = self.options.time_column
        buckets = timeline.make_buckets(self.a.filtered(), column, self.options.timeline_buckets)
        whole = self.full
        if self.algorithm == "hash":  # holds unequal segments only; a timeline counts all rows
            whole = compare_by_key(self.a, self.b, rules=self.options.rules, null_keys="skip")
        return timeline.timeline(whole, column, buckets)

    def alerts(self, thresholds: Mapping[str, float] | None = None) -> DataFrame:
        return grading.alerts(self.stats, dict(thresholds or {}))

    def save(self, path: str, comparison_id: str) -> ResultStore:
        """Write summary, details, column statistics, timeline and metrics; a run that fails is stored as failed."""
        store = ResultStore(self.a.df.sparkSession, path)
        begun = datetime.now(timezone.utc).replace(tzinfo=None)
        try:
            return self._save(store, comparison_id)
        except Exception as e:
            row = (self.a.name, self.b.name, list(self.a.keys), self.algorithm, begun, "failed", f"{type(e).__name__}: {e}")
            layout = (
                "source_table string, target_table string, key_columns array<string>, algorithm string, "
                "start_time timestamp_ntz, status string, error_message string"
            )
            store.save("comparison_summary", comparison_id, store.spark.createDataFrame([row], layout))
            raise

    def _save(self, store: ResultStore, comparison_id: str) -> ResultStore:
        spark = store.spark
        begun = datetime.now(timezone.utc).replace(tzinfo=None)
        clock = time.monotonic()
        row = self.stats.first()
        store.save("difference_details", comparison_id, detail_rows(self.compared))
        if self.options.profile_columns:
            left, right, _ = self.column_statistics()
            labels = F.to_json(F.struct(F.col("p25").alias("25"), F.col("p50").alias("50"), F.col("p75").alias("75")))
            left = left.join(profile.distributions(self.a.rows(), self.a.columns), "column_name", "left")
            right = right.join(profile.distributions(self.b.rows(), self.b.columns), "column_name", "left")
            both = left.withColumn("table_side", F.lit("source")).unionByName(right.withColumn("table_side", F.lit("target")))
            store.save("column_statistics", comparison_id, both.withColumn("percentiles", labels))
        if self.options.time_column and self.full is not None:
            store.save("timeline_analysis", comparison_id, timeline_rows(self.timeline, self.options.time_column))
        seconds = time.monotonic() - clock
        larger = max(row.rows_A, row.rows_B)
        metrics = [
            ("execution_time", seconds, "seconds"),
            ("throughput", larger / max(seconds, 1.0), "rows/second"),
        ]
        store.save(
            "performance_metrics",
            comparison_id,
            spark.createDataFrame(metrics, "metric_name string, metric_value double, metric_unit string"),
        )
        summary = spark.createDataFrame(
            [
                (
                    self.a.name,
                    self.b.name,
                    list(self.a.keys),
                    self.algorithm,
                    begun,
                    datetime.now(timezone.utc).replace(tzinfo=None),
                    seconds,
                    larger,
                    max(larger - row.diff_keys, 0),
                    row.diff_keys,
                    round(row.match_rate * 100, 2),
                    json.dumps({"percent": self.options.sample_percent, "size": self.options.sample_size}),
                    json.dumps(dict(self.options.remapping.mapping) if self.options.remapping else {}),
                    json.dumps(dict(zip(("source", "target"), self.where))),
                    "completed",
                )
            ],
            "source_table string, target_table string, key_columns array<string>, algorithm string, start_time timestamp_ntz, "
            "end_time timestamp_ntz, execution_time_seconds double, rows_compared bigint, rows_matched bigint, "
            "rows_different bigint, match_rate double, sampling_config string, column_remapping string, "
            "where_conditions string, status string",
        )
        store.save("comparison_summary", comparison_id, summary)
        return store


def timeline_rows(periods: DataFrame, time_column: str) -> DataFrame:
    """Timeline buckets in the layout of the result store."""
    return periods.select(
        F.lit(time_column).alias("time_column"),
        F.lit("bucket").alias("period_type"),
        F.col("bucket_start").alias("period_start"),
        F.col("bucket_end").alias("period_end"),
        F.col("rows_a").alias("source_count"),
        F.col("rows_b").alias("target_count"),
        (F.col("total_rows") - F.col("differences")).alias("matched_count"),
        F.col("differences").alias("difference_count"),
        (F.greatest(F.col("match_rate"), F.lit(0.0)) * 100).alias("match_rate"),
    )


def all_warnings(spark: SparkSession, a: TableSide, b: TableSide, options: Options) -> DataFrame:
    """Unsupported types, lowered precision, times with and without a zone, mapping entries without a column."""
    found = unsupported_types(spark, a, b, strict=options.strict_types)
    unused = options.remapping.warnings(a.value_columns, b.value_columns) if options.remapping else []
    rows = [(None, None, None, text) for text in unused]
    left, right = hashdiff.aligned(a, b, options.remapping)
    for ca, cb in pair_columns(left, right):
        if {type(left.dtype(ca)), type(right.dtype(cb))} == {T.TimestampType, T.TimestampNTZType}:
            rows.append((None, ca, f"{left.dtype(ca).simpleString()}, {right.dtype(cb).simpleString()}", "only one side has a time zone"))
        digits = lowered_scale(left.dtype(ca), right.dtype(cb))
        if digits is not None and not options.rules.tolerant(ca, left.dtype(ca), right.dtype(cb)):
            types = f"{left.dtype(ca).simpleString()}, {right.dtype(cb).simpleString()}"
            rows.append((None, ca, types, f"compared by {digits} fraction digits, finer differences are not seen"))
    return found.unionByName(spark.createDataFrame(rows, found.schema)) if rows else found


def with_found_forms(a: TableSide, b: TableSide) -> tuple[TableSide, TableSide]:
    """C14: text columns that hold nothing but UUIDs on both sides are compared as UUIDs; one aggregate per side."""
    pairs = [
        (ca, cb)
        for ca, cb in pair_columns(a, b)
        if isinstance(a.dtype(ca), T.StringType) and isinstance(b.dtype(cb), T.StringType) and not pair_form(a, b, ca, cb)
    ]
    if not pairs:
        return a, b
    kinds = [{r.column_name: r.kind for r in text_kinds(s.rows(), c).collect()} for s, c in zip((a, b), zip(*pairs))]
    found = [(ca, cb) for ca, cb in pairs if kinds[0][ca] == kinds[1][cb] == "uuid"]
    left = replace(a, text_forms=a.text_forms + tuple((ca, "uuid") for ca, _ in found))
    return left, replace(b, text_forms=b.text_forms + tuple((cb, "uuid") for _, cb in found))


def compare(a: TableSide, b: TableSide, options: Options | None = None, *, same_system: bool = True) -> ComparisonResult:
    """Compare two sides; the checks run now, the results on demand."""
    options = options or Options()
    check_keys(a, b)
    spark = a.df.sparkSession
    warnings = all_warnings(spark, a, b, options)
    where = (a.where, b.where)
    a, b = hashdiff.aligned(a, b, options.remapping)
    if options.detect_text_forms:
        a, b = with_found_forms(a, b)
    a, b = whole = with_key_forms(a, b)
    a, b = sampled(a, b, options)
    whole = None if options.sample_percent is None and options.sample_size is None else whole
    algorithm, unique = choose_algorithm(a, b, options, same_system)
    left, right = a, b
    if algorithm == "hash":
        left, right = hashdiff.unequal_parts(
            a, b, rules=options.rules, factor=options.factor, threshold=options.threshold, gaps=unique
        )
    if algorithm == "rows" or not unique:
        rows = hashdiff.rowset_diff(left, right, rules=options.rules)
        aligned = align_rows(left, right, rules=options.rules)
        return ComparisonResult(a, b, options, algorithm, None, rows, warnings, where, whole, aligned)
    full = compare_by_key(left, right, rules=options.rules, null_keys="skip")
    return ComparisonResult(a, b, options, algorithm, full, None, warnings, where, whole)

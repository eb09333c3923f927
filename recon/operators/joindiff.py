"""Comparison by full outer join on unique keys."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recon.functions.names import Remapping
from recon.functions.normalize import common_scale
from recon.functions.predicates import CompareRules
from recon.operators.keys import any_null, require_sound_keys
from recon.sources.side import TableSide, check_keys, pair_form, with_key_forms

NUMERIC = T.NumericType
KEYS_PER_TASK = 1 << 19


@dataclass(frozen=True)
class Compared:
    """Two sides matched by key.

    `matched` holds one row per key with positional columns ``a0..``, ``b0..``
    and the presence markers ``in_a``/``in_b``, so no column name of the user
    can clash with a suffix. Names come back at the edge, in `all_rows`,
    `diff_rows`, `signed_rows` and `cells`.
    """

    a: TableSide
    b: TableSide
    pairs: tuple[tuple[str, str], ...]
    matched: DataFrame
    rules: CompareRules = field(default_factory=CompareRules)

    # ---- columns -----------------------------------------------------------

    @property
    def key_count(self) -> int:
        return len(self.a.keys)

    @property
    def value_positions(self) -> range:
        return range(self.key_count, len(self.pairs))

    @staticmethod
    def only_a() -> Column:
        return F.col("in_b").isNull()

    @staticmethod
    def only_b() -> Column:
        return F.col("in_a").isNull()

    @staticmethod
    def in_both() -> Column:
        return F.col("in_a").isNotNull() & F.col("in_b").isNotNull()

    def differs(self, i: int) -> Column:
        """Non-null boolean: does pair `i` differ (a missing side counts as NULL)?"""
        ca, cb = self.pairs[i]
        if ca in self.rules.ignored_columns:
            return F.lit(False)
        form = pair_form(self.a, self.b, ca, cb)
        return self.rules.differs(F.col(f"a{i}"), F.col(f"b{i}"), ca, self.a.dtype(ca), self.b.dtype(cb), form)

    def any_value_differs(self) -> Column:
        tests = [self.differs(i) for i in self.value_positions]
        return reduce(lambda x, y: x | y, tests, F.lit(False))

    def changed(self) -> Column:
        return self.in_both() & self.any_value_differs()

    def is_different(self) -> Column:
        return self.only_a() | self.only_b() | self.any_value_differs()

    def text(self, i: int, which: str) -> Column:
        ca, cb = self.pairs[i]
        scale = common_scale(self.a.dtype(ca), self.b.dtype(cb))
        one, name = (self.a, ca) if which == "a" else (self.b, cb)
        return one.text(name, F.col(f"{which}{i}"), scale=scale)

    def key_columns(self) -> list[Column]:
        return [F.coalesce(F.col(f"a{i}"), F.col(f"b{i}")).alias(self.pairs[i][0]) for i in range(self.key_count)]

    # ---- row outputs -------------------------------------------------------

    @cached_property
    def different(self) -> DataFrame:
        """The matched rows that differ, still positional."""
        return self.matched.where(self.is_different())

    def _flat(self, rows: DataFrame) -> DataFrame:
        out = [
            (self.in_b_missing()).alias("is_exclusive_a"),
            (self.in_a_missing()).alias("is_exclusive_b"),
        ]
        out += [self.differs(i).cast("int").alias(f"is_diff_{ca}") for i, (ca, _) in enumerate(self.pairs)]
        for i, (ca, cb) in enumerate(self.pairs):
            out += [self.text(i, "a").alias(f"{ca}_a"), self.text(i, "b").alias(f"{cb}_b")]
        return rows.select(*out)

    in_b_missing = only_a
    in_a_missing = only_b

    def all_rows(self) -> DataFrame:
        """Every matched row with exclusivity flags, difference flags and both texts."""
        return self._flat(self.matched)

    def diff_rows(self) -> DataFrame:
        """Only the rows with a difference."""
        return self._flat(self.different)

    def signed_rows(self, typed: bool = False) -> DataFrame:
        """`-` for the A row and `+` for the B row of every difference, named as in A."""

        def half(sign: str, which: str) -> Column:
            fields = [
                (F.col(f"{which}{i}") if typed else self.text(i, which)).alias(ca) for i, (ca, _) in enumerate(self.pairs)
            ]
            return F.struct(F.lit(sign).alias("sign"), *fields)

        both = F.filter(
            F.array(F.when(~self.only_b(), half("-", "a")), F.when(~self.only_a(), half("+", "b"))),
            lambda r: r.isNotNull(),
        )
        return self.different.select(F.explode(both).alias("r")).select("r.*")

    def cells(self) -> DataFrame:
        """One row per differing value of a key present on both sides."""
        items = [
            F.when(
                self.differs(i),
                F.struct(
                    F.lit(self.pairs[i][0]).alias("column_name"),
                    self.text(i, "a").alias("source_value"),
                    self.text(i, "b").alias("target_value"),
                ),
            )
            for i in self.value_positions
        ]
        rows = self.matched.where(self.changed())
        exploded = rows.select(*self.key_columns(), F.explode(F.array(*items)).alias("cell")).where("cell is not null")
        return exploded.select(*self.pairs_key_names(), "cell.*")

    def pairs_key_names(self) -> list[str]:
        return [self.pairs[i][0] for i in range(self.key_count)]

    def exclusive(self, which: str) -> DataFrame:
        """The rows of one side whose key the other side lacks."""
        other = self.only_a() if which == "a" else self.only_b()
        return self.matched.where(other).select(
            *[F.col(f"{which}{i}").alias(self.pairs[i][0 if which == "a" else 1]) for i in range(len(self.pairs))]
        )

    # ---- numbers -----------------------------------------------------------

    def _counts(self) -> list[Column]:
        return [
            F.count("in_a").alias("rows_A"),
            F.count("in_b").alias("rows_B"),
            F.count_if(self.only_a()).alias("exclusive_A"),
            F.count_if(self.only_b()).alias("exclusive_B"),
            F.count_if(self.changed()).alias("updated"),
        ]

    def stats(self) -> DataFrame:
        """A4: the counts of a comparison, in one pass over the matched rows."""
        n = self.matched.agg(*self._counts())
        unchanged = F.col("rows_A") - F.col("exclusive_A") - F.col("updated")
        total = F.col("exclusive_A") + F.col("exclusive_B") + F.col("updated")
        return n.withColumn("unchanged", unchanged).withColumn("total", total)

    def diff_stats(self) -> DataFrame:
        """A3: counts plus difference score; both row and key counts are given.

        `diff_keys` counts an update once, `diff_rows` twice (both signs).
        """
        return with_scores(self.stats())

    def column_counts(self) -> DataFrame:
        """A5: per column, differences over all differing rows and over updated keys only."""
        aggs = []
        for i, (ca, _) in enumerate(self.pairs):
            hit = self.differs(i)
            aggs.append(
                F.struct(
                    F.lit(ca).alias("column_name"),
                    F.count_if(self.is_different() & hit).alias("diff_count"),
                    F.count_if(self.in_both() & hit).alias("values_changed"),
                )
            )
        one = self.matched.agg(F.array(*aggs).alias("all"))
        return one.select(F.explode("all").alias("c")).select("c.*")

    def exclusive_count(self) -> DataFrame:
        """K5: how many rows are on one side only."""
        return self.matched.agg(F.count_if(self.only_a() | self.only_b()).alias("exclusive_count"))

    def exclusive_sample(self, n: int = 10, seed: int | None = None) -> DataFrame:
        """K5: a few exclusive rows, those with the smallest digest of the key, or of seed and key; repeatable either way."""
        rows = self.matched.where(self.only_a() | self.only_b())
        salt = [] if seed is None else [F.lit(str(seed))]
        order = F.md5(F.concat_ws("|", *salt, *[c.cast("string") for c in self.key_columns()]))
        flat = [self.text(i, w).alias(f"{self.pairs[i][0 if w == 'a' else 1]}_{w}") for i in range(len(self.pairs)) for w in "ab"]
        return rows.orderBy(order, *self.key_columns()).limit(n).select(*flat)


def with_scores(stats: DataFrame) -> DataFrame:
    """Add `diff_keys`, `diff_rows`, `diff_percent`, `match_rate` and `legacy_match_rate`.

    The score divides by the larger side. `match_rate` counts an updated key
    once; `legacy_match_rate` counts its two signed rows.
    """
    larger = F.greatest("rows_A", "rows_B")
    keys = F.col("exclusive_A") + F.col("exclusive_B") + F.col("updated")
    rows = keys + F.col("updated")
    return (
        stats.withColumn("diff_keys", keys)
        .withColumn("diff_rows", rows)
        .withColumn("diff_percent", F.when(larger > 0, 1 - F.col("unchanged") / larger).otherwise(F.lit(0.0)))
        .withColumn("match_rate", F.when(larger > 0, 1 - keys / larger).otherwise(F.lit(1.0)))
        .withColumn("legacy_match_rate", F.when(larger > 0, 1 - rows / larger).otherwise(F.lit(1.0)))
    )


def pair_columns(a: TableSide, b: TableSide, remapping: Remapping | None = None) -> tuple[tuple[str, str], ...]:
    """Key pairs first (by position), then value pairs (by position, or through a remapping)."""
    keys = list(zip(a.keys, b.keys))
    if remapping is not None:
        return tuple(keys + remapping.pairs(a.value_columns, b.value_columns))
    if len(a.value_columns) != len(b.value_columns):
        raise ValueError("both sides need the same number of compared columns")
    return tuple(keys + list(zip(a.value_columns, b.value_columns)))


def compare_by_key(
    a: TableSide,
    b: TableSide,
    *,
    rules: CompareRules | None = None,
    remapping: Remapping | None = None,
    null_keys: str = "keep",
    hint: str | None = None,
) -> Compared:
    """Match two sides with unique keys by one full outer join.

    One shuffle per side, on the keys; sides stored bucketed by the keys need
    none. Rows with a NULL key part match nothing, and in a join they would all
    meet in one partition, so they bypass it: they are appended as exclusive
    rows (`null_keys="keep"`) or left out (`"skip"`).
    """
    check_keys(a, b)
    a, b = with_key_forms(a, b)
    pairs = pair_columns(a, b, remapping)
    n = len(a.keys)
    cols_a = [F.col(ca).alias(f"a{i}") for i, (ca, _) in enumerate(pairs)]
    cols_b = [F.col(cb).alias(f"b{i}") for i, (_, cb) in enumerate(pairs)]
    rows_a = a.rows().select(*cols_a, F.lit(True).alias("in_a"))
    rows_b = b.rows().select(*cols_b, F.lit(True).alias("in_b"))

    whole_a, whole_b = _no_null(n, "a"), _no_null(n, "b")
    on = [F.col(f"a{i}") == F.col(f"b{i}") for i in range(n)]
    right = rows_b.where(whole_b)
    matched = rows_a.where(whole_a).join(right.hint(hint) if hint else right, on, "full_outer")
    if null_keys == "keep":
        for loose in (rows_a.where(~whole_a), rows_b.where(~whole_b)):
            matched = matched.unionByName(loose, allowMissingColumns=True)
    elif null_keys != "skip":
        raise ValueError("null_keys must be 'keep' or 'skip'")
    return Compared(a, b, pairs, matched, rules or CompareRules())


def _no_null(n: int, which: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{which}{i}").isNotNull() for i in range(n)])


def emulated_outer(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Outer join as the distinct union of a left and a right join (for parity checks)."""
    on = [a[k] == b[k] for k in keys]
    return a.join(b, on, "left").union(a.join(b, on, "right")).distinct()


def both_sides(a: TableSide, b: TableSide) -> DataFrame:
    """Rows of A whose key is also in B."""
    return _by_presence(a, b, "left_semi")


def only_left(a: TableSide, b: TableSide) -> DataFrame:
    """Rows of A whose key is not in B; a NULL key is in no table."""
    null = any_null(a.keys)
    return _by_presence(a, b, "left_anti").unionByName(a.rows().where(null))


def _by_presence(a: TableSide, b: TableSide, how: str) -> DataFrame:
    """Semi or anti join on whole keys.

    Tasks hold about KEYS_PER_TASK rows each, however many there are: their number
    is set, so adaptive execution does not merge them, and no task makes the keys
    of a whole file distinct. The keys of B are made distinct in parts first, so a
    frequent key of B meets in one task as often as there are tasks, at most.
    """
    left = a.rows().where(~any_null(a.keys))
    right = b.rows().select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(b.keys)])
    right = right.where(~any_null(tuple(right.columns)))
    keys = right.columns
    n = max(left.sparkSession.sparkContext.defaultParallelism, -(-max(left.count(), right.count()) // KEYS_PER_TASK))
    parts = right.withColumn("__part", F.monotonically_increasing_id() % n).repartition(n, *keys, "__part").distinct()
    right = parts.drop("__part").repartition(n, *keys).distinct()
    # Many keys in a row take few bytes, so they would be broadcast whole.
    return left.join(right.hint("merge"), [left[k] == right[f"__{i}"] for i, k in enumerate(a.keys)], how)


def side_stats(s: TableSide) -> DataFrame:
    """A2: row count and the sum of every numeric value column, in one aggregate.

    Floating columns add up as decimals, so the result does not depend on the
    order in which partitions finish.
    """
    aggs = [F.count(F.lit(1)).alias("count")]
    for c in s.value_columns:
        dtype = s.dtype(c)
        if isinstance(dtype, NUMERIC):
            scale = dtype.scale if isinstance(dtype, T.DecimalType) else 6 if isinstance(dtype, (T.FloatType, T.DoubleType)) else 0
            aggs.append(F.sum(F.col(c).cast(T.DecimalType(28, scale))).cast("double").alias(f"sum_{c}"))
    return s.rows().agg(*aggs)


def join_diff(
    a: TableSide,
    b: TableSide,
    *,
    rules: CompareRules | None = None,
    remapping: Remapping | None = None,
    validate_unique_key: bool = True,
    skip_null_keys: bool = False,
) -> Compared:
    """Validate the keys, then compare by key.

    Duplicate keys would multiply in the join, so they raise unless the caller
    vouches for uniqueness (K4); use `rowset_diff` for data with duplicates.
    """
    check_keys(a, b)
    a, b = with_key_forms(a, b)
    require_sound_keys(a, b, unique=validate_unique_key, no_nulls=not skip_null_keys)
    return compare_by_key(a, b, rules=rules, remapping=remapping, null_keys="skip")

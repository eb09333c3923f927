"""Key checks: uniqueness, NULLs, health (K1-K8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recon.sources.side import TableSide


class DuplicateKeysError(ValueError):
    """A key that should be unique occurs more than once."""


class NullKeysError(ValueError):
    """A key column holds NULL."""


def any_null(keys: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])


def duplicate_keys(s: TableSide) -> DataFrame:
    """K1: keys with more than one row, and how many rows; grouped by the real columns."""
    counts = s.rows().groupBy(*s.keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.where(F.col("n_rows") > 1)


def require_unique_keys(s: TableSide) -> None:
    """K1: raise on the first duplicate key; the partial counts are combined before the shuffle."""
    found = duplicate_keys(s).limit(1).collect()
    if found:
        raise DuplicateKeysError(f"duplicate primary keys in {s.name}, for example {found[0].asDict()}")


def null_key_rows(s: TableSide) -> DataFrame:
    """K2: rows with a NULL in any key column."""
    return s.rows().where(any_null(s.keys))


def require_no_null_keys(s: TableSide) -> None:
    if null_key_rows(s).limit(1).collect():
        raise NullKeysError(f"{s.name} has rows whose key is NULL in part or whole")


def key_facts(a: TableSide, b: TableSide) -> list[tuple[int, int]]:
    """Per side: keys with a NULL part, and rows of the most frequent whole key. One job for both sides."""
    parts = [
        s.rows().select(F.lit(i).alias("side"), *[F.col(k).alias(f"k{n}") for n, k in enumerate(s.keys)])
        for i, s in enumerate((a, b))
    ]
    keys = [f"k{n}" for n in range(len(a.keys))]
    counts = parts[0].unionByName(parts[1]).groupBy("side", *keys).agg(F.count(F.lit(1)).alias("n"))
    is_null = any_null(tuple(keys))
    found = counts.groupBy("side").agg(
        F.count_if(is_null).alias("nulls"), F.max(F.when(~is_null, F.col("n"))).alias("most")
    )
    by_side = {r.side: (r.nulls, r.most or 0) for r in found.collect()}
    return [by_side.get(i, (0, 0)) for i in (0, 1)]


def require_sound_keys(a: TableSide, b: TableSide, *, unique: bool = True, no_nulls: bool = True) -> None:
    """K1, K2 for both sides; nothing runs when neither is asked for."""
    if not unique:
        for s in (a, b) if no_nulls else ():
            require_no_null_keys(s)
        return
    for s, (nulls, most) in zip((a, b), key_facts(a, b)):
        if no_nulls and nulls:
            raise NullKeysError(f"{s.name} has rows whose key is NULL in part or whole")
        if most > 1:
            require_unique_keys(s)  # names an offending key


def row_count(s: TableSide) -> DataFrame:
    """K7."""
    return s.rows().agg(F.count(F.lit(1)).alias("n_rows"))


def key_summary(s: TableSide) -> DataFrame:
    """Total rows, NULL-key rows, distinct keys, and rows beyond the first of their key."""
    per_key = s.rows().groupBy(*s.keys).agg(F.count(F.lit(1)).alias("n"))
    is_null = any_null(s.keys)
    zero = F.lit(0).cast("bigint")
    return per_key.agg(
        F.coalesce(F.sum("n"), zero).alias("total_rows"),
        F.coalesce(F.sum(F.when(is_null, F.col("n"))), zero).alias("nulls"),
        F.count_if(~is_null).alias("distincts"),
        F.coalesce(F.sum(F.when(~is_null, F.col("n") - 1)), zero).alias("dupes"),
    )


def key_health(a: TableSide, b: TableSide) -> DataFrame:
    """K6: one row per side with totals, NULLs, duplicates, distinct keys and exclusive keys.

    Both sides are reduced to one row per key before they meet, so hot keys
    cost nothing extra.
    """
    from recon.operators.hashdiff import key_counts

    per_key = key_counts(a, b)
    n = len(a.keys)
    names = [f"k{i}" for i in range(n)]
    is_null = reduce(lambda x, y: x | y, [F.col(k).isNull() for k in names])
    zero = F.lit(0).cast("bigint")

    def numbers(mine: str, other: str) -> list[Column]:
        c, o = F.col(mine), F.col(other)
        return [
            F.coalesce(F.sum(c), zero).alias(f"total_rows_{mine}"),
            F.coalesce(F.sum(F.when(is_null, c)), zero).alias(f"nulls_{mine}"),
            F.coalesce(F.sum(F.when(~is_null & (c > 1), c - 1)), zero).alias(f"dupes_{mine}"),
            F.count_if(~is_null & (c > 0)).alias(f"distincts_{mine}"),
            F.count_if(~is_null & (c > 0) & (o == 0)).alias(f"exclusives_{mine}"),
        ]

    one = per_key.agg(*numbers("n_a", "n_b"), *numbers("n_b", "n_a"))
    fields = ["total_rows", "nulls", "dupes", "distincts", "exclusives"]
    sides = [
        F.struct(F.lit(label).alias("side"), *[F.col(f"{f}_{mine}").alias(f) for f in fields])
        for label, mine in (("A", "n_a"), ("B", "n_b"))
    ]
    return one.select(F.explode(F.array(*sides)).alias("s")).select("s.*")


def column_match(compared) -> DataFrame:
    """K6: share of matched keys with an equal value, per column."""
    both = compared.in_both()
    items = [
        F.struct(
            F.lit(compared.pairs[i][0]).alias("column_name"),
            F.avg(F.when(both, F.when(compared.differs(i), 0.0).otherwise(100.0))).alias("match_percent"),
            F.count_if(both & compared.differs(i)).alias("rows_with_differences"),
        )
        for i in compared.value_positions
    ]
    return compared.matched.agg(F.array(*items).alias("all")).select(F.explode("all").alias("c")).select("c.*")

"""Pairs of rows where keys repeat.

Rows of a key that are equal on both sides cancel out by their numbers. What is
left is paired in the order of the values, NULL first, and what finds no partner is
exclusive to its side. The result has the form of a join of unique keys, so
cells, classes, counts per column and stored details come from it as from any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recon.functions.predicates import CompareRules
from recon.operators.hashdiff import _row_hashes
from recon.operators.joindiff import Compared, pair_columns
from recon.sources.side import TableSide, check_keys, with_key_forms

STEP = 100_000  # repetitions that are written out at a time
UNORDERED = (T.MapType, T.VariantType)


def align_rows(a: TableSide, b: TableSide, *, rules: CompareRules | None = None) -> Compared:
    """The differing rows of two sides whose keys may repeat, in pairs; equal rows are left out.

    Equality is that of the rules. NULL keys are a group like any other. Counting
    keeps a sum per (key, row hash), combined before the shuffle, so equal rows of
    a frequent key are one number per task; only rows that are left over are read
    again, and each different one is ordered once within its key, whatever its
    number. A tolerance is no equivalence and is refused.
    """
    check_keys(a, b)
    a, b = with_key_forms(a, b)
    rules = rules or CompareRules()
    pairs, n = pair_columns(a, b), len(a.keys)
    keys = [f"k{i}" for i in range(n)]
    group = [*keys, "h1", "h2"]

    def rows_of(which: str, one: TableSide) -> DataFrame:
        names = [p[0] if which == "-" else p[1] for p in pairs]
        h1, h2 = _row_hashes(a, b, which, rules)
        named = [F.col(c).alias(f"k{i}" if i < n else f"v{i}") for i, c in enumerate(names)]
        return one.rows().select(*named, h1.alias("h1"), h2.alias("h2"))

    left, right = rows_of("-", a), rows_of("+", b)
    signed = left.select(*group, F.lit(1).alias("s")).unionByName(right.select(*group, F.lit(-1).alias("s")))
    spare = signed.groupBy(*group).agg(F.sum("s").alias("spare")).where("spare <> 0")
    places_a = _places(left, spare.where("spare > 0"), keys, "a")
    places_b = _places(right, spare.where("spare < 0"), keys, "b")
    on = [F.col(f"a{i}").eqNullSafe(F.col(f"b{i}")) for i in range(n)]
    matched = places_a.join(places_b, [*on, F.col("place_a") == F.col("place_b")], "full_outer").drop("place_a", "place_b")
    return Compared(a, b, pairs, matched, rules)


def _places(rows: DataFrame, spare: DataFrame, keys: list[str], which: str) -> DataFrame:
    """The left-over rows of a side, numbered within their key: a0.., in_a, place_a (or b)."""
    group = [*keys, "h1", "h2"]
    values = [f.name for f in rows.schema.fields if f.name not in group]
    ordered = [v for v in values if not isinstance(rows.schema[v].dataType, UNORDERED)]
    renamed = spare.select(*[F.col(c).alias(f"w_{c}") for c in group], F.abs("spare").alias("times"))
    same = [F.col(k).eqNullSafe(F.col(f"w_{k}")) for k in keys] + [F.col(h) == F.col(f"w_{h}") for h in ("h1", "h2")]
    content = F.struct(*values) if values else F.struct(F.lit(0).alias("none"))
    pick = F.min if len(ordered) == len(values) else F.first  # rows of a group are equal by the rules
    one = rows.join(renamed, same).groupBy(*group, "times").agg(pick(content).alias("row")).select(*group, "times", "row.*")
    run = Window.partitionBy(*keys).orderBy(*ordered, "h1", "h2").rowsBetween(Window.unboundedPreceding, 0)
    ends = one.withColumn("end", F.sum("times").over(run))
    chunks = ends.withColumn("first", F.explode(F.sequence(F.col("end") - F.col("times") + 1, F.col("end"), F.lit(STEP).cast("bigint"))))
    places = chunks.withColumn("place", F.explode(F.sequence("first", F.least(F.col("first") + STEP - 1, "end"))))
    taken: list[Column] = [F.col(c).alias(f"{which}{i}") for i, c in enumerate(keys + values)]
    return places.select(*taken, F.lit(True).alias(f"in_{which}"), F.col("place").alias(f"place_{which}"))

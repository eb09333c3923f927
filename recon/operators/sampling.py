"""Samples that both sides agree on, and what they say about the whole (M1-M7)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recon.functions.checksum import NULL_TEXT, low48, md5_bucket
from recon.plans.lineage import materialize

DIGITS = 3  # hexadecimal digits of a digest that one counting pass looks at
MOST_STRATA = 100_000  # more bounds than this are joined by a shuffle

# Z scores of common confidence levels.
Z_SCORES = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576, 0.995: 2.807, 0.999: 3.291}


def z_score(confidence: float) -> float:
    return Z_SCORES.get(confidence) or NormalDist().inv_cdf(1 - (1 - confidence) / 2)


def _share_of(keys: Sequence[str], seed: int) -> Column:
    """A number in [0, 1) made of seed and key: the same for a key wherever its row lies."""
    return low48(F.concat(F.lit(f"{seed}|"), key_text(keys))) / F.lit(float(1 << 48))


def percent_sample(df: DataFrame, percent: float, keys: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """M1: Bernoulli sample, decided row by row inside the scan; repeatable for any file layout if keys are given."""
    if keys is None:
        return df.sample(withReplacement=False, fraction=percent / 100.0, seed=seed)
    return df.where(_share_of(keys, seed) < percent / 100.0)


def block_sample(df: DataFrame, percent: float, seed: int = 42) -> DataFrame:
    """M1, by blocks: all rows of about `percent` of the files that `df` scans, the other files are not opened.

    A file is taken by a digest of seed and file name, which its directory listing tells,
    so the same files are taken on every read, and a larger percentage adds files to
    those of a smaller one. Rows of a file come together: cheap, but rows that were
    written together are not independent. `df` must be a scan of files, possibly
    filtered and projected; a table of few files gives a coarse sample.
    """
    return df.where(low48(F.concat(F.lit(f"{seed}|"), F.col("_metadata.file_name"))) / F.lit(float(1 << 48)) < percent / 100.0)


def fixed_sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """M2: exactly `n` random rows (all, if fewer): those with the smallest digest of seed and key.

    The same rows whatever the file layout. See `smallest_digests`; its counting passes run now.
    """
    return smallest_digests(df, F.md5(F.concat(F.lit(f"{seed}|"), key_text(keys))), keys, n)


def hashed_sample(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """M2, repeatable: the `n` rows with the smallest key digest."""
    return smallest_digests(df, F.md5(key_text(keys)), keys, n)


def smallest_digests(df: DataFrame, digest: Column, keys: Sequence[str], n: int, stratum: str | None = None) -> DataFrame:
    """The `n` rows with the smallest digest (hexadecimal text), of the whole table or of each stratum; ties go by the keys.

    Two counting passes find, per stratum, the bucket of 24 leading bits in which the
    n-th row lies: rows before it are kept by a plain filter, and only that bucket, a
    16-millionth of the rows, is ordered. No task sends its n best rows, so n may be
    as large as the table. NULL is a stratum like any other.
    """
    columns, group = df.columns, ["__stratum"]
    tagged = df.withColumn("__stratum", F.lit(0) if stratum is None else F.col(stratum)).withColumn("__digest", digest)

    def boundary(rows: DataFrame, length: int, below: Column) -> DataFrame:
        counts = rows.groupBy(*group, F.substring("__digest", 1, length).alias("p")).agg(
            F.count(F.lit(1)).alias("rows"), F.max(below).alias("less")
        )
        run = Window.partitionBy(*group).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)  # 4,096 buckets
        seen = counts.withColumn("seen", F.sum("rows").over(run) + F.col("less"))
        crossed = seen.where((F.col("seen") >= n) & (F.col("seen") - F.col("rows") < n))
        return materialize(crossed.select(F.col("__stratum").alias("s"), "p", (F.col("seen") - F.col("rows")).alias("less")), "bounds")

    def known(rows: DataFrame, bounds: DataFrame, how: str) -> DataFrame:
        few = bounds.count() <= MOST_STRATA
        return rows.join(F.broadcast(bounds) if few else bounds, F.col("__stratum").eqNullSafe(F.col("s")), how)

    if n < 1:
        return df.limit(0)
    first = boundary(tagged, DIGITS, F.lit(0))
    inside = known(tagged, first, "inner").where(F.substring("__digest", 1, DIGITS) == F.col("p"))
    placed = known(tagged, boundary(inside, 2 * DIGITS, F.col("less")), "left")
    place = F.substring("__digest", 1, 2 * DIGITS)
    whole = placed.where(F.col("p").isNull() | (place < F.col("p")))
    order = Window.partitionBy(*group).orderBy("__digest", *keys)
    edge = placed.where(place == F.col("p")).withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= n - F.col("less"))
    return whole.select(*columns).unionByName(edge.select(*columns))


def key_text(keys: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit(NULL_TEXT)) for k in keys])


def modulus(*, percent: float | None = None, size: int | None = None, total: int | None = None) -> int:
    """M3: keep one key in this many.

    `int(100 / percent)` rounds down: 30 % keeps every third key and anything
    above 50 % keeps all.
    """
    if percent is not None:
        return max(1, int(100 / percent))
    if size is None or total is None:
        raise ValueError("give a percentage, or a size with the total")
    return 1 if total <= size else max(2, int(total / size))


def key_sample(df: DataFrame, keys: Sequence[str], m: int) -> DataFrame:
    """M3: rows whose key falls on the modulus, so both sides keep the same keys.

    One integer key is tested directly (a plain filter the scan can run);
    other and compound keys by the low 48 bits of their MD5.
    """
    if m <= 1:
        return df
    if len(keys) == 1 and df.schema[keys[0]].dataType.typeName() in ("byte", "short", "integer", "long"):
        return df.where(F.pmod(F.col(keys[0]), F.lit(m)) == 0)
    return df.where(md5_bucket(key_text(keys), m) == 0)


@dataclass(frozen=True)
class SamplePlan:
    """Settings for proposing a sample size; nothing is sampled unless a caller asks for it."""

    confidence: float = 0.95
    margin_of_error: float = 0.01
    min_size: int = 1_000
    max_size: int = 1_000_000
    threshold: int = 100_000
    largest_share: float = 0.8

    def size_for(self, rows: int) -> int | None:
        """M4: proposed sample size for a table, None when sampling would not pay."""
        if rows <= self.threshold:
            return None
        n = sample_size(rows, self.confidence, self.margin_of_error)
        n = min(self.max_size, max(self.min_size, n))
        return None if n >= rows * self.largest_share else n


def sample_size(population: int, confidence: float = 0.95, margin: float = 0.01, proportion: float = 0.5) -> int:
    """M4: rows needed for a margin of error, with finite-population correction."""
    n = math.ceil(z_score(confidence) ** 2 * proportion * (1 - proportion) / margin**2)
    return math.ceil(n / (1 + (n - 1) / population)) if population > 0 else n


def infer(counts: DataFrame, confidence: float = 0.95) -> DataFrame:
    """M5: from `(sample_differences, sample_size, population_size)` to the whole table.

    Uses the difference total once (differing keys over sampled keys).
    """
    z = F.lit(z_score(confidence))
    n, total = F.col("sample_size"), F.col("population_size")
    p = F.when(n > 0, F.col("sample_differences") / n).otherwise(F.lit(0.0))
    error = F.when(n > 1, F.sqrt(p * (1 - p) / n)).otherwise(F.lit(0.0))
    low, high = F.greatest(F.lit(0.0), p - z * error), F.least(F.lit(1.0), p + z * error)
    return counts.select(
        "sample_differences",
        "sample_size",
        "population_size",
        p.alias("sample_proportion"),
        error.alias("standard_error"),
        (z * error).alias("margin_of_error"),
        low.alias("ci_low"),
        high.alias("ci_high"),
        F.floor(p * total).cast("bigint").alias("estimated_differences"),
        F.floor(low * total).cast("bigint").alias("estimated_low"),
        F.floor(high * total).cast("bigint").alias("estimated_high"),
        F.when(n > 0, total / n).otherwise(F.lit(0.0)).alias("extrapolation_factor"),
    )


def numbered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows with their place 1, 2, ... in key order, as `__place`.

    A window over the whole table would number it in one task. Instead the rows
    are range-partitioned and sorted by key, numbered inside each partition, and
    each partition starts from the row count of those before it: a list with one
    number per partition. The range-partitioned rows are written out once, so both
    uses see the same partition boundaries, also after a lost executor.
    """
    local_bits = 33  # layout of monotonically_increasing_id
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    marked = materialize(ranged.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", local_bits)
    local = F.col("__id").bitwiseAND(F.lit((1 << local_bits) - 1)) + 1
    sizes = marked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    joined = marked.join(F.broadcast(offsets), part == F.col("part"))
    return joined.select(*df.columns, (F.col("offset") + local).alias("__place"))


def systematic_sample(df: DataFrame, keys: Sequence[str], every: int) -> DataFrame:
    """M6: every k-th row in key order."""
    return numbered(df, keys).where(F.col("__place") % every == 0).drop("__place")


def stratified_sample(
    df: DataFrame, stratum: str, fractions: dict[Any, float], keys: Sequence[str] | None = None, seed: int = 42
) -> DataFrame:
    """M7: a fraction per stratum, none of strata that are not named; repeatable if keys are given."""
    if keys is None:
        return df.sampleBy(stratum, fractions, seed)
    wanted = F.coalesce(*[F.when(F.col(stratum) == F.lit(v), F.lit(f)) for v, f in fractions.items()], F.lit(0.0))
    return df.where(_share_of(keys, seed) < wanted)


def stratified_fixed(df: DataFrame, stratum: str, keys: Sequence[str], n: int) -> DataFrame:
    """M7, repeatable: `n` rows per stratum by key digest, however large a stratum is; see `smallest_digests`."""
    return smallest_digests(df, F.md5(key_text(keys)), keys, n, stratum)

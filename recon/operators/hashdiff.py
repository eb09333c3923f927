"""Comparison by checksums and by row sets."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recon.functions.checksum import fingerprint
from recon.functions.names import Remapping
from recon.functions.normalize import common_scale, json_text
from recon.functions.predicates import CompareRules
from recon.operators.joindiff import pair_columns
from recon.operators.segments import Segmenter, make_segmenter, segment_checksums, table_checksum
from recon.operators.splitters import RangeSegmenter, rows_segmenter
from recon.sources.side import TableSide, check_keys, pair_form, with_key_forms

# Default number of segments per level and the row count below
# which a segment is compared row by row.
FACTOR = 32
THRESHOLD = 16_384

# Checksum levels at most; a further one must have left out this share of the rows.
LEVELS = 4
LEAST_SHARE = 0.1


def common_scales(a: TableSide, b: TableSide) -> tuple[dict[str, int], dict[str, int]]:
    """Lowest common fraction digits of each column pair, by name on either side."""
    sa, sb = {}, {}
    for ca, cb in pair_columns(a, b):
        scale = common_scale(a.dtype(ca), b.dtype(cb))
        if scale is not None:
            sa[ca] = sb[cb] = scale
    return sa, sb


def check_column_types(a: TableSide, b: TableSide, strict: bool = True) -> list[tuple[str, str, str, str]]:
    """Pairs of incompatible families; `strict` raises on the first."""
    families = ((T.NumericType, T.BooleanType), (T.DateType, T.TimestampType, T.TimestampNTZType))
    bad = []
    for ca, cb in pair_columns(a, b):
        da, db = a.dtype(ca), b.dtype(cb)
        if any(isinstance(da, f) and not isinstance(db, f) for f in families):
            if strict:
                raise TypeError(f"incompatible types for column {ca!r}: {da.simpleString()} <-> {db.simpleString()}")
            bad.append((ca, cb, da.simpleString(), db.simpleString()))
    return bad


# ---- row sets ---------------------------------------------------------------


def _row_hashes(a: TableSide, b: TableSide, which: str, rules: CompareRules, *, with_keys: bool = False) -> list[Column]:
    """Two 64-bit hashes over the comparable values of one side ('-' is A, '+' is B).

    They are the values that the join compares, so all algorithms agree on what is equal.
    """
    n, compared = len(a.keys), []
    for i, (ca, cb) in enumerate(pair_columns(a, b)):
        is_key = i < n
        if (is_key and not with_keys) or (not is_key and ca in rules.ignored_columns):
            continue
        one, name = (a, ca) if which == "-" else (b, cb)
        own, other = (a.dtype(ca), b.dtype(cb)) if which == "-" else (b.dtype(cb), a.dtype(ca))
        if not is_key and rules.tolerant(ca, own, other):
            raise ValueError("a tolerance is no equivalence relation; use join_diff for float_tolerance")
        how = CompareRules() if is_key else rules
        compared.append(how.comparable(F.col(name), ca, own, other, pair_form(a, b, ca, cb)))
    return fingerprint(compared)


def _tagged(a: TableSide, b: TableSide, rules: CompareRules) -> DataFrame:
    """Rows of both sides in one frame: side tag, keys k0.., values v0.., two hashes of the compared values."""
    pairs = pair_columns(a, b)
    n = len(a.keys)
    frames = []
    for which, one in (("-", a), ("+", b)):
        names = [p[0] if which == "-" else p[1] for p in pairs]
        keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(names[:n])]
        values = [F.col(c).alias(f"v{i}") for i, c in enumerate(names[n:])]
        h1, h2 = _row_hashes(a, b, which, rules)
        frames.append(one.rows().select(F.lit(which).alias("sign"), *keys, *values, h1.alias("h1"), h2.alias("h2")))
    return frames[0].unionByName(frames[1])


def key_counts(a: TableSide, b: TableSide) -> DataFrame:
    """Rows per key on each side, reduced before the shuffle: k0.., n_a, n_b."""
    n = len(a.keys)
    parts = [
        s.rows().select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(s.keys)], F.lit(ia).alias("ia"), F.lit(1 - ia).alias("ib"))
        for s, ia in ((a, 1), (b, 0))
    ]
    return (
        parts[0]
        .unionByName(parts[1])
        .groupBy(*[f"k{i}" for i in range(n)])
        .agg(F.sum("ia").alias("n_a"), F.sum("ib").alias("n_b"))
    )


def _key_verdicts(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with counts and whether its rows must be reported.

    A key is reported unless it has exactly one row on each side and both hash
    alike. Counts and hash extremes are plain longs, so partial aggregation
    collapses a hot key before anything is shuffled.
    """
    per_key = tagged.groupBy(*keys).agg(
        F.count_if(F.col("sign") == "-").alias("n_a"),
        F.count_if(F.col("sign") == "+").alias("n_b"),
        *[f(h).alias(f"{name}_{h}") for h in ("h1", "h2") for name, f in (("lo", F.min), ("hi", F.max))],
    )
    same = (F.col("lo_h1") == F.col("hi_h1")) & (F.col("lo_h2") == F.col("hi_h2"))
    one_each = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    return per_key.select(*keys, "n_a", "n_b", (~(one_each & same)).alias("reported"))


def rowset_diff(
    a: TableSide,
    b: TableSide,
    *,
    rules: CompareRules | None = None,
    as_text: bool = True,
) -> DataFrame:
    """D3: duplicate-safe difference: `(sign, keys.., values..)`.

    If either side has other than one row for a key, all rows of that key are
    reported; if both have one, they are reported when they differ in a column
    that is not ignored. Ignored columns stay in the output.

    First pass: per key two counts and two hash ranges (small, pre-aggregated).
    Second pass: the rows of the reported keys by a left-semi join. It becomes a
    broadcast when few keys differ; otherwise adaptive execution can split the
    rows of a frequent key over tasks, since no row of the left side needs another.
    NULL keys form a group like any other.
    """
    check_keys(a, b)
    a, b = with_key_forms(a, b)
    rules = rules or CompareRules()
    keys = [f"k{i}" for i in range(len(a.keys))]
    tagged = _tagged(a, b, rules)
    reported = _key_verdicts(tagged, keys).where("reported").select(*keys)
    return _named(_semi(tagged, reported, keys), a, b, as_text)


def _semi(rows: DataFrame, wanted: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """Semi or anti join where NULL keys equal each other."""
    renamed = wanted.select(*[F.col(k).alias(f"w_{k}") for k in keys])
    on = reduce(lambda x, y: x & y, [rows[k].eqNullSafe(renamed[f"w_{k}"]) for k in keys])
    return rows.join(renamed, on, how)


def _named(picked: DataFrame, a: TableSide, b: TableSide, as_text: bool) -> DataFrame:
    out = [F.col("sign")]
    n = len(a.keys)
    for i, (ca, cb) in enumerate(pair_columns(a, b)):
        c = F.col(f"k{i}" if i < n else f"v{i - n}")
        if as_text:
            c = a.text(ca, c, scale=common_scale(a.dtype(ca), b.dtype(cb)))
        out.append(c.alias(ca))
    return picked.select(*out)


def rowset_stats(a: TableSide, b: TableSide, *, rules: CompareRules | None = None) -> DataFrame:
    """A4 for data with duplicates: keys with several rows get a class of their own.

    `updated` counts keys with one row on each side that differ; `exclusive_*`
    count rows whose key the other side lacks; `duplicated` counts keys present
    on both sides with several rows on at least one.
    """
    a, b = with_key_forms(a, b)
    keys = [f"k{i}" for i in range(len(a.keys))]
    v = _key_verdicts(_tagged(a, b, rules or CompareRules()), keys)
    na, nb = F.col("n_a"), F.col("n_b")
    zero = F.lit(0).cast("bigint")
    one_each = (na == 1) & (nb == 1)

    def total(c: Column, name: str) -> Column:
        return F.coalesce(F.sum(c), zero).alias(name)

    return v.agg(
        total(na, "rows_A"),
        total(nb, "rows_B"),
        total(F.when(nb == 0, na), "exclusive_A"),
        total(F.when(na == 0, nb), "exclusive_B"),
        F.count_if(one_each & F.col("reported")).alias("updated"),
        F.count_if(one_each & ~F.col("reported")).alias("unchanged"),
        F.count_if((na > 0) & (nb > 0) & ~one_each).alias("duplicated"),
    )


def ordered_diff(diff: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """Sorted by key with `-` before `+`; with `n`, only the first rows (top-n, no full sort)."""
    rows = diff.orderBy(*keys, F.col("sign").desc(), *[c for c in diff.columns if c not in keys and c != "sign"])
    return rows if n is None else rows.limit(n)


# ---- checksums --------------------------------------------------------------


def compare_segments(
    a: TableSide, b: TableSide, segmenter: Segmenter, *, ignored: frozenset[str] = frozenset()
) -> DataFrame:
    """Counts and checksums of both sides per segment, with `is_diff`."""
    sa, sb = common_scales(a, b)
    ignored_b = frozenset(cb for ca, cb in pair_columns(a, b) if ca in ignored)
    left = segment_checksums(a, segmenter, ignored=ignored, scales=sa)
    right = segment_checksums(b, segmenter, ignored=ignored_b, scales=sb)
    left = left.select("segment_id", F.col("n_rows").alias("rows_a"), F.col("checksum").alias("checksum_a"))
    right = right.select("segment_id", F.col("n_rows").alias("rows_b"), F.col("checksum").alias("checksum_b"))
    zero = F.lit(0).cast("bigint")
    return left.join(right, "segment_id", "full_outer").select(
        "segment_id",
        F.coalesce("rows_a", zero).alias("rows_a"),
        F.coalesce("rows_b", zero).alias("rows_b"),
        "checksum_a",
        "checksum_b",
        (~F.col("checksum_a").eqNullSafe(F.col("checksum_b")) | ~F.col("rows_a").eqNullSafe(F.col("rows_b"))).alias("is_diff"),
    )


# Sums of 22-bit parts stay within bigint for two trillion rows of a segment.
PART_BITS = 22
PART_MASK = (1 << PART_BITS) - 1


def unequal_segments(
    a: TableSide, b: TableSide, segmenter: Segmenter | RangeSegmenter, rules: CompareRules
) -> DataFrame:
    """Numbers and sizes of the segments whose rows are not the same on both sides.

    Both sides meet in one aggregate: rows of A add their hashes, rows of B take
    theirs away, and what is left is zero where the rows are equal. Typed engine
    hashes (128 bits per row) replace the MD5 text here, since the numbers never
    leave the engine; `segment_checksums` has the portable ones.
    """
    exact = replace(rules, float_tolerance=None)  # stricter than the rule, so nothing is missed
    frames = []
    for which, one, sign in (("-", a, 1), ("+", b, -1)):
        parts = []
        for h in _row_hashes(a, b, which, exact, with_keys=True):
            parts += [F.shiftright(h, 2 * PART_BITS), F.shiftright(h, PART_BITS).bitwiseAND(PART_MASK), h.bitwiseAND(PART_MASK)]
        signed = [(p * sign).alias(f"p{i}") for i, p in enumerate(parts)]
        frames.append(one.rows().select(segmenter.of(one).alias("segment_id"), F.lit(sign).alias("s"), *signed))
    parts = [c for c in frames[0].columns if c.startswith("p")]
    sums = (
        frames[0]
        .unionByName(frames[1])
        .groupBy("segment_id")
        .agg(F.count_if(F.col("s") == 1).alias("rows_a"), F.count_if(F.col("s") == -1).alias("rows_b"), *[F.sum(p).alias(p) for p in parts])
    )
    differs = reduce(lambda x, y: x | y, [F.col(p) != 0 for p in parts], F.col("rows_a") != F.col("rows_b"))
    return sums.where(differs).select(
        "segment_id", F.greatest("rows_a", "rows_b").alias("n"), (F.col("rows_a") + F.col("rows_b")).alias("both")
    )


def _check_factors(factor: int, threshold: int) -> None:
    if factor >= threshold:
        raise ValueError("the bisection factor must be lower than the threshold")
    if factor < 2:
        raise ValueError("at least two segments per level are needed")


def hash_diff(
    a: TableSide,
    b: TableSide,
    *,
    rules: CompareRules | None = None,
    factor: int = FACTOR,
    threshold: int = THRESHOLD,
    levels: int = LEVELS,
    as_text: bool = True,
) -> DataFrame:
    """Compare segments by checksum, then only the rows of unequal segments.

    The checksum levels run now, the row comparison on demand. Two equal tables
    shuffle no rows at all.
    """
    rules = rules or CompareRules()
    left, right = unequal_parts(a, b, rules=rules, factor=factor, threshold=threshold, levels=levels)
    return rowset_diff(left, right, rules=rules, as_text=as_text)


def unequal_parts(
    a: TableSide,
    b: TableSide,
    *,
    rules: CompareRules,
    factor: int = FACTOR,
    threshold: int = THRESHOLD,
    levels: int = LEVELS,
    remapping: Remapping | None = None,
    gaps: bool = False,
) -> tuple[TableSide, TableSide]:
    """Both sides cut down to the segments whose rows differ.

    The first level cuts the keys into `factor` squared ranges of about equal
    rows (MOST_SEGMENTS at most); one scan per side compares all of them. While an
    unequal range holds `threshold` rows or more, the next level cuts what is left
    in the same way, unless the last one left out less than LEAST_SHARE of the rows;
    then the rows themselves are compared. Ranges are comparisons of the keys, of
    any type and number, so the scan can skip what they leave out. The driver sees
    the numbers of unequal ranges alone. `gaps` allows a tolerance: segments are then
    found by exact equality, and the caller compares their rows by the tolerance.
    """
    _check_factors(factor, threshold)
    check_keys(a, b)
    left, right = with_key_forms(*aligned(a, b, remapping))
    check_column_types(left, right)
    for ca, cb in pair_columns(left, right)[len(left.keys) :]:
        if ca not in rules.ignored_columns and rules.tolerant(ca, left.dtype(ca), right.dtype(cb)) and not gaps:
            raise ValueError("a tolerance is no equivalence relation; use join_diff for float_tolerance")
    for _ in range(levels):
        segmenter = rows_segmenter(left, right, factor**2)
        if segmenter is None:  # both sides empty: equal (K8)
            break
        unequal = unequal_segments(left, right, segmenter, rules).collect()
        numbers = [r.segment_id for r in unequal]
        left, right = (replace(s, df=segmenter.restrict(s, numbers)) for s in (left, right))
        largest = max((r.n for r in unequal), default=0)
        if largest < threshold or sum(r.both for r in unequal) > (1 - LEAST_SHARE) * segmenter.rows:
            break
    return left, right


def aligned(a: TableSide, b: TableSide, remapping: Remapping | None = None) -> tuple[TableSide, TableSide]:
    """Both sides with their row restrictions applied, and their columns paired by position."""
    left, right = (
        replace(s, df=s.filtered(), min_key=None, max_key=None, min_update=None, max_update=None, where=None) for s in (a, b)
    )
    if remapping is None:
        return left, right
    pairs = remapping.pairs(a.value_columns, b.value_columns)
    return (
        replace(left, update_column=None, extra_columns=tuple(p[0] for p in pairs)),
        replace(right, update_column=None, extra_columns=tuple(p[1] for p in pairs)),
    )


def bisect_report(
    a: TableSide, b: TableSide, *, factor: int = FACTOR, threshold: int = THRESHOLD, levels: int = 2
) -> DataFrame:
    """The tree of compared segments, one row per visited segment.

    Checksums add up, so one scan at the finest level gives every coarser level
    by summing. A segment is visited when its parent differs, holds at least
    `threshold` rows and spans at least two segments per child.
    """
    _check_factors(factor, threshold)
    segmenter = make_segmenter(a, b, factor**levels)
    if segmenter is None or segmenter.buckets or len(a.keys) != 1:
        raise ValueError("the report needs one integer key and at least one row")
    axis = segmenter.axes[0]
    fine = compare_segments(a, b, segmenter)
    wide = T.DecimalType(38, 0)
    width, start, last = axis.width, axis.start, axis.cells - 1
    # The children of a segment tile it exactly: level L cells are runs of finest cells.
    report, parents = None, None
    for level in range(1, levels + 1):
        run = factor ** (levels - level)
        number = F.floor(F.col("segment_id") / F.lit(run)).cast("bigint")
        at_level = (
            fine.withColumn("id", number)
            .groupBy("id")
            .agg(
                F.sum("rows_a").alias("rows_a"),
                F.sum("rows_b").alias("rows_b"),
                F.sum("checksum_a").cast(wide).alias("checksum_a"),
                F.sum("checksum_b").cast(wide).alias("checksum_b"),
                F.max("is_diff").alias("is_diff"),
            )
            .select(
                F.lit(level).alias("level"),
                F.col("id").alias("segment_id"),
                (F.lit(start) + F.col("id") * F.lit(run * width)).alias("lo"),
                F.when((F.col("id") + 1) * F.lit(run) > F.lit(last), F.lit(axis.end))
                .otherwise(F.lit(start) + (F.col("id") + 1) * F.lit(run * width))
                .alias("hi"),
                "rows_a",
                "rows_b",
                "checksum_a",
                "checksum_b",
                "is_diff",
            )
        )
        if parents is not None:
            up = F.floor(F.col("segment_id") / F.lit(factor)).cast("bigint")
            at_level = at_level.join(parents, up == parents["parent_id"], "left_semi")
        report = at_level if report is None else report.unionByName(at_level)
        if run * width < 2 * factor:
            break
        parents = at_level.where(F.col("is_diff") & (F.greatest("rows_a", "rows_b") >= threshold)).select(
            F.col("segment_id").alias("parent_id")
        )
    return report


def tables_equal(a: TableSide, b: TableSide) -> DataFrame:
    """Did anything change? One row, from two whole-table checksums."""
    sa, sb = common_scales(a, b)
    parts = [
        table_checksum(s, scales=scales).select(F.lit(tag).alias("side"), "n_rows", "checksum")
        for s, scales, tag in ((a, sa, "a"), (b, sb, "b"))
    ]
    both = parts[0].unionByName(parts[1])
    return both.agg(
        F.max(F.when(F.col("side") == "a", F.col("n_rows"))).alias("rows_A"),
        F.max(F.when(F.col("side") == "b", F.col("n_rows"))).alias("rows_B"),
        F.max(F.when(F.col("side") == "a", F.col("checksum"))).alias("checksum_A"),
        F.max(F.when(F.col("side") == "b", F.col("checksum"))).alias("checksum_B"),
    ).withColumn(
        "is_equal",
        F.col("checksum_A").eqNullSafe(F.col("checksum_B")) & (F.col("rows_A") == F.col("rows_B")),
    )


def suppressed_json_columns(compared, json_columns: list[str]) -> DataFrame:
    """Per JSON column, matched keys whose texts differ but whose values are the same."""
    items = []
    for i in compared.value_positions:
        ca = compared.pairs[i][0]
        if ca in json_columns:
            raw = ~F.col(f"a{i}").eqNullSafe(F.col(f"b{i}"))
            same = json_text(F.col(f"a{i}")).eqNullSafe(json_text(F.col(f"b{i}")))
            items.append(
                F.struct(F.lit(ca).alias("column_name"), F.count_if(compared.in_both() & raw & same).alias("suppressed"))
            )
    return compared.matched.agg(F.array(*items).alias("all")).select(F.explode("all").alias("c")).select("c.*")

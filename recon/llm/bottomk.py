"""Near duplicates by bottom-k sketches of one hash function, confirmed on full sets.

1. Each document's set of word shingles is hashed once per shingle; its K smallest
   hashes are its sketch. Documents with equal sets become one representative.
2. Inverted lists: large sets are listed under runs of two neighbouring sketch
   values. Two sets of Jaccard similarity J share none of m neighbouring runs if no
   two neighbours among m + 1 hashes of their union are common: at J = 0.8 and
   m = 31 about 5 in 10^10 pairs, and fewer if the m runs lie apart. Small sets are
   listed under their smallest values, as many as must hold a common one, which
   misses nothing.
3. Members of lists with more than LIST_PAIRS members are compared with three hubs of
   their lists: smallest rows and members that are in many long lists, as the original
   of many copies is. A set with SURE runs in short lists meets every similar set in
   one of them. Where the other members of a long list still span several
   components, they are listed again under the tokens of their full sets that are
   rarest, as many as must hold a common one, and compared across components there.
4. Pairs pass if size ratio, 64 bits of each set, its parities and, for large sets, the
   overlap of the union's sketch allow the threshold; the survivors are compared on
   full sets. The bits travel with the lists, so that most chance pairs end there.
   Parities tell in 512 bins whether a set has an odd number of tokens there: sets
   differ in at least as many tokens as bins, so they never end a similar pair.
5. Components of the confirmed links give the groups. First, each set is compared with
   the smallest of its partners only, then pairs whose ends are not in one component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recon.llm.common import attach, forget_others, whole_text, without_rows
from recon.llm.components import components
from recon.plans.lineage import materialize

WORDS, PERCENT = 5, 80
K = 64
LIST_PAIRS = 16
RUN = 2
SURE = 31  # runs in short lists that a similar set shares one of, but for 5 in 10^10
BUCKETS = 1 << 20  # of token counts; they only set the order of tokens, and any order misses nothing
BINS = 64
PARITIES = 8  # words of 64 bins each
CHANCE_ODD = 200  # of the 512 bins; sets that have nothing in common differ in about half of them
MISSED = 1e-9  # share of similar pairs that the union sketch may reject, and that the bits may
KNOWN_WORDS = 1 << 17
MARKS = 1 << 26  # bits that tell which rows a join needs, 8 MB at most; where they are all set, all rows are shuffled
LEAST_MARKS = 1 << 15  # one row of bits

_known: dict[bytes, int] = {}


def _forget_words() -> None:
    _known.clear()


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct 63-bit hashes of the text's word shingles.

    A-Z count as a-z. A text with fewer words than a shingle is one shingle of all
    its words; without words the set is empty.
    """
    tokens = text.lower().split()  # bytes: only ASCII letters change, only ASCII white space parts words
    if not tokens:
        return np.empty(0, np.int64)
    known, h = _known, []
    for t in tokens:
        x = known.get(t)
        if x is None:
            x = xxhash.xxh3_64_intdigest(t)
            if len(known) < KNOWN_WORDS:
                known[t] = x
        h.append(x)
    w = np.array(h, np.uint64)
    n = min(words, len(w))
    z = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        z = z * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(((z ^ (z >> np.uint64(31))) >> np.uint64(1)).view(np.int64))


def bin_bits(s: np.ndarray) -> int:
    """One bit of the smallest of the sorted hashes in each of BINS bins; 0 where there is none.

    Sets of similarity J differ in a bin with a chance of at most (1 - J) / 2.
    """
    bit = np.zeros(BINS, np.uint8)
    back = s[::-1]
    bit[back & (BINS - 1)] = (back >> 6) & 1  # the last one stays
    return int(np.packbits(bit, bitorder="little").view(np.int64)[0])


def parities(s: np.ndarray) -> np.ndarray:
    """PARITIES words of bits: whether the number of hashes in a bin is odd."""
    bins = 64 * PARITIES
    odd = np.bincount(s & (bins - 1), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


PARITY_COLUMNS = [f"p{i}" for i in range(PARITIES)]


def _differing(a: str, b: str) -> Column:
    """Bins in whose parity two sets differ; `a` and `b` lead to their words, as in 'a_' for a_p0, a_p1 ..."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in PARITY_COLUMNS])


def _near_enough(sizes: Column, differing: Column, percent: int) -> Column:
    """Sets of together `sizes` tokens may be similar if they differ in no more than `differing` of them."""
    return (sizes - differing) * 100 >= (sizes + differing) * percent


def most_differing(percent: int) -> int:
    """Bits in which two sets at the threshold differ at most, but for MISSED of the pairs."""
    p, above = (1 - percent / 100) / 2, 0.0
    for c in range(BINS, 0, -1):
        above += math.comb(BINS, c) * p**c * (1 - p) ** (BINS - c)
        if above > MISSED:
            return c
    return 0


def _sketches(rows: DataFrame, words: int, k: int) -> DataFrame:
    """(row_id, doc_id, n, sig, sketch, bits, p0 ...): set size, 128-bit digest of the set, its k smallest hashes, bits of its bins, parities."""
    out = T.StructType(
        [
            rows.schema["row_id"],
            rows.schema["doc_id"],
            *T._parse_datatype_string("n long, sig binary, sketch array<long>, bits long, " + ", ".join(f"{c} long" for c in PARITY_COLUMNS)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(_forget_words)
        for b in batches:
            n, sig, sketch, bits, odd = [], [], [], [], np.empty((b.num_rows, PARITIES), np.int64)
            for i, text in enumerate(b.column(2)):
                s = shingle_hashes(text.as_py().encode(), words)
                odd[i] = parities(s)
                n.append(len(s))
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sketch.append(s[:k])
                bits.append(bin_bits(s))
            found = (pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(sketch, pa.list_(pa.int64())), pa.array(bits, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *found, *map(pa.array, odd.T.copy())], names=out.names)

    return rows.select("row_id", "doc_id", "text").mapInArrow(run, out)


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """(row_id, full): the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(_forget_words)
        for b in batches:
            full = [shingle_hashes(t.as_py().encode(), words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(full, pa.list_(pa.int64()))], names=["row_id", "full"])

    return rows.select("row_id", "text").mapInArrow(run, "row_id long, full array<long>")


def marks_for(rows: int) -> int:
    """Bits for the ids of at most `rows` rows: 32 to 64 for each, LEAST_MARKS to MARKS in all."""
    return min(MARKS, max(LEAST_MARKS, 1 << (32 * rows).bit_length()))


def _marked(rows: DataFrame, ids: DataFrame, column: str, others: bool = False, marks: int = MARKS) -> DataFrame:
    """`rows` without most of those whose `column` is not in `ids`: a bitmap of at most `marks` bits is broadcast, the rows stay where they are.

    With `others`, it is the rows left out there.
    """
    place = F.pmod(F.xxhash64(column), F.lit(marks)) + 1
    number, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    bits = ids.select(number.alias("number"), bit.alias("bit")).groupBy("number").agg(F.bitmap_construct_agg("bit").alias("marks"))
    octet = F.conv(F.hex(F.substring("marks", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(bits), number == F.col("number"), "left" if others else "inner")
    met = met.withColumns({"octet": octet, "bit": (bit % 8).cast("int")})
    return met.where("coalesce(shiftright(octet, bit) % 2, 0) = 0" if others else "shiftright(octet, bit) % 2 = 1").select(*rows.columns)


def _sets_of(ids: DataFrame, rows: DataFrame, words: int, marks: int = MARKS) -> DataFrame:
    """(rep, full): the full sets of the rows of the given row_ids, and of few others that share a bit with them; no text is shuffled."""
    return _sets(_marked(rows, ids, "row_id", marks=marks), words).withColumnRenamed("row_id", "rep")


def _run_keys(length: int) -> Column:
    """Hashes of all runs of `length` neighbouring sketch values, with their first position."""
    starts = F.sequence(F.lit(1), F.size("sketch") - length + 1)
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice("sketch", i, length)).alias("key")))


def _listed(reps: DataFrame, length: int) -> DataFrame:
    """(rep, n, bits, at, key): sets under their runs of `length` sketch values."""
    return reps.where(F.size("sketch") >= length).select("rep", "n", "bits", F.explode(_run_keys(length)).alias("e")).select(
        "rep", "n", "bits", "e.at", "e.key"
    )


def _small_listed(reps: DataFrame, percent: int) -> DataFrame:
    """Sets under their smallest values, as many as leave fewer behind than a similar set must share."""
    least = F.floor((F.col("n") * percent + 99) / 100)
    prefix = F.slice("sketch", 1, (F.col("n") - least + 1).cast("int"))
    return reps.select("rep", "n", "bits", F.lit(0).alias("at"), F.explode(prefix).alias("key"))


def _similar_sizes(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _alike(x: Column, y: Column, percent: int) -> Column:
    """Sizes and bits of the sets x and y allow the threshold."""
    enough = F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent
    return enough & (F.bit_count(x["bits"].bitwiseXOR(y["bits"])) <= most_differing(percent))


def _short_pairs(listed: DataFrame, counts: DataFrame, most: int, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of lists with 2 to `most` members; no list is longer than `most` here."""
    lists = (
        listed.join(counts.where((F.col("members") > 1) & (F.col("members") <= most)).select("key"), "key")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("rep", "n", "bits"))).alias("l"))
        .select("l", F.posexplode("l").alias("i", "x"))
        .select("x", F.explode(F.filter(F.slice("l", F.col("i") + 2, most), lambda y: _alike(F.col("x"), y, percent))).alias("y"))
    )
    return lists.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def _candidates(reps: DataFrame, percent: int, k: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs from short lists and with hubs of long ones, and (key, rep): members of long lists that short ones do not settle."""
    edge = k * 100 // percent
    pairs, long_members = [], []
    small, large = _small_listed(reps.where(F.col("n") <= edge), percent), _listed(reps.where(F.col("n") > k), RUN)
    for name, listed in (("small-lists", small), ("lists", large)):
        counts = materialize(listed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), name)
        listed = _marked(listed, counts, "key")
        pairs.append(_short_pairs(listed, counts, most, percent))
        long_keys = counts.where(F.col("members") > most).select("key")
        if long_keys.take(1):
            long = materialize(listed.join(long_keys, "key").select("key", "rep", "n", "bits"), f"long-{name}")
            pairs.append(_hub_pairs(long, percent))
            if name == "lists":
                # Of a sketch's k - RUN + 1 runs, those not in long lists are in short ones.
                busy = long.groupBy("rep").agg(F.count(F.lit(1)).alias("runs")).where(F.col("runs") > k - RUN + 1 - SURE)
                long = long.join(busy.select("rep"), "rep", "left_semi")
            long_members.append(long.select("key", "rep"))
    members = reduce(DataFrame.unionByName, long_members) if long_members else None
    return reduce(DataFrame.unionByName, pairs), members


def _hub_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Every member with up to three hubs of its lists, as far as it can be similar to them: linear in the members.

    The original of a family has no edits, so it is in the most long lists; ties go
    the same way in each list, so lists of one family share hubs. Of the hubs of all
    its lists, a member takes those by the same order.
    """
    met = members.join(members.groupBy("rep").agg(F.count(F.lit(1)).alias("lists")), "rep")
    hub = F.struct("rep", "n", "bits", "lists")

    def order(rep: Column | str, lists: Column | str, salt: int) -> Column:
        return F.struct(lists, F.xxhash64(rep, F.lit(salt)))

    tops = [F.max_by(hub, order("rep", "lists", salt)) for salt in (1, 2)]
    pick = met.groupBy("key").agg(F.min(hub).alias("h0"), *[h.alias(f"h{i}") for i, h in enumerate(tops, 1)])
    own = F.struct("rep", "n", "bits")

    def taken(h: str) -> Column:
        return F.when((F.col("rep") != F.col(f"{h}.rep")) & _alike(own, F.col(h), percent), F.col(h))

    met = members.join(pick, "key").select("rep", *[taken(h).alias(h) for h in ("h0", "h1", "h2")])
    # max_by skips NULL orders only, so a hub that is not taken has none.
    best = [
        F.max_by(h, F.when(F.col(h).isNotNull(), order(F.col(f"{h}.rep"), F.col(f"{h}.lists"), salt))) for salt, h in ((1, "h1"), (2, "h2"))
    ]
    hubs = met.groupBy("rep").agg(F.array_compact(F.array_distinct(F.array(F.min("h0")["rep"], *[h["rep"] for h in best]))).alias("hubs"))
    met = hubs.select("rep", F.explode("hubs").alias("hub"))
    return met.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))


def _unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(rep, root) of members of lists that span several components."""
    m = members.join(roots, members.rep == roots.node, "left").select(
        "key", "rep", F.coalesce("root", "rep").alias("root")
    )
    spread = m.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    return m.join(spread.select("key"), "key", "left_semi").select("rep", "root").distinct()


def _buckets(tokens: np.ndarray) -> np.ndarray:
    return tokens & (BUCKETS - 1)


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(rep, root, n, at, key, p0 ...): the sets (rep, root, full) under their rarest tokens, as many as leave fewer behind than a similar set must share."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for s in b.column(0):
                np.add.at(total, _buckets(s.values.to_numpy()), 1)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "met"])

    counted = sets.select("full").mapInArrow(count, "bucket long, met long")
    table = counted.groupBy("bucket").agg(F.sum("met").alias("met")).toArrow()
    often = np.zeros(BUCKETS, np.int64)
    often[table["bucket"].to_numpy()] = table["met"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for b in batches:
            for rep, root, full in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                s = full.values.to_numpy()
                n, met = len(s), often[_buckets(s)]
                first = np.lexsort((s, met))[: n - (n * percent + 99) // 100 + 1]
                at = np.flatnonzero(met[first] > 1)  # others are in one set only
                cols = [np.full(len(at), x, np.int64) for x in (rep, root, n)]
                odd = [np.full(len(at), x, np.int64) for x in parities(s)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(at), pa.array(s[first[at]]), *map(pa.array, odd)], names=names)

    names = ["rep", "root", "n", "at", "key", *PARITY_COLUMNS]
    return sets.select("rep", "root", "full").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _split_pairs(m: DataFrame, percent: int) -> DataFrame:
    """Members outside their list's largest component, with all members of other components.

    `at` counts the tokens before a member's place. At the first token that two sets
    share, what both have from there on must reach the overlap that the threshold asks.
    Of pairs that differ in too many parities, none is made.
    """
    sizes = m.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    major = sizes.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.count(F.lit(1)).alias("parts"))
    m = m.join(major.where("parts > 1").drop("parts"), "key")
    minor = m.where("root <> major").select(
        "key",
        F.col("rep").alias("z"),
        F.col("n").alias("zn"),
        F.col("root").alias("zroot"),
        F.col("at").alias("zat"),
        *[F.col(c).alias(f"z{c}") for c in PARITY_COLUMNS],
    )
    once = (F.col("root") == F.col("major")) | (F.col("rep") < F.col("z"))
    left = F.least(F.col("n") - F.col("at"), F.col("zn") - F.col("zat"))
    enough = left * (100 + percent) >= (F.col("n") + F.col("zn")) * percent
    near = _near_enough(F.col("n") + F.col("zn"), _differing("", "z"), percent)
    met = m.join(minor, "key").where((F.col("root") != F.col("zroot")) & once & enough & _similar_sizes("n", "zn", percent) & near)
    return met.select(F.least("rep", "z").alias("a"), F.greatest("rep", "z").alias("b"))


def _with(pairs: DataFrame, values: DataFrame, column: str, marks: int) -> DataFrame:
    """Pairs, read from files, with the value of both ends, as a_value and b_value."""
    # Both ends take their values from the same rows, so these are looked up and shuffled once.
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep"))
    met = _marked(values, ends, "rep", marks=marks).select("rep", F.col(column).alias("value"))
    left, right = (met.select(F.col("rep").alias(end), F.col("value").alias(f"{end}_value")) for end in ("a", "b"))
    return pairs.join(left, "a").join(right, "b")


def least_common(k: int, percent: int) -> int:
    """So many of the k smallest hashes of a union are common to both sets, but for MISSED of the pairs at the threshold."""
    p, below = percent / 100, 0.0
    for c in range(k + 1):
        below += math.comb(k, c) * p**c * (1 - p) ** (k - c)
        if below > MISSED:
            return c
    return k


def _plausible(pairs: DataFrame, reps: DataFrame, k: int, percent: int, marks: int = MARKS) -> DataFrame:
    """Pairs whose parities allow the threshold and, where these tell little, whose union sketch holds enough common values."""
    pairs = materialize(pairs.distinct(), "met")
    both = _with(pairs, reps.select("rep", F.struct("n", *PARITY_COLUMNS).alias("odd")), "odd", marks)
    sizes = F.col("a_value.n") + F.col("b_value.n")
    large = _near_enough(sizes, F.lit(CHANCE_ODD), percent).alias("large")
    near = materialize(both.where(_near_enough(sizes, _differing("a_value.", "b_value."), percent)).select("a", "b", large), "near")
    small, large = near.where("NOT large").select("a", "b"), near.where("large").select("a", "b")
    if not large.take(1):
        return small
    both = _with(large, reps, "sketch", marks)
    union = F.slice(F.array_sort(F.array_union("a_value", "b_value")), 1, k)
    common = F.size(F.array_intersect(union, F.array_intersect("a_value", "b_value")))
    enough = (common >= least_common(k, percent)) | (F.size("a_value") < k) | (F.size("b_value") < k)
    return small.unionByName(both.where(enough).select("a", "b"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, marks: int) -> DataFrame:
    both = _with(pairs, sets, "full", marks)
    common = F.size(F.array_intersect("a_value", "b_value"))
    return both.where(common * 100 >= (F.size("a_value") + F.size("b_value") - common) * percent).select("a", "b")


def _linked(
    pairs: DataFrame, sets: DataFrame, percent: int, roots: DataFrame | None = None, marks: int = MARKS
) -> tuple[DataFrame, DataFrame]:
    """Confirmed links that connect the same sets as all similar pairs do, and the roots of their components and, if given, those of `roots`.

    Copies of one set have nearly all pairs among them; most are in one component
    once each is linked with the smallest, and need not be compared any more.
    """
    first = materialize(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first-pairs")
    links = materialize(_confirmed(first, sets, percent, marks), "links")
    roots = _joined(roots, links)
    rest = pairs.join(first, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        named = roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        rest = rest.join(named, end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
    rest = materialize(rest.where("a_root <> b_root").select("a", "b"), "other-pairs")
    if rest.take(1):
        more = materialize(_confirmed(rest, sets, percent, marks), "other-links")
        if more.take(1):
            links = links.unionByName(more)
            roots = _joined(roots, more)
    return links, roots


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root): the components of `roots`, if given, joined by further links (a, b)."""
    if roots is not None:  # a component is its members' links with its smallest
        links = links.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b")))
    return materialize(components(links, "a", "b"), "roots")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
    k: int = K,
    most: int = LIST_PAIRS,
) -> DataFrame:
    """One row per row of `docs`: row_id, doc_id, n_shingles, component_id, kept, first.

    component_id is the smallest id in the row's group of near duplicates; kept
    tells whether it is the row's own, first is true for exactly one row of a group. NULL texts are empty; texts without words
    link with nothing and stand for themselves. Repeated rows have equal sets and
    so one group; NULL ids count as larger than any other. An empty table gives no
    rows. `docs` must give the same rows in the same partitions when it is read
    again, as a scan of files does.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")
    )
    sketches = materialize(_sketches(rows, words, k), "sketches")
    full = sketches.where("n > 0")
    classes = full.groupBy("sig").agg(F.min("row_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes, "classes")
    total = full.count()
    marks = marks_for(total)
    of_class = attach(full.select("row_id", "doc_id", "n", "sig"), classes, ["sig"], "copies", total).drop("sig")
    of_class = materialize(of_class, "of-class")
    # Most rows are representatives: only those that share a bit with another row of a class are shuffled.
    again = of_class.where("row_id <> rep").select("row_id")
    known = full.select("row_id", "n", "sketch", "bits", *PARITY_COLUMNS)
    # An anti join would be pushed below the bitmap.
    told = _marked(known, again, "row_id", marks=marks).join(again.withColumn("again", F.lit(True)), "row_id", "left").where("again IS NULL")
    reps = _marked(known, again, "row_id", others=True, marks=marks).unionByName(told.drop("again"))
    reps = materialize(reps.withColumnRenamed("row_id", "rep"), "reps")

    found, members = _candidates(reps, percent, k, most)
    pairs = materialize(_plausible(found, reps, k, percent, marks), "candidates")
    # Texts travel once, also for what the lists may leave open.
    needed = pairs.select(F.explode(F.array("a", "b")).alias("row_id"))
    if members is not None:
        needed = needed.unionByName(members.select(F.col("rep").alias("row_id")))
    sets = materialize(_sets_of(materialize(needed.distinct(), "needed"), rows, words, marks), "sets")
    _, roots = _linked(pairs, sets, percent, marks=marks)
    if members is not None:
        open_rows = materialize(_unsettled(members, roots), "unsettled")
        if open_rows.take(1):
            open_sets = materialize(_marked(sets, open_rows, "rep", marks=marks).join(open_rows, "rep"), "open-sets")
            listed = materialize(_rarest(open_sets, percent), "rarest")
            more = materialize(_plausible(_split_pairs(listed, percent), reps, k, percent, marks), "more-candidates")
            if more.take(1):
                _, roots = _linked(more, sets, percent, roots, marks)

    placed = of_class.join(roots, of_class.rep == roots.node, "left").select(
        "row_id", "doc_id", "n", F.coalesce("root", "rep").alias("root")
    )
    placed = materialize(placed, "placed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row_id"))).alias("first")
    groups = materialize(placed.groupBy("root").agg(first, F.count(F.lit(1)).alias("size")), "groups")
    grouped = attach(placed, groups, ["root"], "size", total).select(
        "row_id",
        "doc_id",
        "n",
        F.col("first.doc_id").alias("component_id"),
        (F.col("row_id") == F.col("first.row_id")).alias("first"),
    )
    empty = sketches.where("n = 0")
    alone = empty.select("row_id", "doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return grouped.unionByName(alone).select(
        "row_id",
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        "first",
    )


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, ...) that are first in their group, with all their columns."""
    return without_rows(docs, near_groups(docs).where("NOT first"))

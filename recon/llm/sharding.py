"""Deal documents into shards of near-equal bytes by histogram sort.

Rows are ordered by (hash of the text, hash of the id, row number): equal texts
lie side by side and no key is too large to be cut. Shards are intervals of this
order. Where to cut is found by counting, not by sorting: each round sums the
exact bytes below a grid of probes inside the intervals that still hold a cut,
and zooms into the grid cell of each cut until the error is within tolerance.
Then every row knows its shard from the cuts, and one exchange brings rows to
their place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recon.llm.common import whole_text
from recon.plans.lineage import materialize

SHARDS = 16
TOLERANCE = 0.001  # of a mean shard: how far a cut may lie from its target
GRID_BITS = 10  # probes per open interval and round: 1,024
KEY_BITS = 62
KEYS = ("k1", "k2", "k3")
CELL_ROWS = 50_000  # rows in one sort of the final exchange, on average
MOST_CELLS = 1 << 20


@dataclass(frozen=True)
class Cut:
    """A cut between shards: all rows with `fixed` keys equal and the next key below `low` lie before it.

    While open, it lies somewhere in [low, low + width) of that key; `below` are the
    bytes of all rows in front of the interval.
    """

    target: float
    fixed: tuple[int, ...]
    low: int
    width: int
    below: int

    def shift(self) -> int:
        return max(0, (self.width - 1).bit_length() - GRID_BITS)


def _inside(cut: Cut) -> Column:
    key = F.col(KEYS[len(cut.fixed)])
    own = (key >= F.lit(cut.low)) & (key <= F.lit(cut.low + cut.width - 1))
    for name, value in zip(KEYS, cut.fixed):
        own = own & (F.col(name) == F.lit(value))
    return own


def _probe(rows: DataFrame, open_cuts: list[Cut]) -> dict[tuple, dict[int, tuple[int, int, int]]]:
    """Exact bytes in every grid cell of the open intervals, with the least and largest key met there.

    The result has at most 2^GRID_BITS rows for each of the SHARDS - 1 cuts.
    """
    spans = sorted({(c.fixed, c.low, c.width, c.shift()) for c in open_cuts})
    parts = []
    for i, (fixed, low, width, shift) in enumerate(spans):
        key = F.col(KEYS[len(fixed)])
        cell = F.shiftright(key - F.lit(low), shift)
        inside = _inside(Cut(0, fixed, low, width, 0))
        parts.append(F.when(inside, F.struct(F.lit(i).alias("span"), cell.alias("cell"), key.alias("key"))))
    # Spans of one round are the same or apart, so a row is in one at most.
    hit = rows.select("size", F.coalesce(*parts).alias("at")).where("at is not null")
    counted = hit.groupBy("at.span", "at.cell").agg(F.sum("size"), F.min("at.key"), F.max("at.key")).collect()
    found: dict[tuple, dict[int, tuple[int, int, int]]] = {s[:3]: {} for s in spans}
    for span, cell, size, least, most in counted:
        found[spans[span][:3]][cell] = (size, least, most)
    return found


def _zoom(cut: Cut, cells: dict[int, tuple[int, int, int]], tolerance: float) -> tuple[Cut, bool]:
    """The cut with its interval narrowed to one grid cell, and whether it is settled."""
    below = cut.below
    for cell in sorted(cells):
        size, least, most = cells[cell]
        if below + size < cut.target:
            below += size
            continue
        start = cut.low + (cell << cut.shift())
        if abs(below - cut.target) <= tolerance:
            return Cut(cut.target, cut.fixed, start, 1, below), True
        end = start + (1 << cut.shift())
        if abs(below + size - cut.target) <= tolerance:
            return Cut(cut.target, cut.fixed, end, 1, below + size), True
        if least < most:
            return Cut(cut.target, cut.fixed, least, most - least + 1, below), False
        if len(cut.fixed) + 1 < len(KEYS):  # one key value holds the cut: go on inside it, by the next key
            return Cut(cut.target, (*cut.fixed, least), 0, 1 << KEY_BITS, below), False
        nearer = least + 1 if below + size - cut.target < cut.target - below else least
        return Cut(cut.target, cut.fixed, nearer, 1, below), True
    return Cut(cut.target, cut.fixed, cut.low + cut.width, 1, below), True


def find_cuts(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[Cut]:
    """The shards - 1 cuts of `rows` (size, k1, k2, k3) that give every shard near the same bytes."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    cuts = [Cut(total * i / shards, (), 0, 1 << KEY_BITS, 0) for i in range(1, shards)]
    still = set(range(len(cuts)))
    while still:
        found = _probe(rows, [cuts[i] for i in still])
        for i in sorted(still):
            c = cuts[i]
            cuts[i], settled = _zoom(c, found[(c.fixed, c.low, c.width)], slack)
            if settled:
                still.discard(i)
    return cuts


def _after(cut: Cut) -> Column:
    """Whether a row lies at or behind the cut."""
    depth = len(cut.fixed)
    out = F.col(KEYS[depth]) >= F.lit(cut.low)
    for name, value in reversed(list(zip(KEYS, cut.fixed))):
        out = (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & out)
    return out


def shard(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
    tolerance: float = TOLERANCE,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `bytes`: the bytes of any two shards differ by no more than the tolerance
    or one document. Size is the UTF-8 bytes of the text plus 1; NULL counts as no
    text, with the checksum of the empty text. Equal texts are neighbours, cut
    apart only where a shard ends inside them. Repeated rows, NULL ids and very
    long texts are rows like others; an empty table gives no rows. grown_shard is
    NULL, since it belongs to another law. Slots follow a fixed pseudo-random
    order of cells within each shard and the key order inside a cell.
    """
    text = whole_text(text_col).cast("binary")
    positive = 64 - KEY_BITS
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), positive).alias("k1"),
        F.shiftrightunsigned(F.xxhash64(F.col(id_col)), positive).alias("k2"),
        F.monotonically_increasing_id().alias("k3"),
    )
    rows = materialize(rows, "keys")
    shard_of = F.lit(0)
    for cut in find_cuts(rows, shards, tolerance):
        shard_of = shard_of + F.when(_after(cut), 1).otherwise(0)

    # Cells are even parts of each shard, whatever its keys: one cell is one sort of the exchange. Their counts
    # (fewer than MOST_CELLS plus one per shard) say at which slot each cell begins.
    wanted = max(4096, rows.count() // cell_rows)
    cells = min(wanted, MOST_CELLS) // shards
    placed = rows.withColumn("shard", shard_of.cast("int")).withColumn(
        "cell", F.pmod(F.xxhash64("k1", "k2", "k3"), F.lit(cells)).cast("int")
    )
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("rows"))
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("begin"))
    starts = materialize(starts, "cells")
    inside = F.row_number().over(W.partitionBy("shard", "cell").orderBy(*KEYS))
    return (
        placed.withColumn("nth", inside)
        .join(F.broadcast(starts), ["shard", "cell"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("begin") + F.col("nth") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )

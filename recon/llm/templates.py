"""Line deduplication by a tree of line templates.

Every line goes down a tree of fixed depth: by its number of tokens, then by its
leading tokens. Tokens with digits count as variable and take the wildcard child.
A line is also held against the leaves in which one of its leading tokens takes
the wildcard child, unless its own leaf has half of the lines there or more, and
belongs there if that token varies among them. In a leaf, most
tokens of a template are met about equally often at their places; a token met less
than half as often as them is variable, so it does not matter how large the leaf is
or what else is in it. The line's template is its constant tokens with gaps for the
variable ones; a line that is not constant enough stands for itself, whole. A
template that occurs in several documents is kept where it occurs first and
dropped from all other documents.

Equal lines are counted first, and one of them stands for all. Only different lines
that share a leaf are taken apart into tokens; their counts by leaf, place and token
are sums of numbers, so a leaf of any size is a few numbers per task.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recon.llm.bottomk import _marked
from recon.llm.common import whole_text
from recon.plans.lineage import materialize

LEADING = 3
LEAST_TOKENS = 4  # shorter lines, and scripts without blanks, are compared whole
LEAST_TAIL = 4  # a leading token may vary if so many tokens follow the leading ones
MIN_DOCS = 2
CONSTANT = 0.6  # share of tokens that must be constant
CONSTANT_SHARE = 0.5  # a constant token is met so often, as a share of what most tokens of its line are met
VARIABLE = "<*>"
FLUSH = 100_000  # rows a task gathers before it sends them on
CACHED = 200_000  # token hashes a task remembers

TOKEN = re.compile(r"[^ \t\r]+")
DIGIT = re.compile("[0-9]")
BLANK = " \t\r"


def _hash(text: str) -> int:
    """A positive 63-bit hash."""
    return xxhash.xxh3_64_intdigest(text.encode()) >> 1 | 1


def masked(token: str) -> str:
    return VARIABLE if DIGIT.search(token) else token


def leaves_of(n: int, first: list[str], leading: int, least: int) -> list[int]:
    """The leaf of a line of `n` tokens, then the leaf with a wildcard for each leading token; 0 where there is none."""
    if n < least:
        return [0] * (leading + 1)
    path = [masked(t) for t in first]
    leaf = lambda tokens: _hash("\n".join([str(n), *tokens]))
    out = [leaf(path)]
    for k in range(leading):
        varies = n >= leading + LEAST_TAIL and path[k] != VARIABLE
        out.append(leaf([*path[:k], VARIABLE, *path[k + 1 :]]) if varies else 0)
    return out


def exact_lines(rows: DataFrame) -> DataFrame:
    """(row_id, doc_id, line, exact, words): the lines with tokens, numbered, with the hash of what is between their outer blanks."""
    lines = rows.select("row_id", "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "words"))
    bare = F.btrim("words", F.lit(BLANK))
    return lines.where(F.length(bare) > 0).select("row_id", "doc_id", "line", F.xxhash64(bare).alias("exact"), "words")


def lines_in_tree(lines: DataFrame, leading: int, least: int) -> DataFrame:
    """(row_id, exact, leaf0, leaf1 ...): lines and their leaves."""
    names = ["row_id", "exact", *[f"leaf{k}" for k in range(leading + 1)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines_of_tokens = map(TOKEN.findall, b.column(2).to_pylist())
            numbers = [leaves_of(len(tokens), tokens[:leading], leading, least) for tokens in lines_of_tokens]
            numbers = np.array(numbers, np.int64).reshape(-1, leading + 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, numbers.T.copy())], names=names)

    return lines.select("row_id", "exact", "words").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _shared(lines: DataFrame, leading: int, min_docs: int) -> DataFrame:
    """(exact, row_id, m, leaves): lines to take apart, where one of them is, how often they occur, and in which leaves.

    A leaf counts if different lines of different rows are in it. A wildcard leaf
    counts if it has more than twice the lines that belong to the leaf without the
    wildcard, or if those are under `min_docs`; otherwise the leading token could not vary.
    """
    leaves = [f"leaf{k}" for k in range(leading + 1)]
    rep = lines.groupBy("exact").agg(
        F.count(F.lit(1)).alias("m"), F.min("row_id").alias("a"), F.max("row_id").alias("b"), *[F.max(c).alias(c) for c in leaves]
    )
    rep = materialize(rep, "different-lines")
    spread = rep.select("exact", "m", "a", "b", F.posexplode(F.array(*leaves)).alias("kind", "leaf")).where("leaf <> 0")
    sizes = spread.groupBy("leaf").agg(
        F.sum("m").alias("n"),
        F.sum(F.when(F.col("kind") == 0, F.col("m")).otherwise(0)).alias("own"),
        F.count(F.lit(1)).alias("d"),
        F.min("a").alias("low"),
        F.max("b").alias("high"),
    )
    sizes = materialize(sizes.where("d > 1 AND low <> high").select("leaf", "n", "own"), "leaves")
    met = _marked(spread.select("exact", "m", "a", "kind", "leaf"), sizes, "leaf").join(sizes, "leaf")
    whole = F.coalesce(F.max(F.when(F.col("kind") == 0, F.col("own"))), F.max("m"))
    of_line = met.groupBy("a", "exact").agg(
        F.max("m").alias("m"), whole.alias("whole"), F.sort_array(F.collect_list(F.struct("kind", "leaf", "n"))).alias("leaves")
    )
    chosen = F.filter("leaves", lambda x: (x["kind"] == 0) | (x["n"] > 2 * F.col("whole")) | (F.col("whole") < min_docs))
    return of_line.select("exact", F.col("a").alias("row_id"), "m", chosen.alias("leaves")).where(F.size("leaves") > 0)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers whose bits all depend on all bits of `x`."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Hashes of tokens, 0 of those with digits."""

    def __missing__(self, token: str) -> int:
        found = self[token] = 0 if DIGIT.search(token) else _hash(token)
        return found


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of groups of these sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _spots(exact: pa.Array, m: pa.Array, leaves: pa.ListArray, token: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """The columns of `_placed` of lines with `size` tokens each, whose hashes are `token`."""
    line = np.repeat(np.arange(len(size)), size)
    place = _within(size)
    here = np.flatnonzero(token)
    token, place = token[here], place[here]
    n = np.bincount(line[here], minlength=len(size))
    first = np.cumsum(n) - n
    # Each line's tokens once for each of its leaves.
    kind, leaf = leaves.flatten().flatten()[:2]
    of = np.repeat(np.arange(len(size)), leaves.value_lengths().to_numpy())
    row = np.repeat(np.arange(len(of)), n[of])
    at = first[of][row] + _within(n[of])
    token, place, line = token[at], place[at], of[row]
    salt = _mixed(leaf.to_numpy().astype(np.uint64)[row] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    spot = _mixed(token ^ salt).view(np.int64)
    same = exact.to_numpy()[line], kind.to_numpy()[row], m.to_numpy()[line], size[line].astype(np.int32)
    return (*same, place.astype(np.int32), spot)


def _placed(lines: DataFrame, wants: DataFrame) -> DataFrame:
    """(exact, kind, m, size, place, spot): tokens of the wanted lines of `size` tokens but masked ones; spot hashes leaf, place and token."""
    # A semi join would be pushed below the bitmap.
    texts = _marked(lines.select("row_id", "exact", "words"), wants, "exact").join(wants, ["exact", "row_id"])
    texts = texts.dropDuplicates(["exact"]).select("exact", "m", "leaves", "words")
    names = ["exact", "kind", "m", "size", "place", "spot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in batches:
            a, held, tokens, sizes = 0, 0, [], []
            many = b.column(2).value_lengths().to_pylist()
            for i, line in enumerate(b.column(3)):
                if len(known) > CACHED:
                    known.clear()
                own = list(map(known.__getitem__, TOKEN.findall(line.as_py())))
                tokens += own
                sizes.append(len(own))
                held += len(own) * many[i]
                if held >= FLUSH or i + 1 == b.num_rows:
                    some = b.slice(a, i + 1 - a)
                    spots = _spots(*(some.column(k) for k in range(3)), np.array(tokens, np.uint64), np.array(sizes, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in spots], names=names)
                    a, held, tokens, sizes = i + 1, 0, [], []

    return texts.mapInArrow(run, "exact long, kind int, m long, size int, place int, spot long")


def _starts(exact: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where lines in a leaf start, whose tokens lie together."""
    return np.flatnonzero(np.append(True, (np.diff(exact) != 0) | (np.diff(kind) != 0)))


def _enough(tokens: list[np.ndarray], leading: int, constant: float) -> tuple[np.ndarray, ...]:
    """(exact, usual, kind, general) of lines in leaves with enough constant tokens, from columns of tokens, each line's together."""
    exact, kind, size, place, n, spot = tokens
    first = _starts(exact, kind)
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(exact))))
    exact, kind, size = exact[first], kind[first].astype(np.int64), size[first].astype(np.int64)
    # What enough tokens behind the leading ones are met at least; one met far less often varies, however often that is.
    tail = np.flatnonzero(place >= leading)
    tail = tail[np.lexsort((-n[tail], row[tail]))]
    tails = np.bincount(row[tail], minlength=len(size))
    last = np.ceil(constant * (size - leading)).astype(np.int64) - 1
    good = (last >= 0) & (last < tails)
    usual = np.zeros(len(size), np.int64)
    usual[good] = n[tail[(np.cumsum(tails) - tails + last)[good]]]
    kept = good[row] & (n >= CONSTANT_SHARE * usual[row])
    good &= np.bincount(row[kept], minlength=len(size)) >= constant * size
    good[row[kept & (place == kind[row] - 1)]] = False  # what takes a wildcard must vary
    kept = np.flatnonzero(kept & good[row])
    kept = kept[np.lexsort((spot[kept], row[kept]))]
    ends = np.cumsum(np.bincount(row[kept], minlength=len(size))).tolist()
    spots, found = spot[kept].astype("<i8"), np.flatnonzero(good)
    template = (spots[ends[i - 1] if i else 0 : ends[i]].tobytes() + struct.pack("<q", size[i]) for i in found.tolist())
    general = np.array([xxhash.xxh3_64_intdigest(x) >> 1 for x in template], np.int64)
    return exact[found], usual[found], kind[found], general


def general_templates(placed: DataFrame, leading: int, min_docs: int, constant: float, flush: int = FLUSH) -> DataFrame:
    """(exact, general): lines that are constant enough in one of their leaves, with their template's hash.

    Of several such leaves, a line takes the one where its constant tokens are met most often.
    """
    often = placed.groupBy("spot").agg(F.sum("m").alias("n")).where(F.col("n") >= min_docs)
    often = materialize(often, "often")
    # Tokens met too rarely are told by the size of their line; they need not travel. The others travel as rows: a line's
    # tokens come from all tasks, so lists of them would hardly be combined before.
    met = _marked(placed, often, "spot").join(often, "spot")
    lines = met.select("exact", "kind", "size", "place", "n", "spot").repartition("exact", "kind").sortWithinPartitions("exact", "kind")
    names = ["exact", "usual", "kind", "general"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        held, most = 0, flush

        def out(tokens: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in _enough(tokens, leading, constant)], names=names)

        for b in batches:
            if b.num_rows:
                waiting.append([c.to_numpy() for c in b.columns])
                held += b.num_rows
            if held < most:
                continue
            tokens = [np.concatenate(c) for c in zip(*waiting)]
            last = int(_starts(*tokens[:2])[-1])  # the last line may go on
            if last:
                yield out([c[:last] for c in tokens])
            waiting, held = [[c[last:].copy() for c in tokens]], held - last
            most = max(flush, 2 * held)
        if waiting:
            yield out([np.concatenate(c) for c in zip(*waiting)])

    enough = lines.mapInArrow(run, "exact long, usual long, kind long, general long")
    return enough.groupBy("exact").agg(F.max_by("general", F.struct("usual", "kind")).alias("general"))


def repeated_lines(rows: DataFrame, leading: int, least: int, min_docs: int, constant: float) -> DataFrame:
    """(row_id, line) of lines whose template occurs in at least `min_docs` documents, without those of the first one."""
    lines = exact_lines(rows)
    wants = materialize(_shared(lines_in_tree(lines, leading, least), leading, min_docs), "wants")
    general = general_templates(materialize(_placed(lines, wants), "tokens"), leading, min_docs, constant)
    # Without a general template, the whole line is one.
    told = lines.select("row_id", "doc_id", "line", "exact").join(general, "exact", "left")
    told = materialize(told.select("row_id", "doc_id", "line", F.coalesce("general", "exact").alias("template")), "told")
    first = told.groupBy("template").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row_id"))).alias("first"),
        F.min("row_id").alias("a"),
        F.max("row_id").alias("b"),
    )
    docs = first.where("a <> b").select("template", F.col("first.row_id").alias("home"))
    if min_docs > 2:
        counted = told.select("template", "row_id").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("docs"))
        docs = docs.join(counted.where(F.col("docs") >= min_docs).select("template"), "template")
    return told.join(docs, "template").where("row_id <> home").select("row_id", "line")


def _without(texts: pd.Series, dropped: pd.Series) -> pd.Series:
    def cut(text: str, gone: list | None) -> str:
        if gone is None:
            return text
        out = set(gone)
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in out)

    return pd.Series([cut(t, g) for t, g in zip(texts, dropped)], dtype=object)


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    leading: int = LEADING,
    least: int = LEAST_TOKENS,
    min_docs: int = MIN_DOCS,
    constant: float = CONSTANT,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_lines, n_dropped, text (what is left).

    A recurring template stays in the document with the smallest id, NULL ids last,
    and in ties in the row read first. NULL texts are empty: one line, none dropped. Lines with fewer than
    `least` tokens recur only whole, character by character but for blanks around them. Repeated rows lose all recurring lines but in one of them.
    An empty table gives no rows. `docs` must give the same rows in the same
    partitions when it is read again, as a scan of files does.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")
    )
    gone = repeated_lines(rows, leading, least, min_docs, constant)
    gone = gone.groupBy("row_id").agg(F.collect_list("line").alias("dropped"))
    without = F.pandas_udf(_without, "string")
    return rows.join(gone, "row_id", "left").select(
        "doc_id",
        F.size(F.split("text", "\n")).alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"),
        without("text", "dropped").alias("text"),
    )

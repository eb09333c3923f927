"""Periodic runs of words, by a suffix automaton whose link tree is accessed as a link-cut tree.

Words are appended one after another. Appending word i visits the path from the
state of the prefix to the root of the suffix links; the path falls into
segments whose states were last met at the same end. A segment last met at end j
with states of up to l words says: the last l words also ended at j. If
i - j <= l, a square of period i - j ends here, and the period is primitive, since
a shorter one would have been met later than j. Each square is extended once to
its maximal run. Then the path becomes one segment, coloured i. With splay trees
for segments, all accesses of n words take O(n log n).

Only windows of a text that can hold a run of the wanted length are given to the
automaton. A run of length >= max(least, power * q) has at least as many words
repeating the word q before as `reach` asks for, so all its grams of `GRAM` words
after the first period have been met at most one period before; where grams do
not recur that way, there is no run. The windows keep whole runs, so
nothing is lost (a repeated passage far away is not a run and is passed over).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recon.llm.common import whole_text

LEAST, POWER = 24, 3
GRAM = 8


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length of each state's longest string, suffix link of each state, state of each prefix)."""
    length, link, move, ends = [0], [-1], [{}], []
    last = 0
    for c in words:
        cur = len(length)
        length.append(length[last] + 1)
        link.append(0)
        move.append({})
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = cur
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                move.append(move[q].copy())
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
        ends.append(cur)
    return length, link, ends


def squares(words: list[int]) -> Iterator[tuple[int, int]]:
    """(end, period) of squares with primitive roots: the first of every run, and others."""
    length, link, ends = suffix_automaton(words)
    n = len(length)
    # Splay trees over path segments, by depth; up of a tree's top is the state above the segment.
    up, left, right = link, [-1] * n, [-1] * n
    met = [-1] * n  # the end at which a segment was last met, kept at the top of its tree

    def rotate(x: int, p: int) -> None:
        g = up[p]
        if left[p] == x:
            b = right[x]
            left[p], right[x] = b, p
        else:
            b = left[x]
            right[p], left[x] = b, p
        if b >= 0:
            up[b] = p
        up[p], up[x] = x, g
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def splay(x: int) -> None:
        while True:
            p = up[x]
            if p < 0 or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if g < 0 or (left[g] != p and right[g] != p):
                met[x] = met[p]
                rotate(x, p)
                return
            top = up[g]
            if top < 0 or (left[top] != g and right[top] != g):
                met[x] = met[g]
            if (left[g] == p) == (left[p] == x):
                rotate(p, g)
            else:
                rotate(x, p)
                p = g
            rotate(x, p)

    for i, state in enumerate(ends):
        x, below = state, -1
        while x >= 0:
            splay(x)
            j = met[x]
            if j >= 0 and i - j <= length[x]:
                yield i, i - j
            deeper = right[x]
            if deeper >= 0:
                met[deeper] = j  # cut off with the old end
            right[x] = below
            below, x = x, up[x]
        splay(state)
        met[state] = i


def _equal_run(ids: np.ndarray, i: int, j: int, step: int) -> int:
    """How many of the words from i and from j on are equal, going by `step` (1 or -1)."""
    most = min(len(ids) - max(i, j), len(ids)) if step > 0 else min(i, j) + 1
    done, chunk = 0, 32
    while done < most:
        n = min(chunk, most - done)
        if step > 0:
            differ = ids[i + done : i + done + n] != ids[j + done : j + done + n]
        else:
            differ = (ids[i - done - n + 1 : i - done + 1] != ids[j - done - n + 1 : j - done + 1])[::-1]
        if differ.any():
            return done + int(differ.argmax())
        done, chunk = done + n, chunk * 2
    return done


def windows(ids: np.ndarray, least: int, power: int) -> list[tuple[int, int]]:
    """[first, end) of the stretches of words outside which no run of length >= max(least, power * period) can lie."""
    n, gram = len(ids), min(GRAM, least - least // power)
    count = n - gram + 1
    if n < least:
        return []
    h = ids.astype(np.uint64) + np.uint64(1)
    key = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(gram):
            key = (key + h[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return []
    back = np.full(count, n, np.int64)  # distance to the last gram that is the same
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    # A run of period q has all but q + gram - 1 of its places met at most q before, without a gap.
    shortest = least - least // power - gram + 1
    while True:
        good = np.flatnonzero(back < n)
        if not len(good):
            return []
        cuts = np.flatnonzero(np.diff(good) > 1) + 1
        first, end = good[np.r_[0, cuts]], good[np.r_[cuts - 1, len(good) - 1]] + 1
        reach = (end - first + gram - 1) // (power - 1)  # longest period that a run in here can have
        bound = np.repeat(np.where(end - first >= shortest, reach, 0), end - first)
        far = back[good] > bound
        if not far.any():
            break
        back[good[far]] = n
    out: list[tuple[int, int]] = []
    for a, b, q in zip(first.tolist(), end.tolist(), reach.tolist()):
        a, b = max(0, a - q - 1), min(n, b + gram)
        while out and a <= out[-1][1]:  # a long stretch may reach back over several
            before = out.pop()
            a, b = min(a, before[0]), max(b, before[1])
        out.append((a, b))
    return out


def runs(ids: np.ndarray, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs with length >= max(least, power * period), by start, then period.

    `ids` number the words; a run's period is its smallest. `power` is at least 2.
    """
    found = set()
    for a, b in windows(ids, least, power):
        known: dict[int, int] = {}  # the last word of the last run of a period
        for i, q in squares(ids[a:b].tolist()):
            i += a
            if i <= known.get(q, -1):
                continue
            start = i - q - _equal_run(ids, i - q, i, -1) + 1
            end = i + _equal_run(ids, i + 1 - q, i + 1, 1)
            known[q] = end
            if end - start + 1 >= max(least, power * q):
                found.add((start, q, end - start + 1))
    return [(s, n, q) for s, q, n in sorted(found)]


def numbered_words(words: list[bytes]) -> np.ndarray:
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(names.__getitem__, words), np.int64, len(words))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the tail made periodic that the document's id asks for (one in ten)."""
    h = zlib.crc32(str("null" if doc_id is None else doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * -(-(n - a) // p))[: n - a]


def report(words: list[bytes], least: int = LEAST, power: int = POWER) -> tuple:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of one text's words."""
    found = runs(numbered_words(words), least, power) if len(words) >= least else []
    kept, best = words, (None,) * 4
    if found:
        gone = np.zeros(len(words) + 1, np.int64)
        for s, n, q in found:
            gone[s + q] += 1
            gone[s + n] -= 1
        kept = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
        s, n, q = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (s, n, q, 1000 * n // q)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (len(found), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def word_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, power: int = POWER,
    plant: bool = False,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_runs, the run of greatest exponent, and digests of all runs and of the rest.

    Words are separated by ASCII blanks; NULL and empty texts have none, and
    neither runs. A run is a maximal stretch of words with smallest period q and
    length >= max(least, power * q). `plant` first makes the tail of one document
    in ten periodic, as its id says, so that results can be held against known
    runs. Repeated rows get equal rows, other columns are not looked at. Texts are
    judged each on its own where they are read, without a shuffle; a task holds one
    text at a time, and about 1 KB for each word inside its repeating windows.
    """
    cols = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = text.as_py().split()
                rows.append(report(planted(doc_id, words) if plant else words, least, power))
            parts = list(zip(*rows)) if rows else [[]] * len(cols)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(parts, kinds))], ["doc_id", *cols]
            )

    texts = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).cast("binary").alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    out = ", ".join(f"{c} {'string' if c.endswith('sha256') else 'long'}" for c in cols)
    return texts.mapInArrow(run, f"doc_id {id_type}, {out}")

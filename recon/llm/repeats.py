"""Repeated byte strings between documents, by suffix sorting with bucket pointers over the places that can repeat.

A byte goes if a string of `window` bytes around it also starts in a document
with a smaller id. Every window has an anchor: the gram in it that hashes lowest,
leftmost if it is there twice. The anchor depends on the window's bytes
alone, so equal windows have equal anchor grams, and about one place in 14
is an anchor.

1. Anchors' hashes are dealt into ranges. An anchor whose hash is in no other
   row drops out, and with it its windows.
2. What surrounds a remaining anchor, as far as its windows go, is its context.
   Contexts go into buckets by the anchor's gram, equal ones of a batch once. A
   bucket sorts the suffixes of its contexts: suffixes start in buckets by their
   first bytes, and buckets are refined by the bucket numbers of later offsets,
   refined ones being used again, until they agree on `window` bytes. Each
   bucket then tells the smallest id that has a window.
3. The intervals found so go back to their rows, where they are cut out.

Hashes only choose who meets whom; what is removed is decided by the bytes.

Hot strings: a batch sends each hash or context once, for its smallest id, and
decides its other rows itself; so what meets in one group grows with the number of
batches, not of rows. Grams that stay common in many different contexts are
listed (fewer than HOT_SHARE), and their windows are dealt one by one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recon.llm.common import whole_text
from recon.plans.lineage import materialize

WINDOW, GRAM = 50, 24
CHUNK = 1 << 20  # bytes that are hashed at a time
PLACE = np.uint64((1 << 21) - 1)  # low bits of a window's minimum hold the place in the chunk
BATCH_BYTES = 8 << 20  # text whose anchors or contexts are gathered before they are sent
RANGE_BYTES = 32 << 20  # text whose anchors make one range
FINER = 8  # buckets of contexts per range
ROW_GROUPS = 2  # groups of rows per range, whose places and intervals are gathered
SORT_BYTES = 1 << 20  # context bytes that are sorted at a time
HOT_SHARE, HOT_LEAST = 1_000_000, 50_000
NO_PLACE = np.uint32(0xFFFFFFFF)
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
LEAST_ID = -(2**63)  # a NULL id


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes from each place on."""
    h, have = data.astype(np.uint64), 1
    with np.errstate(over="ignore"):
        while have * 2 <= gram:
            a, b = h[:-have], h[have:]
            if have < 8:
                h = a | (b << np.uint64(8 * have))
            else:
                h = a * MIX_A + b * MIX_B
                h ^= h >> np.uint64(31)
            have *= 2
        if have < gram:
            h = h[: len(h) - (gram - have)] * MIX_A + h[gram - have :] * MIX_B
        h = (h ^ (h >> np.uint64(29))) * MIX_B
        return h ^ (h >> np.uint64(32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of the `width` values from each place on."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def _pieces(texts: list[bytes], window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Chunks of (text, offset, bytes); a long text comes in pieces that share window - 1 bytes."""
    chunk, size = [], 0
    for t, text in enumerate(texts):
        for at in range(0, len(text) - window + 1, CHUNK):
            piece = text[at : at + CHUNK + window - 1]
            if chunk and size + len(piece) > CHUNK + window - 1:
                yield chunk
                chunk, size = [], 0
            chunk.append((t, at, piece))
            size += len(piece)
    if chunk:
        yield chunk


def anchors(texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, place, hash) of every anchor, in order of place."""
    out = []
    for chunk in _pieces(texts, window):
        data = np.frombuffer(b"".join(p for _, _, p in chunk), np.uint8)
        sizes = np.array([len(p) for _, _, p in chunk])
        starts = np.cumsum(sizes) - sizes
        h = _grams(data, gram)
        least = _least((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), window - gram + 1)
        valid, opens = np.ones(len(least), bool), np.zeros(len(least), bool)
        for s in (starts[1:] - window + 1).tolist():
            valid[s : s + window - 1] = False
        opens[starts] = True
        at = np.flatnonzero(valid)
        place = (least[at] & PLACE).astype(np.int64)
        fresh = np.flatnonzero(opens[at] | np.r_[True, place[1:] != place[:-1]])
        first, count, place = at[fresh], np.diff(np.r_[fresh, len(at)]), place[fresh]
        piece = np.searchsorted(starts, first, "right") - 1
        shift = np.array([o for _, o, _ in chunk])[piece] - starts[piece]
        out.append((np.array([t for t, _, _ in chunk])[piece], first + shift, count, place + shift, h[place]))
    if not out:
        return (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[dict]]:
    rows, held = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for row in batch.slice(at, 64).to_pylist():
                rows.append(row)
                held += len(row["text"]) + 200
                if held >= size:
                    yield rows
                    rows, held = [], 0
    if rows:
        yield rows


# Anchors of a batch travel packed: 5 bytes of the hash, row less the batch's first row, place.
CODEC = "zstd"


def _packed(key: np.ndarray, row: np.ndarray, place: np.ndarray) -> bytes:
    base = int(row.min())
    low = np.ascontiguousarray(key, "<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    raw = low + (row - base).astype("<u8").tobytes() + place.astype("<u4").tobytes()
    body = pa.compress(raw, CODEC, asbytes=True)
    return len(raw).to_bytes(8, "little") + base.to_bytes(8, "little") + body


def _unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size, base = int.from_bytes(body[:8], "little"), int.from_bytes(body[8:16], "little")
    raw, n = pa.decompress(body[16:], size, CODEC, asbytes=True), size // 17
    key = np.zeros((n, 8), np.uint8)
    key[:, :5] = np.frombuffer(raw, np.uint8, 5 * n).reshape(n, 5)
    row = np.frombuffer(raw, "<u8", n, 5 * n).astype(np.int64) + base
    return key.view("<u8").reshape(n), row, np.frombuffer(raw, "<u4", n, 13 * n)


def _send_anchors(ranges: int, window: int, gram: int):
    """(range, row_id, body): packed anchors (row_id NULL), and places of rows whose anchors repeat within the batch."""

    def send(rows: list[dict]) -> Iterator[tuple[int, int | None, bytes]]:
        ids = np.array([r["row_id"] for r in rows], np.int64)
        text, _, _, place, key = anchors([r["text"] for r in rows], window, gram)
        if not len(key):
            return
        order = np.argsort(key, kind="stable")
        key, text, place = key[order], text[order], place[order].astype(np.uint32)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        shared = np.minimum.reduceat(text, first) != np.maximum.reduceat(text, first)
        again = np.repeat(shared, np.diff(np.r_[first, len(key)]))
        yield from _by_row(ids[text[again]], place[again], ranges)
        keep = ~again
        keep[first] = True
        sent = np.where(again, NO_PLACE, place)[keep]
        key, row = key[keep], ids[text[keep]]
        deal = ((key >> np.uint64(40)) % np.uint64(ranges)).astype(np.int64)
        order = np.lexsort((sent, row, deal))
        deal, key, row, sent = deal[order], key[order], row[order], sent[order]
        cuts = np.r_[np.flatnonzero(np.r_[True, deal[1:] != deal[:-1]]), len(deal)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield int(deal[a]), None, _packed(key[a:b], row[a:b], sent[a:b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _batches(batches, BATCH_BYTES):
            yield _triples(send(rows))

    return run


def _by_row(row: np.ndarray, place: np.ndarray, ranges: int) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(row, kind="stable")
    row, place = row[order], np.ascontiguousarray(place[order], "<u4")
    cuts = np.r_[np.flatnonzero(np.r_[True, row[1:] != row[:-1]]), len(row)] if len(row) else np.zeros(1, int)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(row[a]) * 7919 % ranges, int(row[a]), place[a:b].tobytes()


def _triples(rows) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary()))], ["bucket", "row_id", "body"]
    )


def _by_groups(items: Iterator[tuple[int, bytes]], groups: int) -> list[tuple[int, bytes]]:
    """(group of rows, body): what was found for single rows, packed by groups of rows."""
    dealt: dict[int, list] = {}
    for row, found in items:
        dealt.setdefault(row * 7919 % groups, []).append((row, found))
    out = []
    for group, parts in dealt.items():
        raw = np.array([(row, len(found)) for row, found in parts], "<i8").tobytes() + b"".join(f for _, f in parts)
        size = len(raw).to_bytes(8, "little") + len(parts).to_bytes(8, "little")
        out.append((group, size + pa.compress(raw, CODEC, asbytes=True)))
    return out


def _of_rows(bodies: pa.ChunkedArray) -> dict[int, bytes]:
    """What was found for each row, put together."""
    out: dict[int, list] = {}
    for body in bodies.to_pylist():
        size, n = int.from_bytes(body[:8], "little"), int.from_bytes(body[8:16], "little")
        raw, at = pa.decompress(body[16:], size, CODEC, asbytes=True), 16 * n
        for row, length in np.frombuffer(raw, "<i8", 2 * n).reshape(n, 2).tolist():
            out.setdefault(row, []).append(raw[at : at + length])
            at += length
    return {row: b"".join(parts) for row, parts in out.items()}


def _places(group: pa.Table) -> pa.Table:
    """(row_id, places): all places of each row of a group."""
    found = _of_rows(group["body"])
    return pa.table({"row_id": pa.array(list(found), pa.int64()), "places": pa.array(list(found.values()), pa.binary())})


def _pairs(rows: list) -> pa.Table:
    cols = list(zip(*rows)) or [[], []]
    return pa.table({"rows": pa.array(cols[0], pa.int32()), "body": pa.array(cols[1], pa.binary())})


def _met_again(hot: int, groups: int):
    """(rows, body): places whose anchor is in two rows at least, packed for each group of rows; with rows NULL,
    hashes of grams that more than `hot` batches or rows sent.
    """

    def run(group: pa.Table) -> pa.Table:
        known = group.filter(pc.is_valid(group["row_id"]))
        packed = group.filter(pc.is_null(group["row_id"]))["body"]
        found, more = list(zip(known["row_id"].to_pylist(), known["body"].to_pylist())), []
        if len(packed):
            key, row, place = (np.concatenate(x) for x in zip(*(_unpacked(b.as_py()) for b in packed)))
            order = np.argsort(key, kind="stable")
            key, row, place = key[order], row[order], place[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            met = np.minimum.reduceat(row, first) != np.maximum.reduceat(row, first)
            # A gram that a batch has in several rows came without a place and needs no answer.
            told = np.repeat(met, size) & (place != NO_PLACE)
            found += [(r, b) for _, r, b in _by_row(row[told], place[told], 1)]
            common = key[first[size > hot]]
            if len(common):
                more = [(None, common.astype("<u8").tobytes())]
        return _pairs(_by_groups(found, groups) + more)

    return run


def bucket_pointers(data: np.ndarray, depth: int, q: int = 8) -> np.ndarray:
    """A bucket number for each suffix: equal exactly if the suffixes agree on their first `depth` bytes.

    Suffixes start in buckets of their first q bytes. A bucket that agrees on d
    bytes is refined by sorting on the bucket numbers of the suffixes d bytes later,
    which agree on d bytes themselves by then; so d doubles. Buckets of one suffix
    are done and only point. `data` is followed by zeros.
    """
    n = len(data)
    q = min(q, depth, 8)
    padded = np.r_[data, np.zeros(depth, np.uint8)].astype(np.uint64)
    start = np.zeros(n, np.uint64)
    for k in range(q):
        start = (start << np.uint64(8)) | padded[k : k + n]
    values, bucket, size = np.unique(start, return_inverse=True, return_counts=True)
    bucket, numbers, done = np.r_[bucket, np.zeros(depth, np.int64)], len(values), q
    open_ = np.flatnonzero(size[bucket[:n]] > 1)
    while done < depth and len(open_):
        step = min(done, depth - done)
        order = np.lexsort((bucket[open_ + step], bucket[open_]))
        open_ = open_[order]
        own, later = bucket[open_], bucket[open_ + step]
        fresh = np.r_[True, (own[1:] != own[:-1]) | (later[1:] != later[:-1])]
        place = np.cumsum(fresh) - 1
        bucket[open_] = numbers + place
        numbers += int(place[-1]) + 1
        open_ = open_[np.bincount(place)[place] > 1]
        done += step
    return bucket[:n]


def first_ids(contexts: list[bytes], ids: list[int], window: int) -> list[np.ndarray]:
    """For each context, the smallest id that has each of its windows."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    counts = sizes - window + 1
    skip = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts)
    at = np.arange(counts.sum()) + skip
    bucket, own = bucket_pointers(data, window)[at], np.repeat(np.array(ids, np.int64), counts)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]])
    least = np.empty(len(at), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(own[order], cuts), np.diff(np.r_[cuts, len(at)]))
    return np.split(least, np.cumsum(counts)[:-1])


def _spans(first: int, gone: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Byte intervals of the windows from `first` on that are marked in `gone`."""
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    return [(first + a, first + b - 1 + window) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


def _raw(spans: list[tuple[int, int]]) -> bytes:
    return np.array(spans, "<i8").tobytes()


def _send_contexts(buckets: int, window: int, gram: int, hot: frozenset[int]):
    """(bucket, row_id, body): packed contexts (row_id NULL), and intervals that are settled within the batch."""

    def send(rows: list[dict]) -> Iterator[tuple[int, int | None, bytes]]:
        rows.sort(key=lambda r: LEAST_ID if r["doc_id"] is None else r["doc_id"])
        texts = [r["text"] for r in rows]
        text, first, count, place, key = anchors(texts, window, gram)
        wanted = np.concatenate(
            [np.uint64(t << 40) | np.frombuffer(r["places"], "<u4").astype(np.uint64) for t, r in enumerate(rows)]
        )
        stay = np.isin((text.astype(np.uint64) << np.uint64(40)) | place.astype(np.uint64), wanted)
        met: dict[bytes, tuple[int, int, list]] = {}  # context: key, id, (row, first window) of that id
        settled: list[list] = [[] for _ in rows]

        def offer(context: bytes, key: int, t: int, at: int) -> None:
            doc = LEAST_ID if rows[t]["doc_id"] is None else rows[t]["doc_id"]
            have = met.get(context)
            if have is None:
                met[context] = (key, doc, [(rows[t]["row_id"], at)])
            elif have[1] < doc:
                settled[t].append((at, at + len(context)))
            else:
                have[2].append((rows[t]["row_id"], at))

        for t, at, n, k in zip(*(x[stay].tolist() for x in (text, first, count, key))):
            if k & (2**40 - 1) in hot:
                for i in range(at, at + n):
                    one = texts[t][i : i + window]
                    offer(one, zlib.crc32(one), t, i)
            else:
                offer(texts[t][at : at + n + window - 1], k >> 1, t, at)
        for t, spans in enumerate(settled):
            if spans:
                yield rows[t]["row_id"] * 7919 % buckets, rows[t]["row_id"], _raw(spans)
        dealt: dict[int, list] = {}
        for context, (key, doc, places) in met.items():
            dealt.setdefault(key % buckets, []).append((context, key, doc, places))
        for bucket, items in dealt.items():
            head = [(len(c), key, doc, len(p)) for c, key, doc, p in items]
            tail = [x for _, _, _, p in items for x in p]
            raw = np.array(head, "<i8").tobytes() + np.array(tail, "<i8").tobytes() + b"".join(c for c, _, _, _ in items)
            size = len(raw).to_bytes(8, "little") + len(head).to_bytes(8, "little") + len(tail).to_bytes(8, "little")
            yield bucket, None, size + pa.compress(raw, CODEC, asbytes=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _batches(batches, BATCH_BYTES):
            yield _triples(send(rows))

    return run


def _contexts(body: bytes) -> Iterator[tuple[bytes, int, int, list[tuple[int, int]]]]:
    size, n, m = (int.from_bytes(body[8 * k : 8 * k + 8], "little") for k in range(3))
    raw = pa.decompress(body[24:], size, CODEC, asbytes=True)
    head = np.frombuffer(raw, "<i8", 4 * n).reshape(n, 4).tolist()
    tail = np.frombuffer(raw, "<i8", 2 * m, 32 * n).reshape(m, 2).tolist()
    at, used = 32 * n + 16 * m, 0
    for length, key, doc, places in head:
        yield raw[at : at + length], key, doc, [tuple(p) for p in tail[used : used + places]]
        at, used = at + length, used + places


def _settle(window: int, groups: int):
    """(rows, body): packed intervals of rows whose windows a smaller id has too, for each group of rows."""

    def run(group: pa.Table) -> pa.Table:
        best: dict[bytes, tuple[int, list, int]] = {}
        known = group.filter(pc.is_valid(group["row_id"]))
        gone: dict[int, list] = {
            row: np.frombuffer(body, "<i8").reshape(-1, 2).tolist()
            for row, body in zip(known["row_id"].to_pylist(), known["body"].to_pylist())
        }

        def all_of(context: bytes, places: list) -> None:
            for row, at in places:
                gone.setdefault(row, []).append((at, at + len(context)))

        for body in group.filter(pc.is_null(group["row_id"]))["body"]:
            for context, key, doc, places in _contexts(body.as_py()):
                have = best.get(context)
                if have is None or doc < have[0]:
                    best[context] = (doc, places, key)
                    if have is not None:
                        all_of(context, have[1])
                elif doc == have[0]:
                    best[context] = (doc, have[1] + places, key)
                else:
                    all_of(context, places)

        def sort(part: list[bytes]) -> None:
            ids = [best[c][0] for c in part]
            for c, doc, least in zip(part, ids, first_ids(part, ids, window)):
                less = least < doc
                if less.any():
                    for row, at in best[c][1]:
                        gone.setdefault(row, []).extend(_spans(at, less, window))

        # Equal windows have the same gram as anchor, so a context that is alone with its key is done, and
        # the others are sorted in parts that keep a key together.
        several = Counter(b[2] for b in best.values())
        part, held, last = [], 0, None
        for key, context in sorted((b[2], c) for c, b in best.items() if several[b[2]] > 1):
            if held >= SORT_BYTES and key != last:
                sort(part)
                part, held = [], 0
            part.append(context)
            held, last = held + len(context), key
        if part:
            sort(part)
        return _pairs(_by_groups(((row, _raw(spans)) for row, spans in gone.items()), groups))

    return run


def _by_rows(group: pa.Table) -> pa.Table:
    """(row_id, spans): all intervals of each row of a group, disjoint and in order."""
    gone, out = _of_rows(group["body"]), []
    for spans in gone.values():
        pairs = np.frombuffer(spans, "<i8").reshape(-1, 2)
        first, end = pairs[np.argsort(pairs[:, 0], kind="stable")].T
        end = np.maximum.accumulate(end)
        opens = np.flatnonzero(np.r_[True, first[1:] > end[:-1]])
        out.append(np.c_[first[opens], end[np.r_[opens[1:] - 1, len(end) - 1]]].astype("<i8").tobytes())
    return pa.table({"row_id": pa.array(list(gone), pa.int64()), "spans": pa.array(out, pa.binary())})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            text, end, removed, kept = text.as_py(), 0, 0, []
            pairs = np.frombuffer(spans.as_py() or b"", "<i8").reshape(-1, 2).tolist()
            for a, b in pairs:
                kept.append(text[end:a])
                removed, end = removed + b - a, b
            kept.append(text[end:])
            rows.append((len(text), removed, len(pairs), hashlib.sha256(b"".join(kept)).hexdigest()))
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()]))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def repeated_strings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
    hot_least: int = HOT_LEAST,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if a string of `window` bytes that covers it also starts in a
    document with a smaller id; strings lie within one text and are judged on the
    input. Texts count as UTF-8, NULL as empty; texts of under `window` bytes stay
    whole. Ids are integers; NULL ids count as one id smaller than all others. Rows
    with the same id do not remove from each other. An empty table gives no rows.
    Other columns are not looked at. `docs` must be a scan of files, since rows are
    numbered. A task holds the texts of a batch (8 MB, or one longer text).
    """
    texts = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_col).cast("long").alias("doc_id"),
        whole_text(text_col).cast("binary").alias("text"),
    )
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = max(1, -(-total // RANGE_BYTES))
    sent = texts.select("row_id", "text").mapInArrow(
        _send_anchors(ranges, window, gram), "bucket int, row_id long, body binary"
    )
    groups, most = ranges * ROW_GROUPS, max(hot_least, total // HOT_SHARE)
    found = materialize(sent.groupBy("bucket").applyInArrow(_met_again(most, groups), "rows int, body binary"), "anchors")
    common = [r.body for r in found.where("rows IS NULL").select("body").collect()]
    hot = frozenset(np.frombuffer(b"".join(common), "<u8").tolist())
    places = found.where("rows IS NOT NULL").groupBy("rows").applyInArrow(_places, "row_id long, places binary")
    # The texts' exchange is the same for both joins, so Spark shuffles them once.
    contexts = (
        texts.join(places, "row_id")
        .select("row_id", "doc_id", "text", "places")
        .mapInArrow(_send_contexts(ranges * FINER, window, gram, hot), "bucket int, row_id long, body binary")
    )
    gone = contexts.groupBy("bucket").applyInArrow(_settle(window, groups), "rows int, body binary")
    spans = gone.groupBy("rows").applyInArrow(_by_rows, "row_id long, spans binary")
    return (
        texts.join(spans, "row_id", "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )

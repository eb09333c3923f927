"""Pack token pieces into fixed-length sequences: first-fit decreasing on a tournament tree, in random groups.

Documents are tokenised once, where they lie. What moves afterwards is a row of
numbers per piece. A document's tokens are cut every `seq_len`; full pieces are
sequences already, and the rest of each document goes to a random group of about
GROUP_DOCS rests. Each group is packed by itself, so groups stay bounded while
their number grows with the data.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recon.llm.common import forget_others, whole_text
from recon.plans.lineage import materialize

SEQ_LEN = 1024
END_ID = 0
GROUP_DOCS = 2048
CACHED_CHUNKS = 1_000_000
# White space by Unicode or by Python, each before a blank.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
UNCUTTABLE = [w + " " for w in WHITE]

PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


class ChunkEncoder:
    """Token ids of whole texts, remembering those of the first CACHED_CHUNKS different chunks.

    The tokenizer never joins a character that is no white space with a following
    blank, so a text may be cut in front of every blank that follows such a
    character, and the ids of its chunks joined. Texts with a blank behind white
    space are encoded in one go. Chunks met for the first time can be encoded with
    the same vocabulary as ranks (`ranks`, a tiktoken file), which is faster; texts
    with a special token's name always go to the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.fast = None
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def _encode(self, text: str) -> bytes:
        if self.fast and not any(s in text for s in self.special):
            return np.asarray(self.fast.encode_ordinary(text), "<u4").tobytes()
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of the text."""
        if text[:1] == " " or any(x in text for x in UNCUTTABLE):
            return self._encode(text)
        first, *rest = text.split(" ")
        chunks = [first, *[" " + x for x in rest]]
        get = self.known.get
        found = list(map(get, chunks))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = get(chunks[i]) or self._encode(chunks[i])
                    if len(self.known) < CACHED_CHUNKS:
                        self.known[chunks[i]] = found[i]
        return b"".join(found)


@lru_cache(maxsize=2)
def _encoder(path: str, ranks: str | None, pattern: str | None) -> ChunkEncoder:
    return ChunkEncoder(path, ranks, pattern)


def _forget_encoders() -> None:
    _encoder.cache_clear()


def tokenised(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    seq_len: int = SEQ_LEN,
    with_ids: bool = False,
    ranks: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """One row per piece of at most `seq_len` tokens: doc_id, start, length, ids_crc32, doc_tokens, and the ids if asked."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    out = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string(PIECE + (", ids binary" if with_ids else ""))])
    end = np.asarray([END_ID], "<u4").tobytes()
    step = 4 * seq_len

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(_forget_encoders)
        enc = _encoder(tokenizer, ranks, pattern)
        for batch in batches:
            at, start, length, crc, tokens, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = enc.ids(text.as_py()) + end
                for p in range(0, len(ids), step):
                    piece = ids[p : p + step]
                    at.append(i)
                    start.append(p // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    tokens.append(len(ids) // 4)
                    if with_ids:
                        kept.append(piece)
            cols = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))]
            cols += [pa.array(kept, pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays(cols, names=out.names)

    return rows.mapInArrow(run, out)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item. Items go in by falling length, each to the first bin with room.

    The bins are the leaves of a tournament tree whose inner nodes hold the largest
    room below them, so the first bin with room is found by walking down once.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    seq_len: int = SEQ_LEN,
    group_docs: int = GROUP_DOCS,
    with_ids: bool = False,
    ranks: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked).

    Every token lies in exactly one piece, offsets in a sequence have no gaps and
    start at 0. NULL and empty texts are one end token. Repeated rows and ids are
    packed like any others, since groups are drawn by row. A text of any length
    spreads over as many sequences as it fills. An empty table gives no rows.
    `tokenizer` is the path of a tokenizers file that every executor has; `ranks` and
    `pattern`, if given, hold the same vocabulary for a faster encoder of single chunks.
    """
    pieces = materialize(tokenised(docs, tokenizer, id_col, text_col, seq_len, with_ids, ranks, pattern), "pieces")
    rests = pieces.where(F.col("length") < seq_len).count()
    groups = max(1, -(-rests // group_docs))
    row = F.monotonically_increasing_id()
    pieces = pieces.withColumn("row", row).withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    whole = pieces.where(F.col("length") == seq_len).select(
        *[c for c in pieces.columns if c not in ("row", "group")],
        (F.lit(groups << 32) + F.col("row")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )

    def fill(group: pa.Table) -> pa.Table:
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), seq_len)
        sequence = (group["group"].to_numpy() << 32) + bins
        group = group.drop_columns(["row", "group"])
        return group.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))

    rest = pieces.where(F.col("length") < seq_len)
    return whole.unionByName(rest.groupBy("group").applyInArrow(fill, whole.schema))

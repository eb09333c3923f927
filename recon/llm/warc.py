"""Web archives with a two-level capture index.

Archives are WARC 1.1 files of one gzip member per record, written by the tasks
that hold the pages. Of pages with equal payloads one is stored, the others are
short revisit records that name it.

The index orders captures by their URL with the host reversed, so that captures
of a host and its subdomains lie together. Its sorted entries are cut into
compressed blocks; a sparse directory at the end of every index part has the first
key of each block, and a table with one row per part has the first key of each
part. A lookup searches the parts, then the directory, then one block, each by
bisection, and then reads exactly the bytes of its record. No step needs more
in memory than the part table, one directory and one block.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recon.llm.common import HOT_SHARE, whole_text
from recon.llm.files import opened
from recon.plans.lineage import materialize, scratch_path

FILE_BYTES = 1 << 30  # an archive is closed once it is larger
TASK_BYTES = 32 << 20  # compressed records that one task reads back
BATCH_BYTES = 16 << 20  # html that a task holds before it sends it on
BLOCK_ENTRIES = 3000
DATE = "2000-01-01T00:00:00Z"
NO_ID = -(2**63)  # orders NULL ids first
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """com,example,www)/path?query for http://www.example.com/path?query: scheme and port dropped, host in lower case."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"(^.*@)|(:\d*$)", ""))
    path = F.regexp_replace(rest, r"^[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _id_of(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "none" else int(text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int | None] | None, date: str = DATE) -> bytes:
    """One gzip member; refers_to holds the id of the response that a revisit names."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {_urn(page_id)}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    head += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if refers_to:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_urn(refers_to[0])}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + pack.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and stored payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, first): `first` names the response of each group of equal payloads, for groups of two or more.

    Only digests are grouped. Payloads of hot groups stay where they are (fewer
    than HOT_SHARE groups are broadcast), others meet their group in a join.
    """
    rows = pages.withColumn("same", F.sha2(F.col("html").cast("binary"), 256))
    big = rows.where(F.octet_length("html") >= least_bytes)
    groups = big.groupBy("same").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id"))).alias("least"), F.count(F.lit(1)).alias("n")
    )
    groups = groups.where("n > 1").select("same", "n", F.struct(F.col("least.page_id").alias("page_id")).alias("first"))
    groups = materialize(groups, "payload-groups")
    total = pages.count()
    is_hot = F.col("n") * HOT_SHARE > total
    hot, cold = groups.where(is_hot).drop("n"), groups.where(~is_hot).drop("n")
    straight = rows.join(F.broadcast(hot), "same")
    other = rows.join(F.broadcast(hot.select("same")), "same", "left_anti").join(cold, "same", "left")
    return straight.unionByName(other).drop("same")


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row of (page_id, url, key, html, first) and return (key, page_id, file, offset, length).

    Every attempt of a task writes files of its own; the returned table names only
    those of the attempts that count, so lost executors leave nothing but unused files.
    """
    out = "key string, page_id long, file string, offset long, length long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = opened(folder)
        store.create_dir(inner, recursive=True)
        stream, name, at = None, "", 0
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for page_id, url, key, html, first in zip(*(b.column(i) for i in range(5))):
                if stream is None or at >= file_bytes:
                    if stream is not None:
                        stream.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    stream = store.open_output_stream(f"{inner}/{name}", compression=None)
                page_id, refers = page_id.as_py(), None
                if first.is_valid:
                    named = first.as_py()["page_id"]
                    refers = None if named == page_id else (named,)
                data = record(page_id, url.as_py(), html.as_py().encode(), refers)
                stream.write(data)
                for c, v in zip(cols, (key.as_py(), page_id, name, at, len(data))):
                    c.append(v)
                at += len(data)
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["key", "page_id", "file", "offset", "length"])
        if stream is not None:
            stream.close()

    return materialize(pages.select("page_id", "url", "key", "html", "first").mapInArrow(run, out), "captures")


def write_index(captures: DataFrame, folder: str, block_entries: int = BLOCK_ENTRIES) -> list[tuple[str, int, str]]:
    """Write the sorted index and return its parts: (first key, first id, file), one for each partition of the sort.

    A part is its compressed blocks, then the compressed directory, then the
    directory's length in 8 bytes. Equal keys go on by id and place, so a host or
    URL with very many captures spreads over parts.
    """
    order = ["key", "id", "file", "offset"]
    rows = captures.withColumn("id", F.coalesce("page_id", F.lit(NO_ID)))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "id", "file", "offset", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = opened(folder)
        store.create_dir(inner, recursive=True)
        name = f"{uuid.uuid4().hex}.index"
        stream, at, directory, waiting = None, 0, [], []

        def flush(least: int) -> None:
            nonlocal at, waiting
            while len(waiting) >= max(1, least):
                block, waiting = waiting[:block_entries], waiting[block_entries:]
                data = zlib.compress(json.dumps(block).encode(), 6)
                directory.append([block[0][0], block[0][1], at, len(data)])
                stream.write(data)
                at += len(data)

        for b in batches:
            if b.num_rows and stream is None:
                stream = store.open_output_stream(f"{inner}/{name}", compression=None)
            waiting += [list(x) for x in zip(*(c.to_pylist() for c in b.columns))]
            flush(block_entries)
        if stream is None:
            return
        flush(1)
        tail = zlib.compress(json.dumps(directory).encode(), 6)
        stream.write(tail + struct.pack("<q", len(tail)))
        stream.close()
        yield pa.RecordBatch.from_pydict({"key": [directory[0][0]], "id": [directory[0][1]], "file": [name]})

    parts = materialize(rows.mapInArrow(run, "key string, id long, file string"), "index-parts")
    return sorted((r.key, r.id, r.file) for r in parts.collect())


class Index:
    """Lookups in an index and its archives, for one task."""

    def __init__(self, archives: str, index: str, parts: list[tuple[str, int, str]]):
        self.archives, self.index, self.parts = opened(archives), opened(index), parts
        self.starts = [p[:2] for p in parts]
        self.directory = lru_cache(maxsize=4)(self._directory)
        self.block = lru_cache(maxsize=2)(self._block)
        self.file = lru_cache(maxsize=64)(lambda name: self.archives[0].open_input_file(f"{self.archives[1]}/{name}"))

    def _directory(self, name: str) -> tuple[list, list]:
        with self.index[0].open_input_file(f"{self.index[1]}/{name}") as f:
            end = f.size()
            (length,) = struct.unpack("<q", f.read_at(8, end - 8))
            found = json.loads(zlib.decompress(f.read_at(length, end - 8 - length)))
        return found, [tuple(x[:2]) for x in found]

    def _block(self, name: str, offset: int, length: int) -> tuple[list, list]:
        with self.index[0].open_input_file(f"{self.index[1]}/{name}") as f:
            found = json.loads(zlib.decompress(f.read_at(length, offset)))
        return found, [tuple(x[:2]) for x in found]

    def lookup(self, key: str, page_id: int | None) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of the captures of a key and id."""
        want = (key, NO_ID if page_id is None else page_id)
        # Equal keys may begin in the part, or block, before the first that starts with them.
        for p in range(max(0, bisect_left(self.starts, want) - 1), bisect_right(self.starts, want)):
            directory, starts = self.directory(self.parts[p][2])
            for d in range(max(0, bisect_left(starts, want) - 1), bisect_right(starts, want)):
                entries, keys = self.block(self.parts[p][2], *directory[d][2:])
                for e in entries[bisect_left(keys, want) : bisect_right(keys, want)]:
                    yield e[2], e[3], e[4]

    def read(self, name: str, offset: int, length: int) -> bytes:
        return self.file(name).read_at(length, offset)


def read_captures(
    wanted: DataFrame, archives: str, index: str, parts: list[tuple[str, int, str]], tasks: int | None = None
) -> DataFrame:
    """Records of (key, page_id) through the index: page_id, payload_bytes, payload_digest, record_type, refers_to, html.

    Keys are sorted before, so neighbouring lookups share blocks. Payloads are
    checked against their digests; a revisit has no html. The keys are small and what
    they read is not, so `tasks` says how many tasks share them; a task sends on its
    rows whenever it holds BATCH_BYTES of html.
    """
    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
    names = [x.split()[0] for x in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = Index(archives, index, parts)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        cols: list[list] = [[] for _ in names]
        held = 0

        def gathered() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for b in batches:
            for key, page_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for place in at.lookup(key, page_id):
                    head, http, payload = parse_record(at.read(*place))
                    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and payload_digest(payload) != digest:
                        raise ValueError(f"{place}: payload does not match its digest")
                    refers = _id_of(head["WARC-Refers-To"]) if kind == "revisit" else None
                    html = payload.decode() if kind == "response" else None
                    values = (_id_of(head["WARC-Record-ID"]), int(http["Content-Length"]), digest, kind, refers, html)
                    for c, v in zip(cols, values):
                        c.append(v)
                    held += len(payload) if html else 0
                    if held >= BATCH_BYTES:
                        yield gathered()
                        cols, held = [[] for _ in names], 0
            yield gathered()
            cols, held = [[] for _ in names], 0

    near = wanted.repartitionByRange(*([tasks] if tasks else []), "key", "page_id").sortWithinPartitions("key", "page_id")
    return near.select("key", F.col("page_id").cast("long")).mapInArrow(run, out)


def archive_round_trip(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0
) -> DataFrame:
    """Write `pages` to archives, index them, and read every page back through the index.

    Payload is the html in UTF-8, NULL as empty. Of equal payloads of at least
    `least_bytes` the smallest id is the response, NULL ids last; rows repeating
    the response's id and payload are responses again. Rows without a URL are found
    under an empty host. Repeated rows come back as often as they went in; an empty table gives
    no rows.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), whole_text(html_col).alias("html"))
    base = scratch_path(spark, "warc")
    archives, index = f"{base}/archives", f"{base}/index"
    captures = write_archives(with_revisits(rows, least_bytes).withColumn("key", url_key(F.col("url"))), archives)
    parts = write_index(captures, index)
    wanted = rows.select(url_key(F.col("url")).alias("key"), "page_id").distinct()
    stored = captures.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-stored // TASK_BYTES))
    return read_captures(wanted, archives, index, parts, tasks)

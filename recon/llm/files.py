"""Plain files in the cluster's shared folder, read and written inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs


def as_uri(path: str) -> str:
    """A path of Spark's as a URI that pyarrow opens."""
    if path.startswith(("s3a://", "s3n://")):
        return "s3://" + path.split("://", 1)[1]
    if path.startswith("file:"):
        return "file:///" + path.removeprefix("file:").lstrip("/")
    return path if "://" in path else "file://" + path


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a path of Spark's."""
    return fs.FileSystem.from_uri(as_uri(path))


def read_table(path: str) -> pa.Table:
    """A small Parquet folder that Spark wrote, inside a task."""
    store, inner = opened(path)
    return pq.read_table(inner, filesystem=store)


def read_batches(path: str, columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """The same folder a few rows at a time, in the same order each time."""
    store, inner = opened(path)
    for part in sorted(f.path for f in store.get_file_info(fs.FileSelector(inner)) if f.path.endswith(".parquet")):
        with store.open_input_file(part) as f:
            yield from pq.ParquetFile(f).iter_batches(rows, columns=columns, use_threads=False)

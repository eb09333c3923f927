"""Small tables on disk, as the operators want them."""

import uuid

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, folder, rows, schema):
    path = f"{folder}/{uuid.uuid4().hex}"
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.read.parquet(path)


def docs_of(spark, folder, texts, sources=None, more=""):
    """Documents numbered from 0; `more` adds a column of that name."""
    rows = [
        (i, t, "en", sources[i] if sources else "s", None if t is None else len(t), *([i % 3] if more else []))
        for i, t in enumerate(texts)
    ]
    return written(spark, folder, rows, DOCS + (f", {more} long" if more else ""))

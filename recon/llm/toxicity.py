"""Toxicity scores of whole texts by a recurrent network trained on labelled documents."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recon.llm import gru
from recon.llm.common import fold_of, forget_others, whole_text

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
# Bounds of the training sample: texts of each kind, and characters of a text that may be in it.
TOXIC_TEXTS, CLEAN_TEXTS, SAMPLE_CHARS = 1000, 3000, 20_000


def _forget_nothing() -> None:
    """A task keeps its scorer to itself."""


def training_sample(docs: DataFrame, labels: DataFrame, toxic: int, clean: int, chars: int) -> DataFrame:
    """(text, toxic): texts of at most `toxic` and `clean` labelled rows of the training folds, drawn by a hash of the id.

    A document labelled twice counts as toxic if any label says so. Documents
    longer than `chars` are left to scoring. At most toxic + clean ids are broadcast.
    """
    known = (
        labels.where((fold_of("doc_id", FOLDS) != HELD_OUT) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    short = docs.where(F.length("text") <= chars)

    def drawn(kind: int, most: int) -> DataFrame:
        # Twice as many ids as texts, since some labelled documents are missing or too long.
        return known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * most)

    ids = drawn(1, toxic).unionByName(drawn(0, clean))
    found = short.join(F.broadcast(ids), "doc_id").select("text", "toxic", F.xxhash64("doc_id").alias("h"), "doc_id")
    order = ["h", "doc_id", "text"]
    return (
        found.where("toxic = 1").orderBy(*order).limit(toxic)
        .unionByName(found.where("toxic = 0").orderBy(*order).limit(clean))
        .select("text", "toxic")
    )


def train(sample: DataFrame, seed: int = 0) -> bytes:
    """Train the network in one task on the bounded sample; the driver gets its weights, a few MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            toxic += b.column(1).to_pylist()
        pairs = sorted(zip(texts, toxic))
        p = gru.train([t for t, _ in pairs], [int(y) for _, y in pairs], seed=seed)
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(p)]})

    return bytes(sample.repartition(1).mapInArrow(run, "model binary").first()[0])


def scorer(model: bytes) -> object:
    """A column function: score of a text column, NULL as empty."""
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget_others(_forget_nothing)
        network = gru.Scorer(pickle.loads(model))  # goes with the task
        for s in texts:
            yield pd.Series(network(s.tolist()))

    return lambda text: score(text)


def trained_scorer(
    docs: DataFrame,
    labels: DataFrame,
    toxic: int = TOXIC_TEXTS,
    clean: int = CLEAN_TEXTS,
    chars: int = SAMPLE_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
):
    """Column function trained on `labels` (doc_id, toxic) and their texts in `docs`.

    Without labels of both kinds every text gets the same score, 0 if none is known
    to be toxic.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return scorer(train(training_sample(texts, labels.select("doc_id", "toxic"), toxic, clean, chars)))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    The score is the highest probability over all overlapping windows of the whole
    text. Only the text is looked at; NULL and empty texts are one empty window.
    Repeated rows get the same score; an empty table gives no rows. held_out says
    that the row's fold never gives a label.
    """
    id_col, text_col = how.get("id_col", "doc_id"), how.get("text_col", "text")
    score: Column = trained_scorer(docs, labels, **how)(whole_text(text_col))
    scored = docs.select(
        F.col(id_col).alias("doc_id"), (fold_of(id_col, FOLDS) == HELD_OUT).alias("held_out"), score.alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` (doc_id, text, ...) that score below the threshold, with all their columns."""
    return docs.where(trained_scorer(docs, labels)(whole_text("text")) < threshold)

"""Mix sources to target weights by hash thresholds, without sorting documents.

Every document has a fixed 60-bit hash. For each source the words are summed by
the leading bits of the hash; the running sums show in which bucket the source's
budget ends. Only that boundary bucket is summed again by the next bits, until
one hash value is left. The mix then is a filter: hash below the threshold.
Budgets are nested: a document taken for a small budget is taken for every
larger one, and the second round over a source takes the documents with the
smallest hashes twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recon.llm.common import whole_text
from recon.plans.lineage import materialize

WEIGHTS = (3, 1, 2)
BUDGET = 1.5  # words of the mix as a share of all words
REPEATS = 2  # a source gives at most so many times its words
STEP_BITS, HASH_BITS = 12, 60


def word_count(text: Column) -> Column:
    """Runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mix_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text, as a long."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("/"), text)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source, by code point, NULL last.

    Targets share `budget` times all words by weight and stop at REPEATS times
    their source's words; what is over is shared again by weight. With sources in
    order of words per weight, the full ones are a prefix; the level (words per
    weight) that the others get follows from running sums, and is the largest of
    those that no open source's limit is below. The table has one
    row per source, so its windows stay small however many documents there are.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    limit = F.col("source_size") * REPEATS
    s = sizes.withColumn("w", weight.cast("long")).withColumn("lim", limit)
    s = s.withColumn("ratio", F.col("lim") / F.col("w"))
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    s = (
        s.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("full", F.sum("lim").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("open", F.sum("w").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.lit(budget) * F.col("total") - F.coalesce("full", F.lit(0))) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    )
    target = F.least(F.col("lim").cast("double"), F.col("w") * F.coalesce("level", F.lit(0.0)))
    return s.select("source", "source_size", target.alias("target"))


def _boundary(sums: DataFrame) -> DataFrame:
    """The bucket in which each source's budget ends: (source, below, budget, prefix), `below` being the words under it.

    `sums` has one row per source and bucket: source, below, budget, prefix, words.
    """
    upto = W.partitionBy("source").orderBy("prefix").rowsBetween(W.unboundedPreceding, 0)
    first = sums.withColumn("words", F.sum("words").over(upto))
    first = first.withColumn("hit", F.col("below") + F.col("words") > F.col("budget"))
    before = F.coalesce(F.max(F.when(~F.col("hit"), F.col("words"))), F.lit(0))
    return first.groupBy("source").agg(
        (F.first("below") + before).alias("below"),
        F.first("budget").alias("budget"),
        F.min(F.when(F.col("hit"), F.col("prefix"))).alias("prefix"),
    ).where("prefix is not null")


def _source_key(source: Column) -> Column:
    """The source as a text that is never NULL, so that plain equality joins it."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def mixing_plan(rows: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """(source, source_size, target, rounds, budget, threshold) from written rows (source, size, h); source is a key.

    Sums are pre-aggregated per task; the result has one row per source.
    """
    top = HASH_BITS - STEP_BITS
    histogram = materialize(
        rows.groupBy("source", F.shiftright("h", top).alias("prefix")).agg(F.sum("size").alias("words")), "histogram"
    )
    named = F.when(F.col("source") != "n", F.expr("substring(source, 2)"))
    sizes = histogram.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes.select(named.alias("source"), "source_size"), weights, budget)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("source", _source_key(F.col("source"))).withColumn(
        "rounds", F.least(rounds, F.lit(REPEATS)).cast("int")
    )
    targets = materialize(
        targets.withColumn("budget", F.col("target") - F.col("rounds") * F.col("source_size")), "targets"
    )

    sums = histogram.join(targets.select("source", "budget"), "source").withColumn("below", F.lit(0).cast("long"))
    edge = materialize(_boundary(sums), "edge")
    inside = rows.select("source", "size", "h")
    for shift in range(top - STEP_BITS, -1, -STEP_BITS):
        at = edge.select("source", F.col("prefix").alias("at"), "below", "budget")
        inside = inside.join(at, "source").where(F.shiftright("h", shift + STEP_BITS) == F.col("at"))
        sums = inside.groupBy("source", F.shiftright("h", shift).alias("prefix")).agg(
            F.sum("size").alias("words"), F.first("below").alias("below"), F.first("budget").alias("budget")
        )
        edge = materialize(_boundary(sums), "edge")
        inside = materialize(inside.select("source", "size", "h"), "boundary")
    # One hash value per source is left, with its words: it goes in if more than half of them fit.
    last = inside.join(edge.withColumnRenamed("prefix", "h"), ["source", "h"]).groupBy("source", "h").agg(
        F.sum("size").alias("words"), F.first("below").alias("below"), F.first("budget").alias("budget")
    )
    fits = 2 * F.col("below") + F.col("words") < 2 * F.col("budget")
    last = last.select("source", F.when(fits, F.col("h") + 1).otherwise(F.col("h")).alias("threshold"))
    return materialize(targets.join(last, "source", "left"), "plan")


def _times() -> Column:
    """Copies of a row in the mix. Without a threshold the source has no words, or its budget is used up by whole rounds."""
    extra = F.coalesce(F.col("h") < F.col("threshold"), F.col("budget") > 0)
    return F.least(F.col("rounds") + F.when(extra, 1).otherwise(0), F.lit(REPEATS))


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = whole_text(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        _source_key(F.col(source_col)).alias("source"),
        word_count(text).alias("size"),
        mix_hash(F.col(id_col), text).alias("h"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple = WEIGHTS,
    budget: float = BUDGET,
) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target, taken, and times (copies in the mix).

    A document is taken whole, `times` times, 0 to REPEATS. The hash is made of id
    and text, so reruns agree and copies under other ids are drawn apart; only rows
    that repeat id and text share one draw. The document on the boundary is taken
    if more than half of it fits. NULL texts are empty, NULL is a source of its
    own; documents without words count 0. A source may hold any share of the rows.
    An empty table gives no rows.
    """
    rows = materialize(_measured(docs, id_col, text_col, source_col), "sizes")
    return (
        rows.join(mixing_plan(rows, weights, budget), "source")
        .withColumn("times", _times())
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")
    )


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """The mix itself: rows of `docs` (doc_id, text, source, ...) with all their columns, each as often as it is taken."""
    rows = materialize(_measured(docs, "doc_id", "text", "source").drop("doc_id"), "sizes")
    plan = mixing_plan(rows, weights, budget)
    own = docs.select(F.struct(*docs.columns).alias("row"))
    text = whole_text(F.col("row.text"))
    drawn = own.select("row", _source_key(F.col("row.source")).alias("source"), mix_hash(F.col("row.doc_id"), text).alias("h"))
    copies = F.array_repeat(F.lit(1), _times())
    return drawn.join(plan, "source").select("row", F.explode(copies)).select("row.*")

"""Exact duplicates by naming blocks: equal texts get equal integer names, different texts different ones.

Each text is cut into blocks of a fixed number of characters. The distinct
blocks are sorted over the cluster and numbered, so a block becomes an integer.
Then adjacent pairs of names are sorted and numbered in turn, again and again,
until every document is a single name. Names stand for whole contents, so equal
names mean equal texts; no digest decides.

Block texts cross the network once, after a map-side distinct. They travel
under a 64-bit hash, and only this hash is joined back; a hash that turns out
to stand for several blocks is numbered by the blocks themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recon.llm.common import attach, numbered, whole_text, without_rows
from recon.plans.lineage import materialize

BLOCK_CHARS = 4096
NO_NAME = -(2**63)  # stands beside the last block of an odd row


def _blocks(text: Column, chars: int) -> Column:
    """The text in blocks of `chars` characters; the empty text is one empty block."""
    cut = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % chars), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(cut)


def _hash(block: Column, bits: int) -> Column:
    h = F.xxhash64(block)
    return h if bits >= 64 else h.bitwiseAND(F.lit((1 << bits) - 1))


def text_names(rows: DataFrame, chars: int = BLOCK_CHARS, bits: int = 64) -> DataFrame:
    """(row_id, level, name) for each row of `rows` (row_id, text): rows have equal (level, name) iff their texts are equal.

    `bits` narrows the travelling hash, so that tests can make it collide.
    `rows` is read three times; its row ids must not change between reads.
    """
    blocks = rows.select("row_id", F.posexplode(_blocks(F.col("text"), chars)).alias("pos", "block"))
    blocks = blocks.withColumn("h", _hash(F.col("block"), bits))
    hashes = materialize(
        rows.select(
            "row_id", F.transform(_blocks(F.col("text"), chars), lambda b: _hash(b, bits)).alias("hs")
        ),
        "hashes",
    )
    distinct = blocks.groupBy("h", "block").agg(F.count(F.lit(1)).alias("n"))
    per_hash = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"))
    names = materialize(numbered(per_hash, ["h"], "name"), "block-names")
    own = names.where("texts = 1").select("h", "n", "name")
    shared = names.where("texts > 1").select("h")

    total = names.agg(F.sum("n")).first()[0] or 0
    placed = hashes.select("row_id", F.size("hs").alias("len"), F.posexplode("hs").alias("pos", "h"))
    state = attach(placed, own, ["h"], "n", total).select("row_id", "len", "pos", "name")
    if shared.take(1):
        met = blocks.join(shared, "h", "left_semi")
        apart = met.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
        apart = materialize(numbered(apart, ["block"], "name"), "shared-names")
        apart = apart.withColumn("name", -F.col("name") - 1)
        met = met.join(hashes.select("row_id", F.size("hs").alias("len")), "row_id")
        state = state.unionByName(attach(met, apart, ["block"], "n", total).select("row_id", "len", "pos", "name"))
    state = materialize(state, "names-0")

    done, level = [], 0
    while True:
        done.append(state.where("len = 1").select("row_id", F.lit(level).alias("level"), "name"))
        longest = state.agg(F.max("len")).first()[0] or 0
        if longest <= 1:
            break
        level += 1
        half = F.floor(F.col("pos") / 2).cast("int")
        pairs = state.where("len > 1").groupBy("row_id", "len", half.alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(NO_NAME)).alias("b"),
        )
        pairs = materialize(pairs.withColumn("len", F.ceil(F.col("len") / 2).cast("int")), f"pairs-{level}")
        counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
        names = materialize(numbered(counted, ["a", "b"], "name"), f"pair-names-{level}")
        state = attach(pairs, names, ["a", "b"], "n", pairs.count()).select("row_id", "len", "pos", "name")
        state = materialize(state, f"names-{level}")
    return reduce(DataFrame.unionByName, done)


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, ...) that stay, with all their columns."""
    return without_rows(docs, exact_groups(docs).where("NOT kept"))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = BLOCK_CHARS, bits: int = 64
) -> DataFrame:
    """One row per row of `docs`: row_id, doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays; NULL ids are smallest, and
    of repeated rows with the same id exactly one stays. NULL texts are empty, so
    they equal empty ones. Other columns of `docs` are not looked at. An empty
    table gives no rows. `docs` must give the same rows in the same partitions
    when it is read again, as a scan of files does.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"), F.monotonically_increasing_id().alias("row_id")
    )
    facts = rows.select("row_id", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    named = materialize(text_names(rows.select("row_id", "text"), chars, bits).join(facts, "row_id"), "identities")
    groups = named.groupBy("level", "name").agg(
        F.max(F.struct("doc_id", "row_id")).alias("keep"), F.count(F.lit(1)).alias("group_size")
    )
    groups = materialize(groups.withColumn("n", F.col("group_size")), "identity-groups")
    return attach(named, groups, ["level", "name"], "n", named.count()).select(
        "row_id",
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("keep.row_id")).alias("kept"),
        "text_sha256",
    )

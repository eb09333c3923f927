"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A key is hot when more than one row in HOT_SHARE has it; so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000

_held: list[Callable[[], object]] = []  # how to free what the last operator keeps in this process


def forget_others(forget: Callable[[], object]) -> None:
    """Free what tasks of other operators keep in this Python worker; `forget`, a function of a module, frees what the caller keeps.

    Workers go from stage to stage, so what each stage keeps for its next tasks would add up.
    """
    if _held != [forget]:
        for other in _held:
            other()
        _held[:] = [forget]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attach(rows: DataFrame, named: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of `rows` with `named`, whose keys are unique and whose column `count` says how many rows each has.

    Hot keys are joined by a broadcast of fewer than HOT_SHARE rows of `named`, so
    their rows are never shuffled; all others meet in an ordinary shuffled join.
    Keys must not be NULL.
    """
    is_hot = F.col(count) * HOT_SHARE > total
    hot, cold = named.where(is_hot).drop(count), named.where(~is_hot).drop(count)
    straight = rows.join(F.broadcast(hot), keys)
    shuffled = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cold, keys)
    return straight.unionByName(shuffled)


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Sort by `keys` over all partitions and give each row an integer that grows in that order.

    The integers have gaps between partitions. They are fixed only once the result is written.
    """
    return (
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id())
    )


def whole_text(col: str | Column) -> Column:
    """The text, NULL as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; NULL ids count as the text 'null'."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % folds


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """`docs` without the rows numbered in `gone` (row_id), all columns as they are.

    Rows are numbered as operators number them, so `docs` must be a scan of files.
    """
    row = fresh(docs, "row_id")
    numbers = gone.select(F.col("row_id").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(numbers, row, "left_anti").drop(row)

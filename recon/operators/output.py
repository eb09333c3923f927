"""Result formats: JSON lines, grouped JSON, CSV fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recon.operators.grading import DIFF_TYPES
from recon.operators.joindiff import Compared


def json_lines(diff: DataFrame) -> DataFrame:
    """Each signed row as one JSON array `["-", ["v1", "v2"]]`; NULL cells stay null."""
    values = F.array(*[F.col(c).cast("string") for c in diff.columns if c != "sign"])
    body = F.to_json(values)
    return diff.select(F.concat(F.lit('["'), F.col("sign"), F.lit('",'), body, F.lit("]")).alias("value"))


def row_json(compared: Compared) -> DataFrame:
    """Each differing row as a JSON object of its cells.

    `group` is `dataset1`, `dataset2` (exclusive rows; cells carry isPK and
    value) or `diff` (cells carry isPK, isDiff and both values).
    """
    n = compared.key_count

    def one_sided(which: str) -> Column:
        side = 0 if which == "a" else 1
        cells = [
            F.struct(F.lit(i < n).alias("isPK"), compared.text(i, which).alias("value")).alias(p[side])
            for i, p in enumerate(compared.pairs)
        ]
        return F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})

    both = [
        F.struct(
            F.lit(i < n).alias("isPK"),
            compared.differs(i).alias("isDiff"),
            compared.text(i, "a").alias("dataset1"),
            compared.text(i, "b").alias("dataset2"),
        ).alias(p[0])
        for i, p in enumerate(compared.pairs)
    ]
    group = F.when(compared.only_a(), "dataset1").when(compared.only_b(), "dataset2").otherwise("diff")
    body = (
        F.when(compared.only_a(), one_sided("a"))
        .when(compared.only_b(), one_sided("b"))
        .otherwise(F.to_json(F.struct(*both), {"ignoreNullFields": "false"}))
    )
    return compared.different.select(*compared.key_columns(), group.alias("group"), body.alias("cells"))


def cell_table(compared: Compared) -> DataFrame:
    """D12, flattened: one row per cell of every differing row."""
    n = compared.key_count
    items = [
        F.struct(
            F.lit(p[0]).alias("column_name"),
            F.lit(i < n).alias("is_pk"),
            compared.differs(i).alias("is_diff"),
            compared.text(i, "a").alias("dataset1"),
            compared.text(i, "b").alias("dataset2"),
        )
        for i, p in enumerate(compared.pairs)
    ]
    group = F.when(compared.only_a(), "dataset1").when(compared.only_b(), "dataset2").otherwise("diff")
    rows = compared.different.select(*compared.key_columns(), group.alias("group"), F.explode(F.array(*items)).alias("c"))
    return rows.select(*compared.pairs_key_names(), "group", "c.*")


def csv_fields(compared: Compared) -> DataFrame:
    """The CSV columns of a difference: type, key, both rows as JSON, differing columns."""
    n = compared.key_count

    def row(which: str) -> Column:
        side = 0 if which == "a" else 1
        return F.to_json(F.struct(*[compared.text(i, which).alias(p[side]) for i, p in enumerate(compared.pairs)]))

    key = F.to_json(F.struct(*[c for c in compared.key_columns()]))
    names = F.concat_ws(
        ",", *[F.when(compared.in_both() & compared.differs(i), F.lit(compared.pairs[i][0])) for i in range(n, len(compared.pairs))]
    )
    kind = F.when(compared.only_a(), DIFF_TYPES["-"]).when(compared.only_b(), DIFF_TYPES["+"]).otherwise(DIFF_TYPES["!"])
    return compared.different.select(
        kind.alias("type"),
        key.alias("key"),
        F.when(compared.only_b(), "").otherwise(row("a")).alias("source_values"),
        F.when(compared.only_a(), "").otherwise(row("b")).alias("target_values"),
        names.alias("differing_columns"),
    )

"""Release comparison: production against development build of a table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recon.functions.names import include_exclude
from recon.operators.joindiff import Compared, compare_by_key
from recon.operators.schema import schema_diff, schema_frame
from recon.sources.side import TableSide


@dataclass(frozen=True)
class Release:
    """Column changes, the row comparison over the unchanged columns, and its counts."""

    columns: DataFrame
    rows: Compared

    def summary(self) -> DataFrame:
        """Total, added, removed, different and unchanged rows."""
        return self.rows.stats().select(
            F.col("rows_A").alias("total_prod"),
            F.col("rows_B").alias("total_dev"),
            F.col("exclusive_B").alias("added"),
            F.col("exclusive_A").alias("removed"),
            F.col("updated").alias("different"),
            "unchanged",
        )

    def values_changed(self) -> DataFrame:
        """Updated keys per column."""
        counts = self.rows.column_counts()
        return counts.where(~F.col("column_name").isin(self.rows.pairs_key_names())).select("column_name", "values_changed")


def release_diff(
    prod: DataFrame,
    dev: DataFrame,
    keys: Sequence[str],
    *,
    where: str | None = None,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
) -> Release:
    """Retyped, added and removed columns are listed and left out of the row comparison; NULL keys are skipped."""
    spark = prod.sparkSession
    columns = schema_diff(schema_frame(spark, prod.schema), schema_frame(spark, dev.schema)).drop("table_name")
    retyped = [c for c in prod.columns if c in dev.columns and prod.schema[c].dataType != dev.schema[c].dataType]
    mutual = [c for c in prod.columns if c in dev.columns and c not in keys]
    chosen = include_exclude(mutual, include, exclude, retyped)
    a, b = (
        TableSide(df, tuple(keys), extra_columns=tuple(chosen), where=where, name=name)
        for df, name in ((prod, "prod"), (dev, "dev"))
    )
    return Release(columns, compare_by_key(a, b, null_keys="skip"))

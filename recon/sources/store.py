"""The result store: appended Parquet tables and a manifest.

A save appends files to a table and then one entry to the manifest; rows count from
the moment their entry is there. The latest entry of a table and comparison decides:
it names the save whose rows stand, or says that they are gone. Deleting is an entry
too. Compaction moves the rows that stand into few large files, ordered by
comparison, and empties the folders that held them.
"""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from recon.operators.grading import difference_type
from recon.operators.history import doomed
from recon.plans.lineage import materialize

# Stored layouts.
LAYOUTS = {
    "comparison_summary": (
        "comparison_id string, source_table string, target_table string, key_columns array<string>, algorithm string, "
        "start_time timestamp_ntz, end_time timestamp_ntz, execution_time_seconds decimal(10,3), rows_compared bigint, "
        "rows_matched bigint, rows_different bigint, match_rate decimal(5,2), sampling_config string, "
        "column_remapping string, where_conditions string, status string, error_message string, created_at timestamp_ntz"
    ),
    "difference_details": (
        "comparison_id string, row_key string, difference_type string, severity string, column_name string, "
        "source_value string, target_value string, metadata string, created_at timestamp_ntz"
    ),
    "column_statistics": (
        "comparison_id string, table_side string, column_name string, data_type string, null_count bigint, "
        "null_rate decimal(5,2), total_count bigint, unique_count bigint, cardinality decimal(10,6), min_value string, "
        "max_value string, avg_value decimal(20,6), avg_length decimal(10,2), value_distribution string, percentiles string"
    ),
    "timeline_analysis": (
        "comparison_id string, time_column string, period_type string, period_start timestamp_ntz, "
        "period_end timestamp_ntz, source_count bigint, target_count bigint, matched_count bigint, "
        "difference_count bigint, match_rate decimal(5,2)"
    ),
    "performance_metrics": (
        "comparison_id string, metric_name string, metric_value decimal(20,6), metric_unit string, "
        "metric_context string, recorded_at timestamp_ntz"
    ),
    "schema_comparison_summary": (
        "comparison_id string, source_schema string, target_schema string, start_time timestamp_ntz, "
        "execution_time_seconds decimal(10,3), total_differences bigint, table_differences bigint, "
        "column_differences bigint, type_differences bigint, schemas_identical boolean, status string, "
        "error_message string, created_at timestamp_ntz"
    ),
    "schema_table_differences": (
        "comparison_id string, table_name string, difference_type string, details string, created_at timestamp_ntz"
    ),
    "schema_column_differences": (
        "comparison_id string, table_name string, column_name string, difference_type string, source_type string, "
        "target_type string, created_at timestamp_ntz"
    ),
}

TABLE_CHILDREN = ("performance_metrics", "timeline_analysis", "column_statistics", "difference_details")
SCHEMA_CHILDREN = ("schema_column_differences", "schema_table_differences")


MANIFEST = "table_name string, comparison_id string, save_id string, place string, at timestamp, revision int, gone boolean"
WRITER = f"writer-{uuid.uuid4().hex}"  # each driver appends to a folder of its own
_appending = threading.Lock()  # two appends to one folder would clear each other's temporary files


@dataclass(frozen=True)
class ResultStore:
    """A folder with one Parquet table per result kind, and the manifest.

    Saving a comparison again replaces what was saved of it; a save that breaks
    leaves what was there. Drivers may save at the same time.
    """

    spark: SparkSession
    path: str

    def location(self, table: str) -> str:
        return f"{self.path.rstrip('/')}/{table}"

    def _scan(self, table: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self.location(table)).select(*schema.names)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def manifest(self) -> DataFrame:
        """All entries, one per save, deletion or move of a comparison in a table."""
        return self._scan("manifest", T.StructType.fromDDL(MANIFEST))

    def _standing(self, table: str) -> DataFrame:
        """(comparison_id, at, revision, save_id, place): the save of each comparison that counts."""
        latest = F.max(F.struct("at", "revision", "save_id", "place", "gone")).alias("e")
        entries = self.manifest().where((F.col("table_name") == table) & F.col("comparison_id").isNotNull())
        return entries.groupBy("comparison_id").agg(latest).where("NOT e.gone").select("comparison_id", "e.*").drop("gone")

    def _rows(self, table: str, standing: DataFrame) -> DataFrame:
        schema = T.StructType.fromDDL(f"{LAYOUTS[table]}, save_id string, place string")
        return self._scan(table, schema).join(standing, ["comparison_id", "save_id", "place"], "left_semi")

    def read(self, table: str) -> DataFrame:
        """A stored table; empty before the first save. Filters on `comparison_id` reach the scan."""
        names = T.StructType.fromDDL(LAYOUTS[table]).names
        return self._rows(table, self._standing(table)).select(*names)

    def _enter(self, entries: DataFrame) -> None:
        schema = T.StructType.fromDDL(MANIFEST)
        defaults = {"at": F.current_timestamp(), "revision": F.lit(0), "gone": F.lit(False)}
        columns = [
            (F.col(f.name) if f.name in entries.columns else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
        with _appending:
            entries.select(*columns).write.mode("append").parquet(f"{self.location('manifest')}/by={WRITER}")

    def save(self, table: str, comparison_id: str | None, rows: DataFrame) -> None:
        """Replace one comparison's rows; missing columns become NULL.

        Without `comparison_id`, `rows` has the column itself and replaces each
        comparison that it holds.
        """
        schema, save_id = T.StructType.fromDDL(LAYOUTS[table]), uuid.uuid4().hex
        out = []
        for f in schema.fields:
            if f.name == "comparison_id" and comparison_id is not None:
                c = F.lit(comparison_id)
            elif f.name in rows.columns:
                c = F.col(f.name)
            elif f.name in ("created_at", "recorded_at"):
                c = F.current_timestamp()
            else:
                c = F.lit(None)
            out.append(c.cast(f.dataType).alias(f.name))
        with _appending:
            stored = rows.select(*out, F.lit(save_id).alias("save_id"))
            stored.write.mode("append").parquet(f"{self.location(table)}/place={WRITER}")
        if comparison_id is not None:
            ids = self.spark.range(1, numPartitions=1).select(F.lit(comparison_id).alias("comparison_id"))
        else:
            saved = self._scan(table, T.StructType.fromDDL("comparison_id string, save_id string, place string"))
            ids = saved.where((F.col("save_id") == save_id) & (F.col("place") == WRITER)).select("comparison_id").distinct()
        about = {"table_name": F.lit(table), "save_id": F.lit(save_id), "place": F.lit(WRITER)}
        self._enter(ids.withColumns(about))

    def delete(self, tables: tuple[str, ...], ids: list[str] | DataFrame) -> None:
        """Drop what is stored for the given comparisons, in one step for all tables."""
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(i,) for i in ids], "comparison_id string")
        names = F.explode(F.array(*[F.lit(t) for t in tables]))
        self._enter(ids.select("comparison_id", names.alias("table_name"), F.lit(True).alias("gone")))

    def clear(
        self, *, kind: str = "all", failed: bool = False, now: datetime | None = None, days: int | None = None
    ) -> dict[str, int]:
        """Delete failed, old or all comparisons with everything stored for them; returns counts."""
        cleared = {}
        for name, parent, children in (
            ("table", "comparison_summary", TABLE_CHILDREN),
            ("schema", "schema_comparison_summary", SCHEMA_CHILDREN),
        ):
            if kind in ("all", name):
                ids = materialize(doomed(self.read(parent), failed=failed, now=now, days=days).distinct(), "doomed")
                cleared[f"{name}_comparisons"] = ids.count()
                if cleared[f"{name}_comparisons"]:
                    self.delete((*children, parent), ids)
        return cleared

    def compact(self, tables: tuple[str, ...] = tuple(LAYOUTS)) -> None:
        """Rewrite the rows that stand into few files and empty the folders they came from.

        Run it while no driver saves: a save under way would lose its files.
        """
        for table in tables:
            standing = materialize(self._standing(table), "standing")
            place = f"packed-{uuid.uuid4().hex}"
            rows = self._rows(table, standing).drop("place")
            packed = rows.repartitionByRange("comparison_id").sortWithinPartitions("comparison_id")
            packed.write.parquet(f"{self.location(table)}/place={place}")
            moved = {"table_name": F.lit(table), "place": F.lit(place), "revision": F.col("revision") + 1}
            self._enter(standing.withColumns(moved))
            # Folders: one per driver or compaction since the last one, not per comparison.
            mine = self.manifest().where((F.col("table_name") == table) & F.col("place").isNotNull())
            emptied = mine.where("gone AND comparison_id IS NULL").select("place")
            old = mine.where(F.col("place") != place).select("place").distinct().join(emptied, "place", "left_anti")
            for (folder,) in old.collect():
                rows.limit(0).write.mode("overwrite").parquet(f"{self.location(table)}/place={folder}")
                if folder != WRITER:  # this driver goes on writing into its own
                    gone = self.spark.range(1, numPartitions=1).select(F.lit(folder).alias("place"))
                    self._enter(gone.withColumns({"table_name": F.lit(table), "gone": F.lit(True)}))

    def details(self, comparison_id: str, limit: int | None = None) -> dict[str, DataFrame]:
        """H2: everything stored for one comparison; reads one partition per table. `limit` shows the first differences only."""
        mine = F.col("comparison_id") == comparison_id
        out = {t: self.read(t).where(mine) for t in ("comparison_summary", "column_statistics", "performance_metrics")}
        shown = self.read("difference_details").where(mine)
        out["difference_details"] = shown if limit is None else shown.orderBy("row_key", "column_name").limit(limit)
        return out


def detail_rows(compared, limit: int | None = None) -> DataFrame:
    """Differing keys in long form: one row per differing column, or one per exclusive row.

    All differing keys are kept, or the first `limit` if asked; values are kept whole.
    """
    names = compared.pairs_key_names()
    kind = difference_type(F.when(compared.only_a(), "-").when(compared.only_b(), "+").otherwise("!"))

    def as_json(which: str):
        side = 0 if which == "a" else 1
        return F.to_json(F.struct(*[compared.text(i, which).alias(p[side]) for i, p in enumerate(compared.pairs)]))

    def item(column, source, target, severity):
        return F.struct(
            column.cast("string").alias("column_name"),
            source.alias("source_value"),
            target.alias("target_value"),
            F.lit(severity).alias("severity"),
        )

    changed = [
        F.when(
            compared.differs(i),
            item(
                F.lit(compared.pairs[i][0]),
                F.coalesce(compared.text(i, "a"), F.lit("")),
                F.coalesce(compared.text(i, "b"), F.lit("")),
                "medium",
            ),
        )
        for i in compared.value_positions
    ]
    none, empty = F.lit(None), F.lit("")
    items = (
        F.when(compared.only_a(), F.array(item(none, as_json("a"), empty, "high")))
        .when(compared.only_b(), F.array(item(none, empty, as_json("b"), "high")))
        .otherwise(F.array(*changed))
    )
    keyed = compared.different.select(*compared.key_columns(), kind.alias("difference_type"), items.alias("items"))
    first = keyed if limit is None else keyed.orderBy(*names).limit(limit)
    row_key = F.to_json(F.struct(*[F.col(k) for k in names]))
    rows = first.select(row_key.alias("row_key"), "difference_type", F.explode("items").alias("i")).where("i is not null")
    return rows.select("row_key", "difference_type", "i.*")

"""Schemas as data: differences, normalized type names, warnings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recon.sources.side import TableSide

# Type names of several systems and the common name each stands for.
TYPE_NAMES = {
    "INTEGER": "INT",
    "INT4": "INT",
    "INT2": "SMALLINT",
    "SERIAL": "INT",
    "BIGSERIAL": "BIGINT",
    "SMALLSERIAL": "SMALLINT",
    "INT8": "TINYINT",
    "INT16": "SMALLINT",
    "INT32": "INT",
    "INT64": "BIGINT",
    "REAL": "FLOAT",
    "FLOAT4": "FLOAT",
    "FLOAT32": "FLOAT",
    "DOUBLE PRECISION": "DOUBLE",
    "FLOAT8": "DOUBLE",
    "FLOAT64": "DOUBLE",
    "CHARACTER VARYING": "STRING",
    "VARCHAR": "STRING",
    "CHARACTER": "STRING",
    "CHAR": "STRING",
    "TEXT": "STRING",
    "BOOL": "BOOLEAN",
    "TIMESTAMP WITHOUT TIME ZONE": "TIMESTAMP",
    "TIMESTAMP_NTZ": "TIMESTAMP",
    "TIMESTAMP WITH TIME ZONE": "TIMESTAMP_LTZ",
    "TIMESTAMPTZ": "TIMESTAMP_LTZ",
    "DATETIME": "TIMESTAMP",
    "NUMERIC": "DECIMAL",
    "MONEY": "DECIMAL",
    "JSONB": "JSON",
    "BYTEA": "BINARY",
    "BLOB": "BINARY",
}
# In some systems INT8 counts bytes, not bits.
BYTE_COUNTED = {"INT8": "BIGINT"}


def normalized_type(name: Column, byte_counted: bool = False) -> Column:
    """Common type name; length and precision are dropped."""
    base = F.trim(F.upper(F.regexp_replace(name, r"\(.*$", "")))
    table = {**TYPE_NAMES, **(BYTE_COUNTED if byte_counted else {})}
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, base), base)


def schema_frame(spark: SparkSession, schema: T.StructType, table: str = "") -> DataFrame:
    """A schema as rows: name, type, position, precision, scale, kind."""
    rows = []
    for i, f in enumerate(schema.fields, start=1):
        decimal = isinstance(f.dataType, T.DecimalType)
        temporal = isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
        rows.append(
            (
                table,
                f.name,
                f.dataType.simpleString(),
                i,
                6 if temporal else None,
                f.dataType.precision if decimal else None,
                f.dataType.scale if decimal else None,
                column_kind(f.dataType),
            )
        )
    layout = (
        "table_name string, column_name string, data_type string, position int, "
        "datetime_precision int, numeric_precision int, numeric_scale int, kind string"
    )
    return spark.createDataFrame(rows, layout)


def column_kind(dtype: T.DataType) -> str:
    """Coarse kind of a column."""
    kinds = [
        (T.BooleanType, "boolean"),
        (T.DateType, "date"),
        ((T.TimestampType, T.TimestampNTZType), "datetime"),
        ((T.FloatType, T.DoubleType), "float"),
        ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "integer"),
        ((T.StringType, T.CharType, T.VarcharType, T.ArrayType, T.StructType, T.VariantType), "string"),
    ]
    if isinstance(dtype, T.DecimalType):
        return "float" if dtype.scale else "integer"
    return next((kind for types, kind in kinds if isinstance(dtype, types)), "unsupported")


def schema_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Columns only in source, only in target, or with another type (inputs: `schema_frame`)."""
    s = source.select("table_name", "column_name", F.col("data_type").alias("source_type"))
    t = target.select("table_name", "column_name", F.col("data_type").alias("target_type"))
    both = s.join(t, ["table_name", "column_name"], "full_outer")
    kind = (
        F.when(F.col("target_type").isNull(), "only_in_source")
        .when(F.col("source_type").isNull(), "only_in_target")
        .when(normalized_type(F.col("source_type")) != normalized_type(F.col("target_type")), "type_changed")
    )
    return both.withColumn("difference_type", kind).where(F.col("difference_type").isNotNull())


def table_key(name: str) -> str:
    """Table name without catalog and schema prefix."""
    return name.rsplit(".", 1)[-1]


def catalog_frame(spark: SparkSession, tables: Mapping[str, T.StructType]) -> DataFrame:
    """Many schemas in one frame, by table name without prefix."""
    frames = [schema_frame(spark, s, table_key(n)) for n, s in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def catalog_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Tables on one side only, and column differences of the common tables."""
    st, tt = source.select("table_name").distinct(), target.select("table_name").distinct()
    tables = st.withColumn("in_s", F.lit(True)).join(tt.withColumn("in_t", F.lit(True)), "table_name", "full_outer")
    alone = tables.where(F.col("in_s").isNull() | F.col("in_t").isNull()).select(
        "table_name",
        F.lit(None).cast("string").alias("column_name"),
        F.lit(None).cast("string").alias("source_type"),
        F.lit(None).cast("string").alias("target_type"),
        F.when(F.col("in_t").isNull(), "table_only_in_source").otherwise("table_only_in_target").alias("difference_type"),
    )
    common = tables.where(F.col("in_s") & F.col("in_t")).select("table_name")
    columns = schema_diff(source, target).join(common, "table_name", "left_semi")
    return alone.unionByName(columns)


def catalog_summary(diff: DataFrame) -> DataFrame:
    """Totals; column and type differences count tables, as the overall number does."""
    kind = F.col("difference_type")
    one_sided = kind.isin("only_in_source", "only_in_target")
    n = diff.agg(
        F.count_if(kind.startswith("table_only")).alias("table_differences"),
        F.count_distinct(F.when(one_sided, F.col("table_name"))).alias("column_differences"),
        F.count_distinct(F.when(kind == "type_changed", F.col("table_name"))).alias("type_differences"),
    )
    total = F.col("table_differences") + F.col("column_differences") + F.col("type_differences")
    return n.withColumn("total_differences", total).withColumn("schemas_identical", total == 0)


def attribute_warnings(source: DataFrame, target: DataFrame) -> DataFrame:
    """Per shared column, each attribute that differs."""
    fields = ["data_type", "datetime_precision", "numeric_precision", "numeric_scale"]
    s = source.select("column_name", *[F.col(f).cast("string").alias(f"s_{f}") for f in fields])
    t = target.select("column_name", *[F.col(f).cast("string").alias(f"t_{f}") for f in fields])
    items = F.array(
        *[
            F.when(
                ~F.col(f"s_{f}").eqNullSafe(F.col(f"t_{f}")),
                F.struct(F.lit(f).alias("attribute"), F.col(f"s_{f}").alias("source"), F.col(f"t_{f}").alias("target")),
            )
            for f in fields
        ]
    )
    found = s.join(t, "column_name").select("column_name", F.explode(F.filter(items, lambda x: x.isNotNull())).alias("w"))
    return found.select("column_name", "w.*")


def layout_changes(source: DataFrame, target: DataFrame) -> DataFrame:
    """Mismatched, retyped and reordered columns, and column counts.

    A shared column is reordered when its rank among the shared columns changed.
    """
    s = source.select("column_name", F.col("position").alias("ps"), F.col("data_type").alias("ts"))
    t = target.select("column_name", F.col("position").alias("pt"), F.col("data_type").alias("tt"))
    both = s.join(t, "column_name", "full_outer")
    shared = F.col("ps").isNotNull() & F.col("pt").isNotNull()
    rank = lambda c: F.sum(shared.cast("int")).over(Window.orderBy(c))  # noqa: E731  (schema-sized)
    ranked = both.withColumns({"rs": rank("ps"), "rt": rank("pt")})
    return ranked.agg(
        F.count("ps").alias("columns_a"),
        F.count("pt").alias("columns_b"),
        F.count_if(F.col("pt").isNull()).alias("only_in_a"),
        F.count_if(F.col("ps").isNull()).alias("only_in_b"),
        F.count_if(shared & (F.col("ts") != F.col("tt"))).alias("column_type_mismatches"),
        F.count_if(shared & (F.col("rs") != F.col("rt"))).alias("column_reorders"),
    )


SUPPORTED = (
    T.NumericType,
    T.BooleanType,
    T.StringType,
    T.DateType,
    T.TimestampType,
    T.TimestampNTZType,
    T.ArrayType,
    T.StructType,
    T.VariantType,
)


class UnsupportedTypeError(TypeError):
    """A compared column has a type without a normal form (strict mode)."""


def unsupported_types(spark: SparkSession, a: TableSide, b: TableSide, strict: bool = False) -> DataFrame:
    """Compared columns whose text form may not be comparable; `strict` raises."""
    rows = [
        (which, c, s.dtype(c).simpleString(), "no normal form for this type")
        for which, s in (("A", a), ("B", b))
        for c in s.columns
        if not isinstance(s.dtype(c), SUPPORTED)
    ]
    if rows and strict:
        raise UnsupportedTypeError(f"unsupported column types: {rows}")
    return spark.createDataFrame(rows, "side string, column_name string, data_type string, reason string")


def affected_values(found: DataFrame, s: TableSide) -> DataFrame:
    """How many values of the side stand behind each listed column (one aggregate over its rows)."""
    columns = [c for c in s.columns]
    counted = s.rows().agg(
        F.array(*[F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n_values")) for c in columns]).alias("all")
    )
    per_column = counted.select(F.explode("all").alias("c")).select("c.*")
    return found.join(per_column, "column_name", "left")


def zone_warnings(spark: SparkSession, a: TableSide, b: TableSide) -> DataFrame:
    """T4: column pairs where only one side carries a time zone, with a recommended precision."""
    from recon.operators.joindiff import pair_columns

    rows = []
    for ca, cb in pair_columns(a, b):
        kinds = {type(a.dtype(ca)), type(b.dtype(cb))}
        if kinds == {T.TimestampType, T.TimestampNTZType}:
            rows.append((ca, "one side has a time zone, the other has none", "millisecond"))
    return spark.createDataFrame(rows, "column_name string, warning string, recommended_precision string")


UUID_PATTERN = r"^\s*[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\s*$"
ALPHANUMERIC_PATTERN = r"^[ \-0-9A-Z_a-z]+$"


def text_kinds(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """C14: what text columns hold: UUIDs, alphanumeric keys, a mix, or plain text; every row is checked, in one aggregate."""
    columns = list(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    rows = df.select(*columns)
    items = []
    for c in columns:
        v = F.col(c)
        is_uuid, is_alnum = v.rlike(UUID_PATTERN), v.rlike(ALPHANUMERIC_PATTERN)
        n, uuids, alnums = F.count(v), F.count_if(is_uuid), F.count_if(is_alnum)  # NULLs tell nothing
        kind = (
            F.when(n == 0, "text")
            .when(uuids == n, "uuid")
            .when(uuids > 0, "mixed_uuid")
            .when(alnums == n, "alphanumeric")
            .otherwise("text")
        )
        lower = F.coalesce(F.bool_and(F.when(is_uuid, v == F.lower(v))), F.lit(False))
        upper = F.coalesce(F.bool_and(F.when(is_uuid, v == F.upper(v))), F.lit(False))
        items.append(
            F.struct(
                F.lit(c).alias("column_name"), kind.alias("kind"), lower.alias("all_lowercase"), upper.alias("all_uppercase")
            )
        )
    return rows.agg(F.array(*items).alias("all")).select(F.explode("all").alias("c")).select("c.*")

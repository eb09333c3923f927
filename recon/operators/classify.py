"""Severity of differences (Q1-Q4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recon.functions.predicates import TEMPORAL

# Relative gaps above which a numeric difference is high or medium.
HIGH_GAP = 0.10
MEDIUM_GAP = 0.01
MANY_DIFFERENCES = 100
BLANKS = " \t\n\r\x0b\x0c"


def classify_cells(
    compared,
    *,
    numeric_tolerance: float = 0.0,
    null_is_critical: bool = False,
    case_sensitive: bool = True,
) -> DataFrame:
    """Q1: one row per differing cell with its type and severity.

    The column types pick the rule, so the values are compared typed, before
    they become text. Every differing column of a row is classified.
    """
    items = []
    for i in compared.value_positions:
        ca, cb = compared.pairs[i]
        kind, severity = _rule(
            F.col(f"a{i}"),
            F.col(f"b{i}"),
            compared.a.dtype(ca),
            compared.b.dtype(cb),
            numeric_tolerance,
            "critical" if null_is_critical else "high",
            "medium" if case_sensitive else "low",
        )
        items.append(
            F.when(
                compared.differs(i),
                F.struct(
                    F.lit(ca).alias("column_name"),
                    kind.alias("difference_type"),
                    severity.alias("severity"),
                    compared.text(i, "a").alias("source_value"),
                    compared.text(i, "b").alias("target_value"),
                ),
            )
        )
    rows = compared.matched.where(compared.changed())
    cells = rows.select(*compared.key_columns(), F.explode(F.array(*items)).alias("cell")).where("cell is not null")
    return cells.select(*compared.pairs_key_names(), "cell.*")


def _rule(
    a: Column, b: Column, left: T.DataType, right: T.DataType, tolerance: float, null_level: str, case_level: str
) -> tuple[Column, Column]:
    """Type and severity of one differing pair of values."""
    null_gap = a.isNull() != b.isNull()

    def chain(*steps: tuple[Column, str, str | Column]) -> tuple[Column, Column]:
        kind, level = F.when(null_gap, "null_mismatch"), F.when(null_gap, null_level)
        for test, k, s in steps[:-1]:
            kind, level = kind.when(test, k), level.when(test, s)
        return kind.otherwise(steps[-1][1]), level.otherwise(steps[-1][2])

    always = F.lit(True)
    if isinstance(left, T.NumericType) and isinstance(right, T.NumericType):
        gap = F.abs(a.cast("double") - b.cast("double"))
        larger = F.greatest(F.abs(a.cast("double")), F.abs(b.cast("double")))
        relative = F.when(larger > 0, gap / larger).otherwise(gap)
        level = F.when(relative > HIGH_GAP, "high").when(relative > MEDIUM_GAP, "medium").otherwise("low")
        within = gap <= F.lit(tolerance) if tolerance > 0 else F.lit(False)
        return chain((within, "precision_difference", "info"), (always, "value_mismatch", level))
    if type(left) is not type(right):
        return chain((always, "type_mismatch", "high"))
    if isinstance(left, T.StringType):
        blanks = F.lit(BLANKS)
        steps = [
            (F.lower(a) == F.lower(b), "case_difference", case_level),
            (F.btrim(a, blanks) == F.btrim(b, blanks), "whitespace_difference", "low"),
        ]
        return chain(*steps, (always, "value_mismatch", "medium"))
    if isinstance(left, TEMPORAL):
        return chain((always, "date_format_difference", "medium"))
    return chain((always, "value_mismatch", "medium"))


def classify_duplicates(counts: DataFrame) -> DataFrame:
    """Q2: keys with several rows on a side: which side has more of them (input: k0.., n_a, n_b)."""
    return counts.where((F.col("n_a") > 1) | (F.col("n_b") > 1)).withColumns(
        {
            "difference_type": F.when(F.col("n_a") > F.col("n_b"), "missing_in_target").otherwise("missing_in_source"),
            "severity": F.lit("high"),
        }
    )


def summary(cells: DataFrame) -> DataFrame:
    """Q3: counts by type, by severity and by column and type, from one aggregate."""
    base = cells.groupBy("column_name", "difference_type", "severity").agg(F.count(F.lit(1)).alias("n"))
    views = [
        F.struct(F.lit("type").alias("grouping"), F.lit("").alias("column_name"), F.col("difference_type").alias("label"), "n"),
        F.struct(F.lit("severity").alias("grouping"), F.lit("").alias("column_name"), F.col("severity").alias("label"), "n"),
        F.struct(F.lit("column").alias("grouping"), F.col("column_name"), F.col("difference_type").alias("label"), "n"),
    ]
    flat = base.select(F.explode(F.array(*views)).alias("v")).select("v.*")
    return flat.groupBy("grouping", "column_name", "label").agg(F.sum("n").alias("n"))


def critical_cells(cells: DataFrame) -> DataFrame:
    """Q3: the critical list."""
    return cells.where(F.col("severity") == "critical")


def recommendations(cells: DataFrame) -> DataFrame:
    """Q4: rule-based advice over the classified cells, one row per rule that applies."""
    kind = F.col("difference_type")
    n = cells.agg(
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(kind == "null_mismatch").alias("nulls"),
        F.count_if(kind == "type_mismatch").alias("types"),
        F.count_if(kind.isin("case_difference", "whitespace_difference")).alias("texts"),
        F.count(F.lit(1)).alias("total"),
    )

    def rule(test: Column, name: str, count: str) -> Column:
        return F.when(test, F.struct(F.lit(name).alias("rule"), F.col(count).alias("n")))

    rules = F.array(
        rule(F.col("critical") > 0, "critical issues need attention", "critical"),
        rule(F.col("nulls") > 0, "review data completeness", "nulls"),
        rule(F.col("types") > 0, "ensure consistent data types", "types"),
        rule(F.col("texts") > 0, "consider data normalization", "texts"),
        rule(F.col("total") > MANY_DIFFERENCES, "consider reviewing data pipeline", "total"),
    )
    return n.select(F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("r.*")

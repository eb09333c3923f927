"""Profiles, grades, classification, timelines, schemas."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recon import compare_by_key, release_diff, side
from recon.operators import classify as cl
from recon.operators import grading as gr
from recon.operators import profile as pf
from recon.operators import schema as sc
from recon.operators import timeline as tl
from recon.operators.joindiff import with_scores


@pytest.mark.parametrize("n", [1, 2, 5, 999])
def test_percentiles_of_few_values(spark, n):
    values = [float(i * i % 97) for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = {r.p: r.value for r in pf.exact_percentiles(df, ["v"], [0.25, 0.5, 0.75]).collect()}
    for p in (0.25, 0.5, 0.75):
        assert got[p] == pytest.approx(np.percentile(values, p * 100))


def test_percentiles_through_brackets(spark):
    rng = random.Random(5)
    values = [rng.choice([1.5, rng.gauss(0, 10)]) for _ in range(40_000)]
    df = spark.createDataFrame([(v, -v) for v in values], "v double, w double")
    out = pf.exact_percentiles(df, ["v", "w"], [0.01, 0.25, 0.5, 0.75, 0.999])
    for r in out.collect():
        sign = 1 if r.column_name == "v" else -1
        assert r.value == pytest.approx(np.percentile([sign * v for v in values], r.p * 100))


def test_profile_of_edge_columns(spark):
    df = spark.createDataFrame([(1, None, "ab", True), (None, None, "abcd", False)], "n int, gone double, t string, b boolean")
    rows = {r.column_name: r for r in pf.column_profile(df).collect()}
    assert (rows["n"].null_count, rows["n"].null_rate, rows["n"].unique_count, rows["n"].min_value) == (1, 50.0, 1, "1")
    assert rows["gone"].avg_value is None and rows["gone"].p50 is None and rows["gone"].unique_count == 0
    assert rows["t"].avg_length == 3.0 and rows["t"].cardinality == 1.0
    empty = pf.column_profile(df.where("n > 5")).where("column_name = 'n'").first()
    assert (empty.total_count, empty.null_rate, empty.cardinality) == (0, 0.0, 0.0)


def test_compare_profiles_limits(spark):
    a = spark.createDataFrame([(i, 100.0, i % 2) for i in range(100)], "id int, v double, only_a int")
    b = spark.createDataFrame([(i, None if i < 12 else 106.0) for i in range(100)], "id int, v double")
    c = pf.compare_profiles(pf.column_profile(a), pf.column_profile(b))
    rows = {r.column_name: r for r in c.collect()}
    v = rows["v"]
    assert v.null_rate_differs and v.null_rate_warning and v.min_differs and v.avg_differs and not v.cardinality_differs
    assert rows["only_a"].presence == "missing" and not rows["only_a"].avg_differs
    assert tuple(pf.profile_summary(c).first()) == (3, 1, 1, 0, 1)


def test_distribution_limits(spark):
    df = spark.range(1000).select((F.col("id") % 150).alias("k"), (F.col("id") % 2 == 0).alias("b"))
    assert pf.value_distribution(df, "k").count() == 100
    folded = pf.folded_distribution(df, "k").collect()
    assert len(folded) == 20 and folded[0].total_unique_values == 150
    assert pf.value_distribution(df, "b").count() == 2


def stats_row(spark, a, b, xa, xb, upd):
    row = [(a, b, xa, xb, upd, a - xa - upd, xa + xb + upd)]
    names = "rows_A long, rows_B long, exclusive_A long, exclusive_B long, updated long, unchanged long, total long"
    return with_scores(spark.createDataFrame(row, names))


def test_grades_at_their_bounds(spark):
    df = spark.createDataFrame([(0.96,), (0.95,), (0.81,), (0.8,), (0.99,), (0.995,), (0.9,), (0.1,)], "r double")
    got = df.select("r", *[gr.grade(F.col("r"), s).alias(s) for s in gr.SCALES]).collect()
    by = {r.r: r for r in got}
    assert by[0.95].service == "Fair" and by[0.96].service == "Good" and by[0.8].service == "Poor"
    assert by[0.95].letters == "B" and by[0.99].letters == "A" and by[0.1].letters == "D"
    assert by[0.99].history == "Good" and by[0.995].history == "Excellent" and by[0.9].report == "Fair"


def test_alerts(spark):
    assert gr.alerts(stats_row(spark, 100, 100, 0, 0, 1)).count() == 0
    fired = {r.metric: r for r in gr.alerts(stats_row(spark, 1000, 1000, 150, 0, 10)).collect()}
    assert fired["match_rate"].severity == "high" and fired["difference_rate"].severity == "high"
    assert fired["missing_rows"].value == 150.0
    medium = {r.metric: r.severity for r in gr.alerts(stats_row(spark, 1000, 1000, 60, 0, 10)).collect()}
    assert medium == {"match_rate": "medium", "difference_rate": "medium"}


def test_empty_comparison_scores(spark):
    s = stats_row(spark, 0, 0, 0, 0, 0).first()
    assert (s.match_rate, s.diff_percent) == (1.0, 0.0)
    assert [r[0] for r in gr.advice(stats_row(spark, 5, 5, 0, 0, 0)).collect()] == ["nothing to do: both sides agree"]


def test_classification_rules(spark):
    schema = "id int, n double, s string, d date, mixed {}"
    a = spark.createDataFrame(
        [
            (1, 100.0, "Abc", None, 1),
            (2, 100.0, "abc", None, 1),
            (3, 100.0, "abc", None, 1),
            (4, 0.0, None, None, 1),
            (5, 100.0, "abc\t", None, 1),
        ],
        schema.format("int"),
    )
    b = spark.createDataFrame(
        [
            (1, 150.0, "aBC", None, "1"),
            (2, 102.0, "abd", None, "1"),
            (3, 100.5, "abc ", None, "1"),
            (4, 0.001, "x", None, "1"),
            (5, 100.0, "abc", None, "1"),
        ],
        schema.format("string"),
    )
    cols = ["n", "s", "d"]
    c = compare_by_key(side(a, "id", cols), side(b, "id", cols))
    got = {(r.id, r.column_name): (r.difference_type, r.severity) for r in cl.classify_cells(c, numeric_tolerance=0.01).collect()}
    assert got == {
        (1, "n"): ("value_mismatch", "high"),
        (2, "n"): ("value_mismatch", "medium"),
        (3, "n"): ("value_mismatch", "low"),
        (4, "n"): ("precision_difference", "info"),
        (1, "s"): ("case_difference", "medium"),
        (2, "s"): ("value_mismatch", "medium"),
        (3, "s"): ("whitespace_difference", "low"),
        (4, "s"): ("null_mismatch", "high"),
        (5, "s"): ("whitespace_difference", "low"),
    }
    strict = cl.classify_cells(c, null_is_critical=True, case_sensitive=False)
    levels = {(r.id, r.column_name): r.severity for r in strict.collect()}
    assert levels[(4, "s")] == "critical" and levels[(1, "s")] == "low"
    mixed = compare_by_key(side(a, "id", ["d"]), side(b.withColumn("d", F.lit("2024")), "id", ["d"]))
    assert {r.difference_type for r in cl.classify_cells(mixed).collect()} == {"null_mismatch"}


def test_timeline_totals_and_last_bucket(spark):
    t0 = datetime(2024, 1, 1)
    a = spark.createDataFrame([(i, t0 + timedelta(hours=i), i) for i in range(48)], "id int, ts timestamp_ntz, v int")
    b = a.where("id <> 47").withColumn("v", F.when(F.col("id") < 3, -1).otherwise(F.col("v")))
    c = compare_by_key(side(a, "id"), side(b, "id"))
    buckets = tl.Buckets(t0, t0 + timedelta(hours=47), timedelta(hours=12))
    rows = tl.timeline(c, "ts", buckets).orderBy("bucket").collect()
    assert [r.total_rows for r in rows] == [12, 12, 12, 12]
    assert [r.differences for r in rows] == [3, 0, 0, 1]
    assert rows[3].missing_in_target == 1 and rows[0].match_rate == 0.75


def periods_of(spark, rates, totals=None):
    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(days=i), r, (totals or [10] * len(rates))[i]) for i, r in enumerate(rates)]
    return spark.createDataFrame(rows, "bucket_start timestamp_ntz, match_rate double, total_rows long")


@pytest.mark.parametrize(
    "rates, expected",
    [
        ([1.0] * 6, set()),
        ([0.92] * 3 + [1.0] * 3, {("improving_quality", "medium", 6)}),
        ([1.0] * 3 + [0.95, 0.93, 0.91], {("degrading_quality", "medium", 6)}),
        # The last three average 0.833, the three before 0.667.
        ([1.0, 0.5, 1.0, 0.5, 1.0, 0.5, 1.0], {("periodic_issues", "medium", 2), ("improving_quality", "high", 7)}),
        ([1.0, 1.0], set()),
    ],
)
def test_patterns(spark, rates, expected):
    assert {tuple(r) for r in tl.patterns(periods_of(spark, rates)).collect()} == expected


def test_gap_pattern(spark):
    got = {tuple(r) for r in tl.patterns(periods_of(spark, [1.0, 1.0], [0, 5])).collect()}
    assert got == {("data_gaps", None, 1)}


def test_schema_rows(spark):
    old = T.StructType.fromDDL("id int, price decimal(10,2), note varchar(20), gone int, at timestamp_ntz")
    new = T.StructType.fromDDL("note string, id bigint, price decimal(12,2), fresh int, at timestamp")
    a, b = sc.schema_frame(spark, old), sc.schema_frame(spark, new)
    kinds = {r.column_name: r.difference_type for r in sc.schema_diff(a, b).collect()}
    assert kinds == {"id": "type_changed", "gone": "only_in_source", "fresh": "only_in_target"}
    warned = {(r.column_name, r.attribute) for r in sc.attribute_warnings(a, b).collect()}
    assert ("price", "numeric_precision") in warned and ("price", "numeric_scale") not in warned
    assert tuple(sc.layout_changes(a, b).first()) == (5, 5, 1, 1, 4, 3)


def test_type_names(spark):
    names = ["integer", "NUMERIC(10,2)", "character varying(30)", "int8", "double precision", "jsonb", "weird", "timestamptz"]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    got = {r.t: (r.n, r.p) for r in df.select("t", sc.normalized_type(F.col("t")).alias("n"), sc.normalized_type(F.col("t"), True).alias("p")).collect()}
    assert got["integer"][0] == "INT" and got["NUMERIC(10,2)"][0] == "DECIMAL" and got["character varying(30)"][0] == "STRING"
    assert got["int8"] == ("TINYINT", "BIGINT") and got["double precision"][0] == "DOUBLE" and got["jsonb"][0] == "JSON"
    assert got["weird"][0] == "WEIRD" and got["timestamptz"][0] == "TIMESTAMP_LTZ"


def test_catalog_diff(spark):
    one = T.StructType.fromDDL("id int, v string")
    two = T.StructType.fromDDL("id bigint, v string, w int")
    source = sc.catalog_frame(spark, {"a.orders": one, "a.users": one, "a.old": one})
    target = sc.catalog_frame(spark, {"b.orders": two, "b.users": one, "b.new": one})
    diff = sc.catalog_diff(source, target)
    got = {(r.table_name, r.column_name, r.difference_type) for r in diff.collect()}
    assert got == {
        ("old", None, "table_only_in_source"),
        ("new", None, "table_only_in_target"),
        ("orders", "id", "type_changed"),
        ("orders", "w", "only_in_target"),
    }
    s = sc.catalog_summary(diff).first()
    assert (s.table_differences, s.column_differences, s.type_differences, s.total_differences, s.schemas_identical) == (2, 1, 1, 4, False)


def test_unsupported_and_zone_warnings(spark):
    df = spark.sql("SELECT 1 AS id, map('a', 1) AS m, timestamp '2024-01-01' AS t")
    a, b = side(df, "id"), side(df.withColumn("t", F.col("t").cast("timestamp_ntz")), "id")
    assert {(r.side, r.column_name) for r in sc.unsupported_types(spark, a, b).collect()} == {("A", "m"), ("B", "m")}
    with pytest.raises(sc.UnsupportedTypeError):
        sc.unsupported_types(spark, a, b, strict=True)
    assert [r.column_name for r in sc.zone_warnings(spark, a, b).collect()] == ["t"]


def test_text_kinds_by_sample(spark):
    rows = [("00000000-0000-0000-0000-00000000000a", "Az_9 -", "é", "x")] * 3
    df = spark.createDataFrame(rows, "u string, k string, t string, m string")
    got = {r.column_name: (r.kind, r.all_lowercase, r.all_uppercase) for r in sc.text_kinds(df).collect()}
    assert got["u"] == ("uuid", True, False) and got["k"][0] == "alphanumeric" and got["t"][0] == "text"
    mixed = df.union(spark.createDataFrame([("no", "a", "b", "c")], df.schema))
    assert sc.text_kinds(mixed, ["u"]).first().kind == "mixed_uuid"


def test_release_columns(spark):
    prod = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 3)], "id int, v string, q int")
    dev = spark.createDataFrame([(1, "a", "1", True), (3, "c", "3", True)], "id int, v string, q string, extra boolean")
    r = release_diff(prod, dev, ["id"])
    assert {x.column_name: x.difference_type for x in r.columns.collect()} == {"q": "type_changed", "extra": "only_in_target"}
    assert tuple(r.summary().first()) == (2, 2, 1, 1, 0, 1)
    assert [x.column_name for x in r.values_changed().collect()] == ["v"]


def test_timeline_names_a_missing_time_column(spark):
    s = side(spark.createDataFrame([(1, 2)], "k int, v int"), "k")
    with pytest.raises(ValueError, match="time column 'at'"):
        tl.timeline(compare_by_key(s, s), "at", None)

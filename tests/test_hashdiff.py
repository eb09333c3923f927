"""Row sets, checksums, segments."""

import random
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recon import CompareRules, bisect_report, hash_diff, join_diff, rowset_diff, side
from recon.functions.checksum import checksum_sum, low48
from recon.operators.hashdiff import common_scales, ordered_diff, rowset_stats, tables_equal, unequal_parts
from recon.operators.relational import explain_frame
from recon.operators.segments import EmptyTableError, key_bounds, make_segmenter, table_checksum


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_duplicates_report_every_row(spark):
    a = side(spark.createDataFrame([(12, "ABCDE")] * 2, "id int, data string"), "id")
    b = side(
        spark.createDataFrame([(4, "ABCDEF"), (4, "ABCDE"), (4, "ABCDE")] + [(6, "ABCDE")] * 3, "id int, data string"), "id"
    )
    expected = sorted(
        [("-", "12", "ABCDE")] * 2 + [("+", "4", "ABCDEF")] + [("+", "4", "ABCDE")] * 2 + [("+", "6", "ABCDE")] * 3
    )
    assert rows_of(rowset_diff(a, b)) == expected
    assert rows_of(rowset_diff(a, b)) == expected
    assert rows_of(hash_diff(a, b, factor=2, threshold=4)) == expected


def test_equal_duplicates_are_still_reported(spark):
    a = side(spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "id int, v string"), "id")
    assert rows_of(rowset_diff(a, a)) == [("+", "1", "x")] * 2 + [("-", "1", "x")] * 2
    s = rowset_stats(a, a).first()
    assert (s.rows_A, s.exclusive_A, s.updated, s.unchanged, s.duplicated) == (3, 0, 0, 1, 1)


def test_null_does_not_hide_a_shift(spark):
    a = side(spark.createDataFrame([(1, None, "x")], "id int, p string, q string"), "id")
    b = side(spark.createDataFrame([(1, "x", None)], "id int, p string, q string"), "id")
    assert len(rows_of(rowset_diff(a, b))) == 2


def test_null_concat(spark):
    ids = [str(uuid.UUID(int=i)) for i in range(8)]
    a = side(spark.createDataFrame([(i, f"a{n}", None) for n, i in enumerate(ids)], "id string, c1 string, c2 string"), "id")
    b = side(spark.createDataFrame([(i, f"b{n}", None) for n, i in enumerate(ids)], "id string, c1 string, c2 string"), "id")
    assert hash_diff(a, b).count() == 16


def test_null_cell_is_kept(spark):
    a = side(spark.createDataFrame([("k1", "x"), ("k2", None)], "id string, v string"), "id")
    b = side(spark.createDataFrame([("k1", "x")], "id string, v string"), "id")
    assert rows_of(hash_diff(a, b)) == [("-", "k2", None)]


def test_alphanumeric_key_order(spark):
    keys = ["a_", "a123", "a-", "a", "_", "ZZ", "Z9", "0123", "---"]
    df = spark.createDataFrame([(k,) for k in keys], "id string")
    assert [r.id for r in df.orderBy("id").collect()] == ["---", "0123", "Z9", "ZZ", "_", "a", "a-", "a123", "a_"]
    extra = side(df, "id", [])
    assert rows_of(hash_diff(side(df.where("id <> 'a-'"), "id", []), extra)) == [("+", "a-")]


def test_compound_and_negative_keys(spark):
    rows = [(i, -i) for i in range(-500, 500)]
    a = side(spark.createDataFrame(rows + [(9, 9000)], "id int, id2 int"), ("id", "id2"), [])
    b = side(spark.createDataFrame(rows + [(-7, 12345)], "id int, id2 int"), ("id", "id2"), [])
    expected = [("+", "-7", "12345"), ("-", "9", "9000")]
    assert rows_of(hash_diff(a, b)) == expected
    assert rows_of(rowset_diff(a, b)) == expected


def test_uuid_and_int_key(spark):
    rows = [(str(uuid.UUID(int=i * 7919)), i, "c") for i in range(100)]
    changed = [(u, 9000 if i == 9 else i, c) for u, i, c in rows]
    schema = "id string, id2 int, comment string"
    a = side(spark.createDataFrame(rows, schema), ("id", "id2"))
    b = side(spark.createDataFrame(changed, schema), ("id", "id2"))
    assert [(s, k2) for s, _, k2, _ in rows_of(hash_diff(a, b))] == [("+", "9000"), ("-", "9")]


def test_report_counts(spark):
    a, b = side(spark.range(1000), "id", []), side(spark.range(2000), "id", [])
    assert hash_diff(a, b).count() == 1000
    report = bisect_report(a, b, factor=4, threshold=50, levels=3)
    top = report.where("level = 1").agg(F.sum("rows_a"), F.sum("rows_b")).first()
    assert tuple(top) == (1000, 2000)
    assert report.where("level = 3").count() > 0
    assert report.where("level = 1 AND NOT is_diff").count() > 0
    last = report.where("level = 1").orderBy(F.col("hi").desc()).first()
    assert last.hi == 2000


def test_known_checksum(spark):
    df = spark.createDataFrame([(1, datetime(2022, 1, 1))], "id int, timestamp timestamp_ntz")
    row = table_checksum(side(df, "id")).first()
    assert (row.n_rows, int(row.checksum)) == (1, 139356036957641)
    none = table_checksum(side(df.where("id > 5"), "id")).first()
    assert (none.n_rows, none.checksum) == (0, None)


def test_checksum_sum_is_exact_for_many_copies(spark):
    df = spark.range(0, 300_000, 1, 8).select(F.lit((1 << 48) - 1).alias("n"))
    total = df.agg(checksum_sum(F.col("n")).alias("c")).first().c
    assert int(total) == 300_000 * ((1 << 48) - 1 - ((1 << 48) - 1) // 2)
    one = spark.range(1).select(low48(F.lit("1|2022-01-01 00:00:00.000000")).alias("n")).first().n
    assert one - ((1 << 48) - 1) // 2 == 139356036957641


def test_equal_tables_leave_no_segments(spark):
    df = spark.range(5000).withColumn("v", F.col("id") * 3)
    a = side(df, "id")
    left, right = unequal_parts(a, a, rules=CompareRules())
    assert left.rows().count() == 0 and right.rows().count() == 0
    assert tables_equal(a, a).first().is_equal


def test_scattered_and_neighbouring_segments(spark):
    rows = spark.range(20_000).select(F.expr("nullif(id, 777)").alias("id"), (F.col("id") % 7).alias("v"))
    a = side(rows, "id")
    few = side(rows.withColumn("v", F.when(F.col("id").between(5000, 5005), -1).otherwise(F.col("v"))), "id")
    many = side(rows.withColumn("v", F.when(F.col("id") % 150 == 3, -1).otherwise(F.col("v"))), "id")
    none = side(rows.where("id IS NOT NULL"), "id")
    for b, n, kept in ((few, 12, 200), (many, 268, 6000), (none, 1, 100)):
        left, right = unequal_parts(a, b, rules=CompareRules(), factor=16, threshold=64)
        assert left.rows().count() <= kept
        assert rowset_diff(left, right).count() == n
        assert hash_diff(a, b, factor=16, threshold=64).count() == n
    texts = [side(s.df.withColumn("id", F.concat(F.lit("k"), "id")).na.drop(), "id") for s in (a, many)]
    assert hash_diff(*texts, factor=16, threshold=64).count() == 268


def test_ranges_reach_the_scan(spark, tmp_path):
    rows = spark.range(20_000).withColumn("v", F.col("id") % 7)
    rows.write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    changed = t.withColumn("v", F.when(F.col("id") == 5000, -1).otherwise(F.col("v")))
    left, _ = unequal_parts(side(t, "id"), side(changed, "id"), rules=CompareRules(), factor=16, threshold=64)
    plan = "\n".join(r.plan for r in explain_frame(left.rows()).collect())
    assert "PushedFilters" in plan and "GreaterThanOrEqual(id," in plan and "LessThan(id," in plan


def test_empty_sides(spark):
    a = side(spark.range(5), "id", [])
    none = side(spark.range(0), "id", [])
    assert hash_diff(none, none).count() == 0
    assert hash_diff(a, none).count() == 5
    with pytest.raises(EmptyTableError):
        key_bounds(none)
    assert make_segmenter(none, none, 8) is None


def test_bad_factors(spark):
    a = side(spark.range(5), "id", [])
    for factor, threshold in ((1, 10), (10, 10)):
        with pytest.raises(ValueError):
            hash_diff(a, a, factor=factor, threshold=threshold)


def test_common_scale_makes_copies_equal(spark):
    values = [0.0, 0.1, 0.5, 12.25, 1 / 3, 1 / 109489, 3.141592653589793]
    a = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    b = a.withColumn("v", F.col("v").cast("float"))
    sa, _ = common_scales(side(a, "id"), side(b, "id"))
    assert sa == {"v": 5}
    assert rows_of(hash_diff(side(a, "id"), side(b, "id"))) == []
    with pytest.raises(TypeError):
        hash_diff(side(a, "id"), side(a.withColumn("v", F.lit("x")), "id"))


def test_ignored_column_stays_in_output(spark):
    a = side(spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "id int, p string, q int"), "id")
    b = side(spark.createDataFrame([(1, "x", 9), (2, "z", 9)], "id int, p string, q int"), "id")
    rules = CompareRules(ignored_columns=frozenset({"q"}))
    expected = [("+", "2", "z", "9"), ("-", "2", "y", "2")]
    assert rows_of(rowset_diff(a, b, rules=rules)) == expected
    assert rows_of(hash_diff(a, b, rules=rules)) == expected
    assert rows_of(join_diff(a, b, rules=rules).signed_rows()) == expected


def test_tolerance_needs_a_join(spark):
    a = side(spark.createDataFrame([(1, 1.0)], "id int, v double"), "id")
    with pytest.raises(ValueError):
        rowset_diff(a, a, rules=CompareRules(float_tolerance=0.1))


def test_first_differences_in_order(spark):
    a, b = side(spark.range(10), "id", []), side(spark.range(5, 12), "id", [])
    d = rowset_diff(a, b, as_text=False)
    assert [(r.id, r.sign) for r in ordered_diff(d, ["id"], 3).collect()] == [(0, "-"), (1, "-"), (2, "-")]


@pytest.mark.parametrize("seed", range(3))
def test_algorithms_agree_with_brute_force(spark, seed):
    rng = random.Random(seed)
    schema = "k1 int, k2 string, v int, w string"

    def make():
        return {(rng.randrange(60), rng.choice("abc")): (rng.choice([None, 1, 2]), rng.choice([None, "x", "y"])) for _ in range(90)}

    left = make()
    right = {k: (v if rng.random() < 0.8 else (rng.choice([None, 1, 2]), "z")) for k, v in left.items() if rng.random() < 0.9}
    right |= {k: v for k, v in make().items() if k not in left and rng.random() < 0.3}
    expected = []
    for k in set(left) | set(right):
        if left.get(k) != right.get(k):
            expected += [("-", k, left[k])] if k in left else []
            expected += [("+", k, right[k])] if k in right else []
    expected = {(s, str(k[0]), k[1], None if v[0] is None else str(v[0]), v[1]) for s, k, v in expected}
    a, b = (
        side(spark.createDataFrame([(*k, *v) for k, v in d.items()], schema), ("k1", "k2")) for d in (left, right)
    )
    for found in (join_diff(a, b).signed_rows(), rowset_diff(a, b), hash_diff(a, b, factor=4, threshold=8)):
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    s = join_diff(a, b).stats().first()
    assert s.rows_A == s.unchanged + s.exclusive_A + s.updated
    assert s.rows_B == s.unchanged + s.exclusive_B + s.updated


@pytest.mark.parametrize("seed", range(2))
def test_row_sets_with_duplicates_against_brute_force(spark, seed):
    rng = random.Random(100 + seed)
    make = lambda: [(rng.choice([None, *range(12)]), rng.choice(["x", "y", None])) for _ in range(25)]
    left, right = make(), make()
    expected = []
    for k in {r[0] for r in left + right}:
        la, rb = [r for r in left if r[0] == k], [r for r in right if r[0] == k]
        if len(la) != 1 or len(rb) != 1 or la != rb:
            expected += [("-", *r) for r in la] + [("+", *r) for r in rb]
    a, b = (side(spark.createDataFrame(rows, "k int, v string"), "k") for rows in (left, right))
    order = lambda rows: sorted(rows, key=repr)
    assert order(tuple(r) for r in rowset_diff(a, b, as_text=False).collect()) == order(expected)

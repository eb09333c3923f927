"""Key ranges of about equal rows."""

import bisect
import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recon.functions.predicates import CompareRules
from recon.operators.hashdiff import hash_diff, rowset_diff, unequal_parts
from recon.operators.splitters import cut_points, rows_segmenter, split_predicates
from recon.plans.compare import Options, compare
from recon.sources.side import side, with_key_forms


def test_cut_points_split_rows_evenly():
    assert cut_points([((i,), 1) for i in range(100)], 4) == [(25,), (50,), (75,)]
    assert cut_points([((1,), 1), ((2,), 97), ((3,), 1), ((4,), 1)], 10) == [(2,)]
    assert cut_points([], 4) == [] and cut_points([((1,), 5)], 1) == []


def test_skewed_keys_give_even_segments(spark):
    # 90 % of the rows in 1 % of the key range
    n = 40_000
    key = F.when(F.col("id") % 10 < 9, F.col("id") % 10_000).otherwise(F.col("id") * 25)
    s = side(spark.range(n).select(key.alias("k"), "id"), ["k", "id"])
    one = side(s.df.select("k"), "k", [])
    for which in (s, one):
        seg = rows_segmenter(which, which, 32)
        sizes = [r["count"] for r in which.rows().groupBy(seg.of(which)).count().collect()]
        assert 28 <= len(sizes) <= 32 and max(sizes) < 2 * n / 32


KEYS = {
    "text": lambda r, i: (f"name-{r.choice('aZ_0 é')}{i}",),
    "time": lambda r, i: (datetime(2020, 1, 1) + timedelta(microseconds=r.randrange(10**12)),),
    "uuid": lambda r, i: (r.choice([str, str.upper, "  {}  ".format])(str(uuid.UUID(int=r.getrandbits(128)))),),
    "pair": lambda r, i: (r.randrange(5), f"{i}"),
}
TYPES = {"text": "k string", "time": "k timestamp_ntz", "uuid": "k string", "pair": "k int, l string"}


@pytest.mark.parametrize("kind", sorted(KEYS))
def test_segments_are_ranges_in_key_order(spark, tmp_path, kind):
    rng = random.Random(kind)
    rows = sorted({KEYS[kind](rng, i) for i in range(400)}, key=repr)
    path = str(tmp_path / "t")
    spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], TYPES[kind] + ", v int").write.parquet(path)
    names = ("k", "l") if kind == "pair" else ("k",)
    forms = {"text_forms": (("k", "uuid"),)} if kind == "uuid" else {}
    s, _ = with_key_forms(*(side(spark.read.parquet(path), names, ["v"], **forms),) * 2)
    seg = rows_segmenter(s, s, 8)
    assert seg.size == 8
    plain = lambda t: tuple(x.strip().lower() if kind == "uuid" else x for x in t)
    want = {i: bisect.bisect_right(seg.cuts, plain(r)) for i, r in enumerate(rows)}
    assert {r.v: r.n for r in s.df.select("v", seg.of(s).alias("n")).collect()} == want
    for numbers in ([0], [3], [7], [2, 3, 6]):
        part = seg.restrict(s, numbers)
        assert {r.v for r in part.select("v").collect()} == {i for i, n in want.items() if n in numbers}
        plan = part.select("v")._jdf.queryExecution().toString()
        pushed = plan[plan.rindex("PushedFilters") :].split("]")[0]
        assert "GreaterThanOrEqual(k" in pushed or "LessThan(k" in pushed or "GreaterThan(k" in pushed


def test_null_keys_are_in_the_first_segment(spark):
    rows = [(i, i % 7, i) for i in range(200)] + [(None, 1, 900), (3, None, 901)]
    s = side(spark.createDataFrame(rows, "a int, b int, v int"), ("a", "b"))
    seg = rows_segmenter(s, s, 4)
    assert {r.v for r in seg.restrict(s, [0]).collect()} >= {900, 901}
    parts = [seg.restrict(s, [i]).count() for i in range(seg.size)]
    assert sum(parts) == len(rows)
    none = side(s.df.where("v < 0"), ("a", "b"))
    assert rows_segmenter(none, none, 4) is None


def test_compound_and_text_keys_are_compared_by_parts(spark):
    t = spark.range(5000).select(
        (F.col("id") % 13).alias("a"), F.concat(F.lit("customer number "), F.col("id")).alias("b"), (F.col("id") * 3).alias("v")
    )
    changed = t.withColumn("v", F.when(F.col("b").isin("customer number 77", "customer number 4100"), -1).otherwise(F.col("v")))
    for keys in (("a", "b"), ("b",), ("b", "a")):
        a, b = side(t, keys), side(changed, keys)
        left, right = unequal_parts(a, b, rules=CompareRules(), factor=8, threshold=20)
        assert left.df.count() < 200 and right.df.count() < 200
        got = sorted(map(tuple, hash_diff(a, b, factor=8, threshold=20).collect()))
        assert got == sorted(map(tuple, rowset_diff(a, b).collect())) and len(got) == 4


def test_split_predicates_cover_each_row_once(spark):
    rows = [(f"it's {i % 90}",) for i in range(500)] + [(None,)]
    df = spark.createDataFrame(rows, "k string")
    parts = split_predicates(side(df, "k", []), 6)
    assert len(parts) == 6 and sum(df.where(p).count() for p in parts) == 501
    assert split_predicates(side(df.limit(0), "k", []), 6) == ["1 = 1"]


def test_lowered_precision_is_a_warning(spark):
    a = side(spark.createDataFrame([(1, 1, 1.0)], "k int, v int, w double"), "k")
    b = side(spark.sql("SELECT 1 AS k, CAST(1.4 AS DECIMAL(12,2)) AS v, CAST(1.0 AS DECIMAL(12,2)) AS w"), "k")
    result = compare(a, b, Options(algorithm="join", assume_unique_key=True))
    assert [r.sign for r in result.diff.collect()] == ["-", "+"]
    found = [tuple(r)[1] for r in result.warnings.collect()]
    assert found == ["w"]

"""Exact order statistics and distinct counts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from recon.operators import profile as pf


def test_codes_order_as_doubles_do(spark):
    rng = random.Random(0)
    values = [0.0, -0.0, 1.0, 5e-324, 2.2e-308, 1.7976931348623157e308, float("inf"), 2.0**52, 2.0**53 + 2, 0.1, 3.0]
    values += [math.ldexp(1 + d * 2.0**-52, e) for e in (-1022, -3, 0, 1, 49, 512, 1023) for d in (0, 1, 2**51, 2**52 - 1)]
    values += [rng.uniform(-1, 1) * 10 ** rng.randrange(-300, 300) for _ in range(500)]
    values = sorted(set(values) | {-v for v in values})
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    codes = [r.c for r in df.withColumn("c", pf.ordered_code(F.col("v"))).orderBy("i").collect()]
    assert codes == sorted(codes) and max(map(abs, codes)) < 2**62
    assert max(codes.count(c) for c in set(codes)) <= 8


def expected(values, p):
    x = sorted(v for v in values if v is not None and not math.isnan(v))
    at = p * (len(x) - 1)
    low, high = x[math.floor(at)], x[math.ceil(at)]
    return low if low == high else low + (high - low) * (at - math.floor(at))


COLUMNS = {
    "one value almost everywhere": [7.25] * 990 + [1e9, -1e-9, None, float("nan")] + [3.0] * 6,
    "neighbouring doubles": [math.ldexp(1 + d * 2.0**-52, 3) for d in range(40)],
    "wide": [(-1) ** i * 10.0 ** (i % 600 - 300) for i in range(900)],
    "whole": [i * i % 1009 for i in range(1000)],
    "single": [4.0],
    "infinite": [float("-inf"), float("inf"), 0.0, -0.0, 1.0],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_percentiles_match_sorting(spark, name):
    values = [None if v is None else float(v) for v in COLUMNS[name]]
    df = spark.createDataFrame([(v, None) for v in values], "v double, none double").repartition(7)
    ps = (0.0, 0.5, 1.0) if name == "infinite" else (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    got = {r.p: r.value for r in pf.exact_percentiles(df, ["v", "none"], ps).collect()}
    assert got == {p: expected(values, p) for p in ps}


def test_distinct_counts_without_expanding(spark):
    rows = [(i % 7, float(i % 5), f"x{i % 3}" if i % 4 else None, i % 2 == 0, [i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b double, c string, d boolean, e array<int>")
    df = df.withColumn("t", F.timestamp_seconds("a")).withColumn("n", F.lit(None).cast("string")).withColumn("m", F.col("a").cast("decimal(30,2)"))
    profile = pf.column_profile(df)
    got = {r.column_name: r.unique_count for r in profile.collect()}
    assert got == {"a": 7, "b": 5, "c": 3, "d": 2, "e": 2, "t": 7, "n": 0, "m": 7}
    assert "Expand" not in profile._jdf.queryExecution().toString()
    assert {r.column_name: r.unique_count for r in pf.column_profile(df.limit(0)).collect()} == dict.fromkeys(df.columns, 0)

"""Rows of repeated keys in pairs."""

import random
from collections import Counter

import pytest

from recon.functions.predicates import CompareRules
from recon.operators.alignment import align_rows
from recon.plans.compare import Options, compare
from recon.sources.side import side


def brute(left, right):
    order = lambda r: tuple((v is not None, v) for v in r[1:])
    ca, cb = Counter(left), Counter(right)
    spare_a, spare_b = sorted((ca - cb).elements(), key=order), sorted((cb - ca).elements(), key=order)
    out = []
    for k in {r[0] for r in spare_a + spare_b}:
        xs, ys = [r for r in spare_a if r[0] == k], [r for r in spare_b if r[0] == k]
        out += [(x, y) for x, y in zip(xs, ys)] + [(x, None) for x in xs[len(ys) :]] + [(None, y) for y in ys[len(xs) :]]
    return Counter(out)


def got(c):
    out = []
    for r in c.matched.collect():
        a = tuple(r[f"a{i}"] for i in range(len(c.pairs))) if r.in_a else None
        b = tuple(r[f"b{i}"] for i in range(len(c.pairs))) if r.in_b else None
        out.append((a, b))
    return Counter(out)


@pytest.mark.parametrize("seed", range(4))
def test_pairs_match_brute_force(spark, seed):
    rng = random.Random(seed)
    row = lambda: (rng.choice([None, 1, 2, 3, 3, 3, 3]), rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"]))
    left, right = [row() for _ in range(120)], [row() for _ in range(130)]
    a, b = (side(spark.createDataFrame(rows, "k int, v int, t string"), "k") for rows in (left, right))
    assert got(align_rows(a, b)) == brute(left, right)
    assert got(align_rows(b, a)) == brute(right, left)
    assert align_rows(a, a).matched.count() == 0


def test_a_key_with_half_of_all_rows(spark):
    t = spark.range(200_000).selectExpr("if(id % 2 = 0, -1, id) AS k", "id % 10 AS v", "'same' AS t")
    changed = t.selectExpr("k", "if(k = -1 AND v = 4, 40, v) AS v", "t")
    c = align_rows(side(t, "k"), side(changed, "k"))
    assert c.matched.count() == 20_000
    assert {(r.column_name, r.source_value, r.target_value) for r in c.cells().distinct().collect()} == {("v", "4", "40")}


def test_rules_ignored_columns_and_no_values(spark):
    a = side(spark.createDataFrame([(1, "a", 1), (1, "B", 2), (2, "c", 3)], "k int, t string, n int"), "k")
    b = side(spark.createDataFrame([(1, "A", 9), (1, "b", 9), (2, "d", 3)], "k int, t string, n int"), "k")
    c = align_rows(a, b, rules=CompareRules(ignore_case=True, ignored_columns=frozenset({"n"})))
    assert [(r.a1, r.b1) for r in c.matched.collect()] == [("c", "d")]
    bare = [side(spark.createDataFrame([(k,) for k in ks], "k int"), "k") for ks in ([1, 1, 2], [1, 3])]
    assert got(align_rows(*bare)) == Counter({((1,), None): 1, ((2,), None): 1, (None, (3,)): 1})
    with pytest.raises(ValueError, match="tolerance"):
        align_rows(*(side(s.df.selectExpr("k", "1.0D AS x"), "k") for s in bare), rules=CompareRules(float_tolerance=0.1))


def test_comparison_of_repeated_keys_has_every_result(spark, tmp_path):
    a = side(spark.createDataFrame([(1, "x", 10), (1, "y", 20), (2, "z", 30)], "k int, t string, n int"), "k", name="a")
    b = side(spark.createDataFrame([(1, "x", 10), (1, "Y", 20), (3, "z", 30)], "k int, t string, n int"), "k", name="b")
    result = compare(a, b, Options(algorithm="rows"))
    assert [tuple(r) for r in result.cells.collect()] == [(1, "t", "y", "Y")]
    assert [(r.k, r.difference_type) for r in result.classification.collect()] == [(1, "case_difference")]
    assert {r.column_name for r in result.column_counts.collect()} >= {"t", "n"}
    details = result.save(str(tmp_path / "s"), "r").read("difference_details").collect()
    assert sorted((r.difference_type, r.column_name or "") for r in details) == [
        ("missing_in_source", ""), ("missing_in_target", ""), ("value_different", "t"),
    ]

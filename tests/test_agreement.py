"""All three algorithms call the same rows equal, whatever the rules and types."""

from datetime import date, datetime

import pytest

from recon.functions.predicates import CompareRules
from recon.operators.hashdiff import hash_diff, rowset_diff
from recon.operators.joindiff import join_diff
from recon.sources.side import side

DOC = frozenset({"doc"})
NAN, INF = float("nan"), float("inf")


def answers(spark, left, right, schema_a, schema_b, rules=None, **options):
    a = side(spark.createDataFrame(left, schema_a), "k", **options)
    b = side(spark.createDataFrame(right, schema_b), "k", **options)
    joined = join_diff(a, b, rules=rules).signed_rows().select("sign", "k")
    hashed = hash_diff(a, b, rules=rules, factor=2, threshold=3).select("sign", "k")
    rows = rowset_diff(a, b, rules=rules).select("sign", "k")
    out = [sorted(tuple(r) for r in df.collect()) for df in (joined, hashed, rows)]
    assert out[0] == out[1] == out[2]
    return {k for _, k in out[0]}


@pytest.mark.parametrize(
    "mode,different",
    [("exact", {"1", "2", "3"}), ("normalized", {"2", "3"}), ("semantic", {"2", "3"}), ("keys_only", {"3"})],
)
def test_json_modes(spark, mode, different):
    left = [(0, '{"a":1}'), (1, '{"a": 1, "b": 2}'), (2, '{"a":1}'), (3, '{"a":1}'), (4, None)]
    right = [(0, '{"a":1}'), (1, '{"b":2,"a":1}'), (2, '{"a":2}'), (3, '{"c":1}'), (4, None)]
    rules = CompareRules(json_mode=mode, json_columns=DOC)
    schema = "k int, doc string"
    assert answers(spark, left, right, schema, schema, rules) == different


@pytest.mark.parametrize(
    "rules,different",
    [
        (CompareRules(), {"1", "2", "3"}),
        (CompareRules(ignore_case=True), {"2", "3"}),
        (CompareRules(ignore_blanks=True), {"1", "3"}),
        (CompareRules(ignore_case=True, ignore_blanks=True), {"3"}),
        (CompareRules(ignored_columns=frozenset({"v"})), set()),
    ],
)
def test_text_rules(spark, rules, different):
    left, right = [(0, "a"), (1, "b"), (2, "c"), (3, None)], [(0, "a"), (1, "B"), (2, " c "), (3, "")]
    assert answers(spark, left, right, "k int, v string", "k int, v string", rules) == different


T0 = datetime(2024, 5, 6, 7, 8, 9, 400_000)


@pytest.mark.parametrize(
    "rules,different",
    [
        (CompareRules(), {"1", "2"}),
        (CompareRules(timestamp_precision="second"), {"2"}),
        (CompareRules(timestamp_precision="day"), set()),
        (CompareRules(timestamp_digits=1), {"2"}),
        (CompareRules(timestamp_digits=0, timestamp_rounds=True), {"2"}),
    ],
)
@pytest.mark.parametrize("kinds", [("timestamp", "timestamp"), ("timestamp_ntz", "timestamp"), ("timestamp", "timestamp_ntz")])
def test_times(spark, rules, different, kinds):
    left = [(0, T0), (1, T0), (2, T0), (3, None)]
    right = [(0, T0), (1, T0.replace(microsecond=400_900)), (2, T0.replace(second=40)), (3, None)]
    assert answers(spark, left, right, f"k int, v {kinds[0]}", f"k int, v {kinds[1]}", rules) == different


def test_date_against_midnight(spark):
    left = [(0, date(2024, 1, 2)), (1, date(2024, 1, 2))]
    right = [(0, datetime(2024, 1, 2)), (1, datetime(2024, 1, 2, 1))]
    for kind in ("timestamp", "timestamp_ntz"):
        assert answers(spark, left, right, "k int, v date", f"k int, v {kind}") == {"1"}


def test_numbers_of_unlike_types(spark):
    from decimal import Decimal as D

    left = [(k, D("1.00")) for k in range(6)]
    right = [(0, D("1.000")), (1, D("1.001")), (2, D("1.004")), (3, D("1.006")), (4, D("2.000")), (5, None)]
    assert answers(spark, left, right, "k int, v decimal(12,2)", "k bigint, v decimal(14,3)") == {"3", "4", "5"}
    assert answers(spark, [(0, 1), (1, 2)], [(0, 1), (1, 3)], "k int, v int", "k int, v bigint") == {"1"}


def test_specials_are_equal_to_themselves(spark):
    left = [(0, NAN), (1, INF), (2, -INF), (3, NAN), (4, 1.0), (5, None), (6, 0.0)]
    right = [(0, NAN), (1, INF), (2, INF), (3, 1.0), (4, 1.0), (5, None), (6, -0.0)]
    schema = "k int, v double"
    assert answers(spark, left, right, schema, schema) == {"2", "3"}
    a, b = (side(spark.createDataFrame(rows, schema), "k") for rows in (left, right))
    near = join_diff(a, b, rules=CompareRules(float_tolerance=0.5)).signed_rows()
    assert {r.k for r in near.collect()} == {"2", "3"}


def test_uuid_forms_for_keys_and_values(spark):
    one, two = "11111111-2222-3333-4444-55555555aaaa", "11111111-2222-3333-4444-55555555bbbb"
    left, right = [(one, one), (two, one)], [(one.upper(), one.upper()), (two.upper(), two)]
    forms = (("k", "uuid"), ("v", "uuid"))
    assert answers(spark, left, right, "k string, v string", "k string, v string", text_forms=forms) == {two}


def test_a_tolerance_is_refused_before_any_scan(spark):
    a = side(spark.createDataFrame([(1, 1.0)], "k int, v double"), "k")
    rules = CompareRules(float_tolerance=0.1)
    for algorithm in (hash_diff, rowset_diff):
        with pytest.raises(ValueError, match="tolerance"):
            algorithm(a, a, rules=rules)


def test_keys_of_any_width(spark):
    from decimal import Decimal as D

    keys = [-9 * 10**18, -1, 0, 5, 9 * 10**18]
    left, right = [(k, 1) for k in keys], [(k, 1 if k != 5 else 2) for k in keys[1:]]
    assert answers(spark, left, right, "k bigint, v int", "k bigint, v int") == {str(keys[0]), "5"}
    big = [D(k) * 10**15 for k in keys]
    left, right = [(k, 1) for k in big], [(k, 1 if k != big[3] else 2) for k in big[1:]]
    schema = "k decimal(38,0), v int"
    assert answers(spark, left, right, schema, schema) == {f"{big[0]:f}", f"{big[3]:f}"}

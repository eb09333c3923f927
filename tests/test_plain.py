"""Rules that need no data: ages, names, split points, sample sizes, bucket widths."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import types as T

from recon.functions.age import age_bounds, parse_age
from recon.functions.names import Remapping, expand_columns, include_exclude, like
from recon.functions.normalize import common_scale, default_scale
from recon.functions.predicates import tolerance_digits
from recon.operators.sampling import SamplePlan, modulus, sample_size, z_score
from recon.operators.schema import column_kind, table_key
from recon.operators.segments import Axis, Segmenter, checkpoints, space_size
from recon.operators.timeline import Buckets, bucket_width, label_layout


@pytest.mark.parametrize(
    "text, span",
    [
        ("1min", timedelta(minutes=1)),
        ("1min1s", timedelta(minutes=1, seconds=1)),
        ("1h30min", timedelta(hours=1, minutes=30)),
        ("2mon", timedelta(days=60)),
        ("1y", timedelta(days=365)),
        ("3weeks", timedelta(weeks=3)),
    ],
)
def test_age(text, span):
    assert parse_age(text) == span


@pytest.mark.parametrize("text", ["", "5", "min", "1min1", "1min 1s", "1foo", "1min2min", "1d1mon"])
def test_bad_age(text):
    with pytest.raises(ValueError):
        parse_age(text)


def test_age_bounds():
    now = datetime(2024, 1, 31)
    assert age_bounds(now, min_age="1h", max_age="2d") == (datetime(2024, 1, 29), datetime(2024, 1, 30, 23))


def test_like():
    names = ["id", "created_at", "updated_at", "name"]
    assert like("%_at", names) == ["created_at", "updated_at"]
    assert like("n?me", names) == ["name"]
    assert like("i", names) == []


def test_expand_columns():
    left, right = ["id", "a1", "a2", "ts", "only"], ["id", "a1", "a2", "ts"]
    assert expand_columns(["a%"], left, right, keys=["id"], update="ts") == ["a1", "a2"]
    assert expand_columns(["%"], left, right, keys=["id"], update="ts") == ["a1", "a2"]
    with pytest.raises(ValueError):
        expand_columns(["only"], left, right)


def test_include_exclude():
    assert include_exclude(["A", "b", "c"], include=["a", "B"], exclude=["B"]) == ["A"]
    assert include_exclude(["a", "b"], retyped=["b"]) == ["a"]


def test_remapping():
    r = Remapping.parse("user_id:customer_id, x:y")
    assert r.pairs(["user_id", "x", "same"], ["customer_id", "same", "y"]) == [
        ("user_id", "customer_id"),
        ("x", "y"),
        ("same", "same"),
    ]
    assert r.warnings(["user_id"], ["y"]) == [
        "mapping user_id:customer_id is not used: side B has no column customer_id",
        "mapping x:y is not used: side A has no column x",
    ]
    loose = Remapping({"User_ID": "cust"}, case_sensitive=False)
    assert loose.pairs(["user_id", "Name"], ["CUST", "name"]) == [("user_id", "CUST"), ("Name", "name")]
    assert Remapping({"a": "b"}).pairs(["a", "b"], ["b"]) == [("a", "b")]
    with pytest.raises(ValueError):
        Remapping.parse("nocolon")


def test_scales():
    assert default_scale(T.DoubleType()) == 13
    assert default_scale(T.DecimalType(10, 3)) == 3
    assert common_scale(T.DecimalType(10, 2), T.DoubleType()) == 2
    assert common_scale(T.LongType(), T.StringType()) is None
    assert tolerance_digits(0.01) == 3 and tolerance_digits(1.0) == 1
    with pytest.raises(ValueError):
        tolerance_digits(0)


def test_checkpoints():
    assert checkpoints(0, 100, 4) == [20, 40, 60, 80]
    assert checkpoints(0, 10, 1) == [5]
    assert all(0 < p < 1000 for p in checkpoints(0, 1000, 31)) and len(checkpoints(0, 1000, 31)) == 31
    assert checkpoints(0, 3, 10) == [2]
    assert space_size([(0, 10), (5, 7)]) == 20


def test_mesh_boxes_tile_the_space():
    s = Segmenter((Axis.even(0, 10, 2), Axis.even(0, 30, 3)))
    assert s.size == 6
    assert s.box(0) == [(None, 5), (None, 10)]
    assert s.box(4) == [(5, None), (10, 20)]
    assert s.box(5) == [(5, None), (20, None)]
    assert s.finer(2) is None


def test_axis_follows_the_checkpoints():
    for start, end, cells in ((0, 1000, 32), (-50, 77, 8), (0, 3, 11), (5, 6, 4)):
        axis = Axis.even(start, end, cells)
        inner = checkpoints(start, end, cells - 1) if end - start > 1 else []
        assert [axis.low(i) for i in range(1, axis.cells)] == inner
        assert [axis.high(i) for i in range(axis.cells - 1)] == inner
    fine = Segmenter((Axis.even(0, 1000, 4),)).finer(4)
    assert fine.size == 16


def test_sample_sizes():
    assert sample_size(0) == 9604
    assert sample_size(1_000_000) == 9513
    assert z_score(0.95) == 1.96 and round(z_score(0.8), 3) == 1.282
    plan = SamplePlan()
    assert plan.size_for(100_000) is None
    assert plan.size_for(1_000_000) == 9513
    assert SamplePlan(margin_of_error=0.001).size_for(150_001) is None
    assert modulus(percent=10) == 10 and modulus(percent=30) == 3 and modulus(percent=60) == 1
    assert modulus(size=10, total=5) == 1 and modulus(size=10, total=15) == 2 and modulus(size=10, total=105) == 10


@pytest.mark.parametrize(
    "span, width",
    [
        (timedelta(minutes=5), timedelta(minutes=1)),
        (timedelta(hours=3), timedelta(minutes=5)),
        (timedelta(hours=10), timedelta(minutes=30)),
        (timedelta(days=2), timedelta(hours=2)),
        (timedelta(days=30), timedelta(days=1)),
        (timedelta(days=200), timedelta(days=7)),
        (timedelta(days=1000), timedelta(days=30)),
        (timedelta(days=365 * 30), timedelta(days=365)),
    ],
)
def test_bucket_width(span, width):
    start = datetime(2024, 1, 1)
    assert bucket_width(start, start + span) == width


def test_buckets_and_labels():
    b = Buckets(datetime(2024, 1, 1), datetime(2024, 1, 3, 12), timedelta(days=1))
    assert b.count == 3
    assert Buckets(datetime(2024, 1, 1), datetime(2024, 1, 1), timedelta(days=1)).count == 1
    assert label_layout(timedelta(days=30)) == "yyyy-MM"
    assert label_layout(timedelta(hours=5)) == "yyyy-MM-dd HH:00"


def test_kinds():
    assert column_kind(T.DecimalType(10, 0)) == "integer"
    assert column_kind(T.DecimalType(10, 2)) == "float"
    assert column_kind(T.BinaryType()) == "unsupported"
    assert table_key("db.schema.orders") == "orders"

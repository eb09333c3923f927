"""Join diff and key checks on small tables with known answers."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recon import CompareRules, compare_by_key, join_diff, side
from recon.operators import joindiff
from recon.operators.hashdiff import rowset_diff
from recon.operators.joindiff import both_sides, only_left
from recon.operators.keys import DuplicateKeysError, NullKeysError, duplicate_keys, key_health, key_summary
from recon.operators.output import row_json
from recon.sources.side import TableSide

RATINGS = "id int, userid int, movieid int, rating float, timestamp timestamp_ntz"
T0 = datetime(2022, 1, 1)


def ratings(spark, ids, **changes):
    rows = [(i, changes.get("userid", {}).get(i, i), i, 3.0, T0) for i in ids]
    return spark.createDataFrame(rows, RATINGS)


def signed(df, *cols):
    return sorted((r["sign"], *[r[c] for c in cols]) for r in df.collect())


def test_one_row_missing(spark):
    a, b = (side(ratings(spark, ids), "id", ["timestamp"]) for ids in ([1, 2], [1]))
    c = join_diff(a, b)
    assert signed(c.signed_rows(), "id", "timestamp") == [("-", "2", "2022-01-01 00:00:00.000000")]
    s = c.stats().first()
    assert (s.rows_A, s.rows_B, s.exclusive_A, s.exclusive_B, s.updated, s.unchanged) == (2, 1, 1, 0, 0, 1)


def test_swapped_sides_swap_signs(spark):
    a, b = (side(ratings(spark, ids), "id", ["timestamp"]) for ids in ([1, 2, 3], [1, 4]))
    flip = {"-": "+", "+": "-"}
    there = signed(join_diff(a, b).signed_rows(), "id")
    back = signed(join_diff(b, a).signed_rows(), "id")
    assert sorted((flip[s], i) for s, i in there) == back
    assert join_diff(a, a).signed_rows().count() == 0


def test_composite_key_makes_exclusive_rows(spark):
    a, b = ratings(spark, [1, 2]), ratings(spark, [1, 2], userid={2: 9})
    one = join_diff(side(a, "id", ["userid"]), side(b, "id", ["userid"]))
    assert one.signed_rows().count() == 2
    assert one.exclusive_count().first()[0] == 0
    two = join_diff(side(a, ("id", "userid"), []), side(b, ("id", "userid"), []))
    assert two.signed_rows().count() == 2
    assert two.exclusive_count().first()[0] == 2


def test_flat_row_of_an_exclusive_key(spark):
    a, b = (side(ratings(spark, ids), "id", ["timestamp"]) for ids in ([1, 2], [1]))
    c = join_diff(a, b)
    row = c.diff_rows().first()
    assert tuple(row) == (True, False, 1, 1, "2", None, "2022-01-01 00:00:00.000000", None)
    assert c.all_rows().count() == 2


def test_duplicate_and_null_keys_raise(spark):
    a = side(ratings(spark, [1, 2]), "id", [])
    with pytest.raises(DuplicateKeysError):
        join_diff(side(ratings(spark, [1, 1]), "id", []), a)
    null = ratings(spark, [1, 2]).withColumn("id", F.expr("nullif(id, 2)"))
    with pytest.raises(NullKeysError):
        join_diff(side(null, "id", []), a)
    c = join_diff(side(null, "id", []), a, skip_null_keys=True)
    assert signed(c.signed_rows(), "id") == [("+", "2")]


def test_null_keys_never_match(spark):
    null = spark.createDataFrame([(None, "x"), (1, "y")], "id int, v string")
    c = compare_by_key(side(null, "id"), side(null, "id"))
    s = c.stats().first()
    assert (s.rows_A, s.rows_B, s.exclusive_A, s.exclusive_B, s.unchanged) == (2, 2, 1, 1, 1)


def test_presence_with_duplicates_and_nulls(spark):
    a = side(spark.createDataFrame([(1,), (1,), (2,), (None,)], "id int"), "id")
    b = side(spark.createDataFrame([(1,), (1,), (1,), (None,)], "id int"), "id")
    assert [r.id for r in both_sides(a, b).collect()] == [1, 1]
    assert sorted((r.id for r in only_left(a, b).collect()), key=str) == [2, None]


def test_presence_deals_keys_to_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(joindiff, "KEYS_PER_TASK", 100)
    rows = [(i,) for i in range(3000)] + [(None,)] * 5
    a = side(spark.createDataFrame(rows, "id int"), "id")
    b = side(spark.createDataFrame([(i,) for i in range(0, 4000, 2)] + [(8,)] * 900 + [(None,)], "id int"), "id")
    found = both_sides(a, b).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.id for r in found) == list(range(0, 3000, 2))
    assert max(Counter(r.task for r in found).values()) < 150  # not a fourth of all
    left = [r.id for r in only_left(a, b).collect()]
    assert sorted(x for x in left if x is not None) == list(range(1, 3000, 2)) and left.count(None) == 5


def test_key_types_must_match(spark):
    ints = spark.createDataFrame([(1, "a")], "id int, v string")
    texts = spark.createDataFrame([("1", "a")], "id string, v string")
    floats = spark.createDataFrame([(1.0, "a")], "id double, v string")
    with pytest.raises(TypeError):
        compare_by_key(side(ints, "id"), side(texts, "id"))
    with pytest.raises(NotImplementedError):
        compare_by_key(side(floats, "id"), side(floats, "id"))
    with pytest.raises(ValueError):
        compare_by_key(side(ints, "id"), side(ints, ("id", "v")))


def test_side_validation(spark):
    df = ratings(spark, [1])
    with pytest.raises(ValueError):
        side(df, "id", [], min_update=T0)
    with pytest.raises(ValueError):
        side(df, "id", [], min_key=(5,), max_key=(5,))
    with pytest.raises(ValueError):
        side(df, "id", [], update_column="timestamp", min_update=T0, max_update=T0)
    with pytest.raises(ValueError):
        side(df, "missing")
    assert TableSide(df, ("ID",), extra_columns=("Rating",), case_sensitive=False).columns == ["id", "rating"]


def test_update_window(spark):
    now = datetime(2022, 1, 2)
    ages = [86_400 * 3, 7_200, 5, 1]
    rows = [(i, now - timedelta(seconds=s), "t") for i, s in enumerate(ages)]
    df = spark.createDataFrame(rows, "id int, datetime timestamp_ntz, text_comment string")
    s = side(df, "id", ["text_comment"], update_column="datetime")
    assert s.with_age(now, min_age="3s").rows().count() == 3
    assert s.with_age(now, max_age="1d").rows().count() == 3
    assert s.with_age(now, min_age="3s", max_age="1d").rows().count() == 2


def test_tolerance_only_beyond(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, None), (4, None)], "id int, v double")
    b = spark.createDataFrame([(1, 1.009), (2, 1.2), (3, 1.0), (4, None)], "id int, v double")
    c = compare_by_key(side(a, "id"), side(b, "id"), rules=CompareRules(float_tolerance=0.01))
    assert sorted(r.a0 for r in c.matched.where(c.changed()).collect()) == [2, 3]


def test_timestamp_precision_compares_truncated(spark):
    a = spark.createDataFrame([(1, datetime(2024, 1, 1, 1, 2, 3, 139000))], "id int, t timestamp_ntz")
    b = spark.createDataFrame([(1, datetime(2024, 1, 1, 1, 2, 3, 20409))], "id int, t timestamp_ntz")
    for level, n in (("microsecond", 1), ("millisecond", 1), ("second", 0), ("day", 0)):
        c = compare_by_key(side(a, "id"), side(b, "id"), rules=CompareRules(timestamp_precision=level))
        assert c.stats().first().updated == n


def test_truncation_before_the_epoch(spark):
    df = spark.createDataFrame([(1, datetime(1969, 12, 31, 23, 59, 59, 999999))], "id int, t timestamp_ntz")
    s = side(df, "id")
    assert s.rows().select(s.text("t", precision=3, rounds=True)).first()[0] == "1970-01-01 00:00:00.000000"
    assert s.rows().select(s.text("t", precision=3)).first()[0] == "1969-12-31 23:59:59.999000"


def test_json_modes(spark):
    rows = [
        (1, '{"a": 1, "b": [1, 2]}', '{"b":[1,2],"a":1}'),
        (2, '{"a": 1}', '{"a": 2}'),
        (3, "not json", "not  json"),
        (4, None, '{"a": 1}'),
        (5, '{"x": {"q": 1, "p": 2}}', '{"x":{"p":2,"q":1}}'),
    ]
    df = spark.createDataFrame(rows, "id int, l string, r string")
    a = side(df.selectExpr("id", "l v"), "id")
    b = side(df.selectExpr("id", "r v"), "id")
    expected = {"exact": [1, 2, 3, 4, 5], "normalized": [2, 3, 4], "semantic": [2, 3, 4], "keys_only": [3, 4]}
    for mode, ids in expected.items():
        c = compare_by_key(a, b, rules=CompareRules(json_mode=mode, json_columns=frozenset({"v"})))
        assert sorted(r.a0 for r in c.matched.where(c.changed()).collect()) == ids, mode


def test_suffix_names_do_not_clash(spark):
    a = spark.createDataFrame([(1, "p", "q", "r")], "id int, x string, x_a string, x_b string")
    b = spark.createDataFrame([(1, "p", "q2", "r")], "id int, x string, x_a string, x_b string")
    c = join_diff(side(a, "id"), side(b, "id"))
    assert [(r.column_name, r.source_value, r.target_value) for r in c.cells().collect()] == [("x_a", "q", "q2")]
    cells = row_json(c).first().cells
    assert '"x_a":{"isPK":false,"isDiff":true,"dataset1":"q","dataset2":"q2"}' in cells
    assert '"id":{"isPK":true,"isDiff":false' in cells


def test_key_parts_are_not_glued_together(spark):
    df = spark.createDataFrame([("1", "23"), ("12", "3")], "a string, b string")
    assert duplicate_keys(side(df, ("a", "b"), [])).count() == 0


def test_key_health(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id int")
    b = spark.createDataFrame([(2,), (3,)], "id int")
    rows = {r.side: r for r in key_health(side(a, "id"), side(b, "id")).collect()}
    assert tuple(rows["A"])[1:] == (4, 1, 1, 2, 1)
    assert tuple(rows["B"])[1:] == (2, 0, 0, 2, 1)
    assert tuple(key_summary(side(a, "id")).first()) == (4, 1, 2, 1)


def test_known_counts_on_orders(spark):
    o = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus")
    b = spark.sql(
        """SELECT o_orderkey, CASE WHEN o_orderkey % 89 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
        CASE WHEN o_orderkey % 79 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM {o} WHERE o_orderkey % 97 <> 0
        UNION ALL SELECT o_orderkey + 10000000, o_totalprice, o_orderstatus FROM {o} WHERE o_orderkey % 101 = 0""",
        o=o,
    )
    a, b = side(o, "o_orderkey"), side(b, "o_orderkey")
    s = join_diff(a, b).stats().first()
    assert (s.rows_A, s.rows_B, s.exclusive_A, s.exclusive_B, s.updated) == (15000, 14994, 155, 149, 353)
    assert rowset_diff(a, b).count() == join_diff(a, b).signed_rows().count()

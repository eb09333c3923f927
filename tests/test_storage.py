"""Sources, sinks, the result store, batches, sampling, streaming."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from recon import CompareRules, Options, Remapping, ResultStore, batch_compare, compare, connect_to_table, side
from recon.operators import history as hs
from recon.operators import sampling as sp
from recon.operators.cooldown import last_fired, walk
from recon.operators.keys import DuplicateKeysError, NullKeysError
from recon.operators.relational import explain_frame
from recon.plans.batch import batch_totals
from recon.plans.compare import choose_algorithm
from recon.plans.lineage import scratch_path, shared_folder
from recon.sources import writers as wr
from recon.sources.catalog import list_columns, list_tables
from recon.sources.readers import jdbc_options, read_files, read_query
from recon.streaming.cooldown import fire_with_cooldown
from recon.streaming.running import run_to_files, windowed_match_rate


def pair(spark, n=100):
    t0 = datetime(2024, 1, 1)
    rows = [(i, f"v{i}", float(i), t0 + timedelta(hours=i)) for i in range(n)]
    a = spark.createDataFrame(rows, "id int, v string, x double, ts timestamp_ntz")
    b = a.where("id % 10 <> 0").withColumn("v", F.when(F.col("id") % 7 == 0, F.upper("v")).otherwise(F.col("v")))
    return side(a, "id", name="left"), side(b, "id", name="right")


def test_shared_folder_stays_the_same(spark):
    first = shared_folder(spark)
    assert first == shared_folder(spark)
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_file_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    df.write.format(fmt).save(str(tmp_path / fmt))
    back = read_files(spark, str(tmp_path / fmt), fmt, schema=df.schema)
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError):
        read_files(spark, "x", "exe")


def test_jdbc_options():
    o = jdbc_options("postgresql", "host/db", "t", partition_column="id", bounds=(1, 9), partitions=4)
    assert o["url"] == "jdbc:postgresql://host/db" and (o["lowerBound"], o["upperBound"], o["numPartitions"]) == ("1", "9", "4")
    assert jdbc_options("own", "jdbc:own:db", "t", driver="own.Driver")["driver"] == "own.Driver"
    with pytest.raises(ValueError):
        jdbc_options("nosuch", "x", "t")
    with pytest.raises(ValueError):
        jdbc_options("mysql", "h/d", "t", partition_column="id")


def test_connect_forms(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    df.createOrReplaceTempView("connect_me")
    df.write.parquet(str(tmp_path / "p"))
    for source, fmt in ((df, None), ("connect_me", None), (str(tmp_path / "p"), "parquet")):
        assert connect_to_table(spark, source, "id", fmt).rows().count() == 1
    assert read_query(spark, "SELECT count(*) AS n FROM {d}", d=df).first().n == 1


def test_catalog(spark):
    spark.createDataFrame([(1, "a")], "id int, v string").createOrReplaceTempView("catalog_me")
    assert "catalog_me" in [r.table_name for r in list_tables(spark).collect()]
    assert [(r.column_name, r.data_type) for r in list_columns(spark, "catalog_me").collect()] == [("id", "int"), ("v", "string")]


def test_table_management(spark):
    wr.drop_table(spark, "managed_t")
    wr.create_table(spark, "managed_t", "id int, v string")
    assert wr.insert_rows(spark, "managed_t", ((i, str(i)) for i in range(20)), batch=8) == 20
    wr.insert_query(spark.createDataFrame([(99, "q")], "id int, v string"), "managed_t")
    assert spark.table("managed_t").count() == 21
    wr.create_table_as(spark.table("managed_t"), "managed_copy", ["id"], 4)
    assert spark.table("managed_copy").count() == 21
    wr.truncate_table(spark, "managed_t")
    assert spark.table("managed_t").count() == 0
    wr.temp_view(spark.table("managed_copy"), "managed_view")
    assert spark.table("managed_view").count() == 21
    for t in ("managed_t", "managed_copy"):
        wr.drop_table(spark, t)


def test_bucketed_tables_join_without_shuffle(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    a, b = pair(spark)
    wr.create_table_as(a.df, "bucket_a", ["id"], 4)
    wr.create_table_as(b.df, "bucket_b", ["id"], 4)
    c = compare(side(spark.table("bucket_a"), "id"), side(spark.table("bucket_b"), "id"), Options(assume_unique_key=True))
    plan = "\n".join(r.plan for r in explain_frame(c.full.matched, "simple").collect())
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    for t in ("bucket_a", "bucket_b"):
        wr.drop_table(spark, t)


def test_materialize_limits(spark, tmp_path):
    a, b = pair(spark)
    c = compare(a, b).full
    back = wr.materialize_diff(c, str(tmp_path / "d"), limit=5)
    assert back.count() == 5
    assert wr.materialize_diff(c, str(tmp_path / "d"), limit=None).count() == c.diff_rows().count()
    assert wr.materialize_diff(c, str(tmp_path / "d"), all_rows=True).count() == 100


def test_exports(spark, tmp_path):
    a, b = pair(spark, 20)
    c = compare(a, b)
    wr.export_jsonl(c.diff, str(tmp_path / "j"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert all(sign in "+-" and len(row) == 4 for sign, row in lines) and len(lines) == c.diff.count()
    wr.export_csv(c.compared, str(tmp_path / "c"))
    rows = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).collect()
    changed = [r for r in rows if r.type == "value_different"]
    assert {r.differing_columns for r in changed} == {"v"} and json.loads(changed[0].source_values)["v"].startswith("v")


def test_store_round_trip(spark, tmp_path):
    a, b = pair(spark)
    store = None
    for cid in ("one", "two"):
        r = compare(a, b, Options(time_column="ts", profile_columns=True))
        store = r.save(str(tmp_path / "store"), cid)
        r.save(str(tmp_path / "store"), cid)  # saving again replaces
    s = store.read("comparison_summary").where("comparison_id = 'one'").collect()
    assert len(s) == 1 and (s[0].rows_compared, s[0].rows_different, s[0].status) == (100, 23, "completed")
    assert float(s[0].match_rate) == 77.0
    d = store.details("one")
    kinds = {(r.difference_type, r.severity) for r in d["difference_details"].collect()}
    assert kinds == {("missing_in_target", "high"), ("value_different", "medium")}
    assert store.read("column_statistics").where("comparison_id = 'one'").count() == 8
    assert store.read("timeline_analysis").where("comparison_id = 'one'").agg(F.sum("difference_count")).first()[0] == 23
    assert d["performance_metrics"].count() == 2
    assert hs.history(store.read("comparison_summary"), limit=1).count() == 1
    assert store.clear(kind="table", failed=True) == {"table_comparisons": 0}
    store.delete(("comparison_summary", "difference_details"), ["two"])
    assert [r[0] for r in store.read("comparison_summary").select("comparison_id").collect()] == ["one"]
    later = datetime.now() + timedelta(days=40)
    assert store.clear(now=later, days=30) == {"table_comparisons": 1, "schema_comparisons": 0}
    assert store.read("difference_details").count() == 0


def test_comparison_ids_stay_texts(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "ids"))
    row = spark.createDataFrame([("completed",)], "status string")
    for cid in ("007", "a:b c", "2024-01-01"):
        store.save("comparison_summary", cid, row)
    assert sorted(r.comparison_id for r in store.read("comparison_summary").collect()) == ["007", "2024-01-01", "a:b c"]
    store.delete(("comparison_summary",), ["a:b c"])
    assert store.read("comparison_summary").count() == 2


def test_rows_compare_with_remapping(spark):
    a, b = pair(spark, 40)
    renamed = side(b.df.withColumnRenamed("v", "w"), "id", ["ts", "w", "x"])
    got = compare(a, renamed, Options(algorithm="rows", remapping=Remapping({"v": "w"}))).stats.first()
    assert tuple(got[:5]) == tuple(compare(a, b).stats.select("rows_A", "rows_B", "exclusive_A", "exclusive_B", "updated").first())


def test_store_schema_results(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "s"))
    assert store.read("schema_comparison_summary").count() == 0
    summary = spark.createDataFrame([("a", "b", 2, "completed")], "source_schema string, target_schema string, total_differences long, status string")
    store.save("schema_comparison_summary", "x", summary)
    store.save("schema_column_differences", "x", spark.createDataFrame([("t", "c", "type_changed", "int", "bigint")], "table_name string, column_name string, difference_type string, source_type string, target_type string"))
    store.save("schema_table_differences", "x", spark.createDataFrame([("t2", "table_only_in_source")], "table_name string, difference_type string"))
    assert store.read("schema_comparison_summary").first().total_differences == 2
    assert store.clear(kind="schema") == {"schema_comparisons": 1}
    assert store.read("schema_column_differences").count() == 0


def test_algorithms(spark):
    a, b = pair(spark)
    assert choose_algorithm(a, b, Options()) == ("join", True)
    assert choose_algorithm(a, b, Options(), same_system=False) == ("hash", True)
    doubled = side(a.df.union(a.df), "id")
    assert choose_algorithm(a, doubled, Options()) == ("rows", False)
    with pytest.raises(DuplicateKeysError):
        compare(a, doubled, Options(algorithm="join"))
    assert compare(a, doubled, Options(algorithm="hash")).diff.count() == 300
    null = side(a.df.withColumn("id", F.expr("nullif(id, 3)")), "id")
    with pytest.raises(NullKeysError):
        compare(null, b)
    assert compare(null, b, Options(skip_null_keys=True)).stats.first().exclusive_B == 1
    with pytest.raises(ValueError):
        choose_algorithm(a, b, Options(algorithm="magic"))
    by = {alg: compare(a, b, Options(algorithm=alg)) for alg in ("join", "hash", "rows")}
    pick = ["rows_A", "rows_B", "exclusive_A", "exclusive_B", "updated", "unchanged", "match_rate", "rating"]
    assert len({tuple(r.stats.select(pick).first()) for r in by.values()}) == 1
    assert len({tuple(sorted(tuple(x) for x in r.diff.collect())) for r in by.values()}) == 1


def test_timeline_counts_equal_segments_too(spark):
    a, _ = pair(spark, 200)
    b = side(a.df.where("id <> 150"), "id")
    for algorithm in ("join", "hash"):
        r = compare(a, b, Options(algorithm=algorithm, time_column="ts", factor=4, threshold=8))
        assert tuple(r.timeline.agg(F.sum("total_rows"), F.sum("differences")).first()) == (200, 1)


def test_hash_compare_with_remapping_and_tolerance(spark):
    a, b = pair(spark)
    renamed = side(b.df.withColumnRenamed("v", "w").withColumn("x", F.col("x") + 0.001), "id")
    opts = Options(algorithm="hash", remapping=Remapping({"v": "w"}), rules=CompareRules(float_tolerance=0.01))
    assert tuple(compare(a, renamed, opts).stats.select("exclusive_A", "updated").first()) == (10, 13)


def test_sampled_comparison_keeps_the_same_keys(spark):
    a, b = pair(spark, 1000)
    s = compare(a, b, Options(sample_percent=20)).stats.first()
    assert (s.rows_A, s.rows_B) == (200, 100)
    s = compare(a, b, Options(sample_size=100)).stats.first()
    assert (s.rows_A, s.rows_B) == (100, 0)


def test_batch_isolates_failures(spark):
    a, b = pair(spark, 20)
    bad = side(a.df.withColumn("id", F.col("id").cast("string")), "id")
    out = batch_compare(spark, {"good": (a, b), "bad": (a, bad)})
    rows = {r.name: r for r in out.collect()}
    assert rows["good"].status == "completed" and rows["bad"].status == "failed" and "TypeError" in rows["bad"].error
    assert tuple(batch_totals(out).first()) == (2, 1, 1)


def test_systematic_numbers_every_row(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    places = sp.numbered(df, ["k"]).orderBy("k").collect()
    assert [r["__place"] for r in places] == list(range(1, 1001))
    assert sp.systematic_sample(df, ["k"], 10).count() == 100


def test_samples(spark):
    df = spark.range(1000)
    assert 30 < sp.percent_sample(df, 10).count() < 200
    assert sp.fixed_sample(df, 50, ["id"]).count() == 50 and sp.fixed_sample(df, 5000, ["id"]).count() == 1000
    assert sp.hashed_sample(df, ["id"], 10).collect() == sp.hashed_sample(df, ["id"], 10).collect()
    strata = df.withColumn("g", F.col("id") % 3)
    counts = sp.stratified_fixed(strata, "g", ["id"], 7).groupBy("g").count().collect()
    assert {r["count"] for r in counts} == {7}


def test_inference(spark):
    df = spark.createDataFrame([(50, 1000, 100_000), (0, 0, 10)], "sample_differences long, sample_size long, population_size long")
    one, none = sp.infer(df).orderBy(F.col("sample_size").desc()).collect()
    assert one.estimated_differences == 5000 and one.extrapolation_factor == 100
    assert round(one.ci_low, 4) == 0.0365 and round(one.ci_high, 4) == 0.0635
    assert none.sample_proportion == 0 and none.extrapolation_factor == 0


def fold(ticks, rest):
    fired = []
    for t in sorted(set(ticks)):
        if not fired or t >= fired[-1] + rest:
            fired.append(t)
    return fired


def test_cooldown_batch_and_stream_agree(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    minutes = {"a": [0, 1, 4, 5, 6, 11, 30], "b": [2, 3, 9]}
    rows = [(r, t0 + timedelta(minutes=m), True) for r, ms in minutes.items() for m in ms] + [("a", t0 + timedelta(minutes=20), False)]
    checks = spark.createDataFrame(rows, "rule string, checked_at timestamp_ntz, fires boolean")
    expected = sorted((r, t0 + timedelta(minutes=m)) for r, ms in minutes.items() for m in fold(ms, 5))
    assert sorted(tuple(r) for r in hs.fired_alerts(checks, 300).collect()) == expected
    checks.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(checks.schema).parquet(str(tmp_path / "in"))
    run_to_files(fire_with_cooldown(stream, 300), str(tmp_path / "out"), str(tmp_path / "cp"))
    later = spark.createDataFrame([("b", t0 + timedelta(minutes=12), True), ("b", t0 + timedelta(minutes=14), True)], checks.schema)
    later.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(checks.schema).parquet(str(tmp_path / "in"))
    run_to_files(fire_with_cooldown(stream, 300), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).select("rule", F.col("fired_at").cast("timestamp_ntz"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected + [("b", t0 + timedelta(minutes=14))])


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_cooldown_over_blocks(spark, block):
    """Blocks of any size fire what one fold over each rule's ticks fires."""
    rng, t0 = random.Random(5), datetime(2024, 1, 1)
    minutes = {"a": [rng.randrange(400) for _ in range(90)], "b": list(range(0, 60, 2)), None: [7, 7, 30], "c": [0]}
    rows = [(r, t0 + timedelta(minutes=m), True) for r, ms in minutes.items() for m in ms] + [("a", None, True), ("d", t0, False)]
    checks = spark.createDataFrame(rows, "rule string, checked_at timestamp_ntz, fires boolean")
    expected = {(r, t0 + timedelta(minutes=m)) for r, ms in minutes.items() for m in fold(ms, 11)}
    got = [tuple(r) for r in hs.fired_alerts(checks, 660, block).collect()]
    assert len(got) == len(expected) and set(got) == expected
    assert hs.fired_alerts(checks.where("false"), 660, block).count() == 0


def test_cooldown_of_one_busy_rule():
    ticks = np.arange(0, 2_000_000, 2)
    last = last_fired(ticks, 7)
    assert last[0] == walk(ticks, 0, 7)[-1] and last[3] == walk(ticks, 3, 7)[-1]


def test_store_moves_and_forgets(spark, tmp_path):
    """Rows that stand survive compaction once each; saved anew after a deletion, a comparison is back."""
    store = ResultStore(spark, str(tmp_path / "moved"))

    def save(cid, *names):
        store.save("performance_metrics", cid, spark.createDataFrame([(n,) for n in names], "metric_name string"))

    def stored():
        return sorted((r.comparison_id, r.metric_name) for r in store.read("performance_metrics").collect())

    for cid in ("a", "b", "c"):
        save(cid, "x", "y")
    save("b", "z")
    store.delete(("performance_metrics",), ["c"])
    assert stored() == [("a", "x"), ("a", "y"), ("b", "z")]
    for _ in range(2):
        store.compact(("performance_metrics",))
        assert stored() == [("a", "x"), ("a", "y"), ("b", "z")]
    assert spark.read.parquet(store.location("performance_metrics")).count() == 3
    save("a", "new")
    save("c", "back")
    assert stored() == [("a", "new"), ("b", "z"), ("c", "back")]
    with pytest.raises(Exception, match="broken"):
        store.save("performance_metrics", "b", spark.range(1).selectExpr("raise_error('broken') AS metric_name"))
    assert ("b", "z") in stored()


def test_late_rows_are_dropped(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    schema = "ts timestamp_ntz, is_different boolean"
    at = lambda h: t0 + timedelta(hours=h)

    def feed(rows):
        spark.createDataFrame(rows, schema).repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        run_to_files(
            windowed_match_rate(stream, "ts", window="1 hour", lag="30 minutes"), str(tmp_path / "out"), str(tmp_path / "cp")
        )

    feed([(at(0.1), True), (at(0.2), False), (at(5), False)])
    feed([(at(0.3), True), (at(9), False)])
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()
    assert [(r.window_start, r.total_rows, r.differences) for r in rows] == [(at(0), 2, 1), (at(5), 1, 0)]


def test_history_rules(spark):
    now = datetime(2024, 6, 1)
    rows = [
        ("1", "running", now - timedelta(hours=30)),
        ("2", "running", now - timedelta(hours=1)),
        ("3", "completed", now - timedelta(hours=90)),
    ]
    h = spark.createDataFrame(rows, "comparison_id string, status string, created_at timestamp_ntz")
    got = {r.comparison_id: (r.status, r.error_message) for r in hs.fail_stuck(h, now, 24).collect()}
    assert got == {"1": ("failed", "no end within the allowed hours, last seen running"), "2": ("running", None), "3": ("completed", None)}
    assert [r[0] for r in hs.doomed(h, now=now, days=2).collect()] == ["3"]
    assert hs.success_rate(h).first().health == "unhealthy"
    assert hs.success_rate(h.where("status = 'none'")).first().health == "healthy"


def test_plan_as_rows(spark):
    assert explain_frame(spark.range(5).where("id > 2")).count() > 3

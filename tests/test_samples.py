"""Samples of a fixed number of rows, by counting digests."""

import hashlib

import pytest

from recon.operators import sampling as sp


@pytest.fixture
def table(spark):
    rows = [(i, [None, "a", "b", "b", "b"][i % 5]) for i in range(3000)] + [(7, "b")] * 40
    return rows, spark.createDataFrame(rows, "id int, g string").repartition(5)


@pytest.mark.parametrize("n", [0, 1, 2, 17, 599, 600, 1800, 5000])
def test_samples_match_sorting(table, n):
    rows, df = table
    order = lambda r, seed="": (hashlib.md5(f"{seed}{r[0]}".encode()).hexdigest(), r[0])
    plain = lambda out: sorted(map(tuple, out.collect()), key=repr)
    assert plain(sp.hashed_sample(df, ["id"], n)) == sorted(sorted(rows, key=order)[:n], key=repr)
    assert plain(sp.fixed_sample(df, n, ["id"], 9)) == sorted(sorted(rows, key=lambda r: order(r, "9|"))[:n], key=repr)
    strata = [r for g in (None, "a", "b") for r in sorted((r for r in rows if r[1] == g), key=order)[:n]]
    assert plain(sp.stratified_fixed(df, "g", ["id"], n)) == sorted(strata, key=repr)


def test_no_top_n_in_the_plan(table):
    _, df = table
    for out in (sp.fixed_sample(df, 50, ["id"]), sp.stratified_fixed(df, "g", ["id"], 50)):
        assert "TakeOrdered" not in out._jdf.queryExecution().toString()
    assert sp.fixed_sample(df.where("id < 0"), 5, ["id"]).count() == 0


def test_many_strata_are_joined_by_a_shuffle(table, monkeypatch):
    rows, df = table
    monkeypatch.setattr(sp, "MOST_STRATA", 1)
    want = {r.g: r["count"] for r in sp.stratified_fixed(df, "g", ["id"], 11).groupBy("g").count().collect()}
    assert want == {None: 11, "a": 11, "b": 11}


def test_block_sample_opens_only_its_files(spark, tmp_path):
    path = tmp_path / "blocks"
    spark.range(4000).repartition(40).write.parquet(str(path))
    df = spark.read.parquet(str(path))
    share = lambda name: int(hashlib.md5(f"7|{name}".encode()).hexdigest()[20:], 16) / (1 << 48)
    files = sorted(path.glob("*.parquet"), key=lambda f: share(f.name))
    taken = [f for f in files if share(f.name) < 0.25]
    assert 0 < len(taken) < len(files) == 40
    want = sorted(r.id for f in taken for r in spark.read.parquet(str(f)).collect())
    assert sorted(r.id for r in sp.block_sample(df, 25.0, 7).collect()) == want
    assert sp.block_sample(df, 100.0).count() == 4000 and sp.block_sample(df, 0.0).count() == 0
    assert sp.block_sample(df.where("id % 2 = 0"), 25.0, 7).count() == sum(i % 2 == 0 for i in want)
    for f in files[len(taken) :]:
        f.write_bytes(b"unreadable")
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    # Files outside the sample may be broken: they are not opened.
    assert sorted(r.id for r in sp.block_sample(df, 25.0, 7).collect()) == want

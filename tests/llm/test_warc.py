import glob
import gzip
import random

from pyspark.sql import functions as F

from recon.llm import warc
from tests.llm.tables import written

SCHEMA = "page_id long, url string, html string, key string"


def test_round_trip_with_hot_urls_and_payloads(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"http://h{i % 7}.Example.com:80/p/{i % 11}?q=é", rng.choice(["same", None, "", f"own {i} é"]), "k") for i in range(500)]
    rows += [(i, "https://hot.org/", "hot page", "k") for i in range(500, 700)] + [(900, None, "x", "k"), (901, "a b\nc", "x", "k")]
    rows += [(None, "http://n.org", "hot page", "k"), (700, "http://r.org", "r", "k"), (700, "http://r.org", "r", "k")]
    df = written(spark, tmp_path, rows, SCHEMA)
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        keep = first[h or ""]
        revisit = i != keep
        want.append((i, len(raw), warc.payload_digest(raw), "revisit" if revisit else "response", keep if revisit else None))
    got = [tuple(r)[:5] for r in warc.archive_round_trip(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_small_blocks_find_exactly_their_captures(spark, tmp_path):
    df = written(spark, tmp_path, [(i, f"http://a.org/{i % 5}", f"page {i}", "") for i in range(60)], SCHEMA)
    rows = df.withColumn("first", F.lit(None).cast("struct<page_id:long>")).withColumn("key", warc.url_key(F.col("url")))
    archives, index = f"{tmp_path}/archives", f"{tmp_path}/index"
    captures = warc.write_archives(rows, archives, file_bytes=2000)
    parts = warc.write_index(captures, index, block_entries=4)
    found = warc.Index(archives, index, parts)
    for i in range(60):
        places = list(found.lookup(f"org,a)/{i % 5}", i))
        assert len(places) == 1
        head, _, payload = warc.parse_record(found.read(*places[0]))
        assert payload == f"page {i}".encode() and head["WARC-Record-ID"] == f"<urn:page:{i}>"
    assert list(found.lookup("org,a)/0", 1)) == [] and list(found.lookup("zzz", 1)) == [] and list(found.lookup("", None)) == []
    # Any WARC reader can read the files front to back.
    whole = b"".join(gzip.open(f).read() for f in glob.glob(f"{archives}/*.warc.gz"))
    assert whole.count(b"WARC/1.1\r\n") == 60


def test_keys_and_empty_table(spark, tmp_path):
    urls = ["http://user@www.Example.com:8080/A?b#c", "example.com", None, "HTTPS://a.b?x", "mailto:x"]
    keys = [r.k for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.url_key(F.col("u")).alias("k")).collect()]
    assert keys == ["com,example,www)/A?b#c", "com,example)", ")", "b,a)?x", "mailto:x)"]
    assert warc.archive_round_trip(written(spark, tmp_path, [], SCHEMA)).count() == 0


def test_small_payloads_are_no_revisits(spark, tmp_path):
    df = written(spark, tmp_path, [(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abcd", ""), (4, "u", "abcd", "")], SCHEMA)
    got = {r.page_id: r.record_type for r in warc.archive_round_trip(df, least_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_read_back_in_many_tasks_and_small_batches(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://a.org/{i}", f"page {i} " * (i % 50), "") for i in range(300)] + [(300, "http://a.org/x", "long " * 1_000_000, "")]
    df = written(spark, tmp_path, rows, SCHEMA)
    monkeypatch.setattr(warc, "TASK_BYTES", 1000)
    monkeypatch.setattr(warc, "BATCH_BYTES", 500)
    out = warc.archive_round_trip(df)
    assert out.rdd.getNumPartitions() > 8
    want = {i: h for i, _, h, _ in rows}
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        raw = want[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), warc.payload_digest(raw))
        assert r.record_type == "revisit" or r.html == want[r.page_id]

import random
import zlib
from collections import defaultdict

from recon.llm.sharding import KEY_BITS, find_cuts, shard
from tests.llm.tables import DOCS, docs_of, written


def check(df, texts, shards=16):
    rows = shard(df).collect()
    assert len(rows) == len(texts)
    slots, size = defaultdict(list), defaultdict(int)
    for r in rows:
        assert (r.law, r.grown_shard) == ("bytes", None) and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return rows, [size[i] for i in range(shards)]


def test_even_bytes_with_a_hot_text(spark, tmp_path):
    rng = random.Random(2)
    texts = ["copy " * 20] * 400 + ["é" * rng.randrange(0, 300) for _ in range(800)] + [None, "", "x" * 3000]
    rows, size = check(docs_of(spark, tmp_path, texts, more="shard"), texts)
    assert max(size) - min(size) <= 3001 + 0.002 * sum(size) / 16
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    spread = defaultdict(set)
    for r in rows:
        if texts[r.doc_id] and len(texts[r.doc_id]) < 300:
            spread[texts[r.doc_id]].add(r.shard)
    # Equal texts are neighbours: a group is cut only where a shard ends inside it.
    assert sum(len(s) - 1 for s in spread.values()) <= 15


def test_repeated_rows_few_rows_no_rows(spark, tmp_path):
    same = [(1, "again", None, None, None)] * 320
    _, size = check(written(spark, tmp_path, same, DOCS), same)
    assert max(size) - min(size) <= 6
    check(written(spark, tmp_path, [(None, None, None, None, None)], DOCS), [None])
    assert shard(written(spark, tmp_path, [], DOCS)).count() == 0


def test_cuts_against_a_sorted_list(spark):
    for seed, tolerance in ((1, 0.0), (2, 0.001), (3, 0.2)):
        rng = random.Random(seed)
        big = 1 << KEY_BITS
        rows = []
        for i in range(1500):  # a third of the rows under one key, half of those under one pair of keys
            first = 77 if i % 3 == 0 else rng.choice([rng.randrange(big), rng.randrange(50), big - 1, 0])
            rows.append((rng.choice([1, 7, 300, 5000 if i % 50 == 0 else 20]), first, 5 if i % 6 == 0 else rng.randrange(big), i))
        df = spark.createDataFrame(rows, "size long, k1 long, k2 long, k3 long").repartition(4)
        rows.sort(key=lambda r: r[1:])
        total = sum(r[0] for r in rows)
        ends = [0]
        for r in rows:
            ends.append(ends[-1] + r[0])
        for shards in (2, 16):
            cuts = find_cuts(df, shards, tolerance)
            assert len(cuts) == shards - 1
            for i, cut in enumerate(cuts, 1):
                at = (*cut.fixed, cut.low)
                before = sum(r[0] for r in rows if r[1 : 1 + len(at)] < at)
                nearest = min(abs(e - total * i / shards) for e in ends)
                assert abs(before - total * i / shards) <= max(nearest, tolerance * total / shards), (seed, shards, i)

import hashlib
import random

import numpy as np
import pytest

from recon.llm import repeats
from recon.llm.repeats import anchors, bucket_pointers, repeated_strings
from tests.llm.tables import DOCS, docs_of, written


def brute(rows, window):
    least = {}
    data = [(-(2**63) if i is None else i, i, (t or "").encode()) for i, t in rows]
    for k, _, b in data:
        for p in range(len(b) - window + 1):
            s = b[p : p + window]
            least[s] = min(k, least.get(s, k))
    out = []
    for k, i, b in data:
        gone = [False] * len(b)
        for p in range(len(b) - window + 1):
            if least[b[p : p + window]] < k:
                gone[p : p + window] = [True] * window
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df, **how):
    return sorted((tuple(r) for r in repeated_strings(df, **how).collect()), key=repr)


def texts_of(rng, n):
    base = ["".join(rng.choice("abé ") for _ in range(60)) for _ in range(4)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(4)):
            s = rng.choice(base)
            a = rng.randrange(len(s))
            parts += [s[a : a + rng.randrange(60)], "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(20)))]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("window,gram,hot", [(50, 24, 50_000), (6, 3, 50_000), (6, 3, 2), (9, 8, 1), (12, 12, 3)])
def test_matches_brute_force(spark, tmp_path, window, gram, hot):
    texts = texts_of(random.Random(window + hot), 120)
    texts += [None, "", "a" * 300, "a" * 200, "short"] + ["one passage that very many documents hold, word for word; " * 2] * 40
    df = docs_of(spark, tmp_path, texts, more="n_bytes")
    assert got(df, window=window, gram=gram, hot_least=hot) == brute(list(enumerate(texts)), window)


def test_small_batches_chunks_and_sorts(spark, tmp_path, monkeypatch):
    texts = texts_of(random.Random(4), 60) + ["xyz" * 700]
    df = docs_of(spark, tmp_path, texts)
    how = {"window": 8, "gram": 4}
    for name, value in (("CHUNK", 64), ("BATCH_BYTES", 500), ("SORT_BYTES", 50), ("RANGE_BYTES", 1000)):
        monkeypatch.setattr(repeats, name, value)
    assert got(df, **how) == brute(list(enumerate(texts)), 8)
    # the same chunks in this process, since workers have their own copy of the module
    whole = anchors([t.encode() for t in texts], 8, 4)
    monkeypatch.setattr(repeats, "CHUNK", 1 << 20)
    once = anchors([t.encode() for t in texts], 8, 4)
    covered = [{(t, p + i) for t, p, n in zip(*(x.tolist() for x in a[:3])) for i in range(n)} for a in (whole, once)]
    assert covered[0] == covered[1] == {(t, p) for t, x in enumerate(texts) for p in range(len(x.encode()) - 7)}


def test_nulls_repeated_ids_and_empty_table(spark, tmp_path):
    s = "a passage of well over fifty bytes, so that it is found again wherever it is"
    rows = [(5, s, None, None, None)] * 2 + [(None, s + "!", None, None, None), (5, "?" + s, None, None, None), (7, s[:50], None, None, None)]
    df = written(spark, tmp_path, rows, DOCS)
    assert got(df) == brute([(r[0], r[1]) for r in rows], 50)
    assert got(written(spark, tmp_path, [], DOCS)) == []


def test_very_long_texts(spark, tmp_path):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(200_000)]
    long = " ".join(words)
    df = docs_of(spark, tmp_path, [long, "start " + long[500_000:900_000] + " end", long])
    rows = {r.doc_id: r for r in repeated_strings(df).collect()}
    assert rows[0].n_removed == 0 and rows[2].n_removed == len(long) and rows[2].n_spans == 1
    assert rows[1].n_removed in range(400_000, 400_003) and rows[1].n_spans == 1


@pytest.mark.parametrize("depth", [1, 5, 8, 13, 50])
def test_buckets_agree_with_the_strings(depth):
    rng = random.Random(depth)
    data = bytes(rng.choice(b"ab") for _ in range(300)) + b"abcabc" * 30
    buckets = bucket_pointers(np.frombuffer(data, np.uint8), depth)
    strings = [(data + bytes(depth))[i : i + depth] for i in range(len(data))]
    assert len(set(zip(buckets.tolist(), strings))) == len(set(strings)) == len(set(buckets.tolist()))

import hashlib
import random
import zlib

import numpy as np
import pytest

from recon.llm.runs import runs, squares, suffix_automaton, word_runs
from tests.llm.tables import docs_of


def brute_runs(words, least, power):
    out, n = [], len(words)
    for q in range(1, n // power + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            s, length = i - q, j - i + q
            if j > i and length >= max(least, power * q):
                part = words[s : s + length]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.append((s, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,power", [(24, 3), (4, 2), (6, 3), (2, 2), (9, 4)])
def test_runs_match_brute_force(least, power):
    rng = random.Random(least * 10 + power)
    for _ in range(250):
        words = []
        while len(words) < rng.choice([0, 3, 30, 120]):
            root = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randrange(1, 12))]
            words += root * rng.choice([1, 1, 2, 3, 6])
        assert runs(np.array(words, np.int64), least, power) == brute_runs(words, least, power)


def test_squares_have_primitive_roots_and_meet_every_run():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.randrange(2) for _ in range(rng.randrange(1, 60))]
        met = set()
        for i, q in squares(words):
            part = words[i - 2 * q + 1 : i + 1]
            assert part[:q] == part[q:] and not any(q % d == 0 and part[d:] == part[:-d] for d in range(1, q))
            met.add((i, q))
        for s, _, q in brute_runs(words, 2, 2):
            assert (s + 2 * q - 1, q) in met


def test_automaton_knows_all_substrings():
    words = [1, 2, 1, 2, 2, 1, 1, 2, 1]
    length, link, ends = suffix_automaton(words)
    n = len(words)
    different = {tuple(words[i:j]) for i in range(n) for j in range(i + 1, n + 1)}
    assert sum(length[v] - length[link[v]] for v in range(1, len(length))) == len(different)
    assert [length[e] for e in ends] == list(range(1, n + 1))


def expected(doc_id, text, plant):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words, 24, 3)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]
    best = sorted(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))[:1]
    fact = (best[0][0], best[0][1], best[0][2], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    return (
        doc_id, len(found), *fact,
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(kept)).hexdigest(),
    )


@pytest.mark.parametrize("plant", [True, False])
def test_documents_match_brute_force(spark, tmp_path, plant):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(200))) for _ in range(120)]
    texts += [None, "", " \n\t", "ab " * 500, "x\x0by z\x1c " * 40, "é ü " * 12, "one two three " * 8 + "end", "k\x00 " * 30]
    texts += [texts[-3]] * 3
    df = docs_of(spark, tmp_path, texts, more="n_runs")
    got = sorted(tuple(r) for r in word_runs(df, plant=plant).collect())
    assert got == [expected(i, t, plant) for i, t in enumerate(texts)]
    assert word_runs(docs_of(spark, tmp_path, [])).count() == 0


def test_very_long_text(spark, tmp_path):
    rng = random.Random(1)
    words = [str(rng.randrange(50)) for _ in range(30_000)]
    words[10_000:20_000] = words[10_000:12_000] * 5
    row = word_runs(docs_of(spark, tmp_path, [" ".join(words)])).first()
    assert row.n_runs >= 1 and row.period == 2_000 and row.start <= 10_000 and row.exponent_milli >= 5_000

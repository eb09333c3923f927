import random

import numpy as np
import pytest

from recon.llm import bottomk
from recon.llm import components as components_module
from recon.llm.bottomk import MARKS, _hub_pairs, _joined, _linked, _marked, _rarest, _split_pairs, _with, bin_bits, marks_for, most_differing, near_groups, parities, without_near_copies
from recon.llm.common import forget_others
from recon.llm.components import components
from tests.llm.tables import DOCS, docs_of, written


def sets_of(texts, words):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return out


def brute(texts, words):
    s, root = sets_of(texts, words), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            common = len(s[i] & s[j])
            if common and 100 * common >= 80 * (len(s[i]) + len(s[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(s[i]), find(i), find(i) == i) for i in range(len(s))]


def family(rng, n, copies, edits):
    base = [f"w{rng.randrange(400)}" for _ in range(n)]
    out = [base]
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10_000)}"
        out.append(w)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("words,most", [(2, 16), (2, 2), (5, 3)])
def test_groups_match_brute_force(spark, tmp_path, words, most):
    rng = random.Random(words * 10 + most)
    texts = [None, "", " \n", "One", "one", "ONE two", "one two", "é É", "É É", "a b c"]
    for n in (2, 3, 5, 8, 12, 20, 33, 36, 40, 45, 80, 200):
        texts += family(rng, n, 4, max(1, n // 12))
    texts += family(rng, 120, 60, 4)  # a list longer than `most` at every length
    texts += ["the " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for _ in range(30)]
    rng.shuffle(texts)
    df = docs_of(spark, tmp_path, texts, more="first")
    got = sorted(tuple(r)[1:5] for r in near_groups(df, words=words, most=most).collect())
    assert got == brute(texts, words)


def test_a_mass_of_edits_of_one_original_is_one_group(spark, tmp_path):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base)]
    for i in range(300):
        w = list(base)
        for at in rng.sample(range(10, 290), 5):
            w[at] = f"v{i}x{at}"
        texts.append(" ".join(w))
    # Beside them, texts that share half of the original and are no copies, and edits of edits.
    texts += [" ".join([*base[:150], *(f"u{i}y{j}" for j in range(150))]) for i in range(40)]
    texts += [t.replace("w20 ", "x20 ").replace("w250 ", "x250 ") for t in rng.sample(texts[1:300], 30)]
    rng.shuffle(texts)
    df = docs_of(spark, tmp_path, texts, more="mass")
    got = sorted(tuple(r)[1:5] for r in near_groups(df, words=5).collect())
    assert got == brute(texts, 5)


def test_members_of_many_long_lists_meet_few_hubs(spark):
    rows = [(key, rep, 100, 7) for rep in range(40) for key in range(30)]
    rows += [(99, rep, 100, 7 if rep < 40 else -8) for rep in range(60)]  # the others differ in all bits
    pairs = _hub_pairs(spark.createDataFrame(rows, "key long, rep long, n long, bits long"), 80)
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) <= 3 * 60  # not one for each list that a member is in
    assert {x for p in got for x in p if x < 40} == set(range(40)) and all((a < 40) == (b < 40) for a, b in got)


def test_bits_of_similar_sets_differ_little():
    rng = np.random.default_rng(3)
    least = most_differing(80)
    for n in (1, 4, 30, 64, 65, 300, 5000):
        for _ in range(200):
            s = rng.permutation(np.unique(rng.integers(1, 1 << 62, n + n // 4)))
            a, b = s[: n + n // 8], s[n // 8 :]  # similarity 0.8 or more
            assert ((bin_bits(np.sort(a)) ^ bin_bits(np.sort(b))) % (1 << 64)).bit_count() <= least
    far = [(bin_bits(np.unique(rng.integers(1, 1 << 62, 300))) ^ bin_bits(np.unique(rng.integers(1, 1 << 62, 300)))) % (1 << 64) for _ in range(400)]
    assert np.mean([x.bit_count() > least for x in far]) > 0.9


def test_parities_never_differ_more_than_sets():
    rng = np.random.default_rng(4)
    for n, gone in [(0, 0), (1, 0), (5, 1), (64, 10), (300, 30), (300, 300), (3000, 500)]:
        tokens = np.unique(rng.integers(1, 1 << 62, n + gone))
        a, b = tokens[: len(tokens) - gone], tokens[gone:]
        odd = [int(x) % (1 << 64) for x in parities(a) ^ parities(b)]
        assert len(odd) == 8 and sum(x.bit_count() for x in odd) <= len(np.setxor1d(a, b))


def test_a_mass_of_dissimilar_edits_makes_few_pairs(spark, tmp_path):
    # Edits of one original that are too far from it and from each other, but for two of each hundred.
    rng = random.Random(11)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base)]
    for i in range(300):
        w = list(base)
        for at in rng.sample(range(100), 1 if i % 50 == 0 else 4):
            w[at] = f"v{rng.randrange(40)}"  # edits recur
        texts.append(" ".join(w))
    sets = [{hash(t) & (1 << 62) - 1 for t in x} for x in sets_of(texts, 5)]
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if sets[i] != sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    rows = [(i, i, sorted(x)) for i, x in enumerate(sets)]
    frame = written(spark, tmp_path, rows, "rep long, root long, full array<long>")
    got = {tuple(r) for r in _split_pairs(_rarest(frame, 80), 80).distinct().collect()}
    assert alike <= got and len(got) < 10 * len(texts)
    assert sorted(tuple(r)[1:5] for r in near_groups(docs_of(spark, tmp_path, texts), words=5).collect()) == brute(texts, 5)


def test_copies_of_one_set_are_not_compared_pair_by_pair(spark, tmp_path):
    sets = [(i, [*range(100), 1000 + i]) for i in range(30)] + [(30, [*range(90), *range(2000, 2010)]), (31, list(range(3000, 3100)))]
    pairs = [(i, j) for j in range(32) for i in range(j)]
    links, roots = _linked(
        written(spark, tmp_path, pairs, "a long, b long"), written(spark, tmp_path, sets, "rep long, full array<long>"), 80
    )
    assert {r.node: r.root for r in roots.collect()} == {i: 0 for i in range(31)}
    assert links.count() < 40  # of 435 and more
    # A set that is not like its smallest partner meets the others.
    far = [(0, list(range(5000, 5100))), (1, list(range(100))), (2, [*range(100), 7])]
    _, roots = _linked(
        written(spark, tmp_path, [(0, 1), (0, 2), (1, 2)], "a long, b long"), written(spark, tmp_path, far, "rep long, full array<long>"), 80
    )
    assert {r.node: r.root for r in roots.collect()} == {1: 1, 2: 1}


def test_repeated_rows_nulls_and_no_rows(spark, tmp_path):
    rows = [(5, "same text here", None, None, None)] * 3 + [(None, "same text here", None, None, None), (2, None, None, None, None)]
    df = written(spark, tmp_path, rows, DOCS)
    got = near_groups(df)
    assert sorted((r.component_id, r.n_shingles) for r in got.collect()) == [(2, 0)] + [(5, 1)] * 4
    left = without_near_copies(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [2, 5]
    assert near_groups(written(spark, tmp_path, [], DOCS)).count() == 0


def test_components_of_a_long_path(spark):
    order = list(range(40))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(29)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r.node: r.root for r in components(links, "a", "b").collect()}
    assert got == {n: min(order[:30]) for n in order[:30]} | {100: 100, 101: 100}


def test_components_write_few_tables(spark, tmp_path, monkeypatch):
    wrote = []
    keep = components_module.materialize
    monkeypatch.setattr(components_module, "materialize", lambda df, name: wrote.append(name) or keep(df, name))
    star = written(spark, tmp_path, [(0, i) for i in range(1, 9)] + [(20, 21)], "a long, b long")
    assert {r.node: r.root for r in components(star, "a", "b").collect()} == {i: 0 for i in range(9)} | {20: 20, 21: 20}
    assert len(wrote) == 2
    # Further links join whole components, whose own links are not needed any more.
    more = written(spark, tmp_path, [(8, 21), (30, 31)], "a long, b long")
    roots = _joined(components(star, "a", "b"), more)
    assert {r.node: r.root for r in roots.collect()} == {i: 0 for i in [*range(9), 20, 21]} | {30: 30, 31: 30}


def test_bitmaps_are_as_large_as_the_rows_need(spark, tmp_path):
    assert marks_for(0) == marks_for(500) == 1 << 15 and marks_for(10**9) == MARKS
    assert all(32 * n <= marks_for(n) <= 64 * n for n in (2000, 51_282, 10**6))
    rows = written(spark, tmp_path, [(i,) for i in range(2000)], "rep long")
    ids = rows.where("rep % 20 = 3")
    kept = {r.rep for r in _marked(rows, ids, "rep", marks=marks_for(2000)).collect()}
    assert kept >= set(range(3, 2000, 20)) and len(kept) < 150
    left = {r.rep for r in _marked(rows, ids, "rep", others=True, marks=marks_for(2000)).collect()}
    assert left == set(range(2000)) - kept


def test_values_of_both_ends_are_shuffled_once(spark, tmp_path):
    pairs = written(spark, tmp_path, [(i, i + 50) for i in range(50)], "a long, b long")
    values = written(spark, tmp_path, [(i, 7 * i) for i in range(200)], "rep long, x long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = _with(pairs, values, "x", marks_for(200))
        assert all((r.a_value, r.b_value) == (7 * r.a, 7 * r.b) for r in both.collect()) and both.count() == 50
        both.collect()
        assert "ReusedExchange" in both._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_what_other_operators_keep_is_freed():
    freed = []
    first, second = lambda: freed.append(1), lambda: freed.append(2)
    for forget in (first, first, second, second, first):
        forget_others(forget)
    assert freed[-2:] == [1, 2]
    bottomk.shingle_hashes(b"one two three", 2)
    forget_others(bottomk._forget_words)
    bottomk.shingle_hashes(b"one two three", 2)
    forget_others(first)
    assert not bottomk._known and freed[-1] == 1

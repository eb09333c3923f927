import random
from collections import Counter, defaultdict

from recon.llm.mixing import mix, mixed
from tests.llm.tables import DOCS, docs_of, written


def shared_targets(sizes, weights=(3, 1, 2), budget=1.5):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    full = set()
    while True:
        left = budget * sum(sizes.values()) - sum(2 * sizes[n] for n in full)
        open_weight = sum(w[n] for n in names if n not in full)
        t = {n: 2 * sizes[n] if n in full else left * w[n] / open_weight for n in names}
        over = {n for n in names if n not in full and t[n] > 2 * sizes[n]}
        if not over:
            return t
        full |= over


def test_targets_and_taken_words(spark, tmp_path):
    rng = random.Random(5)
    sources = [rng.choice(["hot"] * 5 + ["a", "B", "é", "z", "", None]) for _ in range(600)]
    texts = [" ".join(rng.choice("ab c") for _ in range(rng.randrange(0, 40))) for _ in sources]
    texts[3], texts[4], texts[5] = None, "", "x" * 50_000
    df = docs_of(spark, tmp_path, texts, sources, more="times")
    rows = mix(df).collect()
    assert len(rows) == len(texts) and rows == mix(df).collect()
    size = {r.doc_id: r.size for r in rows}
    words = [len([w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w]) for t in texts]
    assert [size[i] for i in range(len(texts))] == words
    total, taken, target, largest = defaultdict(int), Counter(), {}, Counter()
    for r in rows:
        s = sources[r.doc_id]
        total[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        largest[s] = max(largest[s], r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    want = shared_targets(total)
    for s in total:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= largest[s] / 2 + 1
    copies = Counter(r.doc_id for r in mixed(df).collect())
    assert mixed(df).columns == df.columns
    assert copies == Counter({r.doc_id: r.times for r in rows if r.times})


def test_nothing_to_mix(spark, tmp_path):
    assert mix(written(spark, tmp_path, [], DOCS)).count() == 0
    rows = mix(docs_of(spark, tmp_path, [None, "", " \n"])).collect()
    assert [(r.size, r.taken, r.target) for r in rows] == [(0, 0, 0.0)] * 3


def test_repeated_rows_share_a_draw(spark, tmp_path):
    rows = [(77, "one two", "en", "s", 7)] * 5 + [(i, "three", "en", "s", 5) for i in range(50)]
    out = mix(written(spark, tmp_path, rows, DOCS)).collect()
    assert len({r.taken for r in out if r.doc_id == 77}) == 1 and len(out) == 55

import contextlib
import math
import tracemalloc
import weakref
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from recon.llm import ctw
from recon.llm.common import fold_of
from recon.llm.ctw import DEPTH, END, log_gamma, lm_scores
from tests.llm.tables import DOCS, docs_of, written


class Tree:
    """Context-tree weighting bit by bit, straight from the definition."""

    def __init__(self, texts):
        self.n = defaultdict(lambda: [0, 0])
        for t in texts:
            for i, byte, ctx in self.steps(t):
                for d in range(DEPTH + 1):
                    node = 1
                    for s in range(7, -1, -1):
                        bit = byte >> s & 1
                        self.n[node, ctx[DEPTH - d :]][bit] += 1
                        node = 2 * node + bit
        self.children = defaultdict(set)
        for node, ctx in self.n:
            if ctx:
                self.children[node, ctx[1:]].add(ctx)
        self.memo = {}

    @staticmethod
    def steps(text):
        whole = bytes([END]) * DEPTH + text + bytes([END])
        for i in range(DEPTH, len(whole)):
            yield i, whole[i], whole[i - DEPTH : i]

    @staticmethod
    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weighted(self, node, ctx):
        if (node, ctx) not in self.memo:
            own = self.kt(*self.n[node, ctx])
            if len(ctx) < DEPTH:
                below = sum(self.weighted(node, c) for c in self.children[node, ctx])
                own = np.logaddexp(own, below) - math.log(2)
            self.memo[node, ctx] = own
        return self.memo[node, ctx]

    def next_one(self, node, full, d=0):
        ctx = full[DEPTH - d :]
        a, b = self.n.get((node, ctx), (0, 0))
        here = (b + 0.5) / (a + b + 1)
        if d == DEPTH:
            return here
        own = math.exp(self.kt(a, b) - math.log(2) - self.weighted(node, ctx)) if a + b else 0.5
        return own * here + (1 - own) * self.next_one(node, full, d + 1)

    def log10(self, text):
        total = 0.0
        for _, byte, ctx in self.steps(text):
            node = 1
            for s in range(7, -1, -1):
                bit = byte >> s & 1
                one = self.next_one(node, ctx)
                total += math.log10(one if bit else 1 - one)
                node = 2 * node + bit
        return total


def test_against_the_definition(spark, tmp_path):
    texts = ["abab abc", "Abracadabra", "the cat", "the cats", None, "", "x" * 70 + " the cat", "b\tb\nb", "the hat", "cat the"] * 2
    df = docs_of(spark, tmp_path, texts, more="score")
    folds = {r.doc_id: r.f for r in df.select("doc_id", fold_of("doc_id", 7).alias("f")).collect()}
    lower = [(t or "").encode().lower() for t in texts]
    train = [t for i, t in enumerate(lower) if folds[i] != 2]
    tree = Tree(train)
    seen = {b for t in train for b in t} | {END}
    words = Counter(w for t in train for w in [*t.split(), b""])
    n, v = sum(words.values()), len(words)
    for r in lm_scores(df).collect():
        t = lower[r.doc_id]
        tokens = [*t.split(), b""]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (folds[r.doc_id] == 2, len(tokens), n)
        assert r.n_known == sum(words[w] > 0 for w in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens))
        # A context that was never met predicts as its longest ending, so contexts of other texts may differ.
        if folds[r.doc_id] != 2 and set(t) <= seen:
            assert r.score == pytest.approx(tree.log10(t), rel=1e-4)
        assert 0 < r.bits_per_byte < 9


def test_fewer_contexts_still_a_distribution(spark, tmp_path):
    df = docs_of(spark, tmp_path, ["abcde fghij klmno"] * 9 + ["pqrst uvwxy"])
    full = {r.doc_id: r.score for r in lm_scores(df).collect()}
    few = {r.doc_id: r.score for r in lm_scores(df, contexts=4).collect()}
    assert full.keys() == few.keys() and all(few[i] < 0 and full[i] > few[i] - 1 for i in full)


def test_contexts_out_of_memory_score_the_same(spark, tmp_path):
    texts = ["abcde fghij klmno", "abcdefgh", None, "zzzz abc abcd", "fghij klm \u00e9"] * 6 + ["pqrst uvwxy abcde", "\u00fc abcd fghi"] * 7
    df = docs_of(spark, tmp_path, texts)
    full = {r.doc_id: (r.score, r.bits_per_byte) for r in lm_scores(df).collect()}
    for held in (0, 4, 30):
        few = {r.doc_id: (r.score, r.bits_per_byte) for r in lm_scores(df, contexts=held).collect()}
        assert few.keys() == full.keys() and all(few[i] == pytest.approx(full[i], rel=1e-9) for i in full)


def test_a_task_holds_one_model(monkeypatch):
    alive, held = [], []

    class Held:
        def __init__(self, path, told, whole):
            alive.append([path for path, r in held if r() is not None])
            held.append((path, weakref.ref(self)))

    monkeypatch.setattr(ctw, "Model", Held)
    monkeypatch.setattr(ctw, "read_table", lambda path: pa.table({"key": [b"a"], "n": [3]}))
    for path in ("m1", "m2", "m2"):
        assert ctw._loaded(path, "words", (1, 2), True)[1] == {b"a": math.log10(4)}
    assert alive == [[], []]  # the first is gone before the second is read
    ctw.forget_model()
    assert all(r() is None for _, r in held)


def test_groups_of_strings_hold_no_model(spark, tmp_path, monkeypatch):
    kind = type(spark.range(1).groupBy("id"))
    plain, works = kind.applyInArrow, []

    def seen(self, work, schema):
        works.append(work)
        return plain(self, work, schema)

    monkeypatch.setattr(kind, "applyInArrow", seen)
    lm_scores(docs_of(spark, tmp_path, [f"some text {i} of words" for i in range(40)]), contexts=5)
    assert len(works) == 4  # pairs and last bytes, then the model's rows, then the answers to strings it lacks
    for work in works:
        ctw._models["an earlier table"] = None
        with contextlib.suppress(KeyError):  # no group has these columns
            work(pa.table({"other": [1]}))
        assert not ctw._models


def test_a_model_is_read_a_few_contexts_at_a_time(monkeypatch, tmp_path):
    told, rng = [97, 98, END], np.random.default_rng(1)
    rows = [(0, 0), (1, 98), (2, 97 << 8 | 98), (3, 97 << 16 | 98 << 8 | 97), (3, END << 16 | END << 8 | END), (4, 97 << 24 | 98 << 16 | 97 << 8 | 97)]
    rows += [(5, END << 32 | 97 << 24 | 98 << 16 | 97 << 8 | 97), (4, 98 << 24 | 97 << 16 | 98 << 8 | 97)]
    logs = -rng.random((len(rows), 4)).astype("<f4")
    for i in range(2):
        depth, context = (pa.array([r[c] for r in rows[i::2]], t) for c, t in ((0, pa.int32()), (1, pa.int64())))
        pq.write_table(pa.table({"depth": depth, "context": context, "logs": [x.tobytes() for x in logs[i::2]]}), tmp_path / f"part-{i}.parquet")
    monkeypatch.setattr(ctw, "READ_ROWS", 2)
    monkeypatch.setattr(ctw, "read_table", None)  # the whole table is not read at once
    model = ctw.Model(str(tmp_path), told)
    by = {r: x for r, x in zip(rows, logs)}
    column = {97: 0, 98: 1, END: 2}
    for text in (b"", b"abab", b"aba", b"zabab\xc3\xa9b", b"babaabab" * 3):
        whole, want = ctw.framed(text), 0.0
        for i in range(DEPTH, len(whole)):
            ending = [(d, int.from_bytes(whole[i - d : i], "big")) for d in range(6)]
            # Longer contexts hang below those of three bytes, one byte at a time.
            most = next((d for d in (3, 4, 5) if ending[d] not in by), 6) - 1
            node = ending[most] if most > 2 else next(e for e in reversed(ending[:3]) if e in by)
            want += float(by[node][column.get(whole[i], 3)])
        assert model.log10(text)[0] == pytest.approx(want / math.log(10), rel=1e-5)


def test_no_rows_and_no_training_rows(spark, tmp_path):
    assert lm_scores(written(spark, tmp_path, [], DOCS)).count() == 0
    ids = [r.id for r in spark.range(100).where(fold_of("id", 7) == 2).collect()]
    rows = lm_scores(written(spark, tmp_path, [(ids[0], "ab", None, None, None)], DOCS)).collect()
    assert rows[0].bits_per_byte == pytest.approx(8) and rows[0].base_score == 0


def test_logs_of_bytes_take_little_memory():
    assert ctw.byte_logs(np.empty((0, 255))).shape == (0, 256)
    ones = np.random.default_rng(2).uniform(0.01, 0.99, (2000, 255))
    tracemalloc.start()
    logs = ctw.byte_logs(ones)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * ones.nbytes
    for byte in (0, 1, 97, 255):
        bits = [(byte >> s & 1, (byte | 256) >> s + 1) for s in range(7, -1, -1)]
        want = sum(np.log(ones[:, node - 1] if bit else 1 - ones[:, node - 1]) for bit, node in bits)
        assert np.allclose(logs[:, byte], want)


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.9, 8.0, 100.5, 1e7])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x])

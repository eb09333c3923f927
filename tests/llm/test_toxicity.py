import pickle
import random
import weakref

import numpy as np
import pandas as pd

from recon.llm import gru
from recon.llm import toxicity as toxicity_module
from recon.llm.common import table
from recon.llm.toxicity import toxicity, without_toxic
from tests.llm.tables import DOCS, docs_of, written


def test_gradients_are_those_of_the_loss():
    p = {k: v.astype(np.float64) for k, v in gru.fresh(3).items()}
    words = ["alpha", "beta", "gamma.", "delta", "x"]
    rows = gru.word_rows(words)
    ids = np.zeros((3, gru.WINDOW), np.int64)
    ids[0, :5], ids[1, :2] = [1, 2, 3, 4, 5], [2, 2]
    y = np.array([1.0, 0.0, 0.0], np.float32)
    _, g = gru.gradients(p, rows, ids, y)
    rng = np.random.default_rng(0)
    for k in p:
        at = np.flatnonzero(g[k].reshape(-1)) if k in ("word", "char") else np.arange(p[k].size)
        for i in rng.choice(at, min(6, len(at)), replace=False):
            flat, old = p[k].reshape(-1), p[k].reshape(-1)[i]
            flat[i] = old + 1e-3
            up = gru.gradients(p, rows, ids, y)[0]
            flat[i] = old - 1e-3
            down = gru.gradients(p, rows, ids, y)[0]
            flat[i] = old
            assert abs((up - down) / 2e-3 - g[k].reshape(-1)[i]) < 2e-4, k


def test_windows_cover_every_word_and_long_texts():
    for n in (0, 1, 47, 48, 49, 80, 81, 500):
        w = gru.windows_of(np.arange(1, n + 1))
        assert set(w.reshape(-1)) - {gru.PAD} == set(range(1, n + 1))
    p = gru.fresh(1)
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(gru.BLOCK_WORDS + 5000))
    s = gru.Scorer(p)
    number = {}
    ids = gru.windows_of(np.array([number.setdefault(w, len(number) + 1) for w in text.split()]))
    gates = gru.projected(p, gru.inputs(p, gru.word_rows(list(number))))
    assert abs(s([text])[0] - gru.scores(p, gates, ids).max()) < 1e-5
    assert abs(s(["a b", text, ""])[1] - s([text])[0]) < 1e-6


def test_held_out_accuracy_and_clean_documents(spark):
    sf = "/root/testdata/sf0.1"  # fewer labels do not tell the words of four languages
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity(docs, labels).collect() if r.held_out and r.doc_id in truth]
    caught = [r.predicted for r in rows if truth[r.doc_id]]
    wrong = [r.predicted for r in rows if not truth[r.doc_id]]
    assert sum(caught) >= 0.75 * len(caught) and sum(wrong) <= 0.03 * len(wrong)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_nulls_one_kind_of_label_and_no_rows(spark, tmp_path):
    labels = written(spark, tmp_path, [(0, 1, 0), (1, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    df = docs_of(spark, tmp_path, ["a b c", None, "", "a b c"], more="score")
    rows = {r.doc_id: r.score for r in toxicity(df, labels).collect()}
    assert len(rows) == 4 and max(rows.values()) < 0.01 and rows[0] == rows[3] and rows[1] == rows[2]
    assert without_toxic(df, labels).columns == df.columns and without_toxic(df, labels).count() == 4
    assert toxicity(written(spark, tmp_path, [], DOCS), labels).count() == 0


def plain_score(p, text):
    """The highest window of a text by loops over words, without padding, batches or remembered words."""
    h, sigmoid = gru.HIDDEN, lambda v: 1 / (1 + np.exp(-v))
    words = text.lower().split()
    starts = [0]
    while starts[-1] + gru.WINDOW < len(words):
        starts.append(starts[-1] + gru.STRIDE)
    best = 0.0
    for at in starts:
        vectors = []
        for word in words[at : at + gru.WINDOW]:
            heads, grams, _ = gru.word_rows([word])
            vectors.append(np.concatenate([p["word"][heads[0]], np.mean([p["char"][g] for g in grams], axis=0)]))
        sides = []
        for side, order in ((0, vectors), (1, vectors[::-1])):
            state, out = np.zeros(h), []
            for v in order:
                x, hu = v @ p["w"][side] + p["b"][side][0], state @ p["u"][side]
                update, reset = sigmoid(x[:h] + hu[:h]), sigmoid(x[h : 2 * h] + hu[h : 2 * h])
                new = np.tanh(x[2 * h :] + reset * hu[2 * h :])
                state = update * state + (1 - update) * new
                out.append(state)
            sides.append(out if side == 0 else out[::-1])
        states = [np.concatenate(s) for s in zip(*sides)]
        weights = np.exp([s @ p["att"] for s in states])
        pooled = sum((w * s for w, s in zip(weights / weights.sum(), states)), np.zeros(2 * h)) if states else np.zeros(2 * h)
        best = max(best, sigmoid(pooled @ p["out"] + p["bias"][0]))
    return best


def test_scores_against_plain_loops():
    p = gru.fresh(5)
    rng = random.Random(5)
    vocabulary = ["fool", "Good", "day,", "(x)", "ünï", "字", "a-b", "%", *[f"w{i}" for i in range(60)]]
    texts = ["", "one", "  Fool fool  "] + [" ".join(rng.choices(vocabulary, k=n)) for n in (2, 31, 47, 48, 49, 64, 80, 81, 113, 400)]
    want = [plain_score({k: v.astype(np.float64) for k, v in p.items()}, t) for t in texts]
    got = gru.Scorer(p)(texts)
    assert np.abs(got - want).max() < 1e-4
    assert len({round(x, 4) for x in want}) > 8  # the texts do differ


def test_a_task_keeps_no_network(spark, monkeypatch):
    made = []

    class Seen(gru.Scorer):
        def __init__(self, p):
            super().__init__(p)
            made.append(weakref.ref(self))

    score = toxicity_module.scorer(pickle.dumps(gru.fresh())).__closure__[0].cell_contents
    monkeypatch.setattr(gru, "Scorer", Seen)
    parts = list(score.func(iter([pd.Series(["one two", ""]), pd.Series(["three"])])))
    assert [len(p) for p in parts] == [2, 1] and len(made) == 1
    assert made[0]() is None

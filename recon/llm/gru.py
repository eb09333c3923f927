"""A small bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters as a word vector beside the mean of the vectors of its character
3- and 4-grams and of its beginnings. Both kinds of vectors are hashed into fixed tables, so the network
has a fixed size. A text is a sequence of overlapping windows of words; its score
is that of its highest window.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

WINDOW, STRIDE = 48, 32
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 12
WORD_ROWS, CHAR_ROWS = 1 << 14, 1 << 15
LEAST_ROUNDS, MOST_ROUNDS, STEPS = 8, 60, 500
KEEP = 30.0  # update-gate input of the padding word: the state passes unchanged
STARTS = (6, 7, 8, 9, 10)  # lengths of word beginnings, with the mark, that count as n-grams
PAD = 0  # its number

Params = dict[str, np.ndarray]


def words_of(text: str) -> list[str]:
    return text.lower().split()


def window_starts(n: int) -> np.ndarray:
    """First words of the windows over n words; every word is in one or two of them. No words: one empty window."""
    return np.arange(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def word_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table row of each word, and flat table rows of its character n-grams with their first places."""
    heads, grams, first = array("q"), array("i"), array("q")
    for w in words:
        core = w.strip(".,;:!?\"'()[]{}*#%&-_") or w
        heads.append(zlib.crc32(core.encode()) % WORD_ROWS)
        first.append(len(grams))
        b = f"<{core}>".encode()
        grams.extend([zlib.crc32(b[i : i + 3]) % CHAR_ROWS for i in range(len(b) - 2)])
        grams.extend([zlib.crc32(b[i : i + 4], 1) % CHAR_ROWS for i in range(len(b) - 3)])
        grams.extend([zlib.crc32(b[:i], 2) % CHAR_ROWS for i in STARTS if i < len(b)])
    return np.array(heads, np.int64), np.array(grams, np.int32), np.array(first, np.int64)


def fresh(seed: int = 0) -> Params:
    rng = np.random.default_rng(seed)
    d, h = WORD_DIM + CHAR_DIM, HIDDEN

    def rand(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return {
        "word": rand(WORD_ROWS, WORD_DIM, scale=0.1),
        "char": rand(CHAR_ROWS, CHAR_DIM, scale=0.3),
        "w": rand(2, d, 3 * h, scale=d**-0.5),  # gates: update, reset, new; directions: forward, backward
        "u": rand(2, h, 3 * h, scale=h**-0.5),
        "b": np.zeros((2, 1, 3 * h), np.float32),
        "att": rand(2 * h, scale=0.1),
        "out": rand(2 * h, scale=0.3),
        "bias": np.array([-1.0], np.float32),
    }


def inputs(p: Params, rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    heads, grams, first = rows
    if not len(heads):
        return np.empty((0, WORD_DIM + CHAR_DIM), np.float32)
    counts = np.diff(np.append(first, len(grams)))[:, None].astype(np.float32)
    return np.hstack([p["word"][heads], np.add.reduceat(p["char"][grams], first, axis=0) / counts])


def projected(p: Params, x: np.ndarray) -> np.ndarray:
    """(2, words + 1, 3h): gate inputs of every word in both directions; row PAD keeps the state."""
    g = x[None] @ p["w"] + p["b"]
    pad = np.zeros((2, 1, 3 * HIDDEN), np.float32)
    pad[:, :, :HIDDEN] = KEEP
    return np.concatenate([pad, g.astype(np.float32)], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _attend(p: Params, states: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Attention weights (time, batch), pooled states and logits."""
    a = states @ p["att"]
    a[~real] = -np.inf
    top = a.max(0)
    top[~np.isfinite(top)] = 0
    e = np.exp(a - top)
    e /= np.maximum(e.sum(0), 1e-30)
    pooled = (states * e[:, :, None]).sum(0)
    return e, pooled, pooled @ p["out"] + p["bias"][0]


def scores(p: Params, gates: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Probability of every window; ids (batch, WINDOW) are rows of `gates`."""
    h, u, t_end = HIDDEN, p["u"], ids.shape[1]
    cols = np.ascontiguousarray(ids.T)
    state = np.zeros((2, len(ids), h), np.float32)
    states = np.empty((t_end, len(ids), 2 * h), np.float32)
    for t in range(t_end):
        x = np.stack([gates[0][cols[t]], gates[1][cols[t_end - 1 - t]]])
        hu = state @ u
        x[:, :, : 2 * h] += hu[:, :, : 2 * h]
        zr = _sigmoid(x[:, :, : 2 * h])
        n = np.tanh(x[:, :, 2 * h :] + zr[:, :, h:] * hu[:, :, 2 * h :])
        state = n + zr[:, :, :h] * (state - n)
        states[t, :, :h] = state[0]
        states[t_end - 1 - t, :, h:] = state[1]
    return _sigmoid(_attend(p, states, cols != PAD)[2])


def gradients(p: Params, rows: tuple, ids: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
    """Mean log loss of windows and its gradients; ids point into the words described by `rows`, 1 for the first."""
    used, ids = np.unique(ids, return_inverse=True)
    ids = ids.reshape(len(y), -1)
    if used[0] != PAD:
        ids, used = ids + 1, np.append(PAD, used)
    heads, grams, first = rows
    ends = np.append(first, len(grams))
    words = used[1:] - 1
    counts = ends[words + 1] - ends[words]
    starts = np.append(0, np.cumsum(counts))[:-1]
    own = np.arange(counts.sum()) + np.repeat(ends[words] - starts, counts)
    part = (heads[words], grams[own], starts)
    x = inputs(p, part)
    gates = projected(p, x)
    h, u, t_end, n_win = HIDDEN, p["u"], ids.shape[1], len(y)
    cols = ids.T
    state = np.zeros((2, n_win, h), np.float32)
    kept, states = [], np.empty((t_end, n_win, 2 * h), np.float32)
    for t in range(t_end):
        g = np.stack([gates[0][cols[t]], gates[1][cols[t_end - 1 - t]]])
        hu = state @ u
        zr = _sigmoid(g[:, :, : 2 * h] + hu[:, :, : 2 * h])
        n = np.tanh(g[:, :, 2 * h :] + zr[:, :, h:] * hu[:, :, 2 * h :])
        kept.append((state, zr, n, hu[:, :, 2 * h :]))
        state = n + zr[:, :, :h] * (state - n)
        states[t, :, :h] = state[0]
        states[t_end - 1 - t, :, h:] = state[1]
    e, pooled, logit = _attend(p, states, cols != PAD)
    prob = _sigmoid(logit)
    loss = -np.mean(np.log(np.where(y > 0, prob, 1 - prob) + 1e-7))

    d_logit = ((prob - y) / n_win).astype(np.float32)
    out = {k: np.zeros_like(v) for k, v in p.items()}
    out["bias"][0] = d_logit.sum()
    out["out"] = pooled.T @ d_logit
    d_pooled = d_logit[:, None] * p["out"]
    d_e = (states * d_pooled).sum(2)
    d_a = e * (d_e - (e * d_e).sum(0))
    out["att"] = np.tensordot(d_a, states, ([0, 1], [0, 1]))
    d_states = e[:, :, None] * d_pooled + d_a[:, :, None] * p["att"]

    d_gates = np.zeros_like(gates)
    d_next = np.zeros((2, n_win, h), np.float32)
    for t in range(t_end - 1, -1, -1):
        before, zr, n, hn = kept[t]
        z, r = zr[:, :, :h], zr[:, :, h:]
        d = d_next + np.stack([d_states[t, :, :h], d_states[t_end - 1 - t, :, h:]])
        d_n = d * (1 - z) * (1 - n * n)
        d_z = d * (before - n) * z * (1 - z)
        d_r = d_n * hn * r * (1 - r)
        d_x = np.concatenate([d_z, d_r, d_n], axis=2)
        d_h = np.concatenate([d_z, d_r, d_n * r], axis=2)
        out["u"] += before.transpose(0, 2, 1) @ d_h
        d_next = d * z + d_h @ u.transpose(0, 2, 1)
        np.add.at(d_gates[0], cols[t], d_x[0])
        np.add.at(d_gates[1], cols[t_end - 1 - t], d_x[1])
    d_gates = d_gates[:, 1:]
    out["w"] = x.T[None] @ d_gates
    out["b"] = d_gates.sum(1, keepdims=True)
    d_in = (d_gates @ p["w"].transpose(0, 2, 1)).sum(0)
    np.add.at(out["word"], part[0], d_in[:, :WORD_DIM])
    spread = np.repeat(d_in[:, WORD_DIM:] / np.maximum(counts, 1)[:, None], counts, axis=0)
    np.add.at(out["char"], part[1], spread)
    return float(loss), out


class Adam:
    def __init__(self, p: Params, rate: float):
        self.rate, self.step = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def update(self, p: Params, g: Params) -> None:
        self.step += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k in p:
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.v[k] += 0.001 * (g[k] * g[k] - self.v[k])
            p[k] -= scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


def windows_of(numbers: np.ndarray) -> np.ndarray:
    """(windows, WINDOW) word numbers of one text, padded at the end."""
    starts = window_starts(len(numbers))
    padded = np.zeros(starts[-1] + WINDOW, np.int64)
    padded[: len(numbers)] = numbers
    return padded[starts[:, None] + np.arange(WINDOW)]


def train(texts: list[str], labels: list[int], batch: int = 128, rate: float = 0.01, seed: int = 0) -> Params:
    """Learn from whole texts: each round trains on the highest window of every text, and on one more of each clean text.

    Only some windows of a toxic text are toxic, and which is not told; the highest
    one is taken for toxic. The first rounds draw windows at random instead. Toxic
    texts are drawn up to twice a round, since they are rare. There are LEAST_ROUNDS
    rounds, and up to MOST_ROUNDS for few texts, to reach STEPS steps.
    """
    p, rng = fresh(seed), np.random.default_rng(seed)
    number: dict[str, int] = {}
    cut = [windows_of(np.array([number.setdefault(w, len(number) + 1) for w in words_of(t)], np.int64)) for t in texts]
    if len(set(labels)) < 2:  # nothing to tell apart
        p["out"][:] = 0
        p["bias"][0] = 9.0 if labels and labels[0] else -9.0
        return p
    rows = word_rows(list(number))
    y = np.array(labels)
    owner = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
    every = np.concatenate(cut)
    opt = Adam(p, rate)
    times = min(2, max(1, int((y == 0).sum() // (y == 1).sum())))
    per_round = (2 * (y == 0).sum() + times * (y == 1).sum()) / batch
    rounds = min(MOST_ROUNDS, max(LEAST_ROUNDS, int(STEPS / per_round)))
    for r in range(rounds):
        opt.rate = rate * (1 - 0.8 * r / rounds)
        if r < rounds // 5 + 1:
            s = rng.random(len(every))
        else:
            gates = projected(p, inputs(p, rows))
            s = np.concatenate([scores(p, gates, every[i : i + 2048]) for i in range(0, len(every), 2048)])
        order = np.lexsort((s, owner))
        last = np.append(np.flatnonzero(np.diff(owner)), len(owner) - 1)
        top = order[last]
        clean = np.flatnonzero(y[owner] == 0)
        more = rng.choice(clean, min(len(clean), int((y == 0).sum())), replace=False)
        chosen = np.concatenate([top[y == 0], np.repeat(top[y == 1], times), more])
        rng.shuffle(chosen)
        for i in range(0, len(chosen), batch):
            part = chosen[i : i + batch]
            _, g = gradients(p, rows, every[part], y[owner[part]].astype(np.float32))
            opt.update(p, g)
    return p


LONG_TEXT = 1_000_000  # characters from which words are found one by one instead of as a list
BLOCK_WORDS = 64_000
KNOWN_WORDS = 300_000


class Scorer:
    """Scores texts with a trained network and remembers the gate inputs of the first KNOWN_WORDS different words."""

    def __init__(self, p: Params):
        self.p, self.known = p, {}
        self.gates = np.zeros((2, KNOWN_WORDS + 1 + BLOCK_WORDS + WINDOW, 3 * HIDDEN), np.float32)
        self.gates[:, :1] = projected(p, np.empty((0, WORD_DIM + CHAR_DIM), np.float32))

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Rows of `gates` for at most BLOCK_WORDS + WINDOW words; rows behind KNOWN_WORDS hold for this call only."""
        numbers = list(map(self.known.get, words))
        if None in numbers:
            new = list(dict.fromkeys(w for w, n in zip(words, numbers) if n is None))
            gates = projected(self.p, inputs(self.p, word_rows(new)))[:, 1:]
            stays = len(self.known) + len(new) <= KNOWN_WORDS
            at = len(self.known) + 1 if stays else KNOWN_WORDS + 1
            self.gates[:, at : at + len(new)] = gates
            own = dict(zip(new, range(at, at + len(new))))
            if stays:
                self.known.update(own)
            numbers = [own[w] if n is None else n for w, n in zip(words, numbers)]
        return np.array(numbers, np.int64)

    def _parts(self, text: str) -> Iterator[list[str]]:
        """The words in parts of whole strides, each repeating the overlap with the part before."""
        words = iter(words_of(text)) if len(text) < LONG_TEXT else (m[0].lower() for m in re.finditer(r"\S+", text))
        part: list[str] = []
        size = BLOCK_WORDS // STRIDE * STRIDE + WINDOW - STRIDE
        for w in words:
            if len(part) == size:
                yield part
                part = part[-(WINDOW - STRIDE) :]
            part.append(w)
        yield part

    def __call__(self, texts: Iterable[str]) -> np.ndarray:
        """The highest window score of each whole text."""
        best: list[float] = []
        waiting: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            nonlocal waiting, size
            if not waiting:
                return
            numbers = self._numbers([w for _, part in waiting for w in part])
            ends = np.cumsum([len(part) for _, part in waiting])
            cut = [windows_of(x) for x in np.split(numbers, ends[:-1])]
            owner = np.repeat([i for i, _ in waiting], [len(c) for c in cut])
            every = np.concatenate(cut)
            for i in range(0, len(every), 2048):
                for o, s in zip(owner[i : i + 2048].tolist(), scores(self.p, self.gates, every[i : i + 2048]).tolist()):
                    best[o] = max(best[o], s)
            waiting, size = [], 0

        for i, text in enumerate(texts):
            best.append(0.0)
            for part in self._parts(text):
                if size + len(part) > BLOCK_WORDS + WINDOW - STRIDE:
                    flush()
                waiting.append((i, part))
                size += len(part)
        flush()
        return np.array(best, np.float64)

"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, from the highest bit down; each decision node
has its own context tree over the preceding bytes, up to DEPTH of them. In every
tree node the Krichevsky-Trofimov estimate of its own counts is weighed against
the product of its children, half and half, and the prediction for a new bit
mixes the estimates of all depths on the path with the weights the corpus gave
them. All that is needed from the corpus are counts of byte strings of length
DEPTH + 1, which every task counts for itself and Spark sums.

Texts end with byte 0xFF, which UTF-8 never uses, and start behind DEPTH of them,
so probabilities of texts sum to one.

The word model beside it is a plain unigram model with one added to each count.
Frequent words are looked up in tasks, all others by a join.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recon.llm.common import fold_of, whole_text
from recon.llm.files import read_batches, read_table
from recon.plans.lineage import materialize, scratch_path

DEPTH = 5
FOLDS, HELD_OUT = 7, 2
END = 0xFF
CHUNK = 1 << 22  # bytes of text handled at once
FLUSH_WORDS = 200_000  # different words a task gathers before it sends them on
HOT_WORDS = 1 << 18  # a word with more than one in so many tokens is looked up in tasks; so there are fewer of them
WORD_BYTES = 64  # longer words go by their digest
MODEL_CONTEXTS = 1 << 18  # contexts of three to DEPTH bytes that scoring keeps in memory, the most frequent ones; bytes behind others are joined
BLOCK_CONTEXTS = 2048  # full-depth contexts whose decision nodes are spread out at once
READ_ROWS = 8192  # contexts of the model read at once
SCORE_ROWS = 1000  # texts whose scores are gathered before they are sent on


def word_key(word: bytes) -> bytes:
    """The word, or a digest that no word can equal if it is long."""
    return word if len(word) <= WORD_BYTES else b"\xff" + hashlib.blake2b(word, digest_size=32).digest()


def framed(text: bytes) -> bytes:
    return bytes([END]) * DEPTH + text + bytes([END])


def codes(data: np.ndarray) -> np.ndarray:
    """Each byte from the DEPTH-th on behind the DEPTH bytes before it, as one number."""
    d = data.astype(np.uint64)
    n = len(d) - DEPTH
    out = d[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        out |= d[DEPTH - back : DEPTH - back + n] << np.uint64(8 * back)
    return out


def _pieces(text: bytes) -> Iterator[np.ndarray]:
    """The framed text in parts that overlap by DEPTH bytes, so that every byte is coded once."""
    whole = np.frombuffer(framed(text), np.uint8)
    for at in range(0, len(whole) - DEPTH, CHUNK):
        yield whole[at : at + CHUNK + DEPTH]


def count_strings(rows: DataFrame) -> DataFrame:
    """(kind, key, n) from (text): kind 0 are byte strings (8 bytes, big-endian), kind 1 words, the empty word being the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_model()  # that of an earlier table, if this process has scored one

        def rows_of(kind: int, keys: pa.Array, n: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), keys, n], names=["kind", "key", "n"])

        def words_rows() -> pa.RecordBatch:
            return rows_of(1, pa.array(list(words.keys()), pa.binary()), pa.array(list(words.values()), pa.int64()))

        def string_rows() -> pa.RecordBatch:
            found, n = strings
            raw = pa.py_buffer(found.astype(">u8").tobytes())
            keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), len(found), [None, raw])
            return rows_of(0, keys.cast(pa.binary()), pa.array(n))

        words: Counter = Counter()
        strings: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.int64))
        waiting: list[np.ndarray] = []
        held = 0

        def fold() -> None:
            nonlocal strings, waiting, held
            held = 0
            new, n = np.unique(np.concatenate(waiting), return_counts=True)
            both, at = np.unique(np.concatenate([strings[0], new]), return_inverse=True)
            strings, waiting = (both, np.bincount(at, np.concatenate([strings[1], n])).astype(np.int64)), []

        for batch in batches:
            for text in batch.column(0):
                low = text.as_py().encode().lower()
                words.update(map(word_key, low.split()))
                words[b""] += 1
                for piece in _pieces(low):
                    waiting.append(codes(piece))
                    held += len(waiting[-1])
                    if held >= CHUNK // 4:
                        fold()
            if len(words) > FLUSH_WORDS:
                yield words_rows()
                words.clear()
            if len(strings[0]) > FLUSH_WORDS * 3:
                yield string_rows()
                strings = (np.empty(0, np.uint64), np.empty(0, np.int64))
        if waiting:
            fold()
        yield words_rows()
        yield string_rows()

    parts = rows.mapInArrow(run, "kind int, key binary, n long")
    return parts.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0, by Stirling's series above 8."""
    small = x < 8
    y = np.where(small, x + 8, x)
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    if small.any():
        part = x[small]
        down = np.zeros_like(part)
        for i in range(8):
            down += np.log(part + i)
        out[small] -= down
    return out


def decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones met at the 255 decision nodes, from (contexts, 256) byte counts; node i is column i - 1."""
    tree = np.zeros((len(counts), 512))
    tree[:, 256:] = counts
    for low in (128, 64, 32, 16, 8, 4, 2, 1):
        tree[:, low : 2 * low] = tree[:, 2 * low : 4 * low : 2] + tree[:, 2 * low + 1 : 4 * low : 2]
    return tree[:, 2:512:2], tree[:, 3:512:2]


_HALVES = log_gamma(np.arange(1 << 12) + 0.5)
_WHOLES = log_gamma(np.arange(1 << 12) + 1.0)


def _log_gamma_at(n: np.ndarray, plus: float, table: np.ndarray) -> np.ndarray:
    out = table[np.minimum(n, len(table) - 1).astype(np.int64)]
    large = n >= len(table)
    if large.any():
        out[large] = log_gamma(n[large] + plus)
    return out


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a bit string."""
    return (
        _log_gamma_at(zeros, 0.5, _HALVES) + _log_gamma_at(ones, 0.5, _HALVES) - math.log(math.pi)
        - _log_gamma_at(zeros + ones, 1.0, _WHOLES)
    )


def kt_next(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Its probability of a one next."""
    return (ones + 0.5) / (zeros + ones + 1)


def weigh(counts: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of the weighted probability of contexts at their decision nodes, and the weight of their own estimates.

    `counts` (contexts, 256) are their byte counts, `children` (contexts, 255) the
    summed ln of their children's weighted probabilities.
    """
    own = kt_log(*decisions(counts)) - math.log(2)
    both = np.logaddexp(own, children - math.log(2))
    return both, np.exp(own - both)


def byte_logs(ones: np.ndarray) -> np.ndarray:
    """(contexts, 256) ln probabilities of bytes from the probability of a one at each decision node."""
    zero, one = np.log(1 - ones), np.log(ones)
    out = np.zeros((len(ones), 1))
    for first in (0, 1, 3, 7, 15, 31, 63, 127):
        level = slice(first, 2 * first + 1)
        out = np.stack([out + zero[:, level], out + one[:, level]], axis=2).reshape(len(ones), 2 * first + 2)
    return out


class Branch:
    """The context trees below one pair of last bytes, from the strings that end in it.

    Contexts of five bytes come in blocks of whole four-byte contexts, so that
    memory for decision nodes is bounded; what stays are the nodes of four and
    three bytes.
    """

    def __init__(self, code: np.ndarray, n: np.ndarray):
        byte = [(code >> (8 * i)) & 255 for i in range(6)]  # 0 is the byte itself, 1 the one before it
        order = np.lexsort((byte[0], byte[5], byte[4], byte[3]))
        code, self.n, self.byte = code[order], n[order].astype(np.float64), byte[0][order]
        self.context = code >> 8
        deep = np.stack([byte[i][order] for i in (3, 4, 5)])
        new5 = np.append(True, (np.diff(deep) != 0).any(0))
        new4 = np.append(True, (np.diff(deep[:2]) != 0).any(0))
        new3 = np.append(True, np.diff(deep[0]) != 0)
        self.first5 = np.flatnonzero(new5)
        self.at5 = np.cumsum(new5) - 1
        self.first4 = np.flatnonzero(new4[self.first5])  # as places among the five-byte contexts
        self.first3 = np.flatnonzero(new3[self.first5][self.first4])  # as places among the four-byte contexts
        logs, counts = [], []
        for _, counts5, starts in self.blocks():
            logs.append(np.add.reduceat(kt_log(*decisions(counts5)), starts))
            counts.append(np.add.reduceat(counts5, starts))
        self.counts4 = np.concatenate(counts)
        logs4, self.own4 = weigh(self.counts4, np.concatenate(logs))
        self.counts3 = np.add.reduceat(self.counts4, self.first3)
        logs3, self.own3 = weigh(self.counts3, np.add.reduceat(logs4, self.first3))
        self.counts2 = self.counts3.sum(0)
        self.logs2, self.own2 = weigh(self.counts2[None], logs3.sum(0)[None])

    def blocks(self):
        """(first four-byte context, byte counts of five-byte contexts, where each four-byte one starts)."""
        ends4 = np.append(self.first4, len(self.first5))
        ends = np.append(self.first5, len(self.n))
        a = 0
        while a < len(self.first4):
            b = max(a + 1, int(np.searchsorted(ends4, ends4[a] + BLOCK_CONTEXTS, side="right")) - 1)
            low, high = ends4[a], ends4[b]
            rows = slice(ends[low], ends[high])
            counts = np.zeros((high - low, 256))
            counts[self.at5[rows] - low, self.byte[rows]] = self.n[rows]
            yield a, counts, self.first4[a:b] - low
            a = b

    def sizes(self) -> np.ndarray:
        """How many contexts of three to five bytes were met at least 2^j times, j from 0 to 47."""
        met = np.concatenate([np.add.reduceat(self.n, self.first5), self.counts4.sum(1), self.counts3.sum(1)])
        return (met[:, None] >= 2.0 ** np.arange(48)).sum(0)

    def predictions(
        self, two: Callable[[np.ndarray], np.ndarray], least: float, asked: Callable[[int, np.ndarray], np.ndarray] | None = None
    ):
        """(depth, contexts, ones) of contexts met at least `least` times, of three and more bytes only those that `asked` tells.

        `two` maps the prediction of deeper contexts to the mixture with all shallower ones.
        """
        told = asked or (lambda depth, context: np.ones(len(context), bool))
        next3, next4 = kt_next(*decisions(self.counts3)), kt_next(*decisions(self.counts4))
        context4 = self.context[self.first5[self.first4]]
        met3 = (self.counts3.sum(1) >= least) & told(3, context4[self.first3] & 0xFFFFFF)
        met4 = (self.counts4.sum(1) >= least) & told(4, context4 & 0xFFFFFFFF)
        yield 2, self.context[:1] & 0xFFFF, two(kt_next(*decisions(self.counts2[None])))
        yield 3, (context4[self.first3] & 0xFFFFFF)[met3], two(self.below2(next3[met3]))
        up3 = np.repeat(np.arange(len(self.first3)), np.diff(np.append(self.first3, len(self.first4))))
        mix3 = lambda at, deeper: self.below2(self.own3[at] * next3[at] + (1 - self.own3[at]) * deeper)
        yield 4, (context4 & 0xFFFFFFFF)[met4], two(mix3(up3[met4], next4[met4]))
        for a, counts5, starts in self.blocks():
            first = self.first4[a]
            context5 = self.context[self.first5[first : first + len(counts5)]]
            take = (counts5.sum(1) >= least) & told(5, context5)
            up4 = a + np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(counts5))))[take]
            own = self.own4[up4] * next4[up4] + (1 - self.own4[up4]) * kt_next(*decisions(counts5[take]))
            yield 5, context5[take], two(mix3(up3[up4], own))

    def below2(self, deeper: np.ndarray) -> np.ndarray:
        return self.own2 * kt_next(*decisions(self.counts2[None])) + (1 - self.own2) * deeper


def build_model(
    strings: DataFrame, path: str, contexts: int = MODEL_CONTEXTS
) -> tuple[list[int], Callable[[DataFrame], DataFrame] | None]:
    """Write predictions to `path` as (depth, context, logs), and return the bytes that `logs` tells one by one.

    `strings` has (code, n). Work is dealt by the last two bytes of the context;
    above that, groups have at most 256 members, and so has what the driver sees.
    `logs` are 32-bit ln probabilities of the bytes met in training and last one for
    each other byte, which share what is left evenly. A context that was never met
    is predicted as its longest ending that was. At most `contexts` contexts of three
    and more bytes are written; if there are others, the second result maps strings
    (code) to their ln probabilities (code, log) from all contexts.
    """
    spark = strings.sparkSession
    node = "counts array<double>, logs array<double>, sizes array<long>"

    def grouped(rows: DataFrame, by: str, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        def alone(group: pa.Table) -> pa.Table:
            forget_model()  # groups need none: they come before scoring, with that of an earlier table, or after it
            return work(group)

        return rows.groupBy(by).applyInArrow(alone, schema)

    def second(group: pa.Table) -> pa.Table:
        b = Branch(group["code"].to_numpy(), group["n"].to_numpy())
        return pa.table({"pair": group["pair"][:1], "counts": [b.counts2], "logs": [b.logs2[0]], "sizes": [b.sizes()]})

    def stacked(group: pa.Table, name: str, width: int) -> np.ndarray:
        return pa.concat_arrays(group[name].chunks).flatten().to_numpy().reshape(-1, width)

    def first(group: pa.Table) -> pa.Table:
        counts = stacked(group, "counts", 256).sum(0)
        logs, own = weigh(counts[None], stacked(group, "logs", 255).sum(0)[None])
        sizes = stacked(group, "sizes", 48).sum(0)
        return pa.table({"last": group["last"][:1], "counts": [counts], "logs": [logs[0]], "sizes": [sizes], "own": [own[0]]})

    paired = strings.withColumn("pair", F.shiftright("code", 8).bitwiseAND(0xFFFF))
    pairs = grouped(paired, "pair", second, f"pair long, {node}")
    pairs = pairs.withColumn("last", F.col("pair").bitwiseAND(255))
    singles = grouped(pairs, "last", first, f"last long, {node}, own array<double>").collect()

    counts1 = {r["last"]: np.array(r["counts"]) for r in singles}
    own1 = {r["last"]: np.array(r["own"]) for r in singles}
    counts0 = sum(counts1.values(), np.zeros(256))
    _, own0 = weigh(counts0[None], sum((np.array(r["logs"]) for r in singles), np.zeros(255))[None])
    next0 = kt_next(*decisions(counts0[None]))
    next1 = {b: kt_next(*decisions(c[None])) for b, c in counts1.items()}
    sizes = sum((np.array(r["sizes"]) for r in singles), np.zeros(48))
    least = 2.0 ** int(np.argmax(sizes <= contexts))
    told = np.flatnonzero(counts0).tolist()

    def logs_of(ones: np.ndarray) -> np.ndarray:
        logs = byte_logs(ones)
        rest = 1 - np.exp(logs[:, told]).sum(1)
        other = np.log(np.maximum(rest, 1e-300) / max(1, 256 - len(told)))
        return np.hstack([logs[:, told], other[:, None]]).astype("<f4")

    def rows_of(depth: int, context: np.ndarray, ones: np.ndarray) -> pa.Table:
        logs = logs_of(ones)
        return pa.table(
            {
                "depth": pa.array(np.full(len(context), depth, np.int32)),
                "context": pa.array(context.astype(np.int64)),
                "logs": pa.array([x.tobytes() for x in logs], pa.binary()),
            }
        )

    def with_shorter(last: int) -> Callable[[np.ndarray], np.ndarray]:
        return lambda deeper: own0 * next0 + (1 - own0) * (own1[last] * next1[last] + (1 - own1[last]) * deeper)

    def one(last: int) -> np.ndarray:
        return own0 * next0 + (1 - own0) * next1[last]

    def full(group: pa.Table) -> pa.Table:
        two = with_shorter(group["pair"][0].as_py() & 255)
        b = Branch(group["code"].to_numpy(), group["n"].to_numpy())
        return pa.concat_tables([rows_of(*x) for x in b.predictions(two, least)])

    column = np.full(256, len(told))
    column[told] = np.arange(len(told))

    def answers(group: pa.Table) -> pa.Table:
        last = group["pair"][0].as_py() & 255
        code, n = group["code"].to_numpy(), group["n"].to_numpy()
        asked = np.sort(code[n == 0])
        context, col = asked >> 8, column[asked & 255]
        endings = {d: context & ((1 << 8 * d) - 1) for d in (3, 4, 5)}
        log = logs_of(one(last) if last in next1 else next0)[0][col]
        if (n > 0).any() and len(asked):
            b = Branch(code[n > 0], n[n > 0])
            for depth, met, ones in b.predictions(with_shorter(last), 1, lambda d, c: np.isin(c, endings[d])):
                # Longer endings come later, those of one depth in any order.
                order = np.argsort(met)
                own = endings[depth] if depth > 2 else context & 0xFFFF
                for at in range(0, len(met), BLOCK_CONTEXTS):
                    some = order[at : at + BLOCK_CONTEXTS]
                    place = np.minimum(np.searchsorted(met[some], own), len(some) - 1)
                    hit = met[some][place] == own
                    log[hit] = logs_of(ones[some])[place[hit], col[hit]]
        return pa.table({"code": asked, "log": log.astype(np.float64)})

    def answered(codes: DataFrame) -> DataFrame:
        asked = codes.select("code", F.lit(0).cast("long").alias("n"), F.shiftright("code", 8).bitwiseAND(0xFFFF).alias("pair"))
        return grouped(paired.unionByName(asked), "pair", answers, "code long, log double")

    schema = "depth int, context long, logs binary"
    upper = [rows_of(0, np.zeros(1, np.int64), next0)]
    upper += [rows_of(1, np.array([b]), one(b)) for b in counts1]
    tops = [(r["depth"], r["context"], bytearray(r["logs"])) for t in upper for r in t.to_pylist()]
    deep = grouped(paired, "pair", full, schema)
    deep.unionByName(spark.createDataFrame(tops, schema)).write.parquet(path)
    return told, answered if least > 1 else None


class Model:
    """The predictions in memory: node numbers by context, and a row of logarithms for each node; `whole` if no context is missing."""

    def __init__(self, path: str, told: list[int], whole: bool = True):
        self.whole = whole
        small = list(read_batches(path, ["depth", "context"], READ_ROWS))
        depth, context = (np.concatenate([b.column(i).to_numpy() for b in small]) for i in (0, 1))
        order = np.lexsort((context, depth))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        depth, context = depth[order], context[order]
        self.width = len(told) + 1
        self.logs = np.empty((len(depth), self.width), "<f4")
        first = 0
        for b in read_batches(path, ["logs"], READ_ROWS):  # straight to their places, so that no second copy of all rows is held
            chunk = b.column(0)
            offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            own = np.frombuffer(chunk.buffers()[2], "<f4")[offsets[0] // 4 : offsets[-1] // 4]
            self.logs[place[first : first + len(chunk)]] = own.reshape(len(chunk), self.width)
            first += len(chunk)
        self.logs = self.logs.reshape(-1)
        pa.default_memory_pool().release_unused()
        self.column = np.full(256, len(told), np.int32)
        self.column[told] = np.arange(len(told))
        # By columns, as every byte of a context that was met has its own.
        three = np.zeros((self.width,) * 3, np.int32)
        for i in np.flatnonzero(depth == 1).tolist():
            three[:, :, self.column[context[i]]] = i
        for i in np.flatnonzero(depth == 2).tolist():
            three[:, self.column[context[i] >> 8], self.column[context[i] & 255]] = i
        three = three.reshape(-1)
        at = np.flatnonzero(depth == 3)
        met = [self.column[context[at] >> s & 255].astype(np.int64) for s in (16, 8, 0)]
        three[(met[0] * self.width + met[1]) * self.width + met[2]] = at
        self.three = three
        # Children of a node by the column of the next older byte; 0 where there is none.
        inner = int((depth < 5).sum())
        self.older = np.zeros(inner * self.width, np.int32)
        for d in (4, 5):
            own = np.flatnonzero(depth == d)
            up = np.flatnonzero(depth == d - 1)
            ending = context[own] & ((1 << 8 * (d - 1)) - 1)
            place = np.searchsorted(context[up], ending)
            place = np.minimum(place, max(0, len(up) - 1))
            ok = context[up][place] == ending if len(up) else np.zeros(len(own), bool)
            oldest = self.column[context[own] >> 8 * (d - 1)]
            self.older[up[place[ok]].astype(np.int64) * self.width + oldest[ok]] = own[ok]
        self.is_three = np.zeros(len(depth), bool)
        self.is_three[at] = True

    def log10(self, text: bytes) -> tuple[float, np.ndarray, np.ndarray]:
        """log10 probability of the bytes whose context is here in full; the strings of all others, and how often they come."""
        total, missing = 0.0, []
        for piece in _pieces(text):
            col = self.column[piece]
            n = len(piece) - DEPTH
            node = self.three[(col[2 : 2 + n] * self.width + col[3 : 3 + n]) * self.width + col[4 : 4 + n]]
            four = np.where(self.is_three[node], self.older[node.astype(np.int64) * self.width + col[1 : 1 + n]], 0)
            five = self.older[four.astype(np.int64) * self.width + col[:n]]
            node = np.where(five > 0, five, np.where(four > 0, four, node)).astype(np.int64)
            logs = self.logs[node * self.width + col[DEPTH:]]
            if not self.whole:
                missing.append(codes(piece)[five == 0])
                logs = logs[five > 0]
            total += float(logs.sum(dtype=np.float64))
        code, times = np.unique(np.concatenate([np.empty(0, np.uint64), *missing]).view(np.int64), return_counts=True)
        return total / math.log(10), code, times


_models: dict[tuple, tuple[Model, dict[bytes, float]]] = {}  # one at most


def forget_model() -> None:
    """Free the model that this process has in memory."""
    if _models:
        _models.clear()
        pa.default_memory_pool().release_unused()


def _loaded(model_path: str, words_path: str, told: tuple[int, ...], whole: bool) -> tuple[Model, dict[bytes, float]]:
    own = (model_path, words_path, told, whole)
    if own not in _models:
        forget_model()  # before the next one is read
        t = read_table(words_path)
        hot = dict(zip(t["key"].to_pylist(), np.log10(t["n"].to_numpy() + 1.0).tolist()))
        _models[own] = Model(model_path, list(told), whole), hot
    return _models[own]


def lm_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", contexts: int = MODEL_CONTEXTS
) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from the rows of the training folds, letters A-Z as a-z, and scores all
    whole texts. score is the log10 probability of the text's bytes under the
    weighted context trees, base_score that of its words and end under the word
    model. NULL texts are empty: one end token. Repeated rows count as often as
    they occur. An empty table gives no rows; without training rows every byte has
    8 bits. Counts cover all training rows; the number of contexts of three and
    more bytes held in memory while scoring is bounded (`contexts`): strings behind
    less frequent ones are scored from all counts in tasks and joined.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (fold_of(id_col, FOLDS) == HELD_OUT).alias("held_out"), whole_text(text_col).alias("text")
    )
    counts = materialize(count_strings(rows.where("NOT held_out").select("text")), "counts")
    words = counts.where("kind = 1").select("key", "n")
    n_train, v_train, ends = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.length("key") == 0, F.col("n"))), F.lit(0))
    ).first()
    code = F.conv(F.hex("key"), 16, 10).cast("long")
    model_path, words_path = scratch_path(spark, "ctw-model"), scratch_path(spark, "hot-words")
    told, answered = build_model(counts.where("kind = 0").select(code.alias("code"), "n"), model_path, contexts)
    told, whole = tuple(told), answered is None
    is_hot = F.col("n") * HOT_WORDS > n_train
    words.where(is_hot).coalesce(8).write.parquet(words_path)

    end_log = math.log10(ends + 1)
    out = T.StructType(
        [
            rows.schema["doc_id"],
            rows.schema["held_out"],
            *T._parse_datatype_string(
                "row long, n_tokens long, known long, logs double, score double, bytes long, rare array<binary>, times array<long>, "
                "code array<long>, met array<long>"
            ),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hot = _loaded(model_path, words_path, told, whole)
        for b in (all_rows.slice(at, SCORE_ROWS) for all_rows in batches for at in range(0, all_rows.num_rows, SCORE_ROWS)):
            cols: list[list] = [[] for _ in range(10)]
            for row, text in zip(b.column(2).to_pylist(), b.column(3)):
                low = text.as_py().encode().lower()
                tokens = low.split()
                found = list(map(hot.get, tokens))
                rare = Counter(word_key(t) for t, f in zip(tokens, found) if f is None) if None in found else Counter()
                logs, known = sum(f for f in found if f is not None), len(found) - rare.total()
                for long_word in [w for w in rare if w in hot]:
                    times = rare.pop(long_word)
                    logs, known = logs + times * hot[long_word], known + times
                known += ends > 0
                score, code, met = model.log10(low)
                values = (row, len(tokens) + 1, known, logs + end_log, score, len(low) + 1, list(rare), list(rare.values()), code, met)
                for c, v in zip(cols, values):
                    c.append(v)
            arrays = [pa.array(c, f.type) for c, f in zip(cols, SCORED)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], names=out.names)

    scored = rows.select("doc_id", "held_out", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(run, out)
    scored = materialize(scored, "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", "r.rare", "r.times")
    cold = words.where(~is_hot & (F.length("key") > 0)).withColumnRenamed("key", "rare")
    met = rare.join(cold, "rare").groupBy("row").agg(
        F.sum("times").alias("cold_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("cold_logs")
    )
    base = F.col("logs") + F.coalesce("cold_logs", F.lit(0.0)) - F.col("n_tokens") * math.log10(n_train + v_train + 1)
    if not whole:
        missing = scored.select("row", F.explode(F.arrays_zip("code", "met")).alias("m")).select("row", "m.code", "m.met")
        logs = materialize(answered(materialize(missing.select("code").distinct(), "asked")), "answers")
        more = missing.join(logs, "code").groupBy("row").agg((F.sum(F.col("met") * F.col("log")) / math.log(10)).alias("more"))
        scored = scored.join(more, "row", "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0))).drop("more")
    return scored.drop("rare", "times", "code", "met").join(met, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("cold_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
        (-F.col("score") * math.log2(10) / F.col("bytes")).alias("bits_per_byte"),
    )


SCORED = pa.schema(
    [
        ("row", pa.int64()),
        ("n_tokens", pa.int64()),
        ("known", pa.int64()),
        ("logs", pa.float64()),
        ("score", pa.float64()),
        ("bytes", pa.int64()),
        ("rare", pa.list_(pa.binary())),
        ("times", pa.list_(pa.int64())),
        ("code", pa.list_(pa.int64())),
        ("met", pa.list_(pa.int64())),
    ]
)

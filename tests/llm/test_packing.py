import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

from recon.llm.packing import ChunkEncoder, first_fit_decreasing, pack
from tests.llm.tables import DOCS, docs_of, written

PATH = public.path("byte_bpe_50k.json")
FAST = {"ranks": public.path("byte_bpe_50k.tiktoken"), "pattern": public.PATTERN}
ODD = ["", " ", "a  b", "  x  y \n z", "a\n b <|endoftext|> c", "<|endoftext|>", "ab ", "x\xa0 y", "x\x1f y \x1f", "don't  stop'll", "😀 é\r\n b"]


def ids_of(text):
    return np.asarray(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0], "<u4")


@pytest.mark.parametrize("fast", [{}, FAST])
def test_chunks_give_the_tokenizers_ids(fast):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" ab.\n\t'é9") for _ in range(rng.randrange(30))) for _ in range(300)]
    enc = ChunkEncoder(PATH, **fast)
    for t in texts:
        assert enc.ids(t) == ids_of(t)[:-1].tobytes(), repr(t)


def test_tree_is_first_fit_decreasing():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 200):
        lengths = rng.integers(1, 1024, n)
        bins, offsets = first_fit_decreasing(lengths, 1024)
        room, want = [], np.empty(n, int)
        for i in np.argsort(-lengths, kind="stable"):
            b = next((j for j, r in enumerate(room) if r >= lengths[i]), len(room))
            if b == len(room):
                room.append(1024)
            assert offsets[i] == 1024 - room[b]
            room[b] -= lengths[i]
            want[i] = b
        assert (bins == want).all()


def test_every_token_in_one_place(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["word", "other", "x1"]) for _ in range(rng.randrange(0, 900))) for _ in range(200)]
    texts += [None, *ODD, "long " * 20_000]
    rows = pack(docs_of(spark, tmp_path, texts, more="offset"), PATH, group_docs=50, with_ids=True, **FAST).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        parts = sorted(docs[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in parts) == ids_of(t).tobytes()
        assert [r.start for r in parts] == list(np.cumsum([0, *(r.length for r in parts)]))[:-1]
        assert {r.doc_tokens for r in parts} == {sum(r.length for r in parts)}
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    tokens = sum(r.length for r in rows)
    assert tokens / (1024 * len(sequences)) > 0.9


def test_repeated_rows_and_no_rows(spark, tmp_path):
    rows = pack(written(spark, tmp_path, [(1, "a b", None, None, None)] * 4, DOCS), PATH).collect()
    assert len(rows) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == 4
    assert pack(written(spark, tmp_path, [], DOCS), PATH).count() == 0

import random

import numpy as np
import pyarrow as pa

from recon.llm import templates
from recon.llm.templates import drop_repeated_lines
from tests.llm.tables import DOCS, docs_of, written


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))


def test_recurring_templates_go_and_clean_lines_stay(spark, tmp_path):
    rng = random.Random(1)
    passage = words(rng, 60)
    own = [[words(rng, rng.randrange(4, 40)) for _ in range(4)] for _ in range(60)]
    texts = []
    for i, lines in enumerate(own):
        extra = [f"Copyright notice {2000 + i} all rights reserved by owner"] if i % 2 else []
        extra += [passage] if i % 10 == 3 else []
        texts.append("\n".join([*lines[:2], *extra, *lines[2:]]))
    df = docs_of(spark, tmp_path, [*texts, None, "", "\n\n", "short line"], more="line")
    got = {r.doc_id: r for r in drop_repeated_lines(df).collect()}
    for i, lines in enumerate(own):
        first = i in (1, 3)
        kept = texts[i] if i == 1 else "\n".join(lines)
        if i == 3:  # first with the passage, second with the notice
            kept = "\n".join([*lines[:2], passage, *lines[2:]])
        assert got[i].text == kept, (i, first)
        assert got[i].n_dropped == texts[i].count("\n") - kept.count("\n")
    assert [got[60 + j].text for j in range(4)] == ["", "", "\n\n", "short line"]


def test_min_docs_repeated_rows_and_no_rows(spark, tmp_path):
    line = "one line with many words in it"
    df = docs_of(spark, tmp_path, [line, line, "another line with other words here", f"{line}\n{line}"])
    assert sum(r.n_dropped for r in drop_repeated_lines(df, min_docs=4).collect()) == 0
    assert sorted(r.n_dropped for r in drop_repeated_lines(df, min_docs=3).collect()) == [0, 0, 1, 2]
    same = written(spark, tmp_path, [(1, line, None, None, None)] * 4 + [(None, line, None, None, None)], DOCS)
    assert sorted(r.n_dropped for r in drop_repeated_lines(same).collect()) == [0, 1, 1, 1, 1]
    assert drop_repeated_lines(written(spark, tmp_path, [], DOCS)).count() == 0


def test_word_valued_fields_vary_in_tables_of_any_size(spark, tmp_path):
    names = ["".join(chr(97 + (i // 26**j) % 26) for j in range(3)) for i in range(200)]
    for size in (100, 10_000):
        rng = random.Random(size)
        texts = [f"this page was last edited by {rng.choice(names)} of the team" for _ in range(size)]
        texts += [f"this page was {words(rng, 7)}" for _ in range(size)]  # the same leaf, other lines
        got = drop_repeated_lines(docs_of(spark, tmp_path, texts, more=f"names{size}")).collect()
        assert sorted(r.doc_id for r in got if r.n_dropped) == list(range(1, size)), size


def test_short_lines_recur_whole(spark, tmp_path):
    texts = ["All rights reserved.\nfirst", "one two 3\nAll rights reserved. ", "一行没有空格的文字\none two 4", "一行没有空格的文字\n\n \n"]
    got = {r.doc_id: r.text for r in drop_repeated_lines(docs_of(spark, tmp_path, texts, more="short")).collect()}
    assert got == {0: texts[0], 1: "one two 3", 2: texts[2], 3: "\n "[0:1] + " \n"}


def test_rows_of_numbers_stay(spark, tmp_path):
    texts = ["2021-03-04 12.5 33.1 48.0", "1999-01-01 7.0 8.1 9.3", "1 2 3 kg", "4 5 6 kg", "1999-01-01 7.0 8.1 9.3"]
    texts += [" ".join(str(i * 100 + j) for j in range(40)) for i in range(3)]
    got = {r.doc_id: r.n_dropped for r in drop_repeated_lines(docs_of(spark, tmp_path, texts, more="numbers")).collect()}
    assert [got[i] for i in range(len(texts))] == [0, 0, 0, 0, 1, 0, 0, 0]  # one is an exact copy


def test_a_leading_token_may_vary(spark, tmp_path):
    rest = "on the old wooden table in town today"
    few = [f"by {name} {rest}" for name in ("ann", "bob", "cid", "dora", "eve", "fay")]
    got = drop_repeated_lines(docs_of(spark, tmp_path, [*few, "by the lake we saw nothing but fog all day"], more="few")).collect()
    assert sorted(r.doc_id for r in got if r.n_dropped) == [1, 2, 3, 4, 5]
    # Names that recur by chance, some met once, at every leading place.
    names = ["".join(chr(97 + (i // 26**j) % 26) for j in range(3)) for i in range(50)]
    rng = random.Random(3)
    for place in range(3):
        texts = []
        for _ in range(400):
            words_of = ["seen", "by", *rest.split()]
            words_of.insert(place, rng.choice(names))
            texts.append(" ".join(words_of))
        got = drop_repeated_lines(docs_of(spark, tmp_path, texts, more=f"place{place}")).collect()
        assert sorted(r.doc_id for r in got if r.n_dropped) == list(range(1, 400)), place


def test_any_number_of_tokens_gives_the_same_outcome(spark, tmp_path):
    names = ["ann", "bob", "cid", "dora"]
    for n in (15, 16, 17, 32, 33, 49, 300):
        rng = random.Random(n)
        line = words(rng, n).split()
        texts = [" ".join([*line[: n // 2], name, *line[n // 2 :]]) for name in names]
        texts += [" ".join([*line[: n // 2], *words(rng, n // 2 + 1).split()]) for _ in range(2)]  # half another line
        got = {r.doc_id: r.n_dropped for r in drop_repeated_lines(docs_of(spark, tmp_path, texts, more=f"n{n}")).collect()}
        assert [got[i] for i in range(6)] == [0, 1, 1, 1, 0, 0], n


def plainly(texts, leading=3, least=4, tail=4, constant=0.6, share=0.5):
    """Which lines of which texts go, by the same rules in plain loops."""
    from collections import Counter, defaultdict

    lines = []
    for row, text in enumerate(texts):
        for at, line in enumerate((text or "").split("\n")):
            tokens = [t for t in line.replace("\t", " ").replace("\r", " ").split(" ") if t]
            if tokens:
                lines.append((row, at, line.strip(" \t\r"), tuple("<*>" if any(c in "0123456789" for c in t) else t for t in tokens)))
    leaves = defaultdict(list)
    for row, _, exact, t in lines:
        if len(t) >= least:
            for k in range(-1, leading if len(t) >= leading + tail else 0):
                if k < 0 or t[k] != "<*>":
                    path = tuple("<*>" if i == k else x for i, x in enumerate(t[:leading]))
                    leaves[len(t), path].append((row, exact, t, k))
    shared = {f: m for f, m in leaves.items() if len({x[1] for x in m}) > 1 and len({x[0] for x in m}) > 1}
    copies, best = Counter(exact for _, _, exact, _ in lines), {}

    def belongs(leaf, exact, t, k):
        """Whether a line takes the wildcard: its own leaf has under half of the lines, or one line."""
        whole = shared.get((len(t), t[:leading]))
        own = sum(x[3] < 0 for x in whole) if whole else copies[exact]
        return k < 0 or own < 2 or len(shared[leaf]) > 2 * own

    for leaf, members in shared.items():
        members = [x for x in members if belongs(leaf, *x[1:])]
        met = Counter((i, x) for _, _, t, _ in members for i, x in enumerate(t) if x != "<*>")
        for _, exact, t, k in members:
            n = [met[i, x] if x != "<*>" else 0 for i, x in enumerate(t)]
            after = sorted(n[leading:], reverse=True)
            need = -(-int(round(constant * 1000)) * len(after) // 1000) - 1
            if need < 0 or after[need] < 2:
                continue
            kept = [(i, x) for i, x in enumerate(t) if n[i] >= 2 and n[i] >= share * after[need]]
            if len(kept) >= constant * len(t) and (k < 0 or k not in [i for i, _ in kept]):
                found = (after[need], k, (leaf, tuple(kept)))
                best[exact] = max(best.get(exact, found), found)
    homes = defaultdict(set)
    told = [(row, at, best[exact][2] if exact in best else exact) for row, at, exact, _ in lines]
    for row, _, template in told:
        homes[template].add(row)
    return sorted((row, at) for row, at, template in told if row != min(homes[template]))


def test_against_plain_loops(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = ["red", "blue", "sky", "sea", "7", "x1"]
    texts = ["\n".join(" ".join(rng.choice(vocabulary[: rng.choice((2, 3, 6))]) for _ in range(rng.randrange(1, 10))) for _ in range(5)) for _ in range(120)]
    base = [rng.choices(["alpha", "beta", "gamma", "delta", "12"], k=11) for _ in range(4)]
    for i in range(80):
        line = list(rng.choice(base))
        line[rng.randrange(11)] = rng.choice(["ann", "bob", f"v{i}"])
        texts.append(" ".join(line) + "\n" + texts[i])
    texts += [None, "", " \t\r", " ".join(f"w{i}x" if i % 5 else "9" for i in range(30_000))] * 2
    got = drop_repeated_lines(docs_of(spark, tmp_path, texts, more="exact")).collect()
    want = plainly(texts)
    assert sum(r.n_dropped for r in got) == len(want)
    for r in got:
        gone = {at for row, at in want if row == r.doc_id}
        assert r.text == "\n".join(x for at, x in enumerate((texts[r.doc_id] or "").split("\n")) if at not in gone), r.doc_id


def test_tokens_of_lines_taken_apart_together():
    rng, leaf = random.Random(4), pa.list_(pa.struct([("kind", pa.int32()), ("leaf", pa.int64()), ("n", pa.int64())]))
    texts = [" ".join(rng.choice(["a", "b", "c7", "é"]) for _ in range(rng.randrange(9))) for _ in range(50)]
    leaves = [[{"kind": k, "leaf": rng.randrange(1, 2**63), "n": 2} for k in range(rng.randrange(1, 5))] for _ in texts]
    found = [templates.TOKEN.findall(t) for t in texts]
    hashes = templates._Hashes()
    token = np.array([hashes[t] for f in found for t in f], np.uint64)
    at = pa.array(range(50), pa.int64()), pa.array([i + 7 for i in range(50)], pa.int64()), pa.array(leaves, leaf)
    cut = [x.slice(10) for x in at]
    skipped = sum(map(len, found[:10]))
    got = list(zip(*(c.tolist() for c in templates._spots(*cut, token[skipped:], np.array([len(f) for f in found[10:]])))))
    want = []
    for i in range(10, 50):
        for x in leaves[i]:
            for place, t in enumerate(found[i]):
                if "7" not in t:
                    salt = templates._mixed(np.array([x["leaf"]], np.uint64) + np.array([place], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    spot = templates._mixed(np.array([templates._hash(t)], np.uint64) ^ salt).view(np.int64)[0]
                    want.append((i, x["kind"], i + 7, len(found[i]), place, int(spot)))
    assert got == want


def test_lines_that_go_on_in_later_batches(spark, tmp_path):
    schema = "exact long, kind int, m long, size int, place int, spot long"
    rows = [(e, k, 1, 6, p, 100 * k + 10 * p + (1000 * e if p == 4 else 0)) for e in range(1, 40) for k in (0, 1) for p in range(k, 6)]
    placed = written(spark, tmp_path, rows, schema)
    whole = sorted(map(tuple, templates.general_templates(placed, 3, 2, 0.6).collect()))
    assert len(whole) == 39 and len({g for _, g in whole}) == 1
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, 4)
    try:
        assert sorted(map(tuple, templates.general_templates(placed, 3, 2, 0.6, flush=3).collect())) == whole
    finally:
        spark.conf.set(batch, before)


def test_templates_are_found_without_lists(spark, tmp_path):
    schema = "exact long, kind int, m long, size int, place int, spot long"
    placed = written(spark, tmp_path, [(e, 0, 1, 6, p, p) for e in (1, 2) for p in range(6)], schema)
    plan = templates.general_templates(placed, 3, 2, 0.6)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan

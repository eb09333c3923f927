import hashlib
import random
from collections import defaultdict

import pytest

from recon.llm.naming import exact_groups, without_copies
from tests.llm.tables import DOCS, docs_of, written


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        stays = False
        for i in ids:
            kept = i == keep and not stays
            stays |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.drop("row_id").collect()), key=repr)


@pytest.mark.parametrize("chars,bits", [(4096, 64), (3, 64), (3, 2), (2, 1)])
def test_groups_match_brute_force(spark, tmp_path, chars, bits):
    rng = random.Random(chars * 100 + bits)
    texts = ["".join(rng.choice("abé😀") for _ in range(rng.choice([0, 1, 2, 3, 5, 6, 7, 13, 40]))) for _ in range(150)]
    texts += [None, "", None, "aaa" * 30, "aaa" * 30 + "b", "aaa" * 30] + ["hot"] * 60
    df = docs_of(spark, tmp_path, texts, more="row_id")
    assert got(exact_groups(df, chars=chars, bits=bits)) == expected(list(enumerate(texts)))


def test_repeated_rows_nulls_and_empty_table(spark, tmp_path):
    rows = [(1, "x", None, None, None)] * 3 + [(None, "x", None, None, None), (None, "y", None, None, None)] * 2
    df = written(spark, tmp_path, rows, DOCS)
    assert got(exact_groups(df)) == expected([(r[0], r[1]) for r in rows])
    left = without_copies(df)
    assert left.columns == df.columns and sorted(r.text for r in left.collect()) == ["x", "y"]
    assert exact_groups(written(spark, tmp_path, [], DOCS)).count() == 0

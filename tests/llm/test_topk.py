import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recon.llm.topk import BallTree, top_inner_products
from tests.llm.tables import written

SCHEMA = "vec_id long, embedding array<float>, label int, score long"


def brute(rows, k=10):
    v = [
        (i, [math.floor(1024 * float(np.float32(x))) for x in e])
        for i, e, *_ in rows
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)
    ]
    out = []
    for a, (i, p) in enumerate(v):
        if i % 10 == 0:
            near = sorted(((-sum(x * y for x, y in zip(p, q)), j) for b, (j, q) in enumerate(v) if b != a))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return sorted(out)


def ask(df, **how):
    return sorted(tuple(r) for r in top_inner_products(df, F.col("vec_id") % 10 == 0, **how).collect())


def test_matches_brute_force_with_ties_copies_and_gaps(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(4)], 0, 0) for i in range(300)]
    rows += [(i, [1.0, 1.0, 1.0, 1.0], None, 0) for i in range(300, 380)]  # one vector, many times
    rows += [(20, rows[20][1], 0, 0), (400, None, 0, 0), (410, [1.0, None, 0.0, 0.0], 0, 0), (None, [1.0] * 4, 0, 0)]
    rows += [(420, [float("nan")] * 4, 0, 0), (430, [float("inf"), 0.0, 0.0, 0.0], 0, 0), (440, [1.0, 2.0], 0, 0), (441, [], 0, 0)]
    df = written(spark, tmp_path, rows, SCHEMA)
    assert ask(df, shard_vectors=50) == brute(rows)


def test_exact_beyond_double_arithmetic(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, [float(np.float32(rng.uniform(-1e5, 1e5))) for _ in range(3)], 0, 0) for i in range(60)]
    assert ask(written(spark, tmp_path, rows, SCHEMA), shard_vectors=20) == brute(rows)


def test_components_of_any_size(spark, tmp_path):
    wide = SCHEMA.replace("array<float>", "array<double>")
    rows = [(0, [1.0, 0.0], 0, 0), (1, [4e12, 0.0], 0, 0), (2, [2.0, 1.0], 0, 0), (3, [-3.5e12, 1e300], 0, 0), (4, [0.0, -1e305], 0, 0)]
    df = written(spark, tmp_path, rows, wide)
    got = top_inner_products(df, F.col("vec_id") == 0)
    exact = {i: math.floor(1024 * e[0]) * 1024 for i, e, *_ in rows[1:]}
    assert [(r.vec_id, r.score) for r in got.orderBy("rank").collect()] == sorted(exact.items(), key=lambda x: (-x[1], x[0]))
    with pytest.raises(Exception, match="64 bits"):
        top_inner_products(df, F.col("vec_id") == 1).collect()


def test_few_or_no_vectors(spark, tmp_path):
    assert ask(written(spark, tmp_path, [], SCHEMA)) == []
    assert ask(written(spark, tmp_path, [(10, [1.0], 0, 0)], SCHEMA)) == []
    two = [(10, [1.0], 0, 0), (3, [2.0], 0, 0)]
    assert ask(written(spark, tmp_path, two, SCHEMA)) == [(10, 1, 3, 2 * 1024 * 1024)]


def test_bounds_hold():
    rng = np.random.default_rng(0)
    points, queries = rng.normal(size=(500, 8)) * 100, rng.normal(size=(20, 8)) * 100
    tree = BallTree(points, leaf=10)
    bounds = tree.bounds(queries)
    for at, (first, end, *_) in enumerate(tree.nodes):
        assert (bounds[:, at] >= (queries @ tree.points[first:end].T).max(1)).all()

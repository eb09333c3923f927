import hashlib
import math
import random

import numpy as np
import pytest

from recon.llm.bisectors import Bisectors, centroid_clusters, quantised
from tests.llm.tables import written

SCHEMA = "vec_id long, embedding array<double>, label int, cluster long"


def brute(rows, k, rounds, width, scale):
    kept = [
        (i, [math.floor(scale * x) for x in e])
        for i, e, *_ in rows
        if e is not None and len(e) == width and all(x is not None and math.isfinite(x) for x in e)
    ]
    name = lambda i: hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, near) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    near = assign()
    sums = {j: sum(d for d, c in near if c == j) for j in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, sums[c], sum(sums.values()), sha[c]) for (i, _), (d, c) in zip(kept, near)), key=repr)


def got(df, **how):
    return sorted((tuple(r) for r in centroid_clusters(df, **how).collect()), key=repr)


@pytest.mark.parametrize("width,k,rounds", [(3, 4, 3), (2, 7, 1), (3, 1, 2)])
def test_matches_brute_force(spark, tmp_path, width, k, rounds):
    rng = random.Random(width * k)
    rows = [(i, [rng.choice([-1.5, 0.0, 0.26, 1.0, 2.0]) for _ in range(width)], 0, 0) for i in range(150)]
    rows += [(i, [1.0] * width, None, 0) for i in range(150, 260)]  # one vector, many times
    rows += [(7, rows[7][1], 0, 0), (7, [9.0] * width, 0, 0), (None, [0.5] * width, 0, 0), (300, None, 0, 0), (301, [], 0, 0)]
    rows += [(302, [1.0, None, 0.0][:width], 0, 0), (303, [float("nan")] * width, 0, 0), (304, [float("-inf")] * width, 0, 0)]
    df = written(spark, tmp_path, rows, SCHEMA)
    assert got(df, width=width, k=k, rounds=rounds) == brute(rows, k, rounds, width, 64)


def test_large_components_stay_exact(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-2e7, 2e7), rng.uniform(-1, 1)], 0, 0) for i in range(80)]
    df = written(spark, tmp_path, rows, SCHEMA)
    assert got(df, width=2, k=5) == brute(rows, 5, 3, 2, 64)
    far = [(i, [1e300, 2.0**70], 0, 0) for i in range(4)] + [(9, [1e300, 2.0**70], 0, 0)]
    df = written(spark, tmp_path, far, SCHEMA)
    assert got(df, width=2, k=2) == brute(far, 2, 3, 2, 64)


def test_few_or_no_vectors(spark, tmp_path):
    assert got(written(spark, tmp_path, [], SCHEMA), width=2) == []
    assert got(written(spark, tmp_path, [(1, [1.0], 0, 0)], SCHEMA), width=2) == []
    one = [(1, [1.0, 2.0], 0, 0)]
    assert got(written(spark, tmp_path, one, SCHEMA), width=2) == brute(one, 16, 3, 2, 64)


def test_ties_go_to_the_smaller_number():
    planes = Bisectors([[0, 0], [2, 0], [0, 2], [2, 0]])
    cluster, distance = planes.nearest(np.array([[1, 0], [1, 1], [2, 0], [0, 2]]))
    assert cluster.tolist() == [0, 0, 1, 2] and distance.tolist() == [1, 2, 0, 0]
    assert quantised(np.array([1e308, -0.1]), 64).tolist() == [64 * int(1e308), -7]

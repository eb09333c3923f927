"""Nearest centroids by a tournament over bisecting planes, in exact integers.

For two centroids i < j, a vector x is nearer to j than to i exactly if
2 x.(c_j - c_i) > |c_j|^2 - |c_i|^2. Normals and thresholds of all pairs are
computed once per round; a vector then meets the centroids in turn, the winner
so far against the next one. k - 1 sign tests leave one centroid; on the plane
itself (zero) the smaller number wins. Only the winner's distance is computed.

Tasks send one sum per cluster and place. The driver holds k centroids, whose
number and width are parameters, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recon.plans.lineage import materialize

SCALE, WIDTH, K, ROUNDS, SEED = 64, 64, 16, 3, 1
LIMB = 60  # bits of one limb of a sum
BLOCK = 8192  # vectors that are held as integers at a time


def is_kept(vec: str, width: int) -> Column:
    """Exactly `width` components, none NULL, NaN or infinite."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(vec) == width) & fine, F.lit(False))


def quantised(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole numbers: int64 where all of them are small, else Python integers."""
    with np.errstate(over="ignore"):
        x = np.floor(flat.astype(np.float64) * scale)
    if np.isfinite(x).all() and (np.abs(x) < 2.0**62).all():
        return x.astype(np.int64)
    # scale * x left the doubles or int64: the product is taken exactly
    out = np.empty(len(flat), object)
    for i, v in enumerate(flat.astype(np.float64).tolist()):
        a, b = v.as_integer_ratio()
        out[i] = (a * scale) // b
    return out


class Bisectors:
    """Normals and thresholds of all pairs of centroids (rows of Python integers)."""

    def __init__(self, centroids: list[list[int]]):
        self.k = len(centroids)
        width = len(centroids[0]) if centroids else 0
        self.centroids = np.array(centroids, object).reshape(self.k, width)
        self.largest = max((abs(v) for c in centroids for v in c), default=0)
        norms = [sum(v * v for v in c) for c in centroids]
        self.normals = np.zeros((self.k, self.k, width), object)
        self.thresholds = np.zeros((self.k, self.k), object)
        for i in range(self.k):
            for j in range(i + 1, self.k):
                self.normals[i, j] = [2 * (b - a) for a, b in zip(centroids[i], centroids[j])]
                self.thresholds[i, j] = norms[j] - norms[i]
        self.small: tuple | None = None

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each row of `x`."""
        most = max(self.largest, int(np.abs(x).max()) if x.size else 0)
        if 8 * x.shape[1] * most * most < 2**63:  # no sum of products leaves int64
            if self.small is None:
                self.small = tuple(a.astype(np.int64) for a in (self.normals, self.thresholds, self.centroids))
            (normals, thresholds, centroids), x = self.small, x.astype(np.int64)
        else:
            normals, thresholds, centroids, x = self.normals, self.thresholds, self.centroids, x.astype(object)
        champion = np.zeros(len(x), np.int64)
        for rival in range(1, self.k):
            side = (x * normals[champion, rival]).sum(1) - thresholds[champion, rival]
            champion[np.asarray(side > 0, bool)] = rival
        gap = x - centroids[champion]
        return champion, (gap * gap).sum(1)


def _blocks(batch: pa.RecordBatch, width: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, BLOCK):
        part = batch.slice(at, BLOCK)
        flat = part.column("v").flatten().to_numpy(zero_copy_only=False)
        yield part, quantised(flat, scale).reshape(-1, width)


def _sums(planes: Bisectors, width: int, scale: int):
    """One row per cluster, place and limb: the sum over a task's vectors; place -1 holds the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * planes.k, [[0] * width for _ in range(planes.k)]
        for batch in batches:
            for _, x in _blocks(batch, width, scale):
                cluster, _ = planes.nearest(x)
                exact = x if x.dtype == object or np.abs(x).max(initial=0) * len(x) < 2.0**62 else x.astype(object)
                for c in np.unique(cluster).tolist():
                    own = exact[cluster == c]
                    counts[c] += len(own)
                    sums[c] = [s + int(t) for s, t in zip(sums[c], own.sum(0))]
        rows = []
        for c, n in enumerate(counts):
            for place, total in enumerate([n, *sums[c]] if n else []):
                sign, rest, limb = (-1 if total < 0 else 1), abs(total), 0
                while rest:
                    rows.append((c, place - 1, limb, sign * (rest & ((1 << LIMB) - 1))))
                    rest >>= LIMB
                    limb += 1
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["cluster", "place", "limb", "part"])

    return run


def _assigned(planes: Bisectors, width: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _blocks(batch, width, scale):
                cluster, distance = planes.nearest(x)
                if distance.dtype == object and any(d >= 2**63 for d in distance):
                    raise OverflowError("a squared distance does not fit 64 bits")
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance.astype(np.int64))],
                    ["vec_id", "cluster", "distance"],
                )

    return run


def first_centroids(rows: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The k vectors whose ids hash lowest; ties of repeated ids go by the vectors themselves.

    Only rows below a bound of the hash that about 64 k of them meet are ordered; the bound
    rises until it holds k rows, so no task gets k rows of every other one.
    """
    total = rows.count()
    named = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256))
    share = min(1.0, 64 * k / max(total, 1))
    while True:
        bound = f"{int(share * (16**12 - 1)):012x}"
        low = named.where(F.substring("h", 1, 12) <= bound) if share < 1 else named
        found = low.orderBy("h", "v").limit(k).select("v").collect()
        if len(found) == k or share == 1:
            return [[int(t) for t in quantised(np.array(r.v, np.float64), scale)] for r in found]
        share = min(1.0, share * 16)


def moved(sums: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The componentwise floor of the means; clusters without vectors stay where they are."""
    total: dict[tuple[int, int], int] = {}
    for r in sums.groupBy("cluster", "place", "limb").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("part")).collect():
        at = (r.cluster, r.place)
        total[at] = total.get(at, 0) + (int(r.part) << (LIMB * r.limb))
    return [
        [total.get((c, p), 0) // total[c, -1] for p in range(len(old))] if (c, -1) in total else old
        for c, old in enumerate(centroids)
    ]


def centroid_clusters(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS,
    width: int = WIDTH, scale: int = SCALE, seed: int = SEED,
) -> DataFrame:
    """One row per kept row of `vectors`: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    A vector is kept if it has exactly `width` components, none NULL, NaN or
    infinite; component x counts as the integer floor(scale * x) of any size. The
    k kept vectors whose `seed:id` has the smallest SHA-256 start as centroids
    (fewer vectors, fewer centroids); `rounds` times every vector goes to its
    nearest centroid and every centroid to the floor of its vectors' mean; then
    vectors are assigned once more. Ties go to the smaller number, an empty cluster
    keeps its centroid. Repeated rows are rows like others, a NULL id hashes as the
    text 'null', other columns are not looked at. No kept vector gives no rows. A
    squared distance beyond 64 bits is an error.
    """
    rows = vectors.where(is_kept(vec_col, width)).select(
        F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")
    )
    centroids = first_centroids(rows, k, seed, scale)
    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(
            _sums(Bisectors(centroids), width, scale), "cluster int, place int, limb int, part long"
        )
        centroids = moved(sums, centroids)
    spark = vectors.sparkSession
    id_type = rows.schema["vec_id"].dataType.simpleString()
    placed = materialize(
        rows.mapInArrow(_assigned(Bisectors(centroids), width, scale), f"vec_id {id_type}, cluster int, distance long"),
        "clusters",
    )
    inertia = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s"))
    sums = {r.cluster: int(r.s) for r in inertia.collect()}
    facts = [
        (c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for c, s in sums.items()
    ]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )

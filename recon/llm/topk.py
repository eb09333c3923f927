"""Exact top-k inner products by ball trees, shard by shard, with a shared bound.

Vectors are dealt into shards of bounded size. Every shard builds a ball tree of
its vectors; the inner product of a query q with anything inside a ball of
centre c and radius r is at most q.c + |q| r. A query visits nodes by falling
bound and stops as soon as the bound falls below its k-th score.

The k-th score is shared between shards in two rounds: first each shard answers
from its most promising leaves only, which gives a k-th score over the whole table;
then the full search starts from that score, so that most shards have
little left to open. Bounds only cut what cannot enter the result, which stays exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recon.plans.lineage import materialize

SCALE, K = 1024, 10
SHARD_VECTORS = 4096
QUERY_BLOCK = 2048  # queries that meet a shard in one task
LEAF = 64
FIRST_LEAVES = 2
LEAST, MOST = -(2**63), 2**63 - 1  # scores beyond these travel as these


class BallTree:
    """Points in nested balls; a node is (centre, radius, first point, end, children)."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.points = points
        self.nodes: list[tuple[int, int, int, int]] = []  # first, end, left, right
        centres, radii = [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            first, end, parent, side = todo.pop()
            own = points[self.order[first:end]]
            centre = own.mean(0)
            gap = own - centre
            far = np.einsum("ij,ij->i", gap, gap)
            at = len(self.nodes)
            centres.append(centre)
            radii.append(np.sqrt(far.max()))
            self.nodes.append((first, end, -1, -1))
            if parent >= 0:
                a, b, left, right = self.nodes[parent]
                self.nodes[parent] = (a, b, at, right) if side == 0 else (a, b, left, at)
            if end - first > leaf and far.max() > 0:
                one = own[far.argmax()]
                gap = own - one
                two = own[np.einsum("ij,ij->i", gap, gap).argmax()]
                along = own @ (two - one)
                split = np.argsort(along, kind="stable")
                self.order[first:end] = self.order[first:end][split]
                middle = first + (end - first) // 2
                todo += [(middle, end, at, 1), (first, middle, at, 0)]
        self.centres = np.array(centres)
        self.radii = np.array(radii)
        self.points = points[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of each query with anything in each node, rounded up."""
        norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        with np.errstate(over="ignore", invalid="ignore"):
            up = queries @ self.centres.T + norms[:, None] * self.radii
            slack = norms[:, None] * (self.radii + np.sqrt(np.einsum("ij,ij->i", self.centres, self.centres)))
            up = up + 1e-9 * (1 + slack)
        return np.where(np.isnan(up), np.inf, up)  # where doubles overflow, nothing is ruled out


class Best:
    """The k best (score, smaller id first) met so far, and the score that a new one must reach."""

    def __init__(self, k: int, floor: float):
        self.k, self.floor, self.heap = k, floor, []

    def bar(self) -> float:
        return max(self.floor, self.heap[0][0]) if len(self.heap) == self.k else self.floor

    def offer(self, score: int, vec_id: int) -> None:
        item = (score, -vec_id)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, item)
        elif item > self.heap[0]:
            heapq.heapreplace(self.heap, item)


def exact_scores(points: np.ndarray, query: np.ndarray, largest: float) -> np.ndarray:
    """Integer inner products; double arithmetic while every sum is a whole number below 2^53."""
    if largest < 2**53:
        return (points @ query).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(p, query)) for p in points], object)


def search(
    tree: BallTree, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, own_rows: np.ndarray, floors: np.ndarray,
    k: int, leaves: int | None, largest: float,
) -> Iterator[tuple[int, int, int]]:
    """(query, vec_id, score) of each query's best in this tree: all that can matter, or those of the first leaves."""
    if not len(queries):
        return
    bounds = tree.bounds(queries)
    for q, query in enumerate(queries):
        best, seen = Best(k, floors[q]), 0
        open_nodes = [(-bounds[q, 0], 0)]
        while open_nodes and -open_nodes[0][0] >= best.bar() and (leaves is None or seen < leaves):
            _, at = heapq.heappop(open_nodes)
            first, end, left, right = tree.nodes[at]
            if left >= 0:
                heapq.heappush(open_nodes, (-bounds[q, left], left))
                heapq.heappush(open_nodes, (-bounds[q, right], right))
                continue
            seen += 1
            found = exact_scores(tree.points[first:end], query, largest)
            inside = tree.order[first:end]
            good = (found >= best.bar()) & (rows[inside] != own_rows[q])
            if good.sum() > k:  # only the k best of a leaf can matter; ties go to the smaller id
                take = np.flatnonzero(good)
                take = take[np.lexsort((ids[inside[take]], -found[take]))[:k]]
            else:
                take = np.flatnonzero(good)
            for i in take.tolist():
                best.offer(int(found[i]), int(ids[inside[i]]))
        for score, minus in best.heap:
            yield q, -minus, min(max(score, LEAST), MOST)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows, shorter ones filled up with zeros."""
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(flat), width))
    out[np.arange(width) < sizes[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


def _answers(points: DataFrame, dealt: DataFrame, width: int, k: int, leaves: int | None, largest: float) -> DataFrame:
    """(row, query_id, vec_id, score): every shard's answers to the queries dealt to it, which carry a `floor`."""

    def run(group: pa.Table) -> pa.Table:
        out: list[tuple] = []
        floor = group["floor"].combine_chunks()
        left, right = group.filter(floor.is_null()), group.filter(floor.is_valid())
        if left.num_rows and right.num_rows:
            ids, rows = left["vec_id"].to_numpy(), left["row"].to_numpy()
            tree = BallTree(_matrix(left["v"], width))
            names, own, floors = (right[c].to_numpy() for c in ("vec_id", "row", "floor"))
            q = _matrix(right["v"], width)
            found = search(tree, ids, rows, q, own, floors, k, leaves, largest)
            out = [(own[i], names[i], v, s) for i, v, s in found]
        cols = list(zip(*out)) if out else [[], [], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("row", "query_id", "vec_id", "score"), cols)})

    parts = ["shard", "row", "vec_id", "v", "floor"]
    both = points.withColumn("floor", F.lit(None).cast("double")).select(parts).unionByName(dealt.select(parts))
    return both.groupBy("shard").applyInArrow(run, "row long, query_id long, vec_id long, score long")


def quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def top_inner_products(
    vectors: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
    scale: int = SCALE, shard_vectors: int = SHARD_VECTORS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `vectors` that meets `queries`, the k best of all other rows.

    Components become floor(scale * x); the score is their integer inner product,
    ties go to the smaller id. Vectors that are NULL or hold NULL, NaN or infinite
    components, and rows without an id, take no part; components may have any size,
    and scores are exact, but a score of the result that does not fit 64 bits is an
    error. A shorter vector counts as filled up
    with zeros. Repeated rows are rows like others: each is a query, and a
    candidate for the other. Copies of one vector are spread over the shards.
    Queries are dealt to every shard in blocks; a block never meets more than one
    shard in a task. No rows, or one row, give no result.
    """
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = materialize(
        vectors.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull())
        .where(fine)
        .select(
            F.col(id_col).cast("long").alias("vec_id"),
            quantised(F.col(vec_col), scale).alias("v"),
            queries.alias("asked"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "vectors",
    )
    n, width, top, asked = rows.agg(
        F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs))), F.count_if("asked")
    ).first()
    width, largest = width or 0, (top or 0.0) ** 2 * (width or 0)
    shards = max(1, -(-n // shard_vectors))
    # Many queries make several groups per shard, each with a copy of the shard's vectors.
    groups = max(1, -(-asked // QUERY_BLOCK))
    points = rows.select("vec_id", "v", "row", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("s"))
    points = points.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    points = points.select("vec_id", "v", "row", (F.col("s") * groups + F.col("g")).alias("shard"))
    wanted = rows.where("asked").select("vec_id", "v", "row", F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(groups)).alias("g"))

    def meet(floors: DataFrame, leaves: int | None) -> DataFrame:
        dealt = floors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        dealt = dealt.withColumn("shard", F.col("shard") * groups + F.col("g")).drop("g")
        return _answers(points, dealt, width, k, leaves, largest)

    first = meet(wanted.withColumn("floor", F.lit(float("-inf"))), FIRST_LEAVES)
    order = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    bars = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    # As a double, a large score may round up; the floor must not.
    lower = F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * 1e-15 - 1
    bars = materialize(bars.select("row", lower.alias("floor")), "bars")
    floors = wanted.join(bars, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = meet(floors, None).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    too_large = F.raise_error(F.lit("a score does not fit 64 bits")).cast("long")
    score = F.when((F.col("score") == LEAST) | (F.col("score") == MOST), too_large).otherwise(F.col("score"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))

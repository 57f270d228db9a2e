"""Nearest neighbours by low-dimensional stable projections in kd-trees, with a chi-square stopping test.

Vectors of length 1 are projected on ``DIMS`` random normal directions (2-stable: a squared projected distance is
the true one times a chi-square variable of ``DIMS`` degrees). A row nearer than a query's k-th best is, with probability
``SURE``, projected no farther than ``enough`` times the k-th best squared distance, where chi2(enough) = SURE. Leaves of a kd-tree are
taken in the order of their distance to the query's projection; their rows within that limit are verified by cosine on
the original vectors, and the search stops at the first leaf beyond it.

Rows are dealt to shards by a kd-tree over the projections of a bounded sample, and a shard with many rows (copies, which no
cut divides) to parts by a hash. A query is searched in its own shard first; its k-th best distance there then
decides by the same test which other shards it is sent to, and is the limit to begin with. Parts and blocks of queries meet in
different tasks, and the best of all are merged per query.

Vectors that are null, zero or hold null or non-finite components, and null ids, take no part; vectors of different
length are never compared. Rows that repeat an id count as one vector. Ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import materialise
from .vectors import distinct_ids, matrix, normalised, usable

DIMS, SURE, LEAF = 12, 0.98, 64
#: Rows of a part, queries of a block; at most 2**DEPTH shards, cut by SAMPLE rows for each.
PART_ROWS, QUERY_ROWS, DEPTH, SAMPLE, SEED = 16_384, 1_024, 12, 16, 7


def chi_square(x: np.ndarray | float, degrees: int) -> float:
    """The distribution function for an even number of degrees."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half ** i / math.factorial(i) for i in range(degrees // 2)) if half < 700 else 1.0


def quantile(sure: float, degrees: int = DIMS) -> float:
    """The value that a chi-square variable stays below with probability ``sure``, by halving."""
    low, high = 0.0, 1_400.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if chi_square(middle, degrees) >= sure else (middle, high)
    return high


def directions(width: int, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng((seed, width)).standard_normal((width, dims))


def gaps(low: np.ndarray, high: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) to boxes (columns)."""
    gap = np.maximum(np.maximum(low[None] - points[:, None], points[:, None] - high[None]), 0)
    return (gap * gap).sum(2)


class Cuts:
    """A complete kd-tree that deals points to 2**depth shards at the medians of a sample."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.at = np.zeros(2 ** depth - 1, np.int64), np.full(2 ** depth - 1, np.inf)
        held = [sample]
        for node in range(len(self.axis)):
            points = held[node]
            if len(points) > 1:
                self.axis[node] = np.ptp(points, axis=0).argmax()
                self.at[node] = np.median(points[:, self.axis[node]])
            right = points[:, self.axis[node]] > self.at[node]
            held += [points[~right], points[right]]

    def shard(self, points: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[rows, self.axis[node]] > self.at[node])
        return node - (2 ** self.depth - 1)


class Tree:
    """A kd-tree kept as its leaves: rows of each, and the box around them."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.rows: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            spread = np.ptp(points[rows], axis=0) if len(rows) > leaf else np.zeros(1)
            if not spread.any():
                self.rows.append(rows)
                continue
            middle = len(rows) // 2
            rows = rows[np.argpartition(points[rows, int(spread.argmax())], middle)]
            todo += [rows[:middle], rows[middle:]]
        self.low = np.array([points[r].min(0) for r in self.rows])
        self.high = np.array([points[r].max(0) for r in self.rows])

    def near(self, point: np.ndarray, limit):
        """Rows within the limit by leaves, nearest leaf first and twice as many leaves at a time; ``limit()`` is asked before each time."""
        far = gaps(self.low, self.high, point[None])[0]
        order, lo, step = np.argsort(far, kind="stable"), 0, 1
        while lo < len(order) and far[order[lo]] <= limit():
            leaves = order[lo : lo + step]
            rows = np.concatenate([self.rows[i] for i in leaves[far[leaves] <= limit()]])
            away = self.points[rows] - point
            yield rows[(away * away).sum(1) <= limit()]
            lo, step = lo + step, 2 * step


def search(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, k: int, sure: float = SURE):
    """For each query the k best of the rows, with a k-th best squared distance known before: (query id, ids, cosines, rows verified)."""
    x, queries, enough = normalised(x), normalised(queries), quantile(sure)
    where = directions(x.shape[1])
    tree = Tree(x @ where)
    for q, own, bound in zip(queries, query_ids, bounds):
        best_score, best_id, verified = np.zeros(0), np.zeros(0, np.int64), 0

        def limit() -> float:
            kth = 2 - 2 * best_score[-1] if len(best_id) == k else np.inf
            return enough * max(min(kth, bound), 1e-12)

        for rows in tree.near(q @ where, limit):
            rows = rows[ids[rows] != own]
            verified += len(rows)
            score, name = np.append(best_score, (x[rows] * q).sum(1)), np.append(best_id, ids[rows])
            top = np.lexsort((name, -score))[:k]
            best_score, best_id = score[top], name[top]
        yield int(own), best_id, best_score, verified


def project(vectors: DataFrame, cuts: Cuts | None = None) -> DataFrame:
    """``vec_id``, ``embedding``, ``dim``, ``point`` (the projection) and, with cuts, ``shard``."""

    def run(batches):
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("embedding")], np.int64)
            for d in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == d))
                column = batch.column("embedding").take(at)
                point = normalised(matrix(column)) @ directions(d)
                shard = cuts.shard(point) if cuts else np.zeros(len(point), np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(at), column.cast(pa.list_(pa.float64())), pa.array(np.full(len(point), d), pa.int32()),
                    pa.array(list(point), pa.list_(pa.float64())), pa.array(shard)], ["vec_id", "embedding", "dim", "point", "shard"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, embedding array<double>, dim int, point array<double>, shard long")


def _meet(rows: DataFrame, asked: DataFrame, k: int, part_rows: int) -> DataFrame:
    """Queries (with ``shard`` and ``bound``) searched in the rows of their shard: ``query_id``, ``vec_id``, ``score``, and a row without
    ``vec_id`` that says how many rows a task has ``verified`` for a query."""
    shard, key = ["dim", "shard"], ["dim", "shard", "part", "block"]
    count = F.count(F.lit(1))
    sizes = (rows.groupBy(*shard).agg(F.ceil(count / part_rows).alias("parts"))
             .join(asked.groupBy(*shard).agg(F.ceil(count / QUERY_ROWS).alias("blocks")), shard))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = rows.join(sizes, shard).select(*shard, F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"), upto("blocks").alias("block"), "vec_id", "embedding").toDF(*key, "vec_id", "embedding")
    right = asked.join(sizes, shard).select(
        *shard, upto("parts").alias("part"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).alias("block"), "vec_id", "embedding", "bound").toDF(*key, "vec_id", "embedding", "bound")

    def run(these: pa.Table, those: pa.Table) -> pa.Table:
        names, found, scores, seen = [], [], [], []
        if these.num_rows and those.num_rows:
            ids, of = these.column("vec_id").to_numpy(), those.column("vec_id").to_numpy()
            for own, best, score, verified in search(
                    matrix(these.column("embedding")), ids, matrix(those.column("embedding")), of, those.column("bound").to_numpy(), k):
                names += [own] * (len(best) + 1)
                found += [None, *best.tolist()]
                scores += [None, *score.tolist()]
                seen += [verified] + [None] * len(best)
        return pa.table([pa.array(names, pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.float64()), pa.array(seen, pa.int64())],
                        ["query_id", "vec_id", "score", "verified"])

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score double, verified long")


def _others(asked: DataFrame, boxes: list, enough: float) -> DataFrame:
    """The queries once per shard, other than their own, whose box is within their limit."""
    names = np.array([b["shard"] for b in boxes], np.int64)
    low, high = (np.array([b[c] for b in boxes]).reshape(-1, DIMS) for c in ("low", "high"))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):  # 64 queries by 4,096 boxes fill 25 MB
                part = batch.slice(lo, 64)
                limit = enough * np.maximum(part.column("bound").to_numpy(), 1e-12)
                within = gaps(low, high, matrix(part.column("point"))) <= limit[:, None]
                within &= names[None] != part.column("shard").to_numpy()[:, None]
                query, box = np.nonzero(within)
                taken = part.select(["dim", "vec_id", "embedding", "bound"]).take(pa.array(query))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(names[box])], ["dim", "vec_id", "embedding", "bound", "shard"])

    return asked.select("dim", "vec_id", "embedding", "bound", "point", "shard").mapInArrow(run, "dim int, vec_id long, embedding array<double>, bound double, shard long")


def verified_pairs(embeddings: DataFrame, every: int = 50, k: int = 5, part_rows: int = PART_ROWS) -> DataFrame:
    """What all tasks found: ``query_id``, ``vec_id``, ``score``; rows without ``vec_id`` say how many rows were ``verified``."""
    able = embeddings.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    depth = min(max(math.ceil(math.log2(max(able.count(), 1) / part_rows)), 0), DEPTH)
    sample = project(able.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE * 2 ** depth)).select("point").toArrow()
    rows = materialise(project(distinct_ids(able, "embedding"), Cuts(matrix(sample.column("point")), depth)), "ann-vectors")
    edge = lambda f: F.array(*[f(F.col("point")[i]) for i in range(DIMS)])
    boxes = rows.groupBy("shard").agg(edge(F.min).alias("low"), edge(F.max).alias("high")).collect()  # at most 2**DEPTH rows
    queries = rows.where(F.col("vec_id") % every == 0)
    first = materialise(_meet(rows, queries.withColumn("bound", F.lit(float("inf"))), k, part_rows), "ann-own-shard")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    kth = first.where("vec_id IS NOT NULL").withColumn("rank", place).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), (2 - 2 * F.col("score")).alias("bound"))
    asked = queries.join(kth, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    sent = materialise(_others(asked, boxes, quantile(SURE)), "ann-other-shards")
    return first.unionByName(_meet(rows, sent, k, part_rows))


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5, part_rows: int = PART_ROWS) -> DataFrame:
    """For the rows whose id is divisible by ``every``: ``query_id``, ``rank``, ``vec_id`` and ``score`` of the nearest other rows."""
    found = verified_pairs(embeddings, every, k, part_rows).where("vec_id IS NOT NULL")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

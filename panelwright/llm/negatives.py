"""Hard negatives by exact integer products of anchors and candidates, multiplied by Strassen's recursion.

Components become 64-bit integers, floor(scale * x). Blocks of anchors meet shards of candidates, each pair in a task of
its own; there, tiles of both are multiplied by seven half-size products a level (halves are filled up with
zeros) down to small leaves. Integer additions are exact, and sums that leave 64 bits on the way come back: any product that fits
64 bits is right.

Two passes over the pairs. The first keeps, for each anchor, a heap of its best rows of the same label; the heaps of all shards are merged. The
second multiplies again and keeps, for each anchor and positive, a heap of the best rows of other labels whose
score lies in the window of that positive's score; these are merged too. A heap is sorted by score, ties by the smaller id,
so heaps can be merged in any order. No scores are stored or shuffled but those in heaps.

Rows with a null label, id or vector, or a null or non-finite component, take no part, nor do vectors so long that a
product may not fit 64 bits (sum of squares of 2**62 and more). Rows that repeat an id count as one, the smallest.
Vectors of different length are never compared. Zero and empty vectors take part with scores of 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import materialise
from .vectors import distinct_ids

#: Candidates of a shard, anchors of a block, rows of a candidate tile and an anchor tile, and the size from which products are not split.
SHARD_ROWS, BLOCK_ROWS, TILE, ANCHORS, LEAF = 16_384, 2_048, 2_048, 256, 32
_LEAST = np.iinfo(np.int64).min + 1


def _even(x: np.ndarray) -> np.ndarray:
    return np.pad(x, [(0, n % 2) for n in x.shape]) if x.shape[0] % 2 or x.shape[1] % 2 else x


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two integer matrices."""
    rows, columns = a.shape[0], b.shape[1]
    if min(rows, a.shape[1], columns) <= leaf:
        return a @ b
    a, b = _even(a), _even(b)
    r, s, t = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :s], a[:r, s:], a[r:, :s], a[r:, s:]
    b11, b12, b21, b22 = b[:s, :t], b[:s, t:], b[s:, :t], b[s:, t:]
    out = np.empty((2 * r, 2 * t), np.int64)
    p = strassen(a11 + a22, b11 + b22, leaf)
    out[:r, :t] = p
    out[r:, t:] = p
    p = strassen(a21 + a22, b11, leaf)
    out[r:, :t] = p
    out[r:, t:] -= p
    p = strassen(a11, b12 - b22, leaf)
    out[:r, t:] = p
    out[r:, t:] += p
    p = strassen(a22, b21 - b11, leaf)
    out[:r, :t] += p
    out[r:, :t] += p
    p = strassen(a11 + a12, b22, leaf)
    out[:r, :t] -= p
    out[:r, t:] += p
    out[r:, t:] += strassen(a21 - a11, b11 + b12, leaf)
    out[:r, :t] += strassen(a12 - a22, b21 + b22, leaf)
    return out[:rows, :columns]


class Heaps:
    """The first ``k`` (score, id) of each of ``n`` rows; takes tiles whose ids ascend from tile to tile."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), _LEAST, np.int64), np.full((n, k), -1, np.int64)

    def take(self, rows: slice, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of the heaps ``rows`` against the ascending ``ids``, where ``allowed``."""
        held, named = self.score[rows], self.id[rows]
        better = np.where(allowed & (scores > held[:, -1:]), scores, _LEAST)  # an equal score has a larger id
        some = np.flatnonzero((better > _LEAST).any(1))
        if not len(some):
            return
        better = better[some]
        k = min(self.k, better.shape[1])
        edge = np.partition(better, better.shape[1] - k, axis=1)[:, [better.shape[1] - k]]
        at, column = np.nonzero((better >= edge) & (better > _LEAST))
        who = np.concatenate([np.repeat(np.arange(len(some)), self.k), at])
        score, name = np.concatenate([held[some].ravel(), better[at, column]]), np.concatenate([named[some].ravel(), ids[column]])
        order = np.lexsort((name, -score, who))
        first = order[np.searchsorted(who[order], np.arange(len(some)))[:, None] + np.arange(self.k)]
        held[some], named[some] = score[first], name[first]


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _tiles(anchors: pa.Table, rows: pa.Table):
    """Products of tiles: (slice of the anchors, ids and labels of the tile's rows, scores)."""
    ids = rows.column("vec_id").to_numpy()
    order = np.argsort(ids)
    ids, labels, x, a = ids[order], rows.column("label").to_numpy()[order], _matrix(rows.column("v"))[order], _matrix(anchors.column("v"))
    for lo in range(0, len(ids), TILE):
        b = np.ascontiguousarray(x[lo: lo + TILE].T)
        for at in range(0, len(a), ANCHORS):
            yield slice(at, min(at + ANCHORS, len(a))), ids[lo: lo + TILE], labels[lo: lo + TILE], strassen(a[at: at + ANCHORS], b)


def _paired(anchors: DataFrame, rows: DataFrame, run, schema: str) -> DataFrame:
    """Every block of anchors with every shard of rows of the same vector length, each pair in a task of its own."""
    sizes = (
        rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).alias("shards"))
        .join(anchors.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks")), "dim"))
    shard, block = F.pmod(F.xxhash64("vec_id"), F.col("shards")).alias("shard"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).alias("block")
    upto = lambda c, name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).alias(name)
    sizes = F.broadcast(sizes)  # one row per length of vectors
    left = anchors.join(sizes, "dim").select("dim", block, upto("shards", "shard"), *[c for c in anchors.columns if c != "dim"])
    right = rows.join(sizes, "dim").select("dim", upto("blocks", "block"), shard, "vec_id", "label", "v")
    key = ["dim", "block", "shard"]
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # columns of their own for both sides
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema)


def _first(found: DataFrame, key: list[str], k: int, name: str) -> DataFrame:
    """The first ``k`` rows of the merged heaps."""
    return found.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("score"), name))).where(F.col("rank") <= k)


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def _usable(vector: Column, scale: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    squares = F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.pow(F.floor(F.least(F.abs(F.lit(scale) * x.cast("double")), F.lit(1e18))).cast("double") + 1, F.lit(2.0)))
    return F.coalesce(finite & (squares < 2.0 ** 62), F.lit(False))


def hard_negatives(vectors: DataFrame, label: Column, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """For the anchors, rows whose id is divisible by ``every``, and each of their first ``positives``: the first ``negatives`` rows of other labels whose
    score is between ``low`` and ``high`` percent of the positive's: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``."""
    part = vectors.select("vec_id", "embedding", label.cast("long").alias("label"))
    part = distinct_ids(part.where("label IS NOT NULL AND embedding IS NOT NULL").where(_usable(F.col("embedding"), scale)), "embedding", "label")
    rows = materialise(part.select("vec_id", "label", integers(F.col("embedding"), scale).alias("v"), F.size("embedding").alias("dim")), "negatives-rows")
    anchors = rows.where(F.col("vec_id") % every == 0)

    def best(asked: pa.Table, these: pa.Table) -> pa.Table:
        own, label = asked.column("vec_id").to_numpy(), asked.column("label").to_numpy()
        heaps = Heaps(len(own), positives)
        for at, ids, labels, scores in _tiles(asked, these):
            heaps.take(at, scores, (label[at, None] == labels) & (own[at, None] != ids), ids)
        row, place = np.nonzero(heaps.id >= 0) if these.num_rows else (np.zeros(0, np.int64),) * 2
        return pa.table([pa.array(own[row]), pa.array(heaps.id[row, place]), pa.array(heaps.score[row, place])], ["anchor_id", "vec_id", "score"])

    found = _first(_paired(anchors, rows, best, "anchor_id long, vec_id long, score long"), ["anchor_id"], positives, "vec_id")
    wanted = found.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("vec_id").alias("id"), "score")).alias("positives"))
    wanted = materialise(wanted, "negatives-positives")
    asked = anchors.join(wanted.withColumnRenamed("anchor_id", "vec_id"), "vec_id")

    def inside(asked: pa.Table, these: pa.Table) -> pa.Table:
        own, label, wanted = asked.column("vec_id").to_numpy(), asked.column("label").to_numpy(), asked.column("positives").to_pylist()
        score = np.full((len(own), positives), -1, np.int64)  # no window below 0
        for i, w in enumerate(wanted):
            score[i, : len(w)] = [p["score"] for p in w]
        heaps = [Heaps(len(own), negatives) for _ in range(positives)]
        for at, ids, labels, scores in _tiles(asked, these):
            other = label[at, None] != labels
            for j, heap in enumerate(heaps):
                s = score[at, j, None]
                # 100 * score between low and high times the positive's, in whole numbers; a window of a negative score is empty
                heap.take(at, scores, other & (scores >= -(-low * s // 100)) & (scores <= high * s // 100), ids)
        out = []
        for j, heap in enumerate(heaps):
            row, place = np.nonzero(heap.id >= 0) if these.num_rows else (np.zeros(0, np.int64),) * 2
            out.append((own[row], np.array([wanted[i][j]["id"] for i in row], np.int64), score[row, j], heap.id[row, place], heap.score[row, place]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], ["anchor_id", "positive_id", "positive_score", "vec_id", "score"])

    found = _paired(asked, rows, inside, "anchor_id long, positive_id long, positive_score long, vec_id long, score long")
    return _first(found, ["anchor_id", "positive_id"], negatives, "vec_id").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def oracle(every: int) -> str:
    return f"""
WITH part AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM part a JOIN part r ON a.vec_id % {every} = 0 AND a.vec_id <> r.vec_id),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN pairs USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3"""

"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order. Vectors that are alike share most of
them. The inverted lists are kept per set of ``shared`` pivots out of a vector's ``near`` nearest: two vectors
meet in a list exactly if their shared-pivot count reaches ``shared``. Those that meet are verified by cosine in
double precision on the original vectors. A pair that meets in several lists counts in the one of its smallest shared pivots only.

Pivots are taken from a bounded sample (the first ids by hash, growing as the cube root of the number of vectors so that chance lists
stay short), leaving out what is close to one already taken: within a cloud of near copies several pivots would be ordered by noise alone.
Vectors that all point much the same way have few pivots that are apart, so the sample's mean may be taken off before pivots are
chosen and vectors described. ``SETTINGS`` are tried on the sample: of those that retrieve ``ENOUGH`` of its links, and of
drawn neighbours of its vectors, the one under which fewest pairs meet is taken; if none does, all vectors are one list and all pairs are
verified. Every vector is indexed. Equal vectors of a label are one class with a weight. Lists are
cut into blocks, and pairs of blocks are verified in different tasks, so a hot list is never one task; a task gives
counts and one edge per vector rather than pairs.

Vectors that are null, zero or hold null or non-finite components, and those of null label, link with nothing; so do vectors of
different length. Null ids are left out of the index and get no component. Rows that repeat an id count as one vector.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, materialise
from .vectors import distinct_ids, matrix, normalised, usable

#: Pivots (this many times the cube root of the number of vectors), nearest ones that describe a vector, shared ones that make a list.
SETTINGS = ((4, 7, 3), (16, 10, 2), (16, 14, 2))
#: At least and at most so many pivots.
LEAST, MOST = 64, 16_000
#: Candidates for each pivot, and the cosine with a pivot already taken from which a candidate is left out.
CANDIDATES, APART = 4, 0.7
#: Vectors of the sample, and links among them, that the settings are tried on (at most); share of links to be retrieved.
TRIED, TRIED_LINKS, ENOUGH = 2_048, 100_000, 0.97
BLOCK = 1_024


class Index:
    """Pivots (rows of length 1, shorter ones filled up with zeros), the mean taken off vectors of each length, and a setting."""

    def __init__(self, pivots: np.ndarray, means: dict[int, np.ndarray], near: int, shared: int):
        self.pivots, self.means = pivots, means
        self.near = min(near, len(pivots))
        self.shared = min(shared, self.near)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Numbers of the nearest pivots of each row, nearest first, ties (to nine digits) to the smaller number."""
        x = centred(normalised(x), self.means)
        w = min(x.shape[1], self.pivots.shape[1])
        return np.argsort(-np.round(x[:, :w] @ self.pivots[:, :w].T, 9), axis=1, kind="stable")[:, : self.near]

    def meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the vectors described by rows of ``a`` and of ``b`` share enough pivots."""
        return (a[:, :, None] == b[:, None, :]).sum((1, 2)) >= self.shared


def centred(x: np.ndarray, means: dict[int, np.ndarray]) -> np.ndarray:
    if x.shape[1] not in means:
        return x
    x = x - means[x.shape[1]]
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def thinned(rows: list[np.ndarray], most: int) -> np.ndarray:
    """The first rows, at most ``most``, that are apart from those already taken."""
    out, taken = np.zeros((most, max((len(r) for r in rows), default=1))), 0
    for r in rows:
        if taken < most and (out[:taken, : len(r)] @ r < APART).all():
            out[taken, : len(r)] = r
            taken += 1
    return out[:taken]


def retrieved(index: Index, x: np.ndarray, threshold: float) -> tuple[float, float]:
    """Share of links that meet (the smaller one of links in ``x`` and of drawn neighbours), and share of other pairs that do."""
    r = np.random.default_rng(0)
    noise = r.standard_normal(x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    cosine = np.linspace(threshold, 1, len(x))[:, None]
    drawn = cosine * x + np.sqrt(1 - cosine * cosine) * noise / np.maximum(np.sqrt((noise * noise).sum(1, keepdims=True)), 1e-9)
    near = index.nearest(x)
    a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
    some = r.permutation(len(a))[:TRIED_LINKS]
    met = [index.meet(near, index.nearest(drawn)), index.meet(near[a[some]], near[b[some]])]
    pairs = np.concatenate([index.meet(near, np.roll(near, by, axis=0)) for by in range(1, min(len(x), 17))] or [np.zeros(1)])
    return min(m.mean() for m in met if len(m)), pairs.mean()


def fit_index(classes: DataFrame, threshold: float) -> Index:
    n = classes.count()
    counts = [int(min(max(c * n ** (1 / 3), LEAST), MOST)) for c, _, _ in SETTINGS]
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(max(CANDIDATES * max(counts), TRIED)).select("embedding").toArrow().column("embedding")
    sizes = np.array([len(v) for v in sample], np.int64)
    by_size = {int(d): normalised(matrix(sample.take(pa.array(np.flatnonzero(sizes == d))))) for d in np.unique(sizes)}
    tried = max(by_size.values(), key=len)[:TRIED]  # of the commonest length
    best, fewest = Index(np.zeros((1, 1)), {}, 0, 0), 1.0
    for means in ({d: x.mean(0) for d, x in by_size.items()}, {}):
        flat = {d: centred(x, means) for d, x in by_size.items()}
        place = {d: np.cumsum(sizes == d) - 1 for d in by_size}
        pivots = thinned([flat[int(d)][place[int(d)][i]] for i, d in enumerate(sizes[: CANDIDATES * max(counts)])], max(counts))
        for m, (_, near, shared) in zip(counts, SETTINGS):
            index = Index(pivots[:m], means, near, shared)
            share, pairs = retrieved(index, tried, threshold)
            if share >= ENOUGH and pairs < fewest:
                best, fewest = index, pairs
    return best


def describe(classes: DataFrame, index: Index) -> DataFrame:
    """``rep``, ``near`` (its nearest pivots in order) and ``key`` for each list the vector is in."""
    several = list(combinations(range(index.near), index.shared))

    def run(batches):
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("embedding")])
            for d in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == d))
                near = index.nearest(matrix(batch.column("embedding").take(at)))
                ordered = np.sort(near, axis=1)
                keys = np.stack([(ordered[:, np.array(c, np.int64)] * (MOST ** np.arange(len(c) - 1, -1, -1, dtype=np.int64))).sum(1) for c in several], axis=1)
                yield pa.RecordBatch.from_arrays([
                    batch.column("rep").take(at), pa.array(near.tolist(), pa.list_(pa.int32())), pa.array(keys.tolist(), pa.list_(pa.int64()))], ["rep", "near", "keys"])

    return classes.select("rep", "embedding").mapInArrow(run, "rep long, near array<int>, keys array<long>").select("rep", "near", F.explode("keys").alias("key"))


def _verify(table: pa.Table, index: Index, threshold: float) -> list[tuple[int, int, int]]:
    """For one list (or pair of its blocks): per linked vector the weight of its links, and the smallest id connected with it."""
    rep, weight, side = (table.column(c).to_numpy() for c in ("rep", "weight", "side"))
    key, cross = int(table.column("key")[0].as_py()), table.column("b1")[0].as_py() != table.column("b2")[0].as_py()
    x = normalised(matrix(table.column("embedding")))
    linked = (x @ x.T >= threshold) & (rep[:, None] != rep[None, :])
    if index.shared:
        near = np.array(table.column("near").to_pylist())
        member = np.zeros((len(rep), len(index.pivots)), np.float32)
        np.put_along_axis(member, near, 1, axis=1)
        member = member[:, : key % MOST + 1]
        linked &= member @ member.T == index.shared
    if cross:
        linked &= side[:, None] != side[None, :]
    label = rep.copy()
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1))
        if (new == label).all():
            break
        label = new
    counts = linked @ weight
    return [(int(r), int(c), int(to)) for r, c, to in zip(rep, counts, label) if c]


def link_counts(classes: DataFrame, threshold: float) -> DataFrame:
    """``rep``, ``links`` (weight of the classes linked, by part) and ``to`` (an id connected with it)."""
    index = fit_index(classes, threshold)
    lists = materialise(describe(classes, index).join(classes.select("rep", "label", F.size("embedding").alias("dim")), "rep"), "pivots-lists")
    name = ["label", "dim", "key"]
    sizes = lists.groupBy(*name).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    dealt = (
        lists.join(sizes, name).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(*name, F.least("side", "other").alias("b1"), F.greatest("side", "other").alias("b2"), "side", "rep", "near")
        .join(classes.select("rep", "embedding", "weight"), "rep"))
    part = [*name, "b1", "b2"]

    def run(batches):
        kept: list[pa.RecordBatch] = []
        names, last = None, None

        def finished(table: pa.Table) -> pa.RecordBatch:
            out = _verify(table, index, threshold) if table.num_rows > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["rep", "links", "to"])

        for batch in batches:
            names = list(zip(*[batch.column(c).to_pylist() for c in part]))
            lo = 0
            while lo < len(names):
                hi = lo
                while hi < len(names) and names[hi] == names[lo]:
                    hi += 1
                if kept and last != names[lo]:
                    yield finished(pa.Table.from_batches(kept))
                    kept = []
                kept.append(batch.slice(lo, hi - lo))
                last, lo = names[lo], hi
        if kept:
            yield finished(pa.Table.from_batches(kept))

    return dealt.repartition(*part).sortWithinPartitions(*part).mapInArrow(run, "rep long, links long, to long")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Per id: ``vec_id``, ``n_links``, ``component_id`` and ``kept``."""
    vectors = materialise(distinct_ids(embeddings, "label", "embedding"), "pivots-vectors")
    able = vectors.where(usable(F.col("embedding")) & F.col("label").isNotNull())
    classes = materialise(able.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "pivots-classes")
    if classes.isEmpty():
        found = None
    else:
        found = materialise(link_counts(classes, threshold), "pivots-links")
    members = able.join(classes, ["label", "embedding"]).select("vec_id", "rep", "weight")
    if found is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    labels = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")), "pivots").select(F.col("id").alias("rep"), "component_id")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = (
        members.join(counts, "rep", "left").join(labels, "rep", "left")
        .select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")))
    return (
        vectors.select("vec_id").join(known, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id")))

"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

The incidence matrix has a row per document and a column per n-gram of words. Its columns are put in one
order, rare before frequent (by a fixed-size count table), ties by hash. Two documents can only reach the
similarity if they share a column among the first ``n - ceil(t * n) + 1`` of each, so only that part of the
matrix is dealt out, in blocks of columns. Within a column every document is multiplied with the column's
smallest document; a product counts while the size-derived bounds can still be met, and overlaps are
accumulated per pair. Pairs left are settled by their complete rows.

A column of L documents thus gives L - 1 products rather than L * (L - 1) / 2. A second round multiplies neighbours
in a column (in the order of a hash) that the first has put in different components. The last round multiplies what is
left in blocks: documents are cut into blocks of bounded size, those that share a frequent column next to one another, and
each two blocks with a column in common meet in one task, which gets their rows in such columns. The sparse product is
made there, so no product is ever a row: overlaps in all of the part dealt out are counted in full, and only pairs that
every bound allows leave the task. So components are exact: each pair that shares such a column is either
settled by its complete rows, excluded by a bound, or already connected.

Rows of null ``doc_id`` get their set size and no component. Rows that repeat an id with other texts are rows of the matrix of
their own; what links one of them links the id. Texts that are null or without words have size 0 and link with nothing.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import components, materialise
from .wordhash import chunked, mix

#: Columns are counted in this many buckets (0.5 MB on the driver, whatever the input's size).
BUCKETS = 1 << 16
#: Entries of the matrix in a block of documents, and documents of a tile within a product of blocks.
BLOCK_ROWS, TILE, AT_ONCE = 1 << 16, 1_024, 1 << 21
#: Pairs that are settled at once, so that a task holds the complete rows of these only.
PAIRS = 256
#: Pairs whose texts are moved in one statement, or half as many as there are documents if these are more.
MOVED = 100_000
#: Signatures a task remembers so that it deals out copies only once; full, it starts anew.
REMEMBERED = 200_000


#: Spark removes the shuffle files of a statement as it ends, and does not wait until the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``materialise``; nothing reads the shuffle files behind a stored table again, so they go once it is written."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, None)
    conf.set(CLEAN_UP, "true")
    try:
        return materialise(df, name)
    finally:
        conf.unset(CLEAN_UP) if before is None else conf.set(CLEAN_UP, before)


def _signature(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s + np.uint64(7)).sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64).view(np.int64))


def survey(docs: DataFrame, k: int) -> DataFrame:
    """One row per document (``doc_id``, ``n``, ``s1``, ``s2``: a 128-bit hash of the set), and per task the columns' counts by bucket (``bucket``, ``n``)."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), []
            for lo, words in chunked(batch.column("text"), fold=True):
                sets = [np.unique(words.grams(i, k)) for i in range(len(words.first) - 1)]
                counts += np.bincount((np.concatenate(sets) >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
                out += [(ids[lo + i], len(s), *_signature(s)) for i, s in enumerate(sets)]
            if out:
                a, b, c, d = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.nulls(len(out), pa.int64())], ["doc_id", "n", "s1", "s2", "bucket"])
        at = np.flatnonzero(counts)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(counts[at]), none, none, pa.array(at.astype(np.int64))], ["doc_id", "n", "s1", "s2", "bucket"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, bucket long")


def _levels(surveyed: DataFrame) -> np.ndarray:
    """How frequent a bucket is: 0 up to the mean, then one more for each doubling."""
    rows = surveyed.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BUCKETS)
    for r in rows:
        counts[r["bucket"]] = r["n"]
    return np.clip(np.ceil(np.log2(np.maximum(counts, 1) / max(counts.mean(), 1)) - 0.1), 0, 30).astype(np.uint64)


def _dealt(n: int, percent: int) -> int:
    """How many columns of a row of n are dealt out."""
    return n - (percent * n + 99) // 100 + 1


def incidence(docs: DataFrame, k: int, percent: int, levels: np.ndarray) -> DataFrame:
    """The part of the matrix that can decide: ``g`` (column), ``doc``, ``t`` (hash of the text), ``place`` (size of the row * 2**32 + place of the column in it)."""

    def run(batches):
        seen: set = set()
        for batch in batches:
            ids, marks = batch.column("doc_id").to_pylist(), batch.column("t").to_pylist()
            for lo, words in chunked(batch.column("text"), fold=True):  # entries leave chunk by chunk, so that a task never holds those of a whole batch
                out = []
                for i in range(len(words.first) - 1):
                    s = np.unique(words.grams(i, k))
                    sig = _signature(s)
                    if not len(s) or sig in seen or ids[lo + i] is None:
                        continue
                    seen.add(sig)
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    g = np.sort((levels[(s >> np.uint64(48)).astype(np.int64)] << np.uint64(58)) | (s >> np.uint64(6)))
                    out.append((g[: _dealt(len(g), percent)], ids[lo + i], marks[lo + i], len(g)))
                if out:
                    sizes = [len(g) for g, *_ in out]
                    places = (np.repeat([n for *_, n in out], sizes).astype(np.int64) << 32) + np.concatenate([np.arange(m) for m in sizes])
                    columns = [np.concatenate([g for g, *_ in out]).view(np.int64), *[np.repeat(np.array([o[k] for o in out], np.int64), sizes) for k in (1, 2)], places]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["g", "doc", "t", "place"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(run, "g long, doc long, t long, place long")


def _needed(percent: int) -> Column:
    """The overlap that the sizes of a pair ask for."""
    return F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))


def _sizes_fit(percent: int) -> Column:
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def _can_reach(percent: int) -> Column:
    """The bounds on a product at one shared column: what precedes and what follows it limits the overlap."""
    overlap = F.least("pos_a", "pos_b") + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    return _sizes_fit(percent) & (overlap >= _needed(percent))


def _leads(percent: int) -> Column:
    """Whether the column is among those of which a pair with enough overlap shares one at least."""
    return (F.col("pos_a") <= F.col("n_a") - _needed(percent)) & (F.col("pos_b") <= F.col("n_b") - _needed(percent))


def _accumulate(products: DataFrame, percent: int) -> DataFrame:
    """Pairs with their overlap in the columns at hand, their last places there, and whether every bound allows them."""
    return products.groupBy("a", "ta", "b", "tb").agg(
        F.count(F.lit(1)).alias("shared"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.max("pos_a").alias("last_a"), F.max("pos_b").alias("last_b"),
        F.min(_can_reach(percent)).alias("reach"), F.max(_leads(percent)).alias("leads")).where("reach AND leads")


def _place(packed: str, side: str) -> list[Column]:
    return [F.shiftright(packed, 32).alias(f"n_{side}"), F.col(packed).bitwiseAND(F.lit(2 ** 32 - 1)).alias(f"pos_{side}")]


def _ordered(products: DataFrame) -> DataFrame:
    """The smaller document of each product as a."""
    swap = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x)
    return products.select(*[pick(f"{c}a", f"{c}b") for c in ("", "t", "n_", "pos_")], *[pick(f"{c}b", f"{c}a") for c in ("", "t", "n_", "pos_")])


def _split_columns(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns whose documents are not all in one component (``c``)."""
    column = W.partitionBy("g")
    return (
        shared.select("g", "doc", "t", "place", "rows").join(labels.select(F.col("id").alias("doc"), "component_id"), "doc", "left")
        .withColumn("c", F.coalesce("component_id", "doc")).drop("component_id")
        .withColumn("c_min", F.min("c").over(column)).withColumn("c_max", F.max("c").over(column))
        .where("c_min < c_max").drop("c_min", "c_max"))


def _blocks(split: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """The entries of the split columns once for each pair of blocks (``x`` <= ``y``) that may need them; ``own`` is the entry's block.

    A document belongs to the block of its most frequent column, so that the documents of a frequent column fill few blocks.
    Columns with more entries than a block holds are cut by the size of the document's row, in steps of the similarity, and then by a hash of the
    document; those with fewer share blocks. An entry goes to a block only if its row's size fits one there that has the column; as sizes rule out a pair
    in all of its columns at once, the overlap of the pairs left is still counted in full.
    """
    node, n = ["doc", "t"], F.shiftright("place", 32)
    total = split.count()
    chosen = split.groupBy(*node).agg(F.max(F.struct("rows", "g"))["g"].alias("key"), F.count(F.lit(1)).alias("entries"), F.first(n).alias("n"))
    chosen = chosen.withColumn("step", F.floor(F.log("n") / math.log(100 / percent)) if percent < 100 else F.col("n"))
    steps = chosen.groupBy("key", "step").agg(F.sum("entries").alias("held")).withColumn("of_key", F.sum("held").over(W.partitionBy("key")))
    small, part = F.pmod(F.xxhash64("key"), F.lit(-(-total // block_rows))), F.pmod(F.xxhash64(*node), F.ceil(F.col("held") / block_rows))
    placed = chosen.join(steps, ["key", "step"]).select(*node, F.when(F.col("of_key") < block_rows, small).otherwise(F.xxhash64("key", "step", part)).alias("own"))
    entries = _stored(split.join(placed, node), "jaccard-blocks")
    meets = (
        entries.groupBy("g", "own").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(n).alias("least"), F.max(n).alias("most"))
        .groupBy("g").agg(F.collect_list(F.struct("own", "lo", "hi", "least", "most")).alias("blocks")))
    mine = F.filter("blocks", lambda m: m["own"] == F.col("own"))[0]
    # two blocks that hold one and the same component in this column have nothing to compare there
    other = F.filter("blocks", lambda m: ((F.col("mine.lo") < F.col("mine.hi")) | (m["lo"] < m["hi"]) | (m["lo"] != F.col("mine.lo"))) & (100 * m["most"] >= percent * n) & (100 * n >= percent * m["least"]))
    return (
        entries.join(meets, "g").withColumn("mine", mine).withColumn("meet", F.explode(other))
        .select(F.least("own", "meet.own").alias("x"), F.greatest("own", "meet.own").alias("y"), "own", "g", "doc", "t", "c", "place"))


class _Rows:
    """Entries of a block, ordered by document and column."""

    def __init__(self, table: pa.Table):
        columns = {c: table.column(c).to_numpy() for c in ("g", "doc", "t", "c", "place")}
        order = np.lexsort((columns["g"], columns["t"], columns["doc"]))
        g, t, doc = (columns[c][order] for c in ("g", "t", "doc"))
        again = np.zeros(len(order), bool)  # a row of the table that several tasks have read
        again[1:] = (g[1:] == g[:-1]) & (t[1:] == t[:-1]) & (doc[1:] == doc[:-1])
        order = order[~again]
        self.g, self.doc, self.t, self.c, place = (columns[c][order] for c in ("g", "doc", "t", "c", "place"))
        self.n, self.pos = place >> 32, place & 0xFFFFFFFF
        new = np.ones(len(order), bool)
        new[1:] = (self.doc[1:] != self.doc[:-1]) | (self.t[1:] != self.t[:-1])
        self.head = np.append(np.flatnonzero(new), len(order))
        self.node = np.cumsum(new) - 1

    def tiles(self):
        """(first document, entries ordered by column) of each tile."""
        for lo in range(0, len(self.head) - 1, TILE):
            a, b = self.head[lo], self.head[min(lo + TILE, len(self.head) - 1)]
            yield lo, a + np.argsort(self.g[a:b], kind="stable")


def _tile_product(left: _Rows, lo_a: int, la: np.ndarray, right: _Rows, lo_b: int, rb: np.ndarray, within: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of documents of two tiles which the overlap in the part dealt out, the sizes and the places allow."""
    rows_a, rows_b = min(TILE, len(left.head) - 1 - lo_a), min(TILE, len(right.head) - 1 - lo_b)
    shared, failed, leading = (np.zeros(rows_a * rows_b, np.int32) for _ in range(3))
    last_a, last_b = np.zeros(rows_a * rows_b, np.int64), np.zeros(rows_a * rows_b, np.int64)
    gb = right.g[rb]
    begin, end = np.searchsorted(gb, left.g[la]), np.searchsorted(gb, left.g[la], "right")
    size = end - begin
    done = np.cumsum(size)
    cuts = np.unique(np.append(np.searchsorted(done, np.arange(0, done[-1] if len(done) else 0, AT_ONCE)), len(la)))
    for lo, hi in zip(np.append(0, cuts[:-1]), cuts):
        part = size[lo:hi]
        i = np.repeat(la[lo:hi], part)
        j = rb[np.repeat(begin[lo:hi] - (np.cumsum(part) - part), part) + np.arange(part.sum())]
        fits = (left.c[i] != right.c[j]) & (100 * np.minimum(left.n[i], right.n[j]) >= percent * np.maximum(left.n[i], right.n[j]))
        if within:
            fits &= left.node[i] < right.node[j]
        i, j = i[fits], j[fits]
        at = (left.node[i] - lo_a) * rows_b + right.node[j] - lo_b
        needed = -(-percent * (left.n[i] + right.n[j]) // (100 + percent))
        rest_a, rest_b = left.n[i] - left.pos[i], right.n[j] - right.pos[j]
        shared += np.bincount(at, minlength=len(shared)).astype(np.int32)
        failed += np.bincount(at[np.minimum(left.pos[i], right.pos[j]) + np.minimum(rest_a, rest_b) < needed], minlength=len(shared)).astype(np.int32)
        leading += np.bincount(at[(rest_a >= needed) & (rest_b >= needed)], minlength=len(shared)).astype(np.int32)
        last_a[at], last_b[at] = left.pos[i], right.pos[j]  # columns ascend, so the last one stays
    at = np.flatnonzero((leading > 0) & (failed == 0))
    i, j = left.head[lo_a + at // rows_b], right.head[lo_b + at % rows_b]
    na, nb = left.n[i], right.n[j]
    # beyond the row that ends first, at most its rest can be shared
    more = np.maximum(np.minimum(-(-percent * na // 100) - 1, nb - last_b[at] - 1), np.minimum(-(-percent * nb // 100) - 1, na - last_a[at] - 1))
    keep = shared[at] + more >= -(-percent * (na + nb) // (100 + percent))
    a, b = left.doc[i[keep]], right.doc[j[keep]]
    return np.minimum(a, b), np.maximum(a, b)


def blocked_products(split: DataFrame, percent: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs of documents of different components (``a``, ``b``) that the part dealt out can't exclude, by products of blocks."""

    def run(table: pa.Table) -> pa.Table:
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        own = table.column("own").to_numpy()
        left = _Rows(table.filter(pa.array(own == x)))
        right = left if x == y else _Rows(table.filter(pa.array(own == y)))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        others = list(right.tiles())
        for lo_a, la in left.tiles():
            found += [_tile_product(left, lo_a, la, right, lo_b, rb, x == y and lo_a == lo_b, percent) for lo_b, rb in others if x != y or lo_a <= lo_b]
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], ["a", "b"])

    return _blocks(split, percent, block_rows).groupBy("x", "y").applyInArrow(run, "a long, b long").where("a < b").distinct()


def settle(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose complete rows, or those of any of their texts, overlap enough."""
    both = (
        pairs.select("a", "b").distinct().join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS):
                part = batch.slice(at, PAIRS)
                left: list[np.ndarray] = []
                for lo, words in chunked(part.column("text_a"), fold=True):
                    left += [np.unique(words.grams(i, k)) for i in range(len(words.first) - 1)]
                keep = np.zeros(part.num_rows, bool)
                for lo, words in chunked(part.column("text_b"), fold=True):
                    for i in range(len(words.first) - 1):
                        a, b = left[lo + i], np.unique(words.grams(i, k))
                        if len(a) and len(b):
                            found = np.searchsorted(a, b)
                            found[found == len(a)] = 0
                            keep[lo + i] = (100 + percent) * int((a[found] == b).sum()) >= percent * (len(a) + len(b))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(keep)), part.column("b").filter(pa.array(keep))], ["a", "b"])

    return both.mapInArrow(run, "a long, b long").distinct()


def _settled(pairs: DataFrame, docs: DataFrame, rows: int, k: int, percent: int) -> DataFrame:
    """``settle`` for a stored table of pairs of the ``rows`` documents, stored.

    Each pair carries a text through a shuffle, and there can be more pairs than documents; so that many pairs
    take several statements, each for half as many pairs as there are documents.
    """
    texts = docs.select(F.col("doc_id").alias("doc"), "text")
    parts = max(1, -(-pairs.count() // max(MOVED, rows // 2)))
    part = F.pmod(F.xxhash64("a", "b"), F.lit(parts))
    return reduce(DataFrame.union, [_stored(settle(pairs.where(part == i), texts, k, percent), "jaccard-settled") for i in range(parts)])


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` under links of similarity ``percent`` / 100 and more."""
    surveyed = _stored(survey(docs, k), "jaccard-survey")
    rows = surveyed.where("bucket IS NULL").select("doc_id", "n", "s1", "s2")
    nodes = rows.where("doc_id IS NOT NULL AND n > 0")
    n_nodes = nodes.count()
    same = nodes.groupBy("s1", "s2").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    copies = nodes.join(same, ["s1", "s2"]).where("a <> doc_id").select("a", F.col("doc_id").alias("b"))

    column = W.partitionBy("g")
    shared = (
        incidence(docs, k, percent, _levels(surveyed))
        .withColumn("least", F.min(F.struct("doc", "t", "place")).over(column))
        .withColumn("rows", F.count(F.lit(1)).over(column)).where("rows > 1"))
    shared = _stored(shared, "jaccard-columns")
    first = _stored(_accumulate(
        shared.where("doc <> least.doc").select(
            F.col("least.doc").alias("a"), F.col("least.t").alias("ta"), *_place("least.place", "a"), F.col("doc").alias("b"), F.col("t").alias("tb"), *_place("place", "b")), percent), "jaccard-first")
    links = _stored(_settled(first, docs, n_nodes, k, percent).union(copies), "jaccard-links")
    labels = components(links, "jaccard")

    split = _split_columns(shared.where("rows > 2"), labels).withColumn("order", F.xxhash64("doc", "g"))
    beside = W.partitionBy("g").orderBy("order", "doc")
    near = (
        split.withColumn("other", F.lag(F.struct("doc", "t", "place", "c")).over(beside)).where("other.c <> c")
        .select(F.col("doc").alias("a"), F.col("t").alias("ta"), *_place("place", "a"), F.col("other.doc").alias("b"), F.col("other.t").alias("tb"), *_place("other.place", "b")))
    near = _stored(_accumulate(_ordered(near), percent).join(first.select("a", "b"), ["a", "b"], "left_anti"), "jaccard-near")
    if not near.isEmpty():
        links = _stored(links.union(_settled(near, docs, n_nodes, k, percent)), "jaccard-links")
        labels = components(links, "jaccard")

    # Columns of two documents give no new pairs, but count in the overlap that excludes a pair.
    split = _stored(_split_columns(shared, labels), "jaccard-split")
    last = blocked_products(split, percent).join(first.select("a", "b").union(near.select("a", "b")), ["a", "b"], "left_anti")
    last = _stored(last, "jaccard-last")
    if not last.isEmpty():
        labels = components(links.union(_settled(last, docs, n_nodes, k, percent)), "jaccard")
    return (
        rows.join(labels.select(F.col("id").alias("doc_id"), "component_id"), "doc_id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))

"""Ranked lexical search, a term at a time with a limited number of accumulators.

1. ``index``: documents are read once; every few thousand of them become a block of an inverted index over the
   terms asked for: postings by term (place in the block, number of occurrences), the documents' ids and numbers of
   terms. Blocks are rows of a stored table, from which Spark sums the collection's figures (N, L, df).
2. ``search``: for each block and item the terms are taken rarest first. A document gets an accumulator when a term of
   it comes up, until what the terms left can add at most is below the k-th best partial score (or the k-th best
   score of blocks before): a document not seen by then cannot be among the first k any more. From there on the
   other terms only update the accumulators there are, in full. So scores are exact.
3. The first k of each task are merged per item.

Items are taken in groups of bounded size, one pass each; only a group's terms are sent to the tasks.

Scores are 64-bit integers: of a term with weight w, w * ((10**9 * tf) div (1000 * tf + 8 * m)), where m grows with the
document's number of terms. Terms are compared by 64-bit hashes. Null texts have no terms. Rows that repeat a ``doc_id`` are
documents of their own; those without one count in the figures and are not ranked. Items without an id take no part, rows that
repeat an ``item_id`` are one item with all their terms. Ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import materialise
from .wordhash import NOT_ALPHANUMERIC, chunked

#: Documents and postings after which a block ends, and terms (with repeats in several items) of a group of items.
BLOCK_DOCS, BLOCK_POSTINGS, GROUP_TERMS = 8_192, 1 << 20, 500_000
_INDEX = ("ids array<long>, sizes array<long>, terms array<int>, df array<int>, kept array<int>, at array<int>, tf array<int>, n_docs long, n_terms long")


def item_terms(items: DataFrame) -> DataFrame:
    """The distinct terms of each item: ``item_id``, ``term`` (hash)."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, terms = [], []
            for lo, words in chunked(batch.column("text"), fold=True, blank=NOT_ALPHANUMERIC):
                at.append(np.repeat(np.arange(lo, lo + len(words.first) - 1), np.diff(words.first)))
                terms.append(words.hash)
            if terms:
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(np.concatenate(at))), pa.array(np.concatenate(terms).view(np.int64))], ["item_id", "term"])

    return items.where("item_id IS NOT NULL").select("item_id", "text").mapInArrow(run, f"item_id {kind}, term long").distinct()


class _Block:
    """Postings gathered for one block."""

    def __init__(self):
        self.ids, self.sizes, self.doc, self.term, self.tf = [], [], [], [], []
        self.docs = self.postings = self.n_docs = self.n_terms = 0

    def add(self, ids: np.ndarray, known: np.ndarray, words, vocabulary: np.ndarray) -> None:
        """``ids`` of the texts (``known``: not null) and their words."""
        n = np.diff(words.first)
        self.n_docs += int((n > 0).sum())
        self.n_terms += int(n.sum())
        at = np.searchsorted(vocabulary, words.hash)
        at[at == len(vocabulary)] = 0
        asked = np.flatnonzero(vocabulary[at] == words.hash)
        text = np.searchsorted(words.first, asked, "right") - 1
        code, tf = np.unique(text * len(vocabulary) + at[asked], return_counts=True)
        text, term = code // len(vocabulary), code % len(vocabulary)
        some, place = np.unique(text, return_inverse=True)
        self.ids.append(np.where(known[some], ids[some], 0))
        self.sizes.append(np.where(known[some], n[some], -1))  # -1: not to be ranked
        self.doc.append(place.reshape(-1) + self.docs)
        self.term.append(term)
        self.tf.append(tf)
        self.docs, self.postings = self.docs + len(some), self.postings + len(code)

    def row(self) -> pa.RecordBatch:
        ids, sizes, doc, term, tf = (np.concatenate(x) for x in (self.ids, self.sizes, self.doc, self.term, self.tf))
        terms, df = np.unique(term, return_counts=True)
        ranked = sizes[doc] >= 0
        doc, term, tf = doc[ranked], term[ranked], tf[ranked]
        order = np.argsort(term, kind="stable")
        kept = np.searchsorted(term[order], terms, "right") - np.searchsorted(term[order], terms)
        lists = [(ids, pa.int64()), (sizes, pa.int64()), (terms, pa.int32()), (df, pa.int32()), (kept, pa.int32()), (doc[order], pa.int32()), (tf[order], pa.int32())]
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind)) for x, kind in lists]
        arrays += [pa.array([self.n_docs], pa.int64()), pa.array([self.n_terms], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["ids", "sizes", "terms", "df", "kept", "at", "tf", "n_docs", "n_terms"])


def index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Blocks of an inverted index of ``docs`` over the sorted ``vocabulary`` of term hashes; ``terms`` are places in it."""

    def run(batches):
        block = _Block()
        for batch in batches:
            column = batch.column("doc_id")
            ids, known = column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)
            for lo, words in chunked(batch.column("text"), fold=True, blank=NOT_ALPHANUMERIC):
                n = len(words.first) - 1
                block.add(ids[lo: lo + n], known[lo: lo + n], words, vocabulary)
                if block.docs >= BLOCK_DOCS or block.postings >= BLOCK_POSTINGS:
                    yield block.row()
                    block = _Block()
        if block.n_docs:
            yield block.row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _INDEX)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def best_of_block(queries: list, where: np.ndarray, lists: list, ids: np.ndarray, best: list, k: int) -> None:
    """Takes the block's documents into ``best`` (per item: scores and ids of the first k, best first).

    ``queries``: per item (terms rarest first, weights); ``where``: the place of a term's list in this block or -1;
    ``lists``: per place (documents, impacts, largest impact).
    """
    for q, (terms, weights) in enumerate(queries):
        here = where[terms]
        have = np.flatnonzero(here >= 0)
        if not len(have):
            continue
        bound = np.array([weights[i] * lists[here[i]][2] for i in have], np.int64)
        rest = np.cumsum(bound[::-1])[::-1]
        scores, names = best[q]
        least = int(scores[-1]) if len(scores) == k else 0
        if rest[0] < least:
            continue
        total, opened, creating = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool), True
        for step, i in enumerate(have):
            at, impact, _ = lists[here[i]]
            creating = creating and rest[step] >= least
            if creating:
                opened[at] = True
                total[at] += weights[i] * impact
                if step + 1 < len(have) and len(total) >= k:
                    least = max(least, int(np.partition(total, len(total) - k)[len(total) - k]))
            else:
                survive = opened[at]
                total[at[survive]] += weights[i] * impact[survive]
        found = np.flatnonzero(opened & (total >= max(least, 1)))
        if len(found):
            scores, names = np.append(scores, total[found]), np.append(names, ids[found])
            top = np.lexsort((names, -scores))[:k]
            best[q] = scores[top], names[top]


def search(blocks: DataFrame, names: pa.Array, queries: list, terms: int, n_docs: int, n_terms: int, k: int, kind: str) -> DataFrame:
    """The first ``k`` documents of each task for each item: ``item_id``, ``doc_id``, ``score``."""

    def run(batches):
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
        for batch in batches:
            for r in range(batch.num_rows):
                ids, sizes, held, kept, at, tf = (batch.column(c)[r].values.to_numpy() for c in ("ids", "sizes", "terms", "kept", "at", "tf"))
                m = 100 - 90 + (90 * np.maximum(sizes, 0) * n_docs) // n_terms
                tf = tf.astype(np.int64)
                impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[at])
                end = np.cumsum(kept)
                lists = [(at[e - n: e], impact[e - n: e], int(impact[e - n: e].max(initial=0))) for n, e in zip(kept, end)]
                where = np.full(terms, -1, np.int64)
                where[held] = np.arange(len(held))
                best_of_block(queries, where, lists, ids, best, k)
        numbers = np.repeat(np.arange(len(best)), [len(s) for s, _ in best])
        if len(numbers):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(numbers)), pa.array(np.concatenate([n for _, n in best])), pa.array(np.concatenate([s for s, _ in best]))], ["item_id", "doc_id", "score"])

    return blocks.drop("df", "n_docs", "n_terms").mapInArrow(run, f"item_id {kind}, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, group_terms: int = GROUP_TERMS) -> DataFrame:
    """Each item's first ``k`` documents with a score above 0: ``item_id``, ``rank``, ``doc_id``, ``score``."""
    kind = items.schema["item_id"].dataType.simpleString()
    asked = materialise(item_terms(items), "ranked-terms")
    groups = max(1, -(-asked.count() // group_terms))
    found = []
    for group in range(groups):
        table = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group).orderBy("item_id").toArrow()  # about GROUP_TERMS rows
        if not table.num_rows:
            continue
        vocabulary, term = np.unique(table.column("term").to_numpy().view(np.uint64), return_inverse=True)
        blocks = materialise(index(docs, vocabulary), "ranked-index")
        n_docs, n_terms = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_terms:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for r in blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df")).collect():  # a row per term of the group
            df[r["terms"]] = r["df"]
        w = np.array([weight(n_docs, int(x)) for x in df], np.int64)
        runs = pa.compute.run_end_encode(table.column("item_id").combine_chunks())
        ends = runs.run_ends.to_numpy()
        queries = []
        for lo, hi in zip(np.concatenate([[0], ends[:-1]]), ends):
            own = term[lo:hi]
            own = own[np.argsort(df[own], kind="stable")]
            queries.append((own, w[own]))
        found.append(materialise(search(blocks, runs.values, queries, len(vocabulary), n_docs, n_terms, k, kind), "ranked-found"))
    place = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    out = docs.sparkSession.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    for part in found:
        out = part if part is found[0] else out.union(part)
    return out.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def oracle(k: int) -> str:
    return f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
figures AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM doc WHERE len(w) > 0),
posting AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM doc) GROUP BY r, term),
item AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM posting GROUP BY term), figures),
measured AS (SELECT r, doc_id, 100 - 90 + (90 * len(w) * n_docs) // n_terms AS m FROM doc, figures),
scored AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM item JOIN posting USING (term) JOIN weights USING (term) JOIN measured USING (r) GROUP BY item_id, r),
placed AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank, doc_id, score FROM scored WHERE score > 0 AND doc_id IS NOT NULL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= {k}"""

"""Benchmark decontamination by Wu-Manber search for many strings at once, with words as letters.

The strings are the windows of ``span`` consecutive words of the benchmark items; an item of fewer words, but not none,
is one string. For the strings of one length there are three tables. ``shift`` tells for the last block of two words
at a place how far the search may move on, since no string holds that block nearer to its end. Where it says 0, the
hash of the block names a bucket of strings that end so; a string of the bucket is selected by the hash of its
words, and compared with the words of the text, byte by byte. Texts are cut into lanes that overlap by a string's
length, and a step is taken on all lanes of a slice of texts together.

Items are cut into parts of bounded length that overlap by ``span - 1`` words and dealt into shards of bounded size,
one pass over the documents each; only one shard's parts are sent to the tasks. Nothing of the documents is shuffled.

Null texts have no words. Items without an id take no part; rows that repeat an ``item_id`` are one item. Every row of
documents gives one row, whatever its id.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise
from .wordhash import NOT_ALPHANUMERIC, chunked, mix

#: Words of an item's part, and bytes of the parts searched for in one pass.
PART_WORDS, SHARD_BYTES = 2_000, 8 << 20
#: Words of a block, and places of a lane.
BLOCK, LANE = 2, 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_tables: dict[str, "Shard"] = {}


def sequence_hash(h: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``length`` words from each place on."""
    out = np.zeros(len(start), np.uint64)
    for j in range(length):
        out = mix(out * _STEP + h[start + j])
    return out


def parts(items: DataFrame, span: int) -> DataFrame:
    """The items in parts of at most ``PART_WORDS`` words that hold all their windows: ``item_id`` (as text), ``part``."""
    step = max(PART_WORDS - span + 1, 1)

    def run(batches):
        for batch in batches:
            names, out = batch.column("item_id").to_pylist(), []
            for lo, words in chunked(batch.column("text"), blank=NOT_ALPHANUMERIC):
                for i in range(len(words.first) - 1):
                    a, b = words.first[i], words.first[i + 1]
                    for x in range(a, max(b - span + 1, min(a + 1, b)), step):
                        y = min(x + step + span - 1, b)
                        out.append((names[lo + i], b" ".join(words.data[s:e].tobytes() for s, e in zip(words.start[x:y], words.end[x:y]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.string()), pa.array([t for _, t in out], pa.binary()).cast(pa.string())], ["item_id", "part"])

    named = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text")
    return named.mapInArrow(run, "item_id string, part string").distinct()


class Strings:
    """The tables for strings of one length: ``start`` are their places in the words ``h``."""

    def __init__(self, h: np.ndarray, start: np.ndarray, length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.bits = int(np.clip(np.ceil(np.log2(16 * len(start))), 10, 24))
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.int64 if length > 250 else np.uint8)
        for j in range(self.block - 1, length):
            self.shift[self.slots(h, start + j)] = length - 1 - j
        key = self.keys(h, start)
        self.key, first, self.of = np.unique(key, return_index=True, return_inverse=True)
        self.start = start[first]

    def slots(self, h: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sequence_hash(h, end - self.block + 1, self.block) >> np.uint64(64 - self.bits)).astype(np.int64)

    def keys(self, h: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The bucket (by the last block), then the hash of all words: a sorted list of these is all buckets in order."""
        slot = self.slots(h, start + self.length - 1).astype(np.uint64)
        return (slot << np.uint64(64 - self.bits)) | (sequence_hash(h, start, self.length) >> np.uint64(self.bits))

    def ends(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The places at which a string may end, those with shift 0, in the texts first[i]:first[i+1]."""
        begin, stop = first[:-1] + self.length - 1, first[1:]
        lanes = np.maximum(-(-(stop - begin) // LANE), 0)
        at = np.repeat(begin, lanes) + LANE * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        stop, found = np.minimum(at + LANE, np.repeat(stop, lanes)), [np.zeros(0, np.int64)]
        while len(at):
            step = self.shift[self.slots(h, at)]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return np.concatenate(found)

    def select(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the texts and the strings to compare there."""
        start = self.ends(h, first) - self.length + 1
        key = self.keys(h, start)
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        same = self.key[at] == key
        return start[same], at[same]


class Shard:
    """The strings of some parts of items, by their length."""

    def __init__(self, table: pa.Table, span: int):
        self.names, item = np.unique(np.array(table.column("item_id").to_pylist(), object).astype(str), return_inverse=True)
        self.names = self.names.tolist()
        h, data, start, end, first, done, size = [], [], [], [], [np.zeros(1, np.int64)], 0, 0
        for _, words in chunked(table.column("part"), fold=True, blank=NOT_ALPHANUMERIC):
            h.append(words.hash)
            start.append(words.start + size)
            end.append(words.end + size)
            first.append(words.first[1:] + done)
            data.append(_FOLD[words.data])
            done, size = done + len(words.hash), size + len(words.data)
        self.h, self.data, self.word_start, self.word_end = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((h, np.uint64), (data, np.uint8), (start, np.int64), (end, np.int64)))
        first = np.concatenate(first)
        sizes = np.diff(first)
        lengths = np.minimum(sizes, span)
        self.sets: list[tuple[Strings, np.ndarray, np.ndarray]] = []
        for length in np.unique(lengths[lengths > 0]):
            own = np.flatnonzero(lengths == length)
            each = sizes[own] - length + 1
            at = np.repeat(first[own] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            strings = Strings(self.h, at, int(length))
            pair = np.unique(strings.of.reshape(-1) * len(self.names) + np.repeat(item[own], each))
            self.sets.append((strings, pair // len(self.names), pair % len(self.names)))

    def occurrences(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All confirmed occurrences: first word, end, and the (place, item) pairs as a matrix of two rows."""
        begin, stop, pairs, folded = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((2, 0), np.int64)], _FOLD[words.data]
        for strings, of, item in self.sets:
            at, which = strings.select(words.hash, words.first)
            if not len(at):
                continue
            same = self._compare(words, folded, at, strings.start[which], strings.length)
            at, which = at[same], which[same]
            begin.append(at)
            stop.append(at + strings.length)
            lo, hi = np.searchsorted(of, which), np.searchsorted(of, which, "right")
            number = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange((hi - lo).sum())
            pairs.append(np.stack([np.repeat(at, hi - lo), item[number]]))
        return np.concatenate(begin), np.concatenate(stop), np.concatenate(pairs, 1)

    def _compare(self, words, folded: np.ndarray, at: np.ndarray, of: np.ndarray, length: int) -> np.ndarray:
        """Whether the words at the places are the strings', by their bytes; a word of both is compared once."""
        steps = np.arange(length)
        code = (at[:, None] + steps).ravel() * len(self.h) + (of[:, None] + steps).ravel()
        code, back = np.unique(code, return_inverse=True)
        left, right = code // len(self.h), code % len(self.h)
        size = words.end[left] - words.start[left]
        same = size == self.word_end[right] - self.word_start[right]
        size = np.where(same, size, 0)
        some = np.flatnonzero(same)
        edge = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(edge, size)
        differ = folded[np.repeat(words.start[left], size) + place] != self.data[np.repeat(self.word_start[right], size) + place]
        if len(some):
            same[some] = ~np.logical_or.reduceat(differ, edge[some])
        return same[back.reshape(-1)].reshape(len(at), length).all(1)


def _shard(name: str, held, span: int) -> Shard:
    """The tables of a pass, made once by each Python worker; those of the last pass go."""
    if name not in _tables:
        _tables.clear()
        _tables[name] = Shard(pa.ipc.open_stream(held.value).read_all(), span)
    return _tables[name]


def _covered(words, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of covered words, cut where a text ends."""
    edge = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, stop, -1)
    inside = np.cumsum(edge)[:-1] > 0
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    firsts = words.first[:-1][words.first[:-1] < words.first[1:]]
    head[firsts] |= inside[firsts]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:] | head[1:]
    return np.flatnonzero(head), np.flatnonzero(tail) + 1


def _one_pass(docs: DataFrame, held, span: int, carry: bool) -> DataFrame:
    """Adds what one shard finds to ``hits`` and ``items`` of earlier passes; keeps the text for a next pass."""
    name, earlier = uuid.uuid4().hex, "hits" in docs.columns

    def run(batches):
        shard = _shard(name, held, span)
        for batch in batches:
            counts, hits, items = [], [], []
            old_hits, old_items = (batch.column(c).to_pylist() if earlier else None for c in ("hits", "items"))
            for lo, words in chunked(batch.column("text"), fold=True, blank=NOT_ALPHANUMERIC):
                n = len(words.first) - 1
                begin, stop, pairs = shard.occurrences(words)
                if earlier:
                    old = [(words.first[i] + s["start"], words.first[i] + s["end"]) for i in range(n) for s in old_hits[lo + i]]
                    begin, stop = (np.concatenate([x, np.array([o[k] for o in old], np.int64)]) for k, x in enumerate((begin, stop)))
                begin, stop = _covered(words, begin, stop)
                of = np.searchsorted(words.first, begin, "right") - 1
                cut = np.searchsorted(of, np.arange(n + 1))
                a, b = (begin - words.first[of]).tolist(), (stop - words.first[of]).tolist()
                text = np.searchsorted(words.first, pairs[0], "right") - 1
                found = np.unique(text * max(len(shard.names), 1) + pairs[1])
                text, item = found // max(len(shard.names), 1), found % max(len(shard.names), 1)
                mine = np.searchsorted(text, np.arange(n + 1))
                for i in range(n):
                    hits.append([{"start": a[k], "end": b[k]} for k in range(cut[i], cut[i + 1])])
                    named = {shard.names[k] for k in item[mine[i]: mine[i + 1]]}
                    items.append(sorted(named.union(old_items[lo + i]) if earlier else named))
                counts.append(np.diff(words.first))
            columns = [batch.column("doc_id"), pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(hits, _HITS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns + [batch.column("text")] * carry, ["doc_id", "n_words", "hits", "items"] + ["text"] * carry)

    schema = "doc_id long, n_words long, hits array<struct<start:long,end:long>>, items array<string>" + ", text string" * carry
    return docs.select("doc_id", "text", *["hits", "items"] * earlier).mapInArrow(run, schema)


def contaminated(docs: DataFrame, items: DataFrame, span: int = 10, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``hits`` (ranges of words inside occurrences, end exclusive, merged) and ``items`` (ids as text, sorted)."""
    spark = docs.sparkSession
    cut = materialise(parts(items, span), "decontaminate-parts")
    shards = -(-(cut.agg(F.sum(F.octet_length("part"))).first()[0] or 1) // shard_bytes)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for shard in range(shards):
        table = cut.where(F.pmod(F.xxhash64("item_id", "part"), F.lit(shards)) == shard).toArrow()  # about SHARD_BYTES
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        last = shard == shards - 1
        out = _one_pass(out, spark.sparkContext.broadcast(sink.getvalue().to_pybytes()), span, not last)
        if not last:
            out = materialise(out, "decontaminate-pass")
    return out


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def oracle(span: int) -> str:
    return f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
strings AS (
  SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS s
  FROM (SELECT item_id, w, least(len(w), {span}) AS size, unnest(range(1, len(w) - least(len(w), {span}) + 2)) AS p FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM doc),
found AS (
  SELECT r, p, size, item_id
  FROM (SELECT r, p, size, array_to_string(w[p:p + size - 1], ' ') AS s FROM places, (SELECT DISTINCT size FROM strings) WHERE p + size - 1 <= len(w))
  JOIN strings USING (size, s)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""

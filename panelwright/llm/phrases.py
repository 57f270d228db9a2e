"""Removal of repeated passages with sharded Aho-Corasick automata.

1. ``anchors``: every window of ``span`` words holds at least one anchor, the phrase of half its length with the
   smallest hash. Windows with the same words have the same anchor, so only documents with an anchor that another
   text has too can share a window.
2. ``confirm``: the windows around such anchors are hashed (128 bits) and grouped; a window found in two
   documents is repeated, and belongs to the smallest of them. Neighbouring windows of an owner form a passage.
3. ``locate``: passages are cut into phrases such that each of their windows holds one, dealt out to shards by
   owner and compiled into an automaton per shard (over word hashes). Documents are streamed through the
   automata of the shards with which they share a window; around every hit the words are compared with the
   passage, so that an occurrence is as long as the agreement really is.

Exact copies are settled by a hash of their words: all but the smallest id are copies of something earlier.
Hot passages: a shard's documents are dealt out over as many salts as their number asks for, each with the
shard's automaton; counts and minima are aggregated before they are shuffled.

Rows of null ``doc_id`` are counted and kept whole, and no other row is held against them. Rows that repeat an id
never remove each other's words; other texts of an id are texts of their own. Texts that are null or have no words give 0 words and the hash of nothing.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise
from .wordhash import Words, chunked, sliding_min

#: Words of passages in one automaton, and documents streamed through it by one task.
SHARD_WORDS = 200_000
SALT_DOCS = 2_000
_EMPTY = hashlib.sha256(b"").hexdigest()


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _kept_hash(words: Words, lo: int, hi: int, keep: np.ndarray | None = None) -> str:
    """SHA-256 of the kept ones of the words lo:hi, joined by blanks."""
    if hi == lo:
        return _EMPTY
    own = words.data[words.start[lo]: words.end[hi - 1]].tobytes().split()
    if keep is not None:
        own = [w for w, k in zip(own, keep) if k]
    return hashlib.sha256(b" ".join(own)).hexdigest()


def _mark():
    """Tells the texts of an id apart."""
    return F.shiftright(F.xxhash64("text"), 32).cast("int").alias("t")


def anchors(docs: DataFrame, span: int) -> DataFrame:
    """Per document ``n_words``, ``s1``, ``s2`` (128-bit hash of its words) and ``sha``; per anchor of a document ``h``. ``t`` is a hash of the text."""
    half = span // 2

    def run(batches):
        for batch in batches:
            ids, marks, rows, found, of = batch.column("doc_id").to_pylist(), batch.column("t").to_pylist(), [], [], []
            for lo, words in chunked(batch.column("text")):
                first, n = words.first, len(words.first) - 1
                some = np.flatnonzero(first[1:] > first[:-1])
                sigs = np.zeros((2, n), np.uint64)
                for which in (0, 1):
                    sigs[which, some] = words.runs(first[some], first[some + 1], which)
                for i in range(n):
                    a, b = first[i], first[i + 1]
                    s1, s2 = int(sigs[0, i].view(np.int64)), int(sigs[1, i].view(np.int64))
                    rows.append((ids[lo + i], int(b - a), s1, s2, _kept_hash(words, a, b)))
                    if b - a >= span and ids[lo + i] is not None:
                        found.append(np.unique(sliding_min(words.grams(i, half), span - half + 1)))
                        of.append((ids[lo + i], s1, marks[lo + i]))
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4]), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int32())],
                                                 ["doc_id", "n_words", "s1", "s2", "sha", "h", "t"])
            if found:
                sizes, none = [len(x) for x in found], pa.nulls(sum(map(len, found)), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([d for d, _, _ in of], sizes)), none, pa.array(np.repeat(np.array([s for _, s, _ in of], np.int64), sizes)), none,
                                                  none.cast(pa.string()), _longs(np.concatenate(found)), pa.array(np.repeat(np.array([t for *_, t in of], np.int32), sizes))], ["doc_id", "n_words", "s1", "s2", "sha", "h", "t"])

    return docs.select("doc_id", "text", _mark()).mapInArrow(run, "doc_id long, n_words long, s1 long, s2 long, sha string, h long, t int")


def windows(suspects: DataFrame, span: int) -> DataFrame:
    """The distinct windows around the anchors ``hs`` of each document: ``w1``, ``w2`` (hashes), ``doc``, ``t``, ``pos`` (its first place)."""
    half = span // 2

    def run(batches):
        for batch in batches:
            ids, marks, lists, out = batch.column("doc").to_pylist(), batch.column("t").to_pylist(), batch.column("hs"), []
            for lo, words in chunked(batch.column("text")):
                for i in range(len(words.first) - 1):
                    a, b = words.first[i], words.first[i + 1]
                    if b - a < span:
                        continue
                    least = sliding_min(words.grams(i, half), span - half + 1)
                    shared = np.sort(lists[lo + i].values.to_numpy().view(np.uint64))
                    at = np.searchsorted(shared, least)
                    at[at == len(shared)] = 0
                    pos = np.flatnonzero(shared[at] == least)
                    if len(pos):
                        w1, first = np.unique(words.runs(a + pos, a + pos + span), return_index=True)
                        pos = pos[first]
                        out.append((w1, words.runs(a + pos, a + pos + span, 1), np.full(len(pos), ids[lo + i]), np.full(len(pos), marks[lo + i], np.int32), pos))
            if out:
                w1, w2, doc, t, pos = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([_longs(w1), _longs(w2), _longs(doc), pa.array(t), _longs(pos)], ["w1", "w2", "doc", "t", "pos"])

    return suspects.select("doc", "t", "text", "hs").mapInArrow(run, "w1 long, w2 long, doc long, t int, pos long")


def passages(owners: DataFrame, span: int) -> DataFrame:
    """Runs of neighbouring windows (places ``at``) of their owners, as text: ``owner``, ``ot`` (the owner's text), ``passage``, ``n_words``."""

    def run(batches):
        for batch in batches:
            ids, marks, lists, out = batch.column("doc").to_pylist(), batch.column("t").to_pylist(), batch.column("at"), []
            for lo, words in chunked(batch.column("text")):
                for i in range(len(words.first) - 1):
                    a, n = words.first[i], words.first[i + 1] - words.first[i]
                    at = np.unique(lists[lo + i].values.to_numpy())
                    at = at[at + span <= n]
                    for piece in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []:
                        x, y = a + piece[0], a + piece[-1] + span
                        out.append((ids[lo + i], words.data[words.start[x]: words.end[y - 1]].tobytes(), int(y - x), marks[lo + i]))
            if out:
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.binary()).cast(pa.string()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int32())], ["owner", "passage", "n_words", "ot"])

    return owners.select("doc", "t", "text", "at").mapInArrow(run, "owner long, passage string, n_words long, ot int")


def _automaton(table: pa.Table, half: int):
    """The automaton of all phrases, with (passage, place) of each, and the passages' word hashes and owners."""
    machine, hashes = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), []
    for _, words in chunked(table.column("passage")):
        hashes += [words.hash[words.first[i]: words.first[i + 1]] for i in range(len(words.first) - 1)]
    for p, h in enumerate(hashes):
        letters = (h >> np.uint64(33)).tolist()
        for at in range(0, len(h) - half + 1, half + 1):
            key = tuple(letters[at: at + half])
            if machine.exists(key):
                machine.get(key).append((p, at))
            else:
                machine.add_word(key, [(p, at)])
    machine.make_automaton()
    return machine, hashes, table.column("owner").to_pylist()


def _occurrences(machine, passage_hashes: list, owners: list, doc: int, h: np.ndarray, span: int) -> list[tuple[int, int]]:
    half, found, done = span // 2, [], {}
    for end, hits in machine.iter(tuple((h >> np.uint64(33)).tolist())):
        start = end - half + 1
        for p, at in hits:
            shift = start - at
            if owners[p] >= doc or done.get((p, shift), -1) >= end + 1:
                continue
            own = passage_hashes[p]
            lo, hi = max(0, -shift), min(len(own), len(h) - shift)
            differ = np.flatnonzero(own[lo:hi] != h[lo + shift: hi + shift]) + lo
            k = np.searchsorted(differ, at)
            left = differ[k - 1] + 1 if k else lo
            right = differ[k] if k < len(differ) else hi
            if right >= at + half:
                done[p, shift] = right + shift
                if right - left >= span:
                    found.append((int(left + shift), int(right + shift)))
    return found


def locate(found: DataFrame, streams: DataFrame, span: int) -> DataFrame:
    """Every occurrence of the passages in the documents of their shard: ``doc``, ``t``, ``spans`` (word places, end exclusive)."""
    half = span // 2

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            machine, hashes, owners = _automaton(left, half)
            ids, marks = right.column("doc").to_pylist(), right.column("t").to_pylist()
            for lo, words in chunked(right.column("text")):
                for i in range(len(words.first) - 1):
                    spans = _occurrences(machine, hashes, owners, ids[lo + i], words.hash[words.first[i]: words.first[i + 1]], span)
                    if spans:
                        out.append((ids[lo + i], [{"start": a, "end": b} for a, b in spans], marks[lo + i]))
        return pa.table({"doc": pa.array([d for d, _, _ in out], pa.int64()), "t": pa.array([t for *_, t in out], pa.int32()), "spans": pa.array([s for _, s, _ in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    key = ["shard", "salt"]
    return found.groupBy(*key).cogroup(streams.groupBy(*key)).applyInArrow(run, "doc long, t int, spans array<struct<start:long,end:long>>")


def _removed(affected: DataFrame) -> DataFrame:
    """Joins the spans of a document and takes their words out: ``spans``, ``n_removed``, ``sha``."""

    def run(batches):
        for batch in batches:
            ids, lists, out = batch.column("doc").to_pylist(), batch.column("spans").to_pylist(), []
            for lo, words in chunked(batch.column("text")):
                for i in range(len(words.first) - 1):
                    a, b = words.first[i], words.first[i + 1]
                    edge = np.zeros(b - a + 1, np.int64)
                    for s in lists[lo + i]:
                        if s["end"] <= b - a:
                            edge[s["start"]] += 1
                            edge[s["end"]] -= 1
                    gone = np.cumsum(edge[:-1]) > 0
                    step = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                    s1 = int(words.runs(np.array([a]), np.array([b]))[0].view(np.int64)) if b > a else 0
                    out.append((ids[lo + i], s1, int(gone.sum()), _kept_hash(words, a, b, ~gone), [{"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))]))
            c = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.string()),
                                              pa.array(c[4], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "s1", "removed", "sha_kept", "spans"])

    return affected.select("doc", "text", "spans").mapInArrow(run, "doc_id long, s1 long, removed long, sha_kept string, spans array<struct<start:long,end:long>>")


def repeated_phrases(docs: DataFrame, span: int = 50) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and ``spans``, the removed word ranges (end exclusive)."""
    base = materialise(anchors(docs, span), "phrases-anchors")
    rows = base.where("h IS NULL").select("doc_id", "n_words", "s1", "s2", "sha")
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("doc"), "text", _mark())
    row = ["doc", "t"]
    firsts = rows.where("doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("first"))

    anchor = base.where("h IS NOT NULL").select("h", "doc_id", "s1", "t")
    shared = anchor.groupBy("h").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo <> hi").select("h")
    lists = (
        anchor.join(shared, "h").groupBy(F.col("doc_id").alias("doc"), "t", "s1").agg(F.collect_set("h").alias("hs"))
        .join(firsts.select(F.col("first").alias("doc"), "s1").distinct(), ["doc", "s1"], "left_semi").drop("s1"))
    suspects = materialise(texts.join(lists, row), "phrases-suspects")

    seen = materialise(windows(suspects, span), "phrases-windows")
    window = ["w1", "w2"]
    repeats = (
        seen.groupBy(*window).agg(F.min(F.struct("doc", "t", "pos")).alias("at"), F.max("doc").alias("last"))
        .where("at.doc < last").select(*window, F.col("at.doc").alias("owner"), F.col("at.t").alias("ot"), F.col("at.pos").alias("pos")))
    repeats = materialise(repeats, "phrases-repeats")
    routes = materialise(
        seen.join(repeats, window).where("doc > owner").select(*row, "owner", "ot").distinct(), "phrases-routes")
    places = repeats.groupBy(F.col("owner").alias("doc"), F.col("ot").alias("t")).agg(F.collect_set("pos").alias("at"))
    confirmed = materialise(passages(suspects.join(places, row), span), "phrases-passages")

    words = confirmed.agg(F.sum("n_words")).first()[0] or 0
    shard = F.pmod(F.xxhash64("owner", "ot"), F.lit(max(1, -(-words // SHARD_WORDS))))
    dealt = routes.select(*row, shard.alias("shard")).distinct()
    salts = dealt.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SALT_DOCS).alias("salts"))
    found = (
        confirmed.withColumn("shard", shard).join(salts, "shard")
        .select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "owner", "passage"))
    streams = (
        dealt.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64(*row), F.col("salts")))
        .join(suspects.select(*row, "text"), row).select("shard", "salt", *row, "text"))
    spans = locate(found, streams, span).groupBy(*row).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    gone = materialise(_removed(suspects.select(*row, "text").join(spans, row)), "phrases-removed").dropDuplicates(["doc_id", "s1"])

    whole = F.expr(f"first < doc_id AND n_words >= {span}")
    out = rows.join(firsts, ["s1", "s2"], "left").join(gone, ["doc_id", "s1"], "left")
    return out.select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(_EMPTY)).otherwise(F.coalesce("sha_kept", "sha")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"))))
        .otherwise(F.coalesce("spans", F.expr("CAST(array() AS array<struct<start:long,end:long>>)"))).alias("spans"))

"""Decontamination, ranked search and hard negatives against brute force, and on awkward tables."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import decontaminate, negatives, queries, ranked

DOCS, ITEMS = "doc_id long, text string, hits string, items string, n_words string", "item_id {}, text string, part string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def some(n, seed, size=40):
    r = np.random.default_rng(seed)
    return " ".join("é%d" % x if x % 3 else "W%d" % x for x in r.integers(0, size, n))


PASSAGE = some(60, 1, 5000)


def corpus():
    rows = [(1, PASSAGE), (2, None), (3, ""), (4, " -- !"), (5, "x, " + PASSAGE.replace(" ", "; ") + " y"), (5, some(30, 2)), (5, some(30, 2)), (6, some(9, 3)), (None, PASSAGE), (None, "Solo"),
            (7, some(12_000, 4, 3000) + " " + PASSAGE + " " + some(9_000, 5, 3000)), (8, " ".join(PASSAGE.split()[:9])), (9, "a b a b a b a b a b a b a b a b a b a b"), (10, "solo 漢字"), (11, "ÀB ab"), (12, "y" * 30_000)]
    rows += [(100 + i, " ".join(PASSAGE.split()[i: i + 15]) + " " + some(40, 50 + i)) for i in range(40)]
    return [(i, t, "h", "i", "n") for i, t in rows]


def benchmark():
    short = " ".join(PASSAGE.split()[20:23])
    return [("a", PASSAGE, "p"), ("b", " ".join(PASSAGE.split()[5:40]), "p"), ("c", short, "p"), ("d", "Solo!", "p"), ("e", None, "p"), ("f", "", "p"), (None, "solo", "p"), ("g", "a b " * 7, "p"), ("d", some(25, 4, 3000), "p"),
            ("d", some(25, 4, 3000), "p"), ("h", some(5000, 9, 3000), "p"), ("é", "àb AB", "p"), ("i", some(30, 2), "p")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(benchmark(), ITEMS.format("string")).repartition(2)


def expected_hits(span):
    strings = {}
    for name, text, _ in benchmark():
        w = words(text)
        size = min(span, len(w))
        for p in range(len(w) - size + 1) if w and name is not None else []:
            strings.setdefault(tuple(w[p: p + size]), set()).add(name)
    sizes, out = {len(s) for s in strings}, []
    for i, text, *_ in corpus():
        w, hit, named = words(text), set(), set()
        for p in range(len(w)):
            for size in sizes:
                if p + size <= len(w) and tuple(w[p: p + size]) in strings:
                    hit |= set(range(p, p + size))
                    named |= strings[tuple(w[p: p + size])]
        out.append((i, len(w), tuple(sorted(hit)), tuple(sorted(named))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_bytes, part_words", [(1 << 20, 2_000), (3_000, 40)])
def test_every_occurrence_is_found_in_one_pass_or_many(spark, docs, items, monkeypatch, shard_bytes, part_words):
    monkeypatch.setattr(decontaminate, "PART_WORDS", part_words)
    rows = decontaminate.contaminated(docs, items, 10, shard_bytes).collect()
    got = [(r["doc_id"], r["n_words"], tuple(x for h in r["hits"] for x in range(h["start"], h["end"])), tuple(r["items"])) for r in rows]
    assert sorted(got, key=repr) == expected_hits(10)
    for r in rows:  # runs are merged and in order
        assert all(a["end"] < b["start"] for a, b in zip(r["hits"], r["hits"][1:]))


def test_shift_tables_skip_most_places_and_no_string():
    r = np.random.default_rng(0)
    h = decontaminate.mix(r.integers(0, 2000, 50_000).astype(np.uint64))
    strings = decontaminate.Strings(h, np.arange(0, 500), 10)
    first = np.array([0, 7, 7, 20_000, 50_000])
    ends = strings.ends(h, first)
    assert len(ends) < 2_000
    start, _ = strings.select(h, first)
    want = [p for p in range(500) if not p < 7 < p + 10]
    assert set(want) <= set(start.tolist())


def test_a_hash_alone_is_no_occurrence():
    shard = decontaminate.Shard(decontaminate.pa.table({"item_id": ["a"], "part": ["one two"]}), 10)
    words_ = next(decontaminate.chunked(decontaminate.pa.array(["one twa", "One Two", "one  two x"]), fold=True, blank=decontaminate.NOT_ALPHANUMERIC))[1]
    words_.hash[:2] = shard.h  # a forged collision
    begin, stop, _ = shard.occurrences(words_)
    assert begin.tolist() == [2, 4] and stop.tolist() == [4, 6]


def test_decontamination_of_empty_tables(spark, docs, items):
    none, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS.format("long"))
    assert decontaminate.contaminated(none, items).count() == 0
    rows = decontaminate.contaminated(docs, no_items).collect()
    assert len(rows) == len(corpus()) and not any(r["hits"] or r["items"] for r in rows)


def test_decontamination_query_columns(spark, docs, items, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((tuple(r) for r in queries.op11_wu_manber_decontamination(spark, str(tmp_path)).collect()), key=repr)
    want = [(i, n, len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)) for i, n, hit, named in expected_hits(10)]
    assert got == sorted(want, key=repr)


def expected_ranking(rows, asked, k):
    texts = [(i, words(t)) for i, t, *_ in rows]
    total, n_docs = sum(len(w) for _, w in texts), sum(bool(w) for _, w in texts)
    df = {}
    for _, w in texts:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    terms, out = {}, []
    for name, text, _ in asked:
        if name is not None:
            terms.setdefault(name, set()).update(words(text))
    for name, own in terms.items():
        found = []
        for i, w in texts:
            if i is None or not w:
                continue
            m, score = 10 + (90 * len(w) * n_docs) // total, 0
            for t in own & set(w):
                tf = w.count(t)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, i))
        out += [(name, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("group_terms, block_docs", [(500_000, 8_192), (300, 7)])
def test_ranking_equals_scoring_every_document(spark, docs, items, monkeypatch, group_terms, block_docs):
    monkeypatch.setattr(ranked, "BLOCK_DOCS", block_docs)
    got = sorted(tuple(r) for r in ranked.ranked_search(docs, items, 10, group_terms).collect())
    assert got == expected_ranking(corpus(), benchmark(), 10)


def test_accumulators_stop_without_changing_scores():
    r = np.random.default_rng(3)
    n, k, weights = 4_000, 5, np.array([9_000, 4_000, 300, 20, 3], np.int64)
    lists, full = [], np.zeros(n, np.int64)
    for w, share in zip(weights, (0.01, 0.05, 0.3, 0.6, 0.9)):
        at = np.flatnonzero(r.random(n) < share)
        impact = r.integers(100_000, 900_000, len(at))
        lists.append((at, impact, int(impact.max())))
        full[at] += w * impact
    ids = r.permutation(n)
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    ranked.best_of_block([(np.arange(5), weights)], np.arange(5), lists, ids, best, k)
    top = np.lexsort((ids, -full))[:k]
    assert best[0][0].tolist() == full[top].tolist() and best[0][1].tolist() == ids[top].tolist()
    # a block that cannot reach the k-th score is passed over: its lists are not read
    before = best[0]
    ranked.best_of_block([(np.arange(5), weights)], np.arange(5), [(None, None, 1)] * 5, ids, best, k)
    assert best[0] is before


def test_ranking_of_empty_tables_and_ties(spark, docs, items):
    none, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS.format("long"))
    assert ranked.ranked_search(none, items).count() == 0
    assert ranked.ranked_search(docs, no_items).count() == 0
    same = spark.createDataFrame([(i, "same words", "h", "i", "n") for i in range(30, 0, -1)] + [(99, "other", "h", "i", "n")], DOCS).repartition(4)
    asked = spark.createDataFrame([(7, "same words", "p"), (8, "nothing", "p")], ITEMS.format("long"))
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in ranked.ranked_search(same, asked, 10).orderBy("rank").collect()] == [(7, i, i) for i in range(1, 11)]


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 64, 70), (65, 33, 129), (100, 384, 97), (40, 1, 50)])
def test_products_are_exact(shape):
    r = np.random.default_rng(sum(shape))
    m, k, n = shape
    a, b = r.integers(-2 ** 27, 2 ** 27, (m, k)), r.integers(-2 ** 27, 2 ** 27, (k, n))
    want = (a.astype(object) @ b.astype(object)).astype(np.int64)
    assert (negatives.strassen(a, b) == want).all() and (negatives.strassen(a, b, 4) == want).all()


def vectors():
    r = np.random.default_rng(8)
    rows = [(i, (r.standard_normal(6) + (i % 3)).tolist(), i % 4, "x") for i in range(400)]
    rows += [(1000 + i, rows[50][1], i % 4, "x") for i in range(60)]  # ties, across labels
    rows += [(2000, None, 1, "x"), (2050, [1.0] * 6, None, "x"), (2100, [1.0, None] + [1.0] * 4, 1, "x"), (2150, [float("nan")] + [1.0] * 5, 1, "x"), (2200, [float("inf")] + [1.0] * 5, 1, "x"), (2250, [0.0] * 6, 1, "x"),
             (2300, [], 1, "x"), (2350, [1.0, 2.0], 1, "x"), (2351, [1.0, 2.5], 1, "x"), (2352, [0.5, 1.0], 2, "x"), (None, [1.0] * 6, 1, "x"), (50, rows[50][1], 50 % 4, "x"), (2400, [1e30] * 6, 1, "x")]
    return rows


def expected_negatives(rows):
    part = {}
    for i, v, label, _ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v) or i == 2400:
            continue
        part[i] = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
    out = []
    for a, (label, v) in part.items():
        if a % 50:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in part.items() if i != a and len(w) == len(v)}
        for p in sorted((i for i in score if part[i][0] == label), key=lambda i: (-score[i], i))[:5]:
            fits = [i for i in score if part[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, rank + 1, i, score[p], score[i]) for rank, i in enumerate(sorted(fits, key=lambda i: (-score[i], i))[:3])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(16_384, 2_048, 2_048, 256), (64, 3, 16, 2)])
def test_negatives_equal_all_products_in_one_block_or_many(spark, monkeypatch, sizes):
    for name, value in zip(("SHARD_ROWS", "BLOCK_ROWS", "TILE", "ANCHORS"), sizes):
        monkeypatch.setattr(negatives, name, value)
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int, v string").repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    want = expected_negatives(vectors())
    assert len(want) > 50
    assert sorted(tuple(r) for r in negatives.hard_negatives(df, label).collect()) == want


def test_negatives_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(df, F.col("label")).count() == 0

"""The corpus operators on small tables: against brute force, and with nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from panelwright.llm import ann, chat, mixing, pii, stages, toxicity
from panelwright.llm.jaccard import jaccard_components
from panelwright.llm.phrases import repeated_phrases
from panelwright.llm.pieces import codec, encode_digests, encode_documents, read_model
from panelwright.llm.pivots import fit_index, near_duplicates
from panelwright.llm.quality import QualityModel, fit, posteriors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
MODEL = read_model(public_tokenizers.path("piece_bpe_32k.model"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(n_words=60, seed=0):
    r = np.random.default_rng(seed)
    return " ".join("w%d" % x for x in r.integers(0, 5000, n_words))


def awkward():
    base, other = texts(80), texts(70, 1)
    rows = [(1, base), (2, base), (3, base + " more"), (4, other), (5, None), (6, ""), (7, "  \n"), (8, "one two"), (9, "One two"), (10, texts(30_000, 2)),
            (11, texts(10, 3) + " " + " ".join(base.split()[5:65])), (12, "naïve 漢字 " + other), (12, "naïve 漢字 " + other), (None, base), (13, "x" * 20_000)]
    return [(i, t, None if i == 4 else "en", None if i == 8 else "s%d" % ((i or 0) % 2), None if t is None else len(t)) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 > 0), int(i % 3 == 0)) for i in range(1, 14)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_jaccard_components_are_those_of_all_pairs(spark, docs, none):
    sets = {}
    for i, t, *_ in awkward():
        w = WORD.findall(fold(t))
        sets[i] = {tuple(w[a:a + 5]) for a in range(max(len(w) - 4, 1))} if w else set()
    label = {i: i for i in sets if i is not None}
    for _ in sets:
        for a in label:
            for b in label:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    label[a] = label[b] = min(label[a], label[b])
    rows = jaccard_components(docs.selectExpr("*", "1 AS g", "2 AS n")).collect()
    assert len(rows) == len(awkward())
    for r in rows:
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert r["component_id"] == label.get(r["doc_id"])
    assert jaccard_components(none).count() == 0


def test_jaccard_of_a_large_group_of_near_copies(spark):
    r = np.random.default_rng(5)
    base = ["b%d" % i for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for at in r.integers(0, 120, r.integers(0, 5)):
            w[at] = "edit%d" % r.integers(0, 1000)
        rows.append((i, " ".join(w)))
    sets = [{tuple(w.split()[a:a + 5]) for a in range(116)} for _, w in rows]
    label = list(range(60))
    for _ in range(60):
        for a in range(60):
            for b in range(60):
                n = len(sets[a] & sets[b])
                if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    label[a] = label[b] = min(label[a], label[b])
    got = {x["doc_id"]: x["component_id"] for x in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert [got[i] for i in range(60)] == label


def jaccard_label(rows, k=5):
    """Component per id by all pairs; an id may have several texts."""
    sets = [(i, {tuple(w[a:a + k]) for a in range(max(len(w) - k + 1, 1))}) for i, w in ((i, WORD.findall(fold(t))) for i, t in rows) if w]
    label = {i: i for i, _ in sets}
    links = [(i, j) for x, (i, a) in enumerate(sets) for j, b in sets[:x] if 100 * len(a & b) >= 80 * len(a | b)]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return label


def test_jaccard_links_every_text_of_an_id(spark):
    first, other, stock = texts(100, 41).split(), texts(17, 42), texts(80, 43)
    rows = [(1, " ".join(first)), (5, " ".join(first[:99] + ["end"])), (5, other + " " + " ".join(first[40:60]) + " " + stock), (5, texts(30, 44)), (9, texts(30, 44) + " x"), (9, texts(40, 45)),
            (3, texts(40, 45)), (3, "lone text of id three here"), (7, "x " + other + " " + " ".join(first[40:60]) + " " + stock)]
    rows += [(20 + i, stock + " " + texts(17, 60 + i)) for i in range(10)]
    got = {x["doc_id"]: x["component_id"] for x in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == jaccard_label(rows)


@pytest.mark.parametrize("block_rows, tile", [(1 << 16, 1_024), (300, 7)])
def test_jaccard_of_a_cloud_and_texts_just_under_the_similarity(spark, monkeypatch, block_rows, tile):
    from panelwright.llm import jaccard
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard.blocked_products, "__defaults__", (block_rows,))
    monkeypatch.setattr(jaccard, "AT_ONCE", 500)
    r = np.random.default_rng(11)
    base, rows = ["b%d" % i for i in range(60)], []
    for i in range(300):
        w = list(base)
        w[r.integers(0, 60)] = "edit%d" % r.integers(0, 10_000)
        rows.append((i, " ".join(w)))
    for i in range(200):  # two or three edits apart: most are under the similarity, some are not
        w = list(base)
        for at in r.choice(60, r.integers(2, 4), replace=False):
            w[at] = "far%d" % r.integers(0, 10_000)
        rows.append((1000 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {x["doc_id"]: x["component_id"] for x in jaccard_components(df).collect()} == jaccard_label(rows)


def test_blocked_products_keep_every_pair_over_the_similarity(spark):
    from panelwright.llm import jaccard
    r = np.random.default_rng(12)
    rows = []
    for g in range(30):
        base = ["g%dw%d" % (g, i) for i in range(100)] + ["all%d" % i for i in range(15)]
        for i in range(8):
            w = list(base)
            for at in r.choice(115, r.integers(1, 4), replace=False):
                w[at] = "e%d" % r.integers(0, 10_000)
            rows.append((g * 10 + i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shared = jaccard.incidence(docs, 5, 80, np.zeros(jaccard.BUCKETS, np.uint64))
    shared = jaccard.materialise(shared.join(shared.groupBy("g").count().where("count > 1").withColumnRenamed("count", "rows"), "g").withColumn("c", F.col("doc")), "test-shared")
    got = {tuple(x) for block in (1 << 16, 200) for x in jaccard.blocked_products(shared, 80, block).collect()}
    assert [tuple(sorted(map(tuple, jaccard.blocked_products(shared, 80, b).collect()))) for b in (1 << 16, 200)] == [tuple(sorted(got))] * 2
    sets = {i: {tuple(t.split()[a:a + 5]) for a in range(111)} for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(want) > 100 and want <= got


class Tasks:
    """Stands for a DataFrame of which only the function run in the tasks is wanted."""

    def __getattr__(self, name):
        return lambda *args: self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_jaccard_tasks_hold_slices_of_a_batch(spark, monkeypatch):
    import pyarrow as pa
    from panelwright.llm import jaccard
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 10_000, 150))) for _ in range(1_500)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1_500)), "text": texts, "t": list(range(1_500))})
    dealt = list(jaccard.incidence(Tasks(), 5, 80, np.zeros(jaccard.BUCKETS, np.uint64)).run(iter([batch])))
    assert sum(b.num_rows for b in dealt) == 1_500 * jaccard._dealt(146, 80)
    assert max(len(b.column("doc").unique()) for b in dealt) < 500
    held, chunks = [], jaccard.chunked
    monkeypatch.setattr(jaccard, "chunked", lambda column, **how: held.append(len(column)) or chunks(column, **how))
    pairs = pa.RecordBatch.from_pydict({"a": list(range(1_500)), "b": list(range(1, 1_501)), "text_a": texts, "text_b": [t if i % 3 == 0 else t[::-1] for i, t in enumerate(texts)]})
    kept = [a for b in jaccard.settle(Tasks(), Tasks(), 5, 80).run(iter([pairs])) for a in b.column("a").to_pylist()]
    assert kept == list(range(0, 1_500, 3)) and max(held) <= jaccard.PAIRS


def test_jaccard_keeps_no_shuffle_files_and_stores_no_texts(spark, monkeypatch):
    import glob
    import time
    from panelwright.llm import jaccard
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())
    files = lambda: {f for d in dirs for f in glob.glob(f"{d.getPath()}/*/shuffle_*")}
    stored, store = {}, jaccard.materialise
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)

    def kept(df, name):
        stored[name], before = df.columns, files()
        out = store(df, name)
        for _ in range(100):  # files of a statement that has ended go in the background
            if not (left := files() - before):
                break
            time.sleep(0.1)
        assert not left
        return out

    monkeypatch.setattr(jaccard, "materialise", kept)
    rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(40))) for i in range(40)]
    got = {x["doc_id"]: x["component_id"] for x in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(40)}
    assert "jaccard-columns" in stored and not any("text" in columns for columns in stored.values())
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting


@pytest.mark.parametrize("moved", [100_000, 30])
def test_jaccard_blocks_meet_only_where_sizes_fit(spark, monkeypatch, moved):
    from panelwright.llm import jaccard
    r = np.random.default_rng(21)
    common, rows = ["all%d" % i for i in range(40)], []
    for i in range(160):  # rows of 50 to 400 words over a common part; every fourth is a near copy of the one before
        own = ["d%dw%d" % (i - (i % 4 == 3), j) for j in range(10 + 350 * ((i - (i % 4 == 3)) % 8) // 7)]
        if i % 4 == 3:
            own[r.integers(0, len(own))] = "edit%d" % i
        rows.append((i, " ".join(common + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    shared = jaccard.incidence(docs, 5, 80, np.zeros(jaccard.BUCKETS, np.uint64))
    shared = jaccard.materialise(shared.join(shared.groupBy("g").count().where("count > 1").withColumnRenamed("count", "rows"), "g").withColumn("c", F.col("doc")), "test-sizes")
    sent = [(*x[:4], x["place"] >> 32) for x in jaccard._blocks(shared, 80, 300).select("x", "y", "own", "g", "place").collect()]
    sides: dict = {}
    for x, y, own, g, n in sent:
        sides.setdefault((x, y, g), ([], []))[int(own == y)].append(n)
    apart = {k: v for k, v in sides.items() if k[0] != k[1]}
    assert apart and all(any(100 * min(a, b) >= 80 * max(a, b) for a in left for b in right) for left, right in apart.values())
    monkeypatch.setattr(jaccard.blocked_products, "__defaults__", (300,))
    monkeypatch.setattr(jaccard, "MOVED", moved)
    monkeypatch.setattr(jaccard, "_levels", lambda surveyed: np.zeros(jaccard.BUCKETS, np.uint64))
    assert {x["doc_id"]: x["component_id"] for x in jaccard_components(docs).collect()} == jaccard_label(rows)


def test_jaccard_counts_columns_of_two_documents(spark, monkeypatch):
    import pyarrow as pa
    from panelwright.llm import jaccard
    from panelwright.llm.wordhash import chunked
    monkeypatch.setattr(jaccard, "_levels", lambda surveyed: np.zeros(jaccard.BUCKETS, np.uint64))
    names = ["w%d" % i for i in range(4000)]
    words = next(w for _, w in chunked(pa.array(names), fold=True))
    hot, *names = [names[i] for i in np.argsort([int(words.grams(i, 1)[0]) for i in range(len(names))])]
    own, common, rows = iter(names[:1000]), iter(names[1000:]), []
    for i in range(100):  # dealt out: the hot word, the text's own, then one that only the pair shares; every third pair has too little in common
        n, alone = 10 + i % 5, 1 + (i % 3 == 0)
        both = [hot] + [next(common) for _ in range(n - 1 - alone)]
        rows += [(i + 100 * side, " ".join(both + [next(own) for _ in range(alone)])) for side in (0, 1)]
    sets = {i: set(t.split()) for i, t in rows}
    label = {i: min(j for j in sets if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i in sets}
    assert sum(i != j for i, j in label.items()) == 66
    got = {x["doc_id"]: x["component_id"] for x in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k=1).collect()}
    assert got == label


def test_repeated_phrases_keep_the_texts_of_an_id_apart(spark):
    passage, own, other = texts(60, 71), texts(60, 72), texts(30, 73)
    rows = [(1, passage), (5, " ".join(own.split()[:30]) + " " + passage + " " + " ".join(own.split()[30:])), (5, other + " " + own + " " + passage), (7, own), (5, texts(90, 74)), (9, texts(90, 74) + " z")]
    got = {(r["doc_id"], r["n_words"]): ([tuple(s) for s in r["spans"]], r["n_removed"]) for r in repeated_phrases(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 50).collect()}
    assert got == {(1, 60): ([], 0), (5, 120): ([(30, 90)], 60), (5, 150): ([(90, 150)], 60), (7, 60): ([(0, 60)], 60), (5, 90): ([], 0), (9, 91): ([(0, 90)], 90)}


def test_repeated_phrases_are_those_of_all_windows(spark, docs, none):
    first, want = {}, {}
    for i, t, *_ in sorted(awkward(), key=lambda r: (r[0] is None, r[0] or 0)):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for a in range(len(w) - 49):
            if i is not None and first.setdefault(tuple(w[a:a + 50]), i) < i:
                gone[a:a + 50] = [True] * 50
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    rows = repeated_phrases(docs.selectExpr("*", "1 AS h", "2 AS s1")).collect()
    assert len(rows) == len(awkward())
    for r in rows:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
    assert repeated_phrases(none).count() == 0


LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aeinrst .,\n1-▁", max_size=80), st.lists(st.integers(259, 31999), max_size=12).map(lambda ids: "".join(LIBRARY.id_to_piece(i) for i in ids).replace("▁", " "))))
def test_pieces_are_the_librarys(text):
    own, ids = codec(MODEL), LIBRARY.encode(text)
    assert own.encode(text) == ids
    assert own.decode(ids) == LIBRARY.decode(ids)


def test_what_ids_decode_to_comes_from_the_ids(monkeypatch):
    from panelwright.llm import pieces
    own = pieces.PieceCodec(MODEL)
    right = "".join(w[2] for w in own.words("plain words"))[1:]
    cover = pieces.PieceCodec._cover
    monkeypatch.setattr(pieces.PieceCodec, "_cover", lambda self, word: [i + 1 for i in cover(self, word)])
    own.forget()
    assert right == "plain words" != "".join(w[2] for w in own.words("plain words"))[1:]


def test_piece_digests(docs, none):
    want = {}
    for i, t, *_ in awkward():
        ids = LIBRARY.encode(t or "")
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest())
    for r in encode_digests(docs, MODEL).collect():
        assert tuple(r)[1:] == want[r["doc_id"]]
    full = {r["doc_id"]: r for r in encode_documents(docs, MODEL).collect()}
    assert list(full[12]["ids"]) == LIBRARY.encode(full[12]["decoded"]) and full[5]["ids"] == []
    assert encode_digests(none, MODEL).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def test_many_matches_in_one_text(spark):
    r = np.random.default_rng(2)
    words = [["%d.%d.%d.%d" % tuple(r.integers(0, 300, 4)), "x", "a%d@b.org" % i, "+1 (555) 010-%04d" % i][r.integers(0, 4)] for i in range(1500)]
    text = "start " + " , ".join(words) + " end"
    docs_ = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {x["doc_id"]: x for x in pii.find_personal_data(docs_).collect()}
    want = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    want += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) < 256 for x in m.group().split("."))]
    assert [tuple(s) for s in got[1]["base"] if s["kind"] in ("email", "ip")] == want and len(want) > 300
    out = spark.createDataFrame([(text, [("email", a, b) for k, a, b in want if k == "email"] + [("ip", 0, 3), ("ip", 2, 5)])], f"text string, spans array<{pii.SPAN}>").select(pii.redact(F.col("text"), F.col("spans"))).first()[0]
    last, parts = 5, ["[IP]"]
    for k, a, b in want:
        if k == "email":
            parts += [text[last:a], "[EMAIL]"]
            last = b
    assert out == "".join(parts) + text[last:]


def test_a_text_of_numbers_takes_time_in_proportion(spark):
    import time
    text = " ".join(str(i) for i in range(100_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    row = pii.scan(df).select(F.size("__words").alias("n"), F.element_at("__words", -1).alias("w")).first()
    assert row["n"] == 100_000 and row["w"]["end"] == len(text) and time.time() - start < 60


def test_personal_data(spark, docs, none):
    r = np.random.default_rng(3)
    pieces = ["a@b.c", "a.b@c.d.e+x@y.z", "@", "1.2.3.4", "001.255.0.9.8.7.6.5", "256.1.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "41111111111111111111111", "+1 (555) 010-9999", "+1+49 30 1234567", "1-2 3", "\u0001", "😀é", "x", " ", " ", ".", "-"]
    rows = [(i, "".join(r.choice(pieces, 12))) for i in range(300)] + [(1000, None), (1001, ""), (1002, "1" * 30_000), (1003, "a" * 30_000 + "@"), (None, "me@x.org"), (None, "you@x.org")]
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS spans", "1 AS pattern")).collect()
    assert len(got) == len(rows)
    for x in got:
        assert [tuple(s) for s in x["base"]] == plain_spans(x["text"] or ""), x["text"]
        assert x["spans"][: len(x["base"])] == x["base"]
    assert pii.find_personal_data(none).count() == 0


def test_contexts_discover_identifiers(spark):
    rows = [(i, f"Hello, please write to user{i}@mail.org about room {i}") for i in range(6)] + [(10, "Hello, please write to agent-77 about it"), (11, "see room 12 about it")]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in got[10]["spans"]] == [("context", 23, 31)]
    assert got[11]["spans"] == []
    text = spark.createDataFrame([("ab 1.2.3.4 cd",)], "t string").selectExpr("t", "array(named_struct('kind','ip','start',3,'end',10), named_struct('kind','card','start',5,'end',12)) AS s")
    assert text.select(pii.redact(text["t"], text["s"])).first()[0] == "ab [IP]d"


def test_contexts_next_to_identifiers_and_long_words(spark):
    rows = [(i, f"row {i} ref user{i}@mail.org") for i in range(6)] + [(10, "row 7 ref agent-77")]
    rows += [(20 + i, f"{'y' * 70} from host{i}@mail.org") for i in range(6)] + [(30, f"{'y' * 70} from agent-88"), (31, "row 7")]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in got[10]["spans"]] == [("context", 10, 18)]
    assert [tuple(s) for s in got[30]["spans"]] == [("context", 76, 84)] and got[31]["spans"] == []


def test_contexts_are_the_two_words_before(spark):
    r = np.random.default_rng(8)
    pieces = ["id", "code", "A12,", "b34", "x@y.z", "1" * 90, "z" * 200, "12", "Ünï", "\n", " ", "  ", "."]
    rows = [(0, "id 123 code 456 acct 789"), (1, "A12, B34 and C56"), (2, "a@b.org or agent-77"), (3, "z" * 30_000 + " 1"), (4, None)]
    rows += [(i, "".join(r.choice([" ", "\n", "\t "]) + w for w in r.choice(pieces, 20))) for i in range(10, 90)]
    for x in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(x["text"] or "")]
        want = [(a, b, re.sub("[0-9]", "0", " ".join(w for *_, w in words[i - 2: i]).lower()) if i > 1 else None) for i, (a, b, w) in enumerate(words) if re.search("[0-9@]", w)]
        assert [(w["start"], w["end"], w["pattern"]) for w in x["__words"]] == want, x["text"]


def test_discovered_identifiers_bring_in_contexts(spark):
    rows = [(i, f"please write to user{i}@mail.org") for i in range(190)] + [(200 + i, f"please write to agent-{i}") for i in range(10)]
    rows += [(300 + i, f"then ask for agent-{i}") for i in range(11)] + [(400 + i, f"see the room {i}") for i in range(11)]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all([s["kind"] for s in got[i]["spans"]] == ["context"] for i in [*range(200, 210), *range(300, 311)])  # agent-10 is seen after "ask for" only
    assert all(got[i]["spans"] == [] for i in range(400, 411))


def test_vectors(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((60, 16))
    x[10:25] = x[0] + 0.15 * r.standard_normal((15, 16))
    x[40] = x[41] = x[0]
    vectors, label = [list(map(float, v)) for v in x], [int(i % 2 == 0 or 10 <= i < 25) for i in range(60)]
    rows = [(i, v, k) for i, (v, k) in enumerate(zip(vectors, label))]
    odd = [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] * 16, 1), (103, vectors[0], None), (104, [None] + vectors[0][1:], 1), (105, vectors[0][:8], 1), (None, vectors[0], 1), (0, vectors[0], label[0])]
    schema = "vec_id long, embedding array<double>, label int"
    got = {a["vec_id"]: a for a in near_duplicates(spark.createDataFrame(rows + odd, schema).selectExpr("*", "1 AS rep")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)) & ~np.eye(60, dtype=bool)
    assert sum(got[i]["n_links"] for i in range(60)) >= 0.9 * s.sum() and all(got[i]["n_links"] <= s[i].sum() for i in range(60))
    assert got[12]["component_id"] == 0 and not got[12]["kept"] and got[0]["kept"]
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(100, 106))
    assert len(got) == 66 and near_duplicates(spark.createDataFrame([], schema)).count() == 0
    found = ann.nearest(spark.createDataFrame(rows + odd, schema), 10, 5).collect()
    hits, u, ids = 0, np.vstack([u, u[:1]]), np.array([*range(60), 103])  # 103 has no label, which searches don't ask for
    for q in range(0, 60, 10):
        order = [i for i in ids[np.lexsort((ids, -(u @ u[q])))] if i != q][:5]
        own = sorted([(a["rank"], a["vec_id"], a["score"]) for a in found if a["query_id"] == q])
        assert [a[0] for a in own] == [1, 2, 3, 4, 5]
        assert all(abs(c - u[q] @ u[i]) < 1e-12 for _, i, c in own if i < 60)
        hits += len({i for _, i, _ in own} & set(order))
    assert hits >= 27 and ann.nearest(spark.createDataFrame([], schema)).count() == 0


def test_pivots_of_a_large_cloud(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((4500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = r.uniform(0.96, 0.975, (1500, 1))
    x[:1500] = near * x[0] + np.sqrt(1 - near ** 2) * x[:1500]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.93).sum(1) - 1
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {a["vec_id"]: a["n_links"] for a in near_duplicates(rows).select("vec_id", "n_links").collect()}
    assert all(got[i] <= links[i] for i in got) and sum(got.values()) >= 0.9 * links.sum() > 0


def alike(r, n, mean, width=64):
    """Vectors of a mean cosine, a quarter of them near copies of others (cosine 0.93 to 0.99)."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(np.sqrt(mean) * unit(r.standard_normal((1, width))) + np.sqrt(1 - mean) * unit(r.standard_normal((n, width))))
    of, cosine, away = r.integers(0, n // 2, n // 4), r.uniform(0.93, 0.99, (n // 4, 1)), r.standard_normal((n // 4, width))
    away -= (away * x[of]).sum(1, keepdims=True) * x[of]
    x[-(n // 4):] = cosine * x[of] + np.sqrt(1 - cosine ** 2) * unit(away)
    return x


@pytest.mark.parametrize("mean, met", [(0.8, 0.1), (0.95, 1)])
def test_pivots_of_vectors_alike_in_direction(spark, mean, met):
    x = alike(np.random.default_rng(4), 3000, mean)
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    index = fit_index(rows.selectExpr("vec_id AS rep", "embedding"), 0.93)
    near = index.nearest(x)
    assert np.mean([index.meet(near, np.roll(near, by, axis=0)).mean() for by in range(1, 100)]) <= met
    links = (x @ x.T >= 0.93).sum(1) - 1
    got = {a["vec_id"]: a["n_links"] for a in near_duplicates(rows).select("vec_id", "n_links").collect()}
    assert all(got[i] <= links[i] for i in got) and sum(got.values()) >= 0.95 * links.sum() > 0


def test_neighbours_over_shards(spark):
    """200 clouds and 2,500 copies of one vector, in shards of which that of the copies has several parts."""
    r = np.random.default_rng(3)
    centre = r.standard_normal((200, 64))
    x = centre[r.integers(0, 200, 20_000)] + 0.5 * r.standard_normal((20_000, 64))
    x[5000:7500] = x[5000]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").withColumn("shard", F.lit("clash"))
    pairs = ann.verified_pairs(rows, 100, 5, 1_500).persist()
    verified = pairs.agg(F.sum("verified")).first()[0]
    assert 0 < verified < 0.3 * 200 * 20_000
    best = pairs.where("vec_id IS NOT NULL").groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, 5).alias("b")).collect()
    pairs.unpersist()
    hits = 0
    for a in best:
        score = x @ x[a["query_id"]]
        score[a["query_id"]] = -2
        hits += sum(-b["s"] >= np.sort(score)[-5] - 1e-12 for b in a["b"])
        assert len(a["b"]) == 5 and all(abs(-b["s"] - score[b["vec_id"]]) < 1e-12 for b in a["b"])
    assert len(best) == 200 and hits >= 0.95 * 1000
    got = ann.nearest(rows.where("vec_id = 6000 OR vec_id BETWEEN 5000 AND 5100"), 100, 3, 20).collect()
    assert [(a["query_id"], a["vec_id"]) for a in sorted(got, key=lambda a: (a["query_id"], a["rank"]))] == [
        (5000, 5001), (5000, 5002), (5000, 5003), (5100, 5000), (5100, 5001), (5100, 5002), (6000, 5000), (6000, 5001), (6000, 5002)]


def test_cuts_of_points_that_are_alike():
    points = np.random.default_rng(0).standard_normal((1000, 12))
    points[:400] = points[0]
    dealt = ann.Cuts(points, 4).shard(points)
    assert len(set(dealt[:400])) == 1 and dealt.min() >= 0 and dealt.max() < 16 and np.bincount(dealt).max() <= 500
    assert (ann.Cuts(np.zeros((0, 12)), 3).shard(points) == 0).all() and abs(ann.chi_square(ann.quantile(0.98), 12) - 0.98) < 1e-9


def test_chi_square():
    draws = np.random.default_rng(0).chisquare(12, 200_000)
    for x in (5.0, 12.0, 24.0):
        assert abs((draws <= x).mean() - ann.chi_square(x, 12)) < 0.005


def test_network_gradients_and_learning():
    import pyarrow as pa
    from panelwright.llm.wordhash import chunked
    words = next(w for _, w in chunked(pa.array(["one two vile", "", "three four five " * 20]), fold=True))
    net, data = toxicity.Network(), toxicity.Inputs(words)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    start, size, of = toxicity.windows(data.first)
    target, equal = np.array([1.0, 0, 1])[of], np.ones(len(of))

    def loss():
        odds = net.forward(net.embed(data), start, size)[0]
        return (np.log1p(np.exp(-odds)) * target + np.log1p(np.exp(odds)) * (1 - target)).mean()

    for k, g in net.gradients(data, net.embed(data), start, size, target, equal).items():
        flat, i = net.p[k].ravel(), int(np.abs(g).argmax())
        there = flat[i]
        flat[i] = there + 1e-2
        above = loss()
        flat[i] = there - 1e-2
        assert abs((above - loss()) / 2e-2 - g.ravel()[i]) < 1e-4, k
        flat[i] = there

    def plain(n, seed):
        return " ".join("w%d" % x for x in np.random.default_rng(seed).integers(0, 40, n))

    vile = lambda n, seed: plain(n, seed) + " vile " + plain(n, seed + 1)
    net = toxicity.train([vile(5 + i % 50, i) if i % 2 else plain(10 + i % 90, i) for i in range(400)], np.arange(400) % 2 * 1.0, 0.5)
    assert (net.score(pa.array([vile(25, 1000 + i) for i in range(40)])) > 0.5).mean() > 0.9 and (net.score(pa.array([plain(50, 2000 + i) for i in range(40)])) < 0.5).mean() > 0.9
    starts, sizes, of = toxicity.windows(np.array([0, 0, 5, 105]))
    covered = {w for s, n in zip(starts, sizes) for w in range(s, s + n)}
    assert covered == set(range(105)) and set(of) == {0, 1, 2} and sizes[0] == 0


def test_windows_are_scored_in_slices(monkeypatch):
    import pyarrow as pa
    net = toxicity.Network(3)
    column = pa.array([texts(3000, 1), None, "", "one", texts(500, 2)], pa.string())
    whole = net.score(column)
    monkeypatch.setattr(toxicity, "SLICE", 7)
    assert np.allclose(net.score(column), whole, atol=1e-6)
    start, size, text = toxicity.windows(np.array([0, 100, 100, 130]))
    for a in range(100 - 16):  # any 16 words lie in one window as a whole
        assert any(s <= a and a + 16 <= s + n for s, n, t in zip(start, size, text) if t == 0)


def test_toxicity_table(spark, docs, labels, none):
    rows = toxicity.toxicity(docs.selectExpr("*", "1 AS toxic", "2 AS score"), labels).collect()
    assert len(rows) == len(awkward()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert toxicity.toxicity(none, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_salted_groups_give_the_same(spark, docs, monkeypatch):
    """Lookups above the bound are joined by salted keys: personal data found from contexts, and replicated documents, stay as they are."""
    rows = [(i, f"please write to user{i}@mail.org") for i in range(40)] + [(100 + i, f"please write to agent-{i}") for i in range(10)] + [(None, "please write to agent-3"), (7, None)]
    told = spark.createDataFrame(rows, "doc_id long, text string")

    def both():
        spans = sorted(str((x["doc_id"], x["spans"])) for x in pii.find_personal_data(told).collect())
        drawn = sorted(str((x["doc_id"], x["copy"])) for x in mixing.mix_sources(docs, power=0.3).collect())
        return spans, drawn

    want = both()
    assert sum("context" in x for x in want[0]) >= 10 and want[1]
    monkeypatch.setattr("panelwright.llm.common.BROADCAST_ROWS", 0)
    assert both() == want


def brute_posteriors(rows):
    """Rates of hosts drawn to the whole's, and of paths to their host's, by plain sums."""
    def sums(key):
        out = {}
        for r in rows:
            n, good = out.get(key(r), (0, 0.0))
            out[key(r)] = n + 1, good + r[2]
        return out

    def strength(groups):  # (n, good, rate of the parent)
        n = sum(g[0] for g in groups)
        spread = sum(k * (good / k - m) ** 2 for k, good, m in groups) - sum(m * (1 - m) for _, _, m in groups)
        within = sum(k * m * (1 - m) for k, _, m in groups) / n
        return min(max(within / (max(spread, 1e-9) / n) - 1, 1.0), 1e6)

    rate = min(max(sum(r[2] for r in rows) / len(rows), 1e-3), 1 - 1e-3)
    hosts, paths = sums(lambda r: r[0]), sums(lambda r: r[:2])
    k = strength([(n, good, rate) for n, good in hosts.values()])
    hosts = {h: (good + k * rate) / (n + k) for h, (n, good) in hosts.items()}
    k = strength([(n, good, hosts[p[0]]) for p, (n, good) in paths.items()])
    return rate, hosts, {p: (good + k * hosts[p[0]]) / (n + k) for p, (n, good) in paths.items()}


@pytest.mark.parametrize("broadcast_rows", [50_000, 2])
def test_posteriors_and_scores_match_brute_force(spark, docs, labels, monkeypatch, broadcast_rows):
    """Also with groups that are joined by salted keys, a host with a third of the rows, null hosts and paths."""
    monkeypatch.setattr("panelwright.llm.common.BROADCAST_ROWS", broadcast_rows)
    r = np.random.default_rng(8)
    hosts = [None if h == 0 else "h%d" % h if h < 30 else "hot" for h in r.integers(0, 45, 900)]
    rows = [(h, None if p == 0 else "p%d" % p, float(r.random() < (0.8 if h == "hot" else 0.2 + 0.1 * p))) for h, p in zip(hosts, r.integers(0, 4, 900))]
    table, rate = posteriors(spark.createDataFrame(rows, "host string, path string, outcome double"))
    want_rate, want_hosts, want_paths = brute_posteriors(rows)
    got = {(x["host"], x["path"]): x for x in table.collect()}
    assert abs(rate - want_rate) < 1e-12 and set(got) == set(want_paths)
    assert all(abs(x["host_posterior"] - want_hosts[p[0]]) < 1e-9 and abs(x["path_posterior"] - want_paths[p]) < 1e-9 for p, x in got.items())
    sparse = [p for p in want_paths if sum(x[:2] == p for x in rows) <= 3]
    assert sparse and all(min(want_hosts[p[0]], sum(x[2] for x in rows if x[:2] == p) / sum(x[:2] == p for x in rows)) - 1e-9 <= got[p]["path_posterior"] for p in sparse)

    model = QualityModel(docs, labels, docs["source"], docs["lang"])
    scored = model.table().collect()
    features = {}
    for x in model.featured.collect():
        features.setdefault(x["doc_id"], []).append(np.array(x["features"]))
    rate, by_path = model.rate, {(x["host"], x["path"]): x["path_posterior"] for x in model.groups.collect()}
    centre, scale, w = model.model
    logit = lambda p: np.log(p / (1 - p))
    assert len(scored) == docs.count()
    for x in scored:
        z = np.clip((features[x["doc_id"]][0] - centre) / scale, -5, 5)
        evidence = 1 / (1 + np.exp(-np.clip(np.concatenate([z, z * z, [1]]) @ w, -30, 30)))
        score = 1 / (1 + np.exp(-(logit(np.clip(evidence, 1e-9, 1 - 1e-9)) + logit(by_path[x["host"], x["path"]]) - logit(rate))))
        assert abs(x["evidence"] - evidence) < 1e-9 and abs(x["score"] - score) < 1e-9 and x["keep"] == (x["score"] >= 0.5)


def test_quality(spark, docs, labels, none):
    r = np.random.default_rng(4)
    f, good = r.standard_normal((400, 3)), np.zeros(400)
    good[f[:, 0] > 0] = 1
    centre, scale, w = fit(f, good)
    z = (f - centre) / scale
    assert ((np.hstack([z, z * z, np.ones((400, 1))]) @ w > 0) == (good == 1)).mean() > 0.95
    rows = [("h%d" % (i % 3) if i % 7 else None, "p%d" % (i % 2), float(i % 5 > 0)) for i in range(200)] + [("rare", "p0", 0.0)]
    table, rate = posteriors(spark.createDataFrame(rows, "host string, path string, outcome double"))
    got = {(x["host"], x["path"]): x for x in table.collect()}
    assert len(got) == len({x[:2] for x in rows}) and abs(rate - np.mean([x[2] for x in rows])) < 1e-9
    assert 0.3 < got["rare", "p0"]["host_posterior"] < rate  # one document moves its host a little
    model = QualityModel(docs.selectExpr("*", "1 AS host", "2 AS features"), labels, docs["source"], docs["lang"])
    assert model.table().count() == len(awkward())
    assert model.filter(docs).columns == docs.columns
    assert QualityModel(none, labels, none["source"], none["lang"]).table().count() == 0
    assert {x["keep"] for x in QualityModel(docs, labels.limit(0), docs["source"], docs["lang"]).table().collect()} == {True}


def test_mixing(spark, docs, none):
    rates = {r["source"]: r for r in mixing.source_rates(docs, power=0.0).collect()}
    assert abs(sum(r["weight"] for r in rates.values()) - 1) < 1e-9 and None in rates
    assert all(abs(r["rate"] * r["size"] - len(awkward()) / 3) < 1e-9 for r in rates.values())
    many = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text", "'s' AS source", "9 AS copy")
    got = mixing.mix_sources(many, budget=2.5).collect()
    per = np.bincount([r["doc_id"] for r in got], minlength=4000)
    assert abs(per.mean() - 2.5) < 0.1 and abs(per.var() - 2.5) < 0.25
    assert [r["shuffle_key"] for r in got] == sorted(r["shuffle_key"] for r in got) and abs(np.corrcoef([r["doc_id"] for r in got], range(len(got)))[0, 1]) < 0.05
    assert mixing.mix_sources(none).count() == 0
    twelve = [r["doc_id"] for r in mixing.mix_sources(docs, budget=3.0).collect()].count(12)
    assert twelve % 2 == 0  # both rows of an id are drawn alike
    only = spark.createDataFrame([("s0", 1.0)], "source string, weight double")
    assert {r["source"] for r in mixing.mix_sources(docs, weights=only).collect()} == {"s0"}


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo <|im_end|>"), (1, 2, "bob", "yo <|im_end|>"), (1, 70, "ann", None), (2, 0, "system", "alone"), (3, None, None, "lost"), (None, 0, "cy", "é😀")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part")
    got = {(r["conv_id"], r["perspective"], r["part"]): r for r in chat.rotate_perspectives(table).collect()}
    assert {k[:2] for k in got} == {(1, "ann"), (1, "bob"), (3, "unknown"), (None, "cy")}
    r = got[1, "bob", 0]
    assert r["rendered"] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>assistant\nyo < |im_end|><|im_end|>\n"
    (a, b), = [map(int, m.split(":")) for m in r["mask"].split(",")]
    assert r["rendered"][a:b] == "yo < |im_end|><|im_end|>"
    assert got[1, "ann", 1]["rendered"] == "<|im_start|>assistant\n<|im_end|>\n" and got[1, "bob", 1]["mask"] == ""
    assert got[None, "cy", 0]["mask"] == "22:34"
    assert chat.rotate_perspectives(table.limit(0)).count() == 0


def test_stages(spark, docs, none, tiny):
    rows = docs.selectExpr("*", "'x' AS spans")
    for f in (stages.quality_filter, stages.jaccard_dedup, stages.pii_redaction, stages.source_mixing):
        out = f(spark, rows, tiny)
        assert out.columns == rows.columns and f(spark, none, tiny).count() == 0
        out.write.format("noop").mode("overwrite").save()
    kept = [r["doc_id"] for r in stages.jaccard_dedup(spark, rows, tiny).collect()]
    assert sorted(i for i in kept if i) == [1, 4, 5, 6, 7, 8, 10, 11, 13] and kept.count(None) == 1


def test_pipeline_runs(spark, tiny):
    import corpus_pipeline
    out = corpus_pipeline.run(spark, tiny).collect()
    assert out and all(r["decoded"] == LIBRARY.decode(list(r["ids"])) for r in out)

"""Personal data: fixed patterns, and identifiers found by their contexts, in DataFrame operations only.

The base kinds are regular expressions with checks, leftmost and without overlaps per kind. They are the seeds of a
bootstrap: the two words before a seed are a lexical pattern; patterns and the identifier-like words (holding
a digit or an at sign) they stand before form a graph. Round by round a pattern scores the
mean confidence of its instances, shrunk by one doubtful instance, and an instance what the patterns around it
leave of doubt; instances of little doubt are seeds of the next round. Patterns of high score with several different seeds then mark every word they stand before, in all
texts; what overlaps no base span is added as kind ``context``.

Places are code points, ends exclusive. Null texts count as empty. Rows that repeat a document get the same spans;
rows of null ``doc_id`` are told apart by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import let
from .common import attach_groups, materialise

KINDS = ("email", "ip", "card", "phone")
#: Written so that each place is tried once: a run is entered at its first character, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "phone": "+"}
BLANK = r"\x20\x09-\x0D"
#: A word that holds a digit or an at sign.
IDENTIFIER = rf"(?<![^{BLANK}])[^0-9@{BLANK}]*+[0-9@][^{BLANK}]*+"
#: The last two words of a text, or its only one. Tried at starts of words only, without going back.
LAST_WORDS = rf"(?<![^{BLANK}])(?:[^{BLANK}]++[{BLANK}]++)?[^{BLANK}]++[{BLANK}]*+$"
ROUNDS, MIN_SEEDS, MIN_SCORE = 3, 3, 0.8
#: From this trust on an instance found in an earlier round counts as a seed.
SURE = 0.9
#: Matches and spans folded at once.
SLICE = 64
SPAN = "struct<kind:string,start:int,end:int>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.split(F.reverse(_digits(value)), "")
    return F.aggregate(
        F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda a, d: a + d) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
        return F.rlike(value, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str, words: bool = False) -> Column:
    """All matches with their places and (if asked for) the last words before them: array of (start, end, value, before)."""
    marked = F.split(F.regexp_replace(text, pattern, "\u0001$0\u0002"), "\u0001")
    none = "array<struct<start:int,end:int,value:string,before:string>>"

    def step(a: Column, part: Column) -> Column:
        value = F.substring_index(part, "\u0002", 1)
        first = a["at"] < 0
        so_far = F.concat(a["before"], F.translate(part, "\u0002", ""))
        return F.struct(
            F.when(first, F.length(part)).otherwise(a["at"] + F.length(part) - 1).alias("at"),
            (F.regexp_extract(so_far, LAST_WORDS, 0) if words else F.lit("")).alias("before"),
            F.when(first, a["found"]).otherwise(F.concat(a["found"], F.array(F.struct(
                a["at"].alias("start"), (a["at"] + F.length(value)).alias("end"), value.alias("value"), a["before"].alias("before"))))).alias("found"))

    def over(parts: Column) -> Column:
        def one(a: Column, own: Column) -> Column:
            inner = F.aggregate(own, F.struct(a["at"].alias("at"), a["before"].alias("before"), F.expr(f"CAST(array() AS {none})").alias("found")), step)
            return let(inner, lambda r: F.struct(r["at"].alias("at"), r["before"].alias("before"), F.concat(a["slices"], F.array(r["found"])).alias("slices")))

        start = F.struct(F.lit(-1).alias("at"), F.lit("").alias("before"), F.expr(f"CAST(array() AS array<{none}>)").alias("slices"))
        return F.aggregate(_sliced(parts), start, one, lambda a: F.flatten(a["slices"]))

    return let(marked, over)


def _sliced(items: Column) -> Column:
    """An array in slices, so that lists are not copied whole for every item."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / SLICE).cast("int")), lambda j: F.slice(items, j * SLICE + 1, F.lit(SLICE)))


def _clean(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "\u0001\u0002", "\u0003\u0003")


def _of_kind(text: Column, kind: str) -> Column:
    passing = F.filter(_matches(text, PATTERNS[kind]), lambda m: _passes(kind, m["value"]))
    found = F.transform(passing, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    if kind in NEEDS:
        found = F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(F.expr(f"CAST(array() AS array<{SPAN}>)"))
    return found


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by kind as listed, then start."""
    return F.concat(*[_of_kind(text, kind) for kind in KINDS])


def _context(before: Column) -> Column:
    """The two words before a place, in lower case, digits as 0; null if there are not two."""
    words = F.trim(F.regexp_replace(F.regexp_replace(F.lower(before), "[0-9]", "0"), rf"[{BLANK}]+", " "))
    return F.when(F.contains(words, F.lit(" ")), words)


def scan(docs: DataFrame) -> DataFrame:
    """The rows with ``__text`` key, ``__base`` (spans) and ``__words`` (identifier-like words with their contexts)."""
    text = _clean(F.col("text"))
    words = F.transform(_matches(text, IDENTIFIER, words=True), lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), F.lower(F.regexp_replace(m["value"], r"^[\p{Punct}&&[^+]]+|\p{Punct}+$", "")).alias("instance"), _context(m["before"]).alias("pattern")))
    return docs.select("*", F.xxhash64("text").alias("__text"), base_spans(text).alias("__base"), words.alias("__words"))


def _overlaps(span: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))


def _occurrences(scanned: DataFrame) -> DataFrame:
    return (
        scanned.where(F.size("__words") > 0)
        .select("doc_id", "__text", "__base", F.explode("__words").alias("w")).where("w.pattern IS NOT NULL AND w.instance <> ''")
        .select("doc_id", "__text", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("w.pattern").alias("pattern"),
                F.col("w.instance").alias("instance"), _overlaps(F.col("w"), F.col("__base")).alias("seed")))


def trusted_patterns(occurrences: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE) -> DataFrame:
    """``pattern`` and ``score`` of the patterns that discover identifiers."""
    edges = materialise(occurrences.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-edges")
    seeds = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("sure"))
    trust = materialise(seeds.select("*", F.lit(0.0).alias("found"), F.col("sure").alias("trust")), "pii-trust")
    patterns = None
    for _ in range(rounds):
        patterns = materialise(
            edges.join(trust.select("instance", "trust", "found"), "instance").groupBy("pattern")
            .agg((F.sum("trust") / (F.count(F.lit(1)) + 1)).alias("score"), F.sum((F.col("seed") | (F.col("found") >= SURE)).cast("long")).alias("seeds"))
            .where(F.col("seeds") >= min_seeds), "pii-patterns")
        around = (
            edges.join(patterns, "pattern").groupBy("instance")
            .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("found")))
        trust = materialise(
            seeds.join(around, "instance", "left").select("instance", "sure", F.coalesce("found", F.lit(0.0)).alias("found"))
            .withColumn("trust", F.greatest("sure", "found")), "pii-trust")
    return patterns.where(F.col("score") >= min_score).select("pattern", "score")


def discovered(scanned: DataFrame) -> DataFrame:
    """Per document with any: ``doc_id``, ``__text`` and ``__more``, the spans of kind ``context``."""
    occurrences = materialise(_occurrences(scanned), "pii-occurrences")
    marked = attach_groups(occurrences.where("NOT seed"), trusted_patterns(occurrences), ["pattern"], "inner")
    return marked.groupBy("doc_id", "__text").agg(F.sort_array(F.collect_set(F.struct(F.lit("context").alias("kind"), "start", "end"))).alias("__more"))


def find_personal_data(docs: DataFrame, base: str = "base", spans: str = "spans") -> DataFrame:
    """The rows with ``base`` and ``spans`` (base, then context): arrays of (kind, start, end). Columns of these names are replaced."""
    scanned = materialise(scan(docs), "pii-scan")
    none = F.expr(f"CAST(array() AS array<{SPAN}>)")
    return (
        attach_groups(scanned, discovered(scanned), ["doc_id", "__text"])
        .select(*[c for c in docs.columns if c not in (base, spans)], F.col("__base").alias(base), F.concat("__base", F.coalesce("__more", none)).alias(spans)))


def listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping ones the first counts, to their common end."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(a: Column, s: Column) -> Column:
        return F.when(s["end"] <= a["at"], a).when(s["start"] < a["at"], F.struct(s["end"].alias("at"), a["out"].alias("out"))).otherwise(F.struct(
            s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out")))

    def one(a: Column, own: Column) -> Column:
        inner = F.aggregate(own, F.struct(a["at"].alias("at"), F.lit("").alias("out")), step)
        return let(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    joined = let(ordered, lambda items: F.aggregate(
        _sliced(items), F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<string>)").alias("out")), one,
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.lit(2 ** 31 - 1) - a["at"]))))
    return F.when(F.size(spans) > 0, joined).otherwise(text)

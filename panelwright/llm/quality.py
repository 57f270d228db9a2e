"""Quality of documents by hierarchical empirical Bayes.

A logistic regression on counts over the whole text gives the evidence of a single document. Hosts, and the paths within
them, get posterior rates of good documents by grouped sums: of the labels where there are any, of the evidence
elsewhere. A path's rate is shrunk to its host's, a host's to the global one, the more the fewer documents it has; the prior
strengths come from the spread between the groups (method of moments). The score moves the evidence's
log odds by what the path's posterior differs from the global rate.

Null hosts and paths are groups of their own. Null texts count as empty. Rows that repeat an id are scored alike and count
repeatedly; of several labels for an id the smallest holds. Without labels of both kinds the evidence is the share of
labels that are 1 (1 without labels), so nothing is rejected by accident.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import attach_groups, materialise
from .wordhash import Words, chunked

#: Labelled rows used to fit the evidence, at most (the first ones by a hash of their id).
FIT_ROWS = 20_000
FEATURES = ("letters", "capitals", "digits", "symbols", "stops", "lines", "words", "word_length", "distinct", "repeats", "longest", "capital_words")
_KIND = np.zeros((6, 256), bool)
_KIND[0, 65:91] = _KIND[0, 97:123] = _KIND[0, 128:] = True
_KIND[1, 65:91] = True
_KIND[2, 48:58] = True
_KIND[3, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_KIND[4, [33, 44, 46, 63]] = True
_KIND[5, 10] = True
_KIND[3] &= ~_KIND[4]


def _table(words: Words) -> np.ndarray:
    n, size = len(words.first) - 1, np.maximum(np.diff(words.offsets), 1)
    out = np.zeros((n, len(FEATURES)))
    for f in range(6):
        sums = np.concatenate([[0], np.cumsum(_KIND[f][words.data])])
        out[:, f] = (sums[words.offsets[1:]] - sums[words.offsets[:-1]]) / size
        if f == 1:
            capitals = np.concatenate([[0], np.cumsum(sums[words.end] - sums[words.start] >= np.maximum(2, words.end - words.start - 2))])
    length = words.end - words.start
    for i in range(n):
        a, b = words.first[i], words.first[i + 1]
        if b > a:
            h = words.hash[a:b]
            out[i, 6:] = np.log1p(b - a), np.log1p(length[a:b].mean()), len(np.unique(h)) / (b - a) ** 0.8, (h[1:] == h[:-1]).mean() if b - a > 1 else 0, np.log1p(length[a:b].max()), (capitals[b] - capitals[a]) / (b - a)
    return out


def add_features(docs: DataFrame, column: str = "features") -> DataFrame:
    """The rows with an array of counts over their whole text."""
    fields = [f for f in docs.schema.fields if f.name != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = [_table(words) for _, words in chunked(batch.column("text"))]
            values = np.concatenate(tables) if tables else np.zeros((0, len(FEATURES)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(FEATURES)), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in fields] + [lists], [f.name for f in fields] + [column])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{column}` array<double>"
    return docs.select(*[F.col(f"`{f.name}`") for f in fields]).mapInArrow(run, schema)


def fit(features: np.ndarray, good: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression on standardised counts and their squares, by Newton steps: centre, scale, weights (the constant last)."""
    centre, scale = features.mean(0), features.std(0) + 1e-9
    x = _expanded((features - centre) / scale)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - good) + ridge * w
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + ridge * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, w


def _expanded(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -5, 5)
    return np.hstack([z, z * z, np.ones((len(z), 1))])


def evidence(features: Column, model: tuple | float) -> Column:
    """The regression's probability as a column expression."""
    if isinstance(model, float):
        return F.lit(model)
    centre, scale, w = model
    m = len(centre)
    z = [F.greatest(F.lit(-5.0), F.least(F.lit(5.0), (F.element_at(features, i + 1) - float(centre[i])) / float(scale[i]))) for i in range(m)]
    logit = F.lit(float(w[-1]))
    for i in range(m):
        logit = logit + z[i] * float(w[i]) + z[i] * z[i] * float(w[m + i])
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))


def learn(featured: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> tuple | float:
    """Fits the evidence on at most ``bound`` labelled rows of ``featured`` (``doc_id``, ``features``)."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("good"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = 1.1 * bound / max(known.count(), 1)  # so that about the bound's number of rows is collected, not that number from every task
    rows = (
        featured.select("doc_id", "features").join(known.where(place < int(min(share, 1.0) * (1 << 30))), "doc_id")
        .select("features", "good", place.alias("place"), "doc_id").collect())
    rows = sorted(rows, key=lambda r: (r["place"], r["doc_id"], r["features"]))[:bound]
    if not rows:
        return 1.0
    good = np.array([float(r["good"]) for r in rows])
    if good.min() == good.max():
        return float(good[0])
    return fit(np.array([r["features"] for r in rows]), good)


def _strength(groups: DataFrame, good: str, n: str, parent: Column) -> float:
    """The prior strength of groups around their parent's rate: m (1 - m) / variance - 1, the variance being what chance leaves."""
    g, size = F.col(good), F.col(n)
    spread = (size * F.pow(g / size - parent, 2))
    r = groups.where(f"{n} > 0").agg(F.sum(spread).alias("spread"), F.sum(parent * (1 - parent)).alias("chance"), F.sum(n).alias("n"), F.sum(size * parent * (1 - parent)).alias("within")).first()
    if not r["n"]:
        return 1.0
    between = max(r["spread"] - r["chance"], 1e-9) / r["n"]
    return float(min(max(r["within"] / r["n"] / between - 1, 1.0), 1e6))


def posteriors(rows: DataFrame) -> tuple[DataFrame, float]:
    """From ``host``, ``path``, ``outcome`` (0 to 1): posterior rates per (host, path), and the global rate."""
    paths = materialise(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("outcome").alias("good")), "quality-paths")
    hosts = materialise(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")), "quality-hosts")
    whole = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good")).first()
    rate = min(max((whole["good"] or 0.0) / max(whole["n"] or 0, 1), 1e-3), 1 - 1e-3)
    k = _strength(hosts, "host_good", "host_n", F.lit(rate))
    hosts = hosts.withColumn("host_posterior", (F.col("host_good") + k * rate) / (F.col("host_n") + k))
    both = materialise(attach_groups(paths, hosts.select("host", "host_posterior"), ["host"]), "quality-both")
    k = _strength(both, "good", "n", F.col("host_posterior"))
    return both.select("host", "path", "host_posterior", ((F.col("good") + k * F.col("host_posterior")) / (F.col("n") + k)).alias("path_posterior")), rate


def combined(evidence: Column, path_posterior: Column, rate: float) -> Column:
    logit = lambda p: F.log(p / (1 - p))
    inside = lambda p: F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return 1 / (1 + F.exp(-(logit(inside(evidence)) + logit(inside(path_posterior)) - float(np.log(rate / (1 - rate))))))


class QualityModel:
    """Evidence and posteriors, learned from all documents of a table."""

    def __init__(self, docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.5, bound: int = FIT_ROWS):
        self.host, self.path, self.threshold = host, path, threshold
        narrow = docs.select("doc_id", "text", host.alias("host"), path.alias("path"))
        self.featured = materialise(add_features(narrow).drop("text"), "quality-features")
        self.model = learn(self.featured, labels, bound)
        known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("good"))
        outcome = F.coalesce(F.col("good").cast("double"), evidence(F.col("features"), self.model))
        self.groups, self.rate = posteriors(self.featured.join(known, "doc_id", "left").select("host", "path", outcome.alias("outcome")))

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds ``evidence``, the posteriors, ``score`` and ``keep`` to rows with ``host``, ``path`` and ``features``."""
        scored = attach_groups(rows, self.groups, ["host", "path"]).withColumn("evidence", evidence(F.col("features"), self.model))
        score = combined(F.col("evidence"), F.coalesce("path_posterior", "host_posterior", F.lit(self.rate)), self.rate)
        return scored.withColumn("score", score).withColumn("keep", F.col("score") >= self.threshold)

    def table(self) -> DataFrame:
        return self.score(self.featured).select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "score", "keep")

    def filter(self, docs: DataFrame) -> DataFrame:
        """The documents that are kept, with their own columns, in one pass over the texts."""
        own = docs.columns
        renamed = docs.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)], F.col("text"), self.host.alias("host"), self.path.alias("path"))
        scored = self.score(add_features(renamed.drop(f"own_{own.index('text')}")))
        back = [F.col("text") if c == "text" else F.col(f"own_{i}").alias(c) for i, c in enumerate(own)]
        return scored.where("keep").select(*back)

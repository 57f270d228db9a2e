"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the embedding of its hash bucket, and as the mean embedding of its character trigrams (with the blanks
around it). Two gated recurrent layers read a window of words forwards and backwards, attention pools their
states, and a linear layer gives the window's log odds. Windows overlap and cover the whole text; a document has the
log odds of its most toxic window, set to scale by a logistic fit.

Training takes a bounded sample of labelled documents (``SAMPLE`` of either label, first ones by a hash of the id, texts of at
most ``SAMPLE_CHARS`` characters). Labels hold for documents, not for windows: the first rounds give
each window its document's label, the later ones train on the window that scores highest in each document.

Null texts and texts without words are scored as one empty window. Without labels of both kinds every score is the share of
labels that are 1 (0 without labels). Rows that repeat an id are scored each; of several labels of an id the largest holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .wordhash import _BLANK, _FOLDED, Words, chunked

WORD_BUCKETS, TRIGRAM_BUCKETS, EMBED, HIDDEN = 1 << 13, 1 << 13, 8, 8
#: Words of a window, and how far one lies from the next: any run of half a window's words lies in some window as a whole.
WINDOW, STEP = 32, 16
#: Windows scored at once.
SLICE = 2_048
SAMPLE, SAMPLE_CHARS = 1_200, 20_000
NOISY_ROUNDS, ROUNDS, BATCH, RATE, SEED = 2, 6, 256, 0.01, 11
#: Steps of either kind that small samples get at least, by more rounds.
LEAST_STEPS = 50
_LETTER = np.where(_BLANK, 32, _FOLDED).astype(np.uint32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Inputs:
    """Buckets of the words of some texts, and of their trigrams (``at``: where each word's begin)."""

    def __init__(self, words: Words):
        self.word = (words.hash >> np.uint64(64 - 13)).astype(np.int64)
        n = len(words.data)
        letters = np.full(n + 2, 32, np.uint32)
        letters[1:-1] = _LETTER[words.data]
        inside = np.repeat(words.start - np.concatenate([[0], np.cumsum(words.end - words.start)[:-1]]), words.end - words.start) + np.arange((words.end - words.start).sum()) if len(words.start) else np.zeros(0, np.int64)
        code = letters[inside] | (letters[inside + 1] << np.uint32(8)) | (letters[inside + 2] << np.uint32(16))
        self.trigram = ((code * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.int32)
        self.length = (words.end - words.start).astype(np.float32)
        self.at = np.concatenate([[0], np.cumsum(words.end - words.start)[:-1]]) if len(words.start) else np.zeros(0, np.int64)
        self.first = words.first


    def part(self, a: int, b: int) -> "Inputs":
        """The inputs of the words a:b alone."""
        out = Inputs.__new__(Inputs)
        lo, hi = (self.at[a], self.at[b - 1] + int(self.length[b - 1])) if b > a else (0, 0)
        out.word, out.length, out.at, out.trigram = self.word[a:b], self.length[a:b], self.at[a:b] - lo, self.trigram[lo:hi]
        return out


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and text of every window; a text without words has an empty one."""
    starts, texts = [], []
    for i in range(len(first) - 1):
        n = int(first[i + 1] - first[i])
        own = np.arange(0, max(n - WINDOW, 0) + 1, STEP)
        if n > WINDOW and own[-1] != n - WINDOW:
            own = np.append(own, n - WINDOW)
        starts.append(own + first[i])
        texts.append(np.full(len(own), i))
    start, text = np.concatenate(starts), np.concatenate(texts)
    return start, np.minimum(first[text + 1] - start, WINDOW), text


class Network:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        f = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"words": f(WORD_BUCKETS, EMBED, scale=0.1), "trigrams": f(TRIGRAM_BUCKETS, EMBED, scale=0.1), "query": f(2 * HIDDEN, scale=0.3), "out": f(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32)}
        for d in ("forward", "backward"):
            self.p[f"in_{d}"] = f(2 * EMBED, 3 * HIDDEN, scale=0.4)
            self.p[f"state_{d}"] = f(HIDDEN, 3 * HIDDEN, scale=0.3)
            self.p[f"bias_{d}"] = np.zeros(3 * HIDDEN, np.float32)
        self.scale, self.shift = 1.0, 0.0

    def embed(self, x: Inputs) -> np.ndarray:
        """The inputs of all words, and a last row of zeros for places beyond a window's end."""
        out = np.zeros((len(x.word) + 1, 2 * EMBED), np.float32)
        if len(x.word):
            out[:-1, :EMBED] = self.p["words"][x.word]
            out[:-1, EMBED:] = np.add.reduceat(self.p["trigrams"][x.trigram], x.at, axis=0) / x.length[:, None]
        return out

    def _layer(self, gates: np.ndarray, active: np.ndarray | None, d: str, keep: bool):
        """States (time, window, unit) of one direction from its input gates (time, window, 3 * unit)."""
        steps, n, h = len(gates), gates.shape[1], HIDDEN
        states, state, kept, u = np.empty((steps, n, h), np.float32), np.zeros((n, h), np.float32), {}, self.p[f"state_{d}"]
        for t in range(steps) if d == "forward" else range(steps - 1, -1, -1):
            own = state @ u
            zr = _sigmoid(gates[t, :, : 2 * h] + own[:, : 2 * h])
            new = np.tanh(gates[t, :, 2 * h:] + zr[:, h:] * own[:, 2 * h:])
            after = new + zr[:, :h] * (state - new)
            if active is not None:
                after = np.where(active[t][:, None], after, state)
            if keep:
                kept[t] = (state, own[:, 2 * h:], zr, new)
            states[t] = state = after
        return states, kept

    def forward(self, x: np.ndarray, start: np.ndarray, size: np.ndarray, keep: bool = False):
        """Log odds of windows of the embedded words x."""
        place = np.arange(WINDOW)[:, None]
        active = place < size
        at = np.where(active, start + place, len(x) - 1)
        full = bool(active.all())
        states, kept = [], []
        for d in ("forward", "backward"):
            gates = (x @ self.p[f"in_{d}"] + self.p[f"bias_{d}"])[at]
            s, k = self._layer(gates, None if full else active, d, keep)
            states.append(s)
            kept.append(k)
        states = np.concatenate(states, axis=2)
        weight = states @ self.p["query"]
        weight = np.where(active, weight, -30) if not full else weight
        weight = np.exp(weight - weight.max(0))
        weight = weight * active if not full else weight
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        return pooled @ self.p["out"] + self.p["bias"], (at, active, states, weight, pooled, kept)

    def gradients(self, data: Inputs, x: np.ndarray, start: np.ndarray, size: np.ndarray, target: np.ndarray, importance: np.ndarray) -> dict:
        """Gradients of the weighted logistic loss."""
        p, h = self.p, HIDDEN
        odds, (at, active, states, weight, pooled, kept) = self.forward(x, start, size, True)
        slope = ((_sigmoid(odds) - target) * importance / importance.sum()).astype(np.float32)
        g = {"out": pooled.T @ slope, "bias": slope.sum(keepdims=True)}
        d_pooled = slope[:, None] * p["out"]
        d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_logit = weight * (d_weight - (weight * d_weight).sum(0))
        g["query"] = np.einsum("tn,tnh->h", d_logit, states)
        d_states = weight[:, :, None] * d_pooled + d_logit[:, :, None] * p["query"]
        d_x = np.zeros_like(x)
        for j, d in enumerate(("forward", "backward")):
            u, d_u, d_gates, carried = p[f"state_{d}"], np.zeros_like(p[f"state_{d}"]), np.zeros((len(at), at.shape[1], 3 * h), np.float32), np.zeros((at.shape[1], h), np.float32)
            for t in range(len(at) - 1, -1, -1) if d == "forward" else range(len(at)):
                state, own, zr, new = kept[j][t]
                total = carried + d_states[t, :, j * h: (j + 1) * h]
                on = active[t][:, None]
                d_new = total * (1 - zr[:, :h]) * (1 - new * new) * on
                d_z = total * (state - new) * zr[:, :h] * (1 - zr[:, :h]) * on
                d_r = d_new * own * zr[:, h:] * (1 - zr[:, h:])
                d_gates[t] = np.concatenate([d_z, d_r, d_new], axis=1)
                d_own = np.concatenate([d_z, d_r, d_new * zr[:, h:]], axis=1)
                d_u += state.T @ d_own
                carried = np.where(on, total * zr[:, :h], total) + d_own @ u.T
            flat = d_gates.reshape(-1, 3 * h)
            g[f"state_{d}"], g[f"bias_{d}"] = d_u, flat.sum(0)
            g[f"in_{d}"] = x[at].reshape(-1, x.shape[1]).T @ flat
            np.add.at(d_x, at.ravel(), flat @ p[f"in_{d}"].T)
        used = np.flatnonzero(d_x[:-1].any(1))
        g["words"], g["trigrams"] = np.zeros_like(p["words"]), np.zeros_like(p["trigrams"])
        np.add.at(g["words"], data.word[used], d_x[used, :EMBED])
        count = data.length[used].astype(np.int64)
        inside = np.repeat(data.at[used] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        np.add.at(g["trigrams"], data.trigram[inside], np.repeat(d_x[used, EMBED:] / data.length[used][:, None], count, axis=0))
        return g

    def score_words(self, words: Words) -> np.ndarray:
        """Log odds of each text: its most toxic window's."""
        data = Inputs(words)
        start, size, text = windows(data.first)
        odds = self.odds(data, start, size)
        best = np.full(len(data.first) - 1, -np.inf)
        np.maximum.at(best, text, odds)
        return best * self.scale + self.shift

    def odds(self, data: Inputs, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log odds of windows in ascending order, a slice of them at a time, so that memory does not grow with a text."""
        out = [np.zeros(0)]
        for lo in range(0, len(start), SLICE):
            own = slice(lo, lo + SLICE)
            a, b = start[own].min(), (start[own] + size[own]).max()
            out.append(self.forward(self.embed(data.part(a, b)), start[own] - a, size[own])[0])
        return np.concatenate(out)

    def score(self, column: pa.Array) -> np.ndarray:
        found = [self.score_words(words) for _, words in chunked(column, fold=True)]
        return _sigmoid(np.clip(np.concatenate(found), -30, 30)) if found else np.zeros(0)


def train(texts: list[str], toxic: np.ndarray, share: float, seed: int = SEED) -> Network:
    """Fits a network to texts with labels; ``share`` is the share of toxic texts to set the scale for."""
    net, r = Network(seed), np.random.default_rng(seed)
    parts = [(Inputs(words), lo) for lo, words in chunked(pa.array(texts, pa.string()), fold=True, size=1 << 62)]
    data = parts[0][0]
    start, size, text = windows(data.first)
    weight = np.where(toxic == 1, 0.5 / max(toxic.sum(), 1), 0.5 / max((1 - toxic).sum(), 1))
    per_text = np.bincount(text, minlength=len(texts))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0

    def learn(which: np.ndarray, importance: np.ndarray) -> None:
        nonlocal step
        which = r.permutation(which)
        for lo in range(0, len(which), BATCH):
            own = which[lo: lo + BATCH]
            # only the words of the batch are embedded
            at = (start[own][:, None] + np.arange(WINDOW))[np.arange(WINDOW) < size[own][:, None]]
            words = np.unique(at)
            sub = Inputs.__new__(Inputs)
            sub.word, sub.length = data.word[words], data.length[words]
            count = sub.length.astype(np.int64)
            sub.at = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else np.zeros(0, np.int64)
            sub.trigram = data.trigram[np.repeat(data.at[words] - sub.at, count) + np.arange(count.sum())] if len(count) else np.zeros(0, np.int64)
            g = net.gradients(sub, net.embed(sub), np.searchsorted(words, start[own]), size[own], toxic[text[own]], importance[own])
            step += 1
            for k, grad in g.items():
                m[k] += 0.1 * (grad - m[k])
                v[k] += 0.01 * (grad * grad - v[k])
                net.p[k] -= (RATE * m[k] / (1 - 0.9 ** step) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)

    def rounds(least: int, windows_each: int) -> range:
        return range(max(least, -(-LEAST_STEPS // max(1, -(-windows_each // BATCH)))))

    for _ in rounds(NOISY_ROUNDS, len(start)):
        learn(np.arange(len(start)), weight[text] / per_text[text])
    for _ in rounds(ROUNDS, 2 * len(texts)):
        odds = net.odds(data, start, size)
        order = np.lexsort((-odds, text))
        top = order[np.searchsorted(text[order], np.arange(len(texts)))]
        clean = np.flatnonzero(toxic[text] == 0)
        learn(np.concatenate([top, r.choice(clean, min(len(clean), len(texts)), replace=False)]), weight[text])
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, text, net.odds(data, start, size))
    net.scale, net.shift = _scale(best, toxic, share)
    return net


def _scale(odds: np.ndarray, toxic: np.ndarray, share: float) -> tuple[float, float]:
    """Logistic fit of the label to a document's log odds, each label weighted to its share; a little ridge keeps it finite."""
    x = np.stack([odds, np.ones_like(odds)], axis=1)
    weight = np.where(toxic == 1, share / max(toxic.sum(), 1), (1 - share) / max((1 - toxic).sum(), 1)) * len(odds)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(np.clip(x @ w, -30, 30))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + 0.5 * np.eye(2), x.T @ (weight * (p - toxic)) + 0.5 * (w - [1.0, 0.0]))
        w -= np.clip(step, -2, 2)
    return float(max(w[0], 1e-3)), float(w[1])


def learn_from(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | float:
    """Trains on at most ``sample`` labelled documents of either label."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    counts = {r["__toxic"]: r["count"] for r in known.groupBy("__toxic").count().collect()}
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    if not 0 < share < 1:
        return float(share)
    short = docs.where(F.length("text") <= SAMPLE_CHARS)
    able = short.select("doc_id").join(known, "doc_id")
    chosen = None
    for label in (0, 1):
        own = able.where(F.col("__toxic") == label).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = own if chosen is None else chosen.union(own)
    # at most 2 * sample ids; of rows that repeat an id the smallest text
    rows = short.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "__toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    toxic = np.array([float(r["__toxic"]) for r in rows])
    if len(set(toxic)) < 2:
        return float(share)
    return train([r["text"] for r in rows], toxic, share)


def score_documents(docs: DataFrame, model: Network | float) -> DataFrame:
    """Per row ``doc_id`` and ``score`` (0 to 1)."""

    def run(batches):
        for batch in batches:
            score = model.score(batch.column("text")) if isinstance(model, Network) else np.full(batch.num_rows, model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score.astype(np.float64))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """``doc_id``, ``held_out`` (CRC-32 of the id divisible by ``folds``: its label is not learned), ``score``, ``predicted``."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    model = learn_from(docs, labels.where(~held))
    return score_documents(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

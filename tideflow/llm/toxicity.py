"""Toxicity classifier: subword-bag embeddings averaged into a linear softmax, trained in numpy.

A word is the bag of its character n-grams, hashed to rows of one embedding table; its vector is
their mean, a window's vector is the mean over its words, and a linear softmax scores it. A
text's logit is a soft maximum over its windows, since a few words make a long text toxic. The
table and the softmax are trained jointly. An unseen misspelling shares most n-grams, hence most
of its vector, with words seen in training.

Training uses at most ``SAMPLE`` labelled texts of each class, chosen by a hash of their ids;
whole texts of all documents are scored. Null and empty texts have no windows and score the bias.
Without labels of both classes the score is 0.5.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Most labelled texts of each class that are fetched for training.
SAMPLE = 1000
BUCKETS, DIM, SHORTEST, LONGEST = 1 << 17, 12, 3, 4
WINDOW, STRIDE = 1, 1
#: Share of n-grams that are left out at random in an epoch, so that each carries its part.
DROP = 0.6
EPOCHS, RATE, DECAY = 70, 0.05, 1e-5
#: Texts of the training sample that must have an n-gram for its row to be trained (fewer for a small sample).
LEAST_TEXTS = 10
#: Sharpness of the soft maximum at the first and the last epoch.
SHARP = (0.5, 12.0)
THRESHOLD = 0.7
REMEMBERED = 400_000
_EDGE = ".,;:!?\"'()[]{}<>«»„“”‘’…-–—*_"


def words(text: str) -> list[str]:
    return text.lower().split()


def grams(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the words' n-grams between boundary marks, and the index of each one's word."""
    marked = [f"<{w.strip(_EDGE)}>" for w in vocabulary]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(marked)), [len(m) for m in marked])
    rows, owners = [], []
    for n in range(SHORTEST, LONGEST + 1):
        if len(codes) < n:
            break
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + codes[i : len(codes) - n + 1 + i]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        inside = word[: len(h)] == word[n - 1 :]
        rows.append((h[inside] >> np.uint64(40)) % np.uint64(BUCKETS))
        owners.append(word[: len(h)][inside])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows).astype(np.int64), np.concatenate(owners)


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)
    return starts, np.minimum(starts + WINDOW, n)


@dataclass
class Model:
    """``weights`` is the embedding table folded with the softmax: a row's contribution to the logit."""

    weights: np.ndarray
    bias: float
    sharp: float = SHARP[1]

    def values(self, vocabulary: list[str]) -> np.ndarray:
        """Each word's part of a window's logit."""
        rows, owner = grams(vocabulary)
        return np.bincount(owner, self.weights[rows], len(vocabulary)) / np.maximum(np.bincount(owner, minlength=len(vocabulary)), 1)

    def logit(self, values: np.ndarray) -> float:
        if not len(values):
            return self.bias
        starts, stops = windows(len(values))
        total = np.concatenate(([0.0], np.cumsum(values)))
        z = (total[stops] - total[starts]) / (stops - starts)
        top = z.max()
        return float(top + np.log(np.exp(self.sharp * (z - top)).mean()) / self.sharp + self.bias)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 1) -> Model:
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), 0.0)
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words(t)], np.int64) for t in texts]
    keep = [i for i, d in enumerate(docs) if len(d)]
    docs, y = [docs[i] for i in keep], y[keep]
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), 0.0)
    tokens = np.concatenate(docs)
    flat, owner = grams(list(number))
    order = np.argsort(owner, kind="stable")
    owner, n_words = owner[order], len(number)
    sizes = np.bincount(owner, minlength=n_words)
    used, flat = np.unique(flat[order], return_inverse=True)
    # an n-gram that only a few texts have says nothing about others: its row stays at zero
    ends, spread = np.cumsum(sizes), np.zeros(len(used), np.int64)
    for d in docs:
        own = np.unique(d)
        spread[np.unique(np.concatenate([flat[ends[w] - sizes[w] : ends[w]] for w in own]))] += 1
    active = spread >= max(2, min(LEAST_TEXTS, len(docs) // 200))
    base = np.cumsum([0] + [len(d) for d in docs])
    spans = [windows(len(d)) for d in docs]
    starts = np.concatenate([s + b for (s, _), b in zip(spans, base, strict=False)])
    stops = np.concatenate([e + b for (_, e), b in zip(spans, base, strict=False)])
    counts = np.array([len(s) for s, _ in spans])
    first, doc = np.cumsum(counts) - counts, np.repeat(np.arange(len(docs)), counts)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())

    rng, mean_of = np.random.default_rng(seed), np.maximum(sizes, 1)
    table, top = rng.normal(0, 0.1, (len(used), DIM)) * active[:, None], rng.normal(0, 1, DIM)
    bias, state = np.zeros(1), {}

    def adam(name: str, value: np.ndarray, grad: np.ndarray, t: int, rate: float) -> None:
        m, v = state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        value -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)

    for t in range(1, epochs + 1):
        sharp = SHARP[0] * (SHARP[1] / SHARP[0]) ** min(1.0, t / (0.7 * epochs))
        shown = (rng.random(len(flat)) >= DROP) / (1 - DROP)
        row = table @ top
        word = np.bincount(owner, (row[flat] * shown), n_words) / mean_of
        total = np.concatenate(([0.0], np.cumsum(word[tokens])))
        length = stops - starts
        z = (total[stops] - total[starts]) / length
        peak = np.maximum.reduceat(z, first)
        e = np.exp(sharp * (z - peak[doc]))
        mass = np.add.reduceat(e, first)
        logit = peak + np.log(mass / counts) / sharp + bias
        error = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y) * share
        by_window = error[doc] * e / mass[doc] / length
        edge = np.bincount(starts, by_window, len(tokens) + 1) - np.bincount(stops, by_window, len(tokens) + 1)
        by_word = np.bincount(tokens, np.cumsum(edge)[:-1], n_words) / mean_of
        by_row = np.bincount(flat, by_word[owner] * shown, len(used)) * active
        grad_top = table.T @ by_row + DECAY * top
        adam("table", table, np.outer(by_row, top) + DECAY * table, t, RATE)
        adam("top", top, grad_top, t, RATE)
        adam("bias", bias, np.array([error.sum()]), t, RATE)
    weights = np.zeros(BUCKETS)
    weights[used] = table @ top
    return Model(weights, float(bias[0]))


def held_out(id: str) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit(""))) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> tuple[list[str], list[int]]:
    """At most ``sample`` texts of each class outside the held-out rows, the same on every run."""
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull() & ~held_out(id)).select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_y"))
    some = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(some[0].union(some[1]).groupBy("_id").agg(F.max("_y").alias("_y")))  # at most 2 * sample ids
    rows = docs.select(F.col(id).alias("id"), text_of(text).alias("t")).join(chosen, F.col("id") == F.col("_id")).select("t", "_y", "_id").distinct().collect()
    rows.sort(key=lambda r: (r["_id"], r["t"]))
    return [r["t"] for r in rows], [r["_y"] for r in rows]


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` and the softmax probability of class 1; without a shuffle."""
    handle, token = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        model, known, out = handle.value, _memory(token), []
        todo = texts.fillna("").tolist()
        for at in range(0, len(todo), 300):
            lists = [words(t) for t in todo[at : at + 300]]
            if len(known) > REMEMBERED:
                known.clear()
            new = list(set().union(*lists) - known.keys())
            known.update(zip(new, model.values(new).tolist(), strict=True))
            out += [model.logit(np.fromiter(map(known.__getitem__, w), np.float64, len(w))) for w in lists]
        z = np.clip(np.array(out), -60, 60)
        return pd.Series(1 / (1 + np.exp(-z)))

    return docs.withColumn(name, probability(text_of(text)))


_words: dict[str, dict[str, float]] = {}


def _memory(model: str) -> dict[str, float]:
    """This worker's word scores under one model."""
    if model not in _words:
        _words.clear()
        _words[model] = {}
    return _words[model]


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """``docs`` and held_out, score, predicted."""
    model = train(*training_rows(docs, labels, id, text, label, sample))
    scored = score(docs.withColumn("held_out", held_out(id)), model, text)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

"""Quality: a factorisation machine over hashed words, structure and metadata.

Each distinct word bucket of a text is a feature with its share of the words; statistics
of the text's form (letters, capitals, marks, digits, lines, word lengths, repeats) and
of its size are dense features, and so is metadata: the length that the table states for a text
(``n_chars``; no other column may be used) and how far it is from the true one. Every pair of features interacts through vectors of a
low rank; the sum over pairs is half the square of the sum less the sum of squares, so
a text costs time linear in its features.

The sample is bounded: ``per_class`` labelled ids a class and ``max_words`` words in all.
A sampled row weighs its class's share of all labelled rows over that of the sample, so the
bound does not move scores.
Null text counts as empty: its word features are zero. Repeated rows get equal scores.
Without labelled rows of both classes every score is the share of label 1, else 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

from routescope.llm.labelled import BUCKETS, buckets, class_rows, class_weights, gathered, hashed_rows, labelled, scored, sigmoid
from routescope.llm.words import ALNUM, arrow_rows, bytes_of, slices

RANK = 8
PER_CLASS = 4000
MAX_WORDS = 8_000_000

_UPPER, _LOWER, _DIGIT, _SPACE, _LINE, _STOP, _MARK, _OTHER = range(8)


def _classes() -> np.ndarray:
    t = np.full(256, _MARK, np.uint8)
    t[128:] = _OTHER
    for lo, hi, kind in (("A", "Z", _UPPER), ("a", "z", _LOWER), ("0", "9", _DIGIT)):
        t[ord(lo) : ord(hi) + 1] = kind
    for c in " \t\r":
        t[ord(c)] = _SPACE
    t[ord("\n")] = _LINE
    for c in ".,;:!?":
        t[ord(c)] = _STOP
    return t


_CLASSES = _classes()


def structure(texts: pa.Array) -> np.ndarray:
    """Per row: shares of byte classes, line and word lengths, runs of one class of mark, size."""
    out = np.zeros((len(texts), 16))
    for lo, hi in slices(texts):
        data, at = bytes_of(texts, lo, hi)
        size = np.diff(at)
        full = size > 0
        starts = at[:-1][full]
        kind = _CLASSES[data]
        counts = np.zeros((hi - lo, 8))
        twice = np.zeros((hi - lo, 2))
        words = np.zeros(hi - lo)
        if full.any():
            for k in range(8):
                counts[full, k] = np.add.reduceat((kind == k).astype(np.int64), starts)
            same = np.zeros(len(data), np.int64)
            same[1:] = (data[1:] == data[:-1]) & (kind[1:] >= _STOP) & (kind[1:] < _OTHER)
            twice[full, 0] = np.add.reduceat(same, starts)
            shout = np.zeros(len(data), np.int64)
            shout[1:] = (kind[1:] == _UPPER) & (kind[:-1] == _UPPER)
            twice[full, 1] = np.add.reduceat(shout, starts)
            opens = np.zeros(len(data), np.int64)
            opens[1:] = (kind[1:] != _SPACE) & (kind[1:] != _LINE) & ((kind[:-1] == _SPACE) | (kind[:-1] == _LINE))
            words[full] = np.add.reduceat(opens, starts) + 1
        n = np.maximum(size, 1)[:, None]
        out[lo:hi, :8] = counts / n
        out[lo:hi, 8:10] = twice / n
        out[lo:hi, 10] = np.log1p(size)
        out[lo:hi, 11] = np.log1p(words)
        out[lo:hi, 12] = size / np.maximum(words, 1)
        out[lo:hi, 13] = np.log1p(size / (counts[:, _LINE] + 1))
        out[lo:hi, 14] = (counts[:, _MARK] + counts[:, _STOP]) / np.maximum(words, 1)
        out[lo:hi, 15] = size == 0
    return out


def form(texts: pa.Array, sizes: pa.Array) -> np.ndarray:
    """``structure``, then metadata: the stated length, its distance from the true one, whether none is stated."""
    true = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(float)
    stated = sizes.to_numpy(zero_copy_only=False).astype(float)
    none = ~np.isfinite(stated)
    stated = np.where(none, true, np.maximum(stated, 0.0))
    return np.column_stack([structure(texts), np.log1p(stated), np.abs(np.log1p(stated) - np.log1p(true)), none])


def shares(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of each row with their share of its words, where each row's begin, and
    the share of words that repeat an earlier one."""
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    keys, times = np.unique(row * BUCKETS + ids, return_counts=True)
    owner = keys // BUCKETS
    begin = np.searchsorted(owner, np.arange(len(counts) + 1))
    value = times / np.maximum(counts[owner], 1)
    return keys % BUCKETS, value, begin, 1 - np.diff(begin) / np.maximum(counts, 1)


@dataclass
class Model:
    base: float
    middle: np.ndarray | None = None
    spread: np.ndarray | None = None
    linear: np.ndarray | None = None  # buckets, then dense features
    factors: np.ndarray | None = None
    offset: float = 0.0

    def dense(self, stats: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        return np.clip((np.column_stack([stats, repeats]) - self.middle) / self.spread, -5, 5)

    def logits(self, ids: np.ndarray, value: np.ndarray, begin: np.ndarray, dense: np.ndarray) -> np.ndarray:
        full = np.diff(begin) > 0
        own = np.zeros((len(dense), 1 + 2 * RANK))
        if full.any():
            v = self.factors[ids] * value[:, None]
            terms = np.column_stack([self.linear[ids] * value, v, v * v])
            own[full] = np.add.reduceat(terms, begin[:-1][full], axis=0)
        v, w = self.factors[BUCKETS:], self.linear[BUCKETS:]
        total = own[:, 1 : 1 + RANK] + dense @ v
        squares = own[:, 1 + RANK :] + (dense * dense) @ (v * v)
        return self.offset + own[:, 0] + dense @ w + 0.5 * (total**2 - squares).sum(axis=1)

    def score(self, texts: pa.Array, sizes: pa.Array) -> np.ndarray:
        if self.linear is None:
            return np.full(len(texts), self.base)
        stats = form(texts, sizes)
        out = np.zeros(len(texts))
        for lo, hi, w in arrow_rows(texts, ALNUM):
            ids, value, begin, repeats = shares(buckets(w), w.first)
            out[lo:hi] = self.logits(ids, value * SCALE, begin, self.dense(stats[lo:hi], repeats))
        return np.round(sigmoid(out), 6)


SCALE = 4.0  # of word shares, against dense features of unit spread


def train(
    rows: list[tuple[int, str | None, np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 0.05, whole: tuple[int, int] | None = None
) -> Model:
    """Stochastic gradients with per-weight rates, one row at a time; seeded. Classes weigh as they occur
    among the rows counted in ``whole``, by default those given."""
    labels = np.array([r[0] for r in rows], int)
    base, weight = class_weights(labels, whole)
    if len(np.unique(labels)) < 2:
        return Model(base)
    rng = np.random.default_rng(11)
    features = []
    for _, _, ids, stats in rows:
        own, value, _, repeats = shares(ids, np.array([0, len(ids)]))
        features.append((own, value * SCALE, np.append(stats, repeats)))
    raw = np.array([f[2] for f in features])
    middle, spread = raw.mean(axis=0), np.maximum(raw.std(axis=0), 1e-3)
    m = raw.shape[1]
    seen = np.zeros(BUCKETS, bool)
    for own, _, _ in features:
        seen[own] = True
    linear = np.zeros(BUCKETS + m)
    factors = rng.normal(0, 0.05, (BUCKETS + m, RANK))
    factors[:BUCKETS][~seen] = 0
    g_l, g_f = np.full(BUCKETS + m, 1e-2), np.full((BUCKETS + m, RANK), 1e-2)
    offset, g_c = float(np.log(base / (1 - base))), 1e-2
    all_dense = np.clip((raw - middle) / spread, -5, 5)
    tail = np.arange(BUCKETS, BUCKETS + m)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = np.concatenate([features[i][0], tail])
            x = np.concatenate([features[i][1], all_dense[i]])
            v = factors[at]
            total = x @ v
            z = offset + linear[at] @ x + 0.5 * float((total**2 - (x * x) @ (v * v)).sum())
            slope = weight[labels[i]] * (float(sigmoid(np.float64(z))) - labels[i])
            to_l = slope * x + 1e-5 * linear[at]
            to_f = slope * (x[:, None] * total - v * (x * x)[:, None]) + 1e-4 * v
            g_l[at] += to_l**2
            g_f[at] += to_f**2
            linear[at] -= rate * to_l / np.sqrt(g_l[at])
            factors[at] -= rate * to_f / np.sqrt(g_f[at])
            g_c += slope * slope
            offset -= rate * slope / np.sqrt(g_c)
    return Model(base, middle, spread, linear.astype(np.float32), factors.astype(np.float32), offset)


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, per_class: int = PER_CLASS, max_words: int = MAX_WORDS) -> Model:
    """A model from the rows of ``labels`` (doc_id, quality) for which ``usable`` holds."""
    rows = hashed_rows(labelled(docs, labels, "quality", per_class, usable), buckets, form)
    return train(gathered(rows, max_words), whole=class_rows(docs, labels, "quality", usable))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row and its ``score``, by the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS
    return scored(docs, keep, lambda texts, sizes: shared.value.score(texts, sizes))

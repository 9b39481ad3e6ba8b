"""Toxicity: a convolutional text classifier, trained in numpy.

A word's embedding is the sum of those of three hash buckets: of the word, and of its
first four and six bytes, which speak for inflections never seen. Filters of several
widths slide over the embeddings and keep their largest answer over the whole text; a
logistic layer joins the answers. Each bucket starts from its smoothed log odds.

Every labelled row takes part, whatever their number. Four fifths, by a hash, give the counts of
buckets and the weights: each group of rows is walked through by one task in small steps from the
weights all start with, the groups' changes are averaged by Spark, and the next round starts there.
The other fifth sets, per language, the threshold that makes fewest errors, from counts of its answers
in steps of 1/``GRID``; the language is guessed from the text, by bucket frequencies, so ``lang`` itself
enters no score. Thresholds become 0.5 in the score. The driver holds the model, whose size ``ROWS``
fixes, never rows. Sums are of integers and groups go by hash, so no order of rows decides.

Null text counts as empty. A text without words has the score of all answers zero.
Repeated rows get equal scores; rows with null or clashing columns need none of them.
Without labelled rows of both classes every score is the share of label 1, else 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routescope.llm.labelled import BUCKETS, buckets, every_labelled, scored, sigmoid
from routescope.llm.words import ALNUM, Words, arrow_rows, mix
from routescope.session import ship_package
from routescope.sources.landing import fresh_folder, removed

WIDTHS = (1, 2, 3)
FILTERS = 8
DEPTH = 8
PER_CLASS = 4096
ROUNDS = 3
STEP = 8  # rows whose gradients are added before the weights move
SCALE = 1 << 20  # changes are summed as multiples of its inverse
GRID = 1024
STEMS = ((4, 1 << 16), (6, 1 << 18))  # bytes at the start of a word, buckets for them
ROWS = BUCKETS + sum(n for _, n in STEMS)


def word_and_stems(words: Words) -> np.ndarray:
    """Three embedding rows for each word."""
    out = [buckets(words)]
    low = BUCKETS
    size = words.end - words.begin
    for length, count in STEMS:
        h = np.zeros(len(size), np.uint64)
        for j in range(length):
            inside = size > j
            letter = words.kept[np.minimum(words.begin + j, len(words.kept) - 1)] * inside if len(size) else h
            h = h * np.uint64(257) + letter.astype(np.uint64)
        out.append((mix(h + np.uint64(length)) & np.uint64(count - 1)).astype(np.int32) + low)
        low += count
    return np.column_stack(out).astype(np.int32)


@dataclass
class Model:
    base: float
    embedding: np.ndarray | None = None
    filters: list[np.ndarray] = field(default_factory=list)  # by width: (width, DEPTH, FILTERS)
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray | None = None
    offset: float = 0.0
    by_language: np.ndarray | None = None  # (BUCKETS, languages)
    thresholds: np.ndarray | None = None

    def pooled(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Largest answer of each filter in each row; zero for a row without words."""
        counts = np.diff(first)
        e = self.embedding[ids].sum(axis=1)
        parts = []
        for width, w, b in zip(WIDTHS, self.filters, self.bias):
            n = len(ids)
            answer = np.zeros((n, FILTERS), np.float32)
            for j in range(min(width, n)):
                part = e[j:] @ w[j]
                if j:  # a window that leaves its row sees nothing there
                    owner = np.repeat(np.arange(len(counts)), counts)
                    part[owner[j:] != owner[: n - j]] = 0
                answer[: n - j] += part
            best = np.zeros((len(counts), FILTERS), np.float32)
            full = counts > 0
            if full.any():
                best[full] = np.maximum.reduceat(answer, first[:-1][full], axis=0) + b
            parts.append(np.maximum(best, 0))
        return np.concatenate(parts, axis=1)

    def languages(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.zeros((len(first) - 1, self.by_language.shape[1]), np.float64)
        full = np.diff(first) > 0
        if full.any():
            total[full] = np.add.reduceat(self.by_language[ids[:, 0]], first[:-1][full], axis=0)
        return total.argmax(axis=1)

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(ids, first) @ self.out + self.offset

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.embedding is None:
            return np.full(len(first) - 1, self.base)
        return np.round(sigmoid(self.logits(ids, first) - self.thresholds[self.languages(ids, first)]), 6)


class Walk:
    """Weights moved by stochastic gradients with per-weight rates, some rows at a time."""

    def __init__(self, start: Model, rate: float, weigh: np.ndarray):
        self.start, self.rate, self.weigh = start, rate, weigh
        self.embedding = start.embedding.copy()
        self.small = [x.copy() for x in _small(start)]  # filters and biases by width, answers, offset
        self.g_e = np.full_like(self.embedding, 1e-2)
        self.g_small = [np.full_like(x, 1e-2) for x in self.small]
        self.touched = np.zeros(ROWS, bool)

    def step(self, ids: np.ndarray, first: np.ndarray, y: np.ndarray) -> None:
        full = np.diff(first) > 0
        if not full.any():
            return
        starts, ends, y = first[:-1][full], first[1:][full], y[full]
        n, k = len(ids), len(WIDTHS)
        owner = np.repeat(np.arange(len(y)), ends - starts)
        e = self.embedding[ids].sum(axis=1)
        filters, bias, (out, offset) = self.small[:k], self.small[k : 2 * k], self.small[2 * k :]
        best, where = [], []
        for width, f, b in zip(WIDTHS, filters, bias):
            answer = e @ f[0]
            for j in range(1, min(width, n)):
                part = e[j:] @ f[j]
                part[owner[j:] != owner[: n - j]] = 0
                answer[: n - j] += part
            top = np.maximum.reduceat(answer, starts, axis=0)
            where.append(np.minimum.reduceat(np.where(answer == top[owner], np.arange(n)[:, None], n), starts, axis=0))
            best.append(top + b)
        raw = np.concatenate(best, axis=1)
        pool = np.maximum(raw, 0)
        slope = (self.weigh[y] * (sigmoid(pool @ out + offset[0]) - y)).astype(np.float32)
        back = slope[:, None] * out * (raw > 0)
        change = [np.zeros_like(x) for x in self.small]
        change[-2], change[-1] = slope @ pool, slope.sum(keepdims=True)
        at, to = [], []
        for i, width in enumerate(WIDTHS):
            d = back[:, i * FILTERS : (i + 1) * FILTERS]
            change[k + i] = d.sum(axis=0)
            for j in range(width):
                inside = where[i] + j < ends[:, None]
                spot, own = np.where(inside, where[i] + j, 0), d * inside
                change[i][j] = np.einsum("rfd,rf->df", e[spot], own)
                moved = own != 0
                at.append(ids[spot[moved]])
                to.append((own[:, :, None] * filters[i][j].T)[moved])
        at, to = np.concatenate(at).ravel(), np.repeat(np.concatenate(to), 1 + len(STEMS), axis=0)
        if len(at):
            order = np.argsort(at, kind="stable")
            row, begin = np.unique(at[order], return_index=True)
            total = np.add.reduceat(to[order], begin, axis=0)
            self.g_e[row] += total**2
            self.embedding[row] -= self.rate * total / np.sqrt(self.g_e[row])
            self.touched[row] = True
        for x, g, by in zip(self.small, self.g_small, change):
            g += by**2
            x -= self.rate * by / np.sqrt(g)

    def changes(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the embedding that moved, and by how much; the small weights follow as rows from ``ROWS`` on."""
        row = np.flatnonzero(self.touched)
        flat = _flat(self.small) - _flat(_small(self.start))
        delta = np.concatenate([self.embedding[row] - self.start.embedding[row], flat])
        return np.concatenate([row, ROWS + np.arange(len(flat))]).astype(np.int32), np.rint(np.clip(delta, -1000, 1000) * SCALE).astype(np.int32)


def _small(m: Model) -> list[np.ndarray]:
    return [*m.filters, *m.bias, m.out, np.array([m.offset], np.float32)]


def _flat(parts: list[np.ndarray]) -> np.ndarray:
    flat = np.concatenate([x.ravel() for x in parts])
    return np.concatenate([flat, np.zeros(-len(flat) % DEPTH, np.float32)]).reshape(-1, DEPTH)


def _moved(m: Model, row: np.ndarray, delta: np.ndarray) -> Model:
    """The model after mean changes of its rows."""
    inside = row < ROWS
    embedding = m.embedding.copy()
    embedding[row[inside]] += delta[inside]
    small = _small(m)
    flat = _flat(small)
    flat[row[~inside] - ROWS] += delta[~inside]
    flat, parts = flat.ravel(), []
    for x in small:
        parts.append(flat[: x.size].reshape(x.shape))
        flat = flat[x.size :]
    k = len(WIDTHS)
    return Model(m.base, embedding, parts[:k], parts[k : 2 * k], parts[-2], float(parts[-1][0]))


def _words(batch: pa.RecordBatch):
    """Embedding rows, first words and the place in the batch of its rows, some at a time."""
    for lo, hi, w in arrow_rows(batch.column("text"), ALNUM, 1 << 20):
        yield lo, hi, word_and_stems(w), w.first


def _counted(rows: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each label that hold a bucket, and words of each language in it, over all of ``rows``."""
    place = {name: i for i, name in enumerate(names)}

    def run(batches):
        seen = np.zeros((2, ROWS), np.int64)
        spoken = np.zeros((max(1, len(names)), BUCKETS), np.int64)
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            lang = [place.get(x, -1) for x in batch.column("lang").to_pylist()]
            for lo, hi, ids, first in _words(batch):
                for i in range(lo, hi):
                    own = ids[first[i - lo] : first[i - lo + 1]]
                    seen[y[i], np.unique(own)] += 1
                    if lang[i] >= 0:
                        np.add.at(spoken[lang[i]], own[:, 0], 1)
        for kind, table in enumerate((seen, spoken)):
            of, row = np.nonzero(table)
            for a in range(0, len(of), 1 << 16):
                b = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(of[b]), kind, np.int32)), pa.array(of[b].astype(np.int32)), pa.array(row[b].astype(np.int32)), pa.array(table[of[b], row[b]])],
                    ["kind", "of", "row", "n"])

    got = rows.select("y", "lang", "text").mapInArrow(run, "kind int, of int, row int, n bigint").groupBy("kind", "of", "row").agg(F.sum("n").alias("n"))
    got = {k: v.to_numpy() for k, v in zip(("kind", "of", "row", "n"), got.toArrow().columns)}
    seen, spoken = np.zeros((2, ROWS), np.int64), np.zeros((max(1, len(names)), BUCKETS), np.int64)
    for kind, table in enumerate((seen, spoken)):
        own = got["kind"] == kind
        table[got["of"][own], got["row"][own]] = got["n"][own]
    return seen, spoken


def _begun(base: float, seen: np.ndarray, size: np.ndarray) -> Model:
    rng = np.random.default_rng(7)
    embedding = rng.normal(0, 0.02, (ROWS, DEPTH)).astype(np.float32)
    embedding[:, 0] = np.log((seen[1] + 2) / (size[1] + 4)) - np.log((seen[0] + 2) / (size[0] + 4))
    embedding[seen.sum(axis=0) == 0] = 0
    filters = [rng.normal(0, 0.3, (w, DEPTH, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] = np.abs(f[:, 0, :])
    out = rng.normal(0.3, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
    return Model(base, embedding, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], out)


def _round(rows: DataFrame, model: Model, rate: float, weigh: np.ndarray) -> Model:
    """The model after every group walked through its rows; a row of the embedding moves by the mean of the groups that moved it."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        walk, part = None, None
        for batch in batches:
            parts, y = batch.column("part").to_numpy(), batch.column("y").to_numpy()
            for lo, hi, ids, first in _words(batch):
                edges = [lo, *(lo + 1 + np.flatnonzero(np.diff(parts[lo:hi]))), hi]
                for a, b in zip(edges[:-1], edges[1:]):
                    if a < b and parts[a] != part:
                        if walk is not None:
                            yield from _change_rows(walk)
                            walk = None
                        walk, part = Walk(shared.value, rate, weigh), parts[a]
                    for at in range(a, b, STEP):
                        to = min(at + STEP, b)
                        begin, end = first[at - lo], first[to - lo]
                        walk.step(ids[begin:end], first[at - lo : to - lo + 1] - begin, y[at:to])
        if walk is not None:
            yield from _change_rows(walk)

    moved = rows.select("part", "y", "text").mapInArrow(run, "row int, " + ", ".join(f"d{i} int" for i in range(DEPTH)))
    mean = moved.groupBy("row").agg(*[(F.sum(f"d{i}") / F.count("*") / SCALE).alias(f"d{i}") for i in range(DEPTH)])
    got = mean.toArrow()
    shared.unpersist()
    return _moved(model, got.column("row").to_numpy(), np.column_stack([got.column(f"d{i}").to_numpy() for i in range(DEPTH)]).astype(np.float32))


def _change_rows(walk: Walk):
    row, delta = walk.changes()
    for a in range(0, len(row), 1 << 16):
        b = slice(a, a + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(row[b]), *[pa.array(np.ascontiguousarray(delta[b, i])) for i in range(DEPTH)]], ["row", *[f"d{i}" for i in range(DEPTH)]])


def _thresholds(rows: DataFrame, model: Model) -> np.ndarray:
    """Per guessed language the cut with fewest errors among all of ``rows``, by counts of answers on a grid."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo, hi, ids, first in _words(batch):
                value = np.rint(np.clip(shared.value.logits(ids, first), -100, 100) * GRID).astype(np.int32)
                guess = shared.value.languages(ids, first).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(lo, hi - lo), pa.array(guess), pa.array(value)], ["y", "guess", "value"])

    got = rows.select("y", "text").mapInArrow(run, "y int, guess int, value int").groupBy("y", "guess", "value").count()
    got = got.orderBy("guess", "value", "y").toArrow()
    shared.unpersist()
    y, guess, value, n = (got.column(k).to_numpy() for k in ("y", "guess", "value", "count"))
    value = value / GRID
    everywhere = _threshold(value, y, counts=n)
    out = np.zeros(model.by_language.shape[1])
    for k in range(len(out)):
        own = guess == k
        out[k] = _threshold(value[own], y[own], everywhere, counts=n[own])
    return out


def _threshold(
    values: np.ndarray, labels: np.ndarray, otherwise: float = 0.0, least: int = 20, weigh: np.ndarray | tuple[float, float] = (1.0, 1.0),
    counts: np.ndarray | None = None,
) -> float:
    """Middle of the widest cut with fewest errors, a row of each class counting as ``weigh`` says and
    standing for ``counts`` like it; ``otherwise`` with few rows of a class."""
    counts = np.ones(len(labels), np.int64) if counts is None else counts
    if min((labels * counts).sum(), ((1 - labels) * counts).sum()) < least:
        return otherwise
    order = np.argsort(values, kind="stable")
    v, y, n = values[order], labels[order], counts[order]
    missed = np.concatenate([[0], np.cumsum(y * n)])
    false = np.concatenate([np.cumsum(((1 - y) * n)[::-1])[::-1], [0]])
    errors = weigh[1] * missed + weigh[0] * false
    cuts = np.flatnonzero(errors[1:-1] <= errors[1:-1].min() + 1e-9 * max(1.0, errors.max())) + 1  # sums of weights may differ by rounding
    best = max(cuts, key=lambda c: v[c] - v[c - 1])
    return float((v[best] + v[best - 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, per_class: int = PER_CLASS, rate: float = 0.1) -> Model:
    """A model from all rows of ``docs`` whose label in ``labels`` (doc_id, toxic) is known and ``usable``.

    ``per_class`` is half the number of rows a group walks through from one start; it bounds no more than that. The rows
    are stored once, by group, while the model is made."""
    spark = docs.sparkSession
    folder = fresh_folder(spark, "labelled")
    ship_package(spark)
    groups = int(max(1, -(-labels.count() // (2 * per_class)), docs.count() >> 16))
    rows = every_labelled(docs, labels, "toxic", usable, groups)
    part = F.pmod(F.hash("doc_id"), F.lit(groups))  # as rows lie already
    mixed = lambda seed: F.xxhash64("doc_id", "text", F.lit(seed))
    placed = rows.select("y", "lang", "text", "doc_id", (F.pmod(mixed(1), F.lit(5)) == 4).alias("held"), part.alias("part"), mixed(2).alias("mix"))
    placed = placed.sortWithinPartitions("part", "mix", "doc_id", "text", "lang").drop("mix", "doc_id")
    placed.write.option("compression", "zstd").parquet(folder)
    rows = spark.read.schema(placed.schema).parquet(folder)
    size = np.zeros((2, 2), np.int64)  # by held and label
    for r in rows.groupBy("held", "y").count().collect():
        size[int(r["held"]), r["y"]] = r["count"]
    total = size.sum(axis=0)
    base = float(total[1] / max(1, total.sum()))
    if not total.all():
        removed(spark, folder)
        return Model(base)
    trained = rows.where("not held") if size[0].all() else rows
    counts = size[0] if size[0].all() else total
    names = sorted(r["lang"] for r in rows.where("lang <> ''").select("lang").distinct().collect())
    seen, spoken = _counted(trained, names)
    model = _begun(base, seen, counts)
    weigh = 0.5 * counts.sum() / counts
    for turn in range(ROUNDS):
        model = _round(trained, model, rate / (1 + turn), weigh)
    model.embedding[seen.sum(axis=0) == 0] = 0
    frequency = spoken.T + 0.1
    model.by_language = np.log(frequency / frequency.sum(axis=0)).astype(np.float32)
    model.thresholds = _thresholds(rows.where("held"), model)
    removed(spark, folder)
    return model


def score(docs: DataFrame, model: Model, keep: list[str], column: str = "score") -> DataFrame:
    """The columns ``keep`` of every row and its score, by the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by ROWS

    def run(texts: pa.Array, _) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, hi, w in arrow_rows(texts, ALNUM, 1 << 20):
            out[lo:hi] = shared.value.score(word_and_stems(w), w.first)
        return out

    return scored(docs, keep, run, column)

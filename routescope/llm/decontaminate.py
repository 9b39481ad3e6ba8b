"""Benchmark decontamination by SimHash windows, checked by weighted shingles.

For every item size, windows of that many words slide over each text word by word. A
window's weighted shingles (five words, as heavy as they occur often) are summed into a
64-bit SimHash. The item fingerprints are indexed in ``BLOCKS`` blocks of bits; each block
lists the items at every value within ``RADIUS // BLOCKS`` bits of theirs, so by the
pigeonhole principle each item within ``RADIUS`` bits of a window is found. Found
pairs are verified by the exact weighted Jaccard similarity, which must reach ``least``.

Before windows are hashed, those that cannot reach ``least`` against any item are passed
over: a window of n shingles of which fewer than 2 * least / (1 + least) * n occur anywhere in
the benchmark is too far from each item of its size, so none is lost by this. A text
shorter than an item is one window, held to the exact bound for its own size.

The benchmark goes to the tasks in blocks of at most ``BLOCK_ITEMS`` items, each a pass over
the documents, so what is broadcast has a bound. Items or texts without words or null match
nothing. Items of one to four words match as a single shingle of all their words. Repeated
items count on their own; repeated rows of a document give one row for each item.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routescope.llm.tables import saved
from routescope.llm.words import SHINGLE, SPACED, Words, arrow_rows, bytes_of, normal_words, shingles
from routescope.session import ship_package

BITS, BLOCKS, RADIUS = 64, 8, 23
LEAST = 0.8
BLOCK_ITEMS = 20_000
_WIDTH = BITS // BLOCKS
_WINDOWS = 1 << 12  # windows hashed at once


def planes(hashes: np.ndarray) -> np.ndarray:
    """(shingles, BITS) of +1 and -1."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64).ravel()


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    values, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    left = np.bincount(back[: len(a)], minlength=len(values))
    right = np.bincount(back[len(a) :], minlength=len(values))
    return float(np.minimum(left, right).sum() / np.maximum(left, right).sum())


class Index:
    """The items of one block of the benchmark that have the same number of words."""

    def __init__(self, ids: list[int], hashes: list[np.ndarray], words: int, radius: int):
        self.ids, self.hashes, self.words, self.radius = np.array(ids), hashes, words, radius
        self.width = min(SHINGLE, words)
        self.size = len(hashes[0])
        self.prints = np.array([packed(planes(h).sum(axis=0, keepdims=True))[0] for h in hashes], np.uint64)
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)) <= radius // BLOCKS
        own = self.prints.view(np.uint8).reshape(-1, BLOCKS)
        self.lists = [near[:, own[:, b]] for b in range(BLOCKS)]  # value of the block -> its items

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items within the radius."""
        blocks = prints.view(np.uint8).reshape(-1, BLOCKS)
        found = self.lists[0][blocks[:, 0]]
        for b in range(1, BLOCKS):
            found = found | self.lists[b][blocks[:, b]]
        window, item = np.nonzero(found)
        close = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
        return window[close], item[close]


class Benchmark:
    """Items by size, and all their shingles by width."""

    def __init__(self, items: list[tuple[int, str]], least: float, radius: int):
        self.least = least
        texts = pa.array([t for _, t in items], pa.large_string())
        w = Words(*bytes_of(texts, 0, len(items)), SPACED)
        by_size: dict[int, tuple[list, list]] = {}
        for k, (item, _) in enumerate(items):
            own = w.hashes[w.first[k] : w.first[k + 1]]
            if len(own):
                ids, lists = by_size.setdefault(len(own), ([], []))
                ids.append(item)
                lists.append(shingles(own, np.array([0, len(own)]), min(SHINGLE, len(own)))[0])
        self.indexes = [Index(ids, lists, size, radius) for size, (ids, lists) in sorted(by_size.items())]
        self.known: dict[int, np.ndarray] = {}
        for width in {i.width for i in self.indexes}:
            self.known[width] = np.unique(np.concatenate([h for i in self.indexes if i.width == width for h in i.hashes]))
        self.marks = {width: _marks(keys) for width, keys in self.known.items()}

    def member(self, width: int, hashes: np.ndarray) -> np.ndarray:
        out = self.marks[width][hashes >> np.uint64(44)]
        maybe = np.flatnonzero(out)
        keys = self.known[width]
        at = np.minimum(np.searchsorted(keys, hashes[maybe]), len(keys) - 1)
        out[maybe] = keys[at] == hashes[maybe]
        return out

    def leaks(self, w: Words) -> list[tuple[int, int, float, int]]:
        """(row, item, similarity, first word) of each row's best window for each item found in it."""
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for width, keys in self.known.items():
            h, first = shingles(w.hashes, w.first, width)
            # a text of fewer words than the width has a shingle of its own width: no item's
            counts, words = np.diff(first), np.diff(w.first)
            hit = np.concatenate([[0], np.cumsum(self.member(width, h))])
            per_row = hit[first[1:]] - hit[first[:-1]]
            for row in np.flatnonzero((per_row > 0) & (words >= width)):
                own = h[first[row] : first[row + 1]]
                total = hit[first[row] : first[row + 1] + 1]
                sums = None
                for index in self.indexes:
                    if index.width != width:
                        continue
                    size = min(index.size, int(counts[row]))
                    both = self.least / (1 + self.least) * (index.size + size)
                    if both > size + 1e-9:
                        continue
                    starts = np.flatnonzero(total[size:] - total[:-size] >= math.ceil(both - 1e-9))
                    if not len(starts):
                        continue
                    if sums is None:
                        sums = _sums(own)
                    for a in range(0, len(starts), _WINDOWS):
                        some = starts[a : a + _WINDOWS]
                        window, item = index.near(packed(sums.between(some, some + size)))
                        for s, i in zip(some[window], item):
                            j = weighted_jaccard(own[s : s + size], index.hashes[i])
                            key = (int(row), int(index.ids[i]))
                            if j >= self.least - 1e-9 and (key not in best or (-j, s) < (-best[key][0], best[key][1])):
                                best[key] = (j, int(s))
        return [(row, item, j, s) for (row, item), (j, s) in sorted(best.items())]


class _sums:
    """Bit sums between positions, from running sums at every position of a stretch of shingles."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes

    def between(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty((len(begin), BITS), np.int32)
        lo = 0
        while lo < len(begin):  # stretches, so that a long text isn't unpacked whole
            hi = int(np.searchsorted(begin, begin[lo] + _WINDOWS))
            a, b = begin[lo], end[hi - 1]
            total = np.zeros((b - a + 1, BITS), np.int32)
            np.cumsum(planes(self.hashes[a:b]), axis=0, out=total[1:])
            out[lo:hi] = total[end[lo:hi] - a] - total[begin[lo:hi] - a]
            lo = hi
        return out


def _marks(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[keys >> np.uint64(44)] = True
    return out


def _blocks(benchmark: DataFrame, size: int) -> list[DataFrame]:
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), normal_words(F.col("text")).alias("text")).where("text <> ''")
    n = max(1, math.ceil(items.count() / size * 1.2))
    if n == 1:
        return [items]
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [items.where(part == i) for i in range(n)]


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, radius: int = RADIUS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, similarity, first_word): each document's best window for each item found in it."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normal_words(F.col("text")).alias("text"))

    def found(block: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in block.collect()])

        def run(batches):
            bench = Benchmark(shared.value, least, radius)
            for batch in batches:
                ids = batch.column("doc_id")
                for lo, _, w in arrow_rows(batch.column("text"), SPACED):
                    out = bench.leaks(w)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([lo + r for r, _, _, _ in out], pa.int64())), pa.array([i for _, i, _, _ in out], pa.int64()),
                         pa.array([j for _, _, j, _ in out], pa.float64()), pa.array([s for _, _, _, s in out], pa.int64())],
                        ["doc_id", "item_id", "similarity", "first_word"])

        return rows.mapInArrow(run, "doc_id bigint, item_id bigint, similarity double, first_word bigint")

    every = reduce(DataFrame.unionAll, [found(b) for b in _blocks(benchmark, block_items)])
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "first_word")).alias("best")
    return every.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("best.s")).alias("similarity"), "best.first_word")


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` in which no item is found; those without an id are kept."""
    found = saved(leaks(docs.where("doc_id IS NOT NULL"), benchmark, least).select("doc_id").distinct(), "leaks")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)

"""Word and shingle hashes of whole texts, a column batch at a time.

A batch of strings is looked at as one array of bytes. A word is a run of bytes that a
256-entry table maps to something other than zero, and its hash is a polynomial in
those mapped bytes, taken from running sums; so no Python object is made per word. All
work goes through windows of a fixed number of bytes, whatever the length of a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SHINGLE = 5
_WINDOW = 1 << 16
_LONGEST = 4096  # bytes; longer words are hashed one by one
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.cumprod(out, dtype=np.uint64)


_POW = _powers(_BASE, _WINDOW + _LONGEST + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), _WINDOW + _LONGEST + 1)


def _table(keep: str) -> np.ndarray:
    """Lower-cases ASCII letters; bytes of other alphabets stay, all else separates."""
    t = np.zeros(256, np.uint8)
    t[128:] = np.arange(128, 256)
    for c in keep:
        t[ord(c)] = ord(c.lower())
    return t


_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALNUM = _table(_LETTERS + "0123456789")
ALPHA = _table(_LETTERS)
SPACED = np.arange(256, dtype=np.uint8)  # for text already normalised to single spaces
SPACED[32] = 0


def normal_words(text: Column) -> Column:
    """Lower case, runs of anything but letters, marks and digits to one space; null to empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def slices(texts: pa.Array, limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text comes alone."""
    at = offsets_of(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


def offsets_of(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def bytes_of(texts: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of rows ``lo`` to ``hi`` (no nulls) and the hi - lo + 1 offsets into them."""
    at = offsets_of(texts)[lo : hi + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


class Words:
    """The words of some rows: ``hashes``, byte ``begin`` and ``end``, and ``first`` (of each row, and a last)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.kept = table[data]
        inside = self.kept != 0
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        starts = offsets[:-1][offsets[:-1] < len(data)]
        ends = offsets[1:][offsets[1:] > 0] - 1
        opens[starts] = inside[starts]
        closes[ends] = inside[ends]
        self.begin = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.begin, offsets)
        self.hashes = mix(span_hashes(self.kept, self.begin, self.end))


def span_hashes(kept: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of each span of bytes; spans come in ascending order of ``begin``."""
    out = np.zeros(len(begin), np.uint64)
    long = np.flatnonzero(end - begin > _LONGEST)
    cuts = np.searchsorted(begin, np.arange(0, len(kept) + _WINDOW, _WINDOW))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if lo == hi:
            continue
        a = int(begin[lo])
        b, e = begin[lo:hi] - a, np.minimum(end[lo:hi] - a, _WINDOW + _LONGEST)
        size = int(e.max())
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(kept[a : a + size] * _POW[:size], out=total[1:])
        out[lo:hi] = (total[e] - total[b]) * _INV[b]
    for i in long:
        digest = hashlib.blake2b(kept[begin[i] : end[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, np.uint64)[0]
    return out


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words within each row, in order, and where each row's begin.

    A row of fewer words, but at least one, has a single shingle of all its words."""
    counts = np.diff(first)
    out_counts = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_first = np.concatenate([[0], np.cumsum(out_counts)])
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    for j in range(min(width, n)):
        rolled[: n - j] += hashes[j:] * _POW[j + 1]
    keep = np.zeros(n + 1, np.int64)
    full = counts >= width
    np.add.at(keep, first[:-1][full], 1)
    np.add.at(keep, first[1:][full] - width + 1, -1)
    rows_short = np.flatnonzero(~full & (counts > 0))
    chosen = np.cumsum(keep[:n]) > 0
    for r in rows_short:
        a, b = first[r], first[r + 1]
        rolled[a] = np.sum(hashes[a:b] * _POW[1 : b - a + 1], dtype=np.uint64)
        chosen[a] = True
    return mix(rolled[chosen] + np.uint64(width)), out_first


def arrow_rows(texts: pa.Array, table: np.ndarray, limit: int = 1 << 22) -> Iterator[tuple[int, int, Words]]:
    """Row ranges of a batch with their words."""
    for lo, hi in slices(texts, limit):
        yield lo, hi, Words(*bytes_of(texts, lo, hi), table)

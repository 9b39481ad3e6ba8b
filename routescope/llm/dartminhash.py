"""Near duplicates by DartMinHash: sparse weighted signatures, banded, then checked exactly.

A text is the weighted set of its five-word shingles, each as heavy as it occurs often.
The region of an element is its weight times the axis of ranks; hashed darts fall into it
as a Poisson process that depends on the element alone, so two texts share the darts of
their common region. Every dart has a coordinate; each of ``COORDS`` coordinates keeps
its earliest dart, and two texts keep the same one with the probability of their weighted
Jaccard similarity. A text throws only darts below a rank at which few coordinates stay
empty, and more, at twice the rank, while some are.

Bands of coordinates are joined on their hash. Texts that differ are represented by a
digest of their words from the start, so copies meet in an aggregation and never as pairs.
Within a bucket all are compared exactly with a few pivots, except those that links found so
far already connect. Pivots then leave the bucket, others take their place, members of the
smallest connected parts first, until what is left of every bucket is connected. So
every two texts that share a bucket are compared or connected, and a large group of
near copies costs as many comparisons as it has members, not pairs.

Links are pairs of similarity >= ``least``; a class is a connected part, named after its
smallest doc_id. Words are runs of letters, marks and digits in lower case. Texts of one
to four words are one shingle. Texts without words and null texts link to nothing: each
is a class of its own. Rows with a null doc_id take no part and have a null class.
Repeated rows with the same id and text give one row; an id with several texts is one
document in each of their classes, with a row for each class.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from routescope.llm.tables import components, saved
from routescope.llm.words import SPACED, Words, arrow_rows, bytes_of, mix, normal_words, offsets_of, shingles
from routescope.session import ship_package

BANDS, ROWS = 28, 5
COORDS = BANDS * ROWS
LEAST = 0.8
PIVOTS = (1, 64, 256)  # of each bucket, by round; the last holds for all later ones
PART = 1024  # members of a bucket, and of a task's group, compared at once
_STEP = np.uint64(0x9E3779B97F4A7C15)


def occurrences(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often each element has come before in its row."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    out = np.empty(len(h), np.int64)
    out[order] = np.arange(len(h)) - start
    return out


def unit(h: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(elements: np.ndarray, slab: np.ndarray, cover: np.ndarray, first: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """(rows, coords): the rank of the earliest dart of each coordinate; inf in a row without weight.

    The weight of an element is split in slabs of one: element i's slab number ``slab[i]``
    is covered up to ``cover[i]`` in (0, 1]. A dart counts if its height is covered."""
    rows = len(first) - 1
    out = np.full((rows, coords), np.inf)
    weight = np.zeros(rows)
    full = np.diff(first) > 0
    if full.any():
        weight[full] = np.add.reduceat(cover, first[:-1][full])
    owner = np.repeat(np.arange(rows), np.diff(first))
    seed = mix(elements + (slab.astype(np.uint64) + np.uint64(1)) * _STEP)
    reach = np.log(coords) + 4.0
    open_rows = full & (weight > 0)
    while open_rows.any():
        limit = np.where(open_rows, reach * coords / np.maximum(weight, 1e-300), 0.0)
        live = np.flatnonzero(open_rows[owner])
        rank = np.zeros(len(live))
        state, top = seed[live], limit[owner[live]]
        turn = 0
        while len(live):
            turn += 1
            h = mix(state + np.uint64(turn * int(_STEP) % (1 << 64)))
            rank = rank - np.log(unit(h))
            inside = rank <= top
            live, rank, state, top = live[inside], rank[inside], state[inside], top[inside]
            h = mix(h[inside] ^ np.uint64(0x5851F42D4C957F2D))
            hit = unit(mix(h + _STEP)) <= cover[live]
            np.minimum.at(out, (owner[live][hit], (h[hit] % np.uint64(coords)).astype(np.int64)), rank[hit])
        open_rows &= np.isinf(out).any(axis=1)
        reach *= 2
    return out


def text_signatures(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the texts' shingles, weighted by their counts; and which texts have any."""
    h, first = shingles(w.hashes, w.first)
    return signatures(h, occurrences(h, first), np.ones(len(h)), first), np.diff(first) > 0


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, -1)
    total = np.zeros(bits.shape[:2], np.uint64)
    for j in range(bits.shape[2]):
        total = mix(total * _STEP + bits[:, :, j])
    return total


def similarity(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Weighted Jaccard of the shingles of normalised texts, pair by pair; 0 for a text without words."""
    out = np.zeros(len(a))
    size = np.diff(offsets_of(a)) + np.diff(offsets_of(b))
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(size[lo:]), 1 << 22)) + lo)
        key, owner, side = [], [], []
        for k, texts in enumerate((a, b)):
            w = Words(*bytes_of(texts, lo, hi), SPACED)
            h, first = shingles(w.hashes, w.first)
            key.append(h)
            owner.append(np.repeat(np.arange(hi - lo), np.diff(first)))
            side.append(np.full(len(h), k))
        key, owner, side = map(np.concatenate, (key, owner, side))
        if len(key):
            order = np.lexsort((key, owner))
            key, owner, side = key[order], owner[order], side[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(new)
            right = np.add.reduceat(side, at)
            left = np.diff(np.append(at, len(key))) - right
            both = np.bincount(owner[at], np.minimum(left, right), hi - lo)
            either = np.bincount(owner[at], np.maximum(left, right), hi - lo)
            out[lo:hi] = both / np.maximum(either, 1)
        lo = hi
    return out


def banded(docs: DataFrame) -> DataFrame:
    """(doc_id, key, bands) of every row with an id: a digest of its words, and its band hashes (null without words)."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), normal_words(F.col("text")).alias("text"))
    rows = rows.select("doc_id", F.unhex(F.md5("text")).alias("key"), "text")

    def run(batches):
        for batch in batches:
            for lo, hi, w in arrow_rows(batch.column("text"), SPACED):
                signature, any_words = text_signatures(w)
                bands = band_hashes(signature).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("key").slice(lo, hi - lo),
                     pa.array([x if ok else None for x, ok in zip(lists, any_words)], lists.type) if not any_words.all() else lists],
                    ["doc_id", "key", "bands"])

    ship_package(docs.sparkSession)
    return rows.mapInArrow(run, "doc_id bigint, key binary, bands array<bigint>")


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, d): the exact distance of each pair of digests."""
    left = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
    rows = left.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches):
        for batch in batches:
            d = 1.0 - similarity(batch.column("ta"), batch.column("tb"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(d)], ["a", "b", "d"])

    return rows.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary, d double")


def parts(docs: DataFrame, signed: DataFrame, least: float = LEAST) -> DataFrame:
    """(node, root): the connected parts of different texts, as digests, under links of at least ``least``."""
    apart = 1.0 - least + 1e-9
    spread = signed.where("bands IS NOT NULL").select("key", F.posexplode("bands").alias("band", "h"))
    members = spread.groupBy("band", "h", "key").agg(F.lit(1).alias("one")).drop("one")
    shared = members.groupBy("band", "h").agg(F.count("*").alias("n")).where("n > 1").select("band", "h")
    open_buckets = saved(members.join(shared, ["band", "h"]), "buckets")
    wanted = open_buckets.select("key").distinct()
    words = normal_words(F.col("text"))
    one_each = docs.where("doc_id IS NOT NULL").select(words.alias("text")).select(F.unhex(F.md5("text")).alias("key"), "text").groupBy("key").agg(F.any_value("text").alias("text"))
    texts = saved(one_each.join(wanted, "key", "left_semi"), "texts")
    # first round: one pivot a bucket, and each pair of texts once however many buckets it shares
    pivots = open_buckets.groupBy("band", "h").agg(F.min("key").alias("a"))
    pairs = open_buckets.withColumnRenamed("key", "b").join(pivots, ["band", "h"]).where("a <> b")
    near = saved(_compared(pairs.select("a", "b").distinct(), texts).where(F.col("d") <= apart).select("a", "b"), "links")
    known, members, turn = None, open_buckets, 0
    while True:
        stars = near if known is None else near.unionAll(known.select(F.col("node").alias("a"), F.col("root").alias("b")))
        known = saved(components(stars), "parts")
        rest = members.join(pivots.select("band", "h", F.col("a").alias("key")), ["band", "h", "key"], "left_anti").select("band", "h", "key")
        rest = rest.join(known.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        several = rest.groupBy("band", "h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band", "h")
        members = saved(rest.join(several, ["band", "h"]).select("band", "h", "key", "root"), "buckets")
        if members.isEmpty():
            return known
        turn += 1
        most = PIVOTS[min(turn, len(PIVOTS) - 1)]
        # members of the smallest parts first: what is left in the end is one part
        sizes = members.groupBy("band", "h", "root").agg(F.count("*").alias("n"))
        order = W.partitionBy("band", "h").orderBy("n", "key")
        ranked = members.join(sizes, ["band", "h", "root"]).withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
        pivots = saved(ranked.select("band", "h", F.col("key").alias("a"), F.col("root").alias("own")), "pivots")
        near = saved(_blocks(members, pivots, texts, apart).distinct(), "links")


def _blocks(members: DataFrame, pivots: DataFrame, texts: DataFrame, apart: float) -> DataFrame:
    """(a, b): links between the pivots and the members of each bucket that no link connects yet.

    A bucket's members go in parts of about ``PART``, each with all the pivots."""
    counts = members.groupBy("band", "h").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    cells = max(1, math.ceil(members.count() / PART))
    meeting = F.xxhash64("band", "h", "part")
    cell = F.pmod(F.xxhash64(F.lit(1), "meeting"), F.lit(cells)).alias("cell")
    left = members.join(counts, ["band", "h"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    left = left.withColumn("meeting", meeting).join(texts, "key").select(cell, "meeting", "key", "root", "text")
    right = pivots.join(counts, ["band", "h"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = right.withColumn("meeting", meeting).withColumnRenamed("a", "key").join(texts, "key").select(cell, "meeting", "key", F.col("own").alias("root"), "text")

    def meet(x: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = [near_pairs(x[x["meeting"] == m], q, apart) for m, q in p.groupby("meeting")]
        return pd.DataFrame([pair for pairs in out for pair in pairs], columns=["a", "b"])

    ship_package(members.sparkSession)
    names = ["cell", "meeting", "key", "root", "text"]
    left, right = left.toDF(*names), right.toDF(*names)  # both hold columns of ``texts``
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInPandas(meet, "a binary, b binary")


def elements(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of normalised texts, the repeats of one told apart, so that sets stand for multisets."""
    column = pa.array(texts, pa.large_string())
    w = Words(*bytes_of(column, 0, len(column)), SPACED)
    h, first = shingles(w.hashes, w.first)
    return mix(h + occurrences(h, first).astype(np.uint64) * _STEP), first


def near_pairs(x: pd.DataFrame, p: pd.DataFrame, apart: float, most: int = 1 << 20) -> list[tuple[bytes, bytes]]:
    """Pairs of a member of ``x`` and a pivot of ``p`` (key, root, text), of different roots, at most ``apart``."""
    own, own_first = elements(p["text"].tolist())
    owner = np.repeat(np.arange(len(p)), np.diff(own_first))
    order = np.argsort(own)
    own, owner = own[order], owner[order]
    p_key, p_root, x_key, x_root = p["key"].tolist(), p["root"].tolist(), x["key"].tolist(), x["root"].tolist()
    out = []
    step = max(1, most // max(1, len(own)))
    for lo in range(0, len(x), step):
        h, first = elements(x["text"].iloc[lo : lo + step].tolist())
        a, b = np.searchsorted(own, h, "left"), np.searchsorted(own, h, "right")
        times = b - a
        rows = len(first) - 1
        who = np.repeat(np.repeat(np.arange(rows), np.diff(first)), times)
        at = np.repeat(a - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum()) if len(times) else np.zeros(0, int)
        both = np.bincount(who * len(p) + owner[at], minlength=rows * len(p)).reshape(rows, len(p))
        either = np.diff(first)[:, None] + np.diff(own_first)[None, :] - both
        for i, j in zip(*np.nonzero(1.0 - both / np.maximum(either, 1) <= apart)):
            if x_root[lo + i] != p_root[j]:
                pair = sorted((bytes(x_key[lo + i]), bytes(p_key[j])))
                out.append((pair[0], pair[1]))
    return out


def classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, key, class_id, class_key): each document's class, named after its smallest id.

    ``class_key`` is the digest of the words of the document that names the class, the
    smallest such digest if its id has several texts in the class."""
    signed = saved(banded(docs), "signatures")
    ids = signed.groupBy("key", "doc_id").agg(F.max(F.col("bands").isNull()).alias("blank"))
    linked = ids.where("NOT blank").join(parts(docs, signed, least).select(F.col("node").alias("key"), "root"), "key", "left")
    linked = linked.select("doc_id", "key", F.coalesce("root", "key").alias("root"))
    named = linked.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("least"))
    rows = linked.join(named, "root").select("doc_id", "key", F.col("least.doc_id").alias("class_id"), F.col("least.key").alias("class_key"))
    blank = ids.where("blank").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.col("key").alias("class_key"))
    return rows.unionAll(blank)


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, class_id) of every document."""
    nameless = docs.where("doc_id IS NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("class_id"))
    return classes(docs, least).select("doc_id", "class_id").unionAll(nameless)


def one_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` of which the class is named, one for each class, and those without an id."""
    chosen = classes(docs, least).where("doc_id = class_id AND key = class_key").select("doc_id", F.col("key").alias("__key")).distinct()
    keyed = docs.withColumn("__key", F.unhex(F.md5(normal_words(F.col("text")))))
    kept = keyed.where("doc_id IS NOT NULL").join(chosen, ["doc_id", "__key"], "left_semi").dropDuplicates(["doc_id", "__key"])
    return kept.unionByName(keyed.where("doc_id IS NULL")).select(*docs.columns)

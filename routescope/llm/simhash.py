"""Near duplicates by SimHash: 64-bit fingerprints, joined on the pieces that close pairs must share.

Words are runs of anything but the six ASCII spaces, A-Z in lower case. The features of a
text are its shingles of four words joined by single spaces, repeats included (a shorter text
is one shingle, a text without words has none), and each counts by its XXH64. A bit of the
fingerprint is set if more than half of the features set it; without features it is zero.

Fingerprints that differ in at most ``RADIUS`` bits are linked. Of ``PIECES`` pieces at most
``RADIUS`` can differ, so close pairs agree in two of six whole pieces, whichever they are: each
fingerprint is listed under every pair of pieces (a block of 20 to 22 bits), and only
fingerprints of one block are compared. Copies meet in an aggregation before, so a block holds
different fingerprints. A block of more than ``CELL`` is cut into chunks: first each chunk is
compared in itself; then, if what was linked so far leaves the block in several parts, the
members outside its largest part meet every chunk. No pair is skipped except within one part,
so parts are those of all links, while a task holds two chunks and emits no more rows than
fingerprints, whatever the size of a group of near copies.

Null text counts as empty. Every row is kept, repeated ids too. Rows with a null doc_id link as
others do, but name no component unless it has no other (then it is null).
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routescope.llm.tables import components, saved
from routescope.llm.words import bytes_of
from routescope.session import ship_package

WIDTH, SEED = 4, 42
RADIUS, PIECES = 4, 6
CELL = 2048
BUSY = 4096  # a key with more than one row in so many is busy; so many keys at most are

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def feature_hashes(text: np.ndarray, most: int = 1 << 16):
    """XXH64 of every shingle of a text given as bytes, in runs of at most ``most``."""
    space = _SPACE[text]
    keep = ~space
    keep[:-1] |= space[:-1] & ~space[1:]  # the last space before a word
    first = int(np.argmin(space)) if len(space) else 0
    keep[:first] = False
    line = _LOWER[text[keep]]
    gaps = np.flatnonzero(_SPACE[line])
    line[gaps] = 32
    if not len(line):
        return
    begin, end = np.concatenate([[0], gaps + 1]), np.append(gaps, len(line))
    width = min(WIDTH, len(begin))
    begin, end = begin[: len(begin) - width + 1], end[width - 1 :]
    data, digest = line.tobytes(), xxhash.xxh64_intdigest
    for lo in range(0, len(begin), most):
        spans = zip(begin[lo : lo + most].tolist(), end[lo : lo + most].tolist())
        yield np.fromiter((digest(data[a:b], SEED) for a, b in spans), np.uint64, min(most, len(begin) - lo))


def fingerprint(text: np.ndarray) -> int:
    """The fingerprint of a text given as bytes."""
    votes, n = np.zeros((8, 8), np.int64), 0
    for h in feature_hashes(text):
        n += len(h)
        for k, byte in enumerate(h.view(np.uint8).reshape(-1, 8).T):
            votes[k] += np.bincount(byte, minlength=256) @ _BITS
    return int(np.packbits((2 * votes > n).ravel(), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print) of every row; the 64 bits as a signed number."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            data, at = bytes_of(batch.column("text"), 0, len(batch))
            found = [fingerprint(data[lo:hi]) for lo, hi in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "print"])

    ship_package(docs.sparkSession)
    return rows.mapInArrow(run, "doc_id bigint, print bigint")


def blocks(radius: int = RADIUS, pieces: int = PIECES) -> list[int]:
    """Masks of the pieces that some close pair shares: every choice of ``pieces - radius`` of them."""
    bounds = [64 * i // pieces for i in range(pieces + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(bounds, bounds[1:])]
    return [sum(chosen) for chosen in itertools.combinations(masks, pieces - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def parts_of(group: np.ndarray, prints: np.ndarray, root: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each row the index of a row of its part: rows of one ``group`` (adjacent) and one
    ``root``, or within ``radius`` of each other, are in one part."""
    n = len(prints)
    order = np.lexsort((root, group))
    new = np.ones(n, bool)
    new[1:] = (group[order][1:] != group[order][:-1]) | (root[order][1:] != root[order][:-1])
    label = np.empty(n, np.int64)
    label[order] = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
    last = np.searchsorted(group, group, side="right")
    alive, step = np.arange(n), 0
    while True:
        step += 1
        alive = alive[alive + step < last[alive]]
        if not len(alive):
            return label
        apart = alive[label[alive] != label[alive + step]]
        near = apart[np.bitwise_count(prints[apart] ^ prints[apart + step]) <= radius]
        while len(near):
            a, b = label[near], label[near + step]
            parent = np.arange(n)
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (parent[parent] != parent).any():
                parent = parent[parent]
            label = parent[label]
            near = near[label[near] != label[near + step]]


def _compared(cells: DataFrame, by: list[str]) -> DataFrame:
    """(a, b): links that join the parts found in each cell of (print, root); a cell's rows stream by together."""

    def run(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                rows = [batch.column(i).to_numpy() for i in range(len(by) + 2)]
                rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
                if not len(rows[0]):
                    continue
            elif held is None:
                return
            else:
                rows = held
            new = np.zeros(len(rows[0]), bool)
            for column in rows[:-2]:
                new[1:] |= column[1:] != column[:-1]
            whole = len(new) if batch is None else int(np.flatnonzero(new)[-1]) if new.any() else 0
            group, prints, root = np.cumsum(new)[:whole], rows[-2][:whole], rows[-1][:whole]
            held = [x[whole:] for x in rows]
            label = parts_of(group, prints.view(np.uint64), root)
            joined = np.flatnonzero(root[label] != root)
            yield pa.RecordBatch.from_arrays([pa.array(root[joined]), pa.array(root[label[joined]])], ["a", "b"])

    ship_package(cells.sparkSession)
    laid = cells.select(*by, "print", "root").repartition(*by).sortWithinPartitions(*by)
    return laid.mapInArrow(run, "a bigint, b bigint").where("a <> b").distinct()


def _chunk(parts: str) -> Column:
    return F.pmod(F.xxhash64("print"), F.col(parts)).cast("int")


def parts(prints: DataFrame, cell: int = CELL) -> DataFrame:
    """(print, root): the part of every fingerprint that is linked to another one; ``prints`` are distinct."""
    lists = F.array(*[F.struct(F.lit(k).alias("block"), F.col("print").bitwiseAND(F.lit(_signed(m))).alias("piece")) for k, m in enumerate(blocks())])
    listed = prints.select("print", F.explode(lists).alias("l")).select("l.*", "print")
    large = saved(listed.groupBy("block", "piece").agg(F.count("*").alias("n")).where(F.col("n") > cell), "blocks")
    sized = listed.join(large, ["block", "piece"], "left").withColumn("chunks", F.coalesce(F.ceil(F.col("n") / cell), F.lit(1)))
    cells = sized.select("block", "piece", _chunk("chunks").alias("chunk"), "print", F.col("print").alias("root"))
    found = components(_compared(cells, ["block", "piece", "chunk"]), "simhash").toDF("print", "root")
    if large.isEmpty():
        return found
    # members of the large blocks, by the parts known now
    members = sized.where("n IS NOT NULL").select("block", "piece", "chunks", "print").join(found, "print", "left")
    members = saved(members.withColumn("root", F.coalesce("root", "print")), "members")
    of_part = members.groupBy("block", "piece", "root").agg(F.count("*").alias("m"))
    of_block = of_part.groupBy("block", "piece").agg(F.max(F.struct("m", "root")).alias("main"), F.sum("m").alias("n"))
    still = of_block.where("main.m < n").select(
        "block", "piece", F.col("main.root").alias("main"), F.ceil((F.col("n") - F.col("main.m")) / cell).alias("others"))
    placed = members.join(still, ["block", "piece"]).withColumn("outside", F.col("root") != F.col("main"))
    placed = placed.withColumns({"chunk": _chunk("chunks"), "other": _chunk("others")})
    every = lambda n: F.sequence(F.lit(0), F.col(n).cast("int") - 1)
    meet = placed.withColumn("other_at", F.explode(every("others"))).select("block", "piece", "chunk", F.col("other_at").alias("other"), "print", "root")
    bring = placed.where("outside").withColumn("chunk_at", F.explode(every("chunks"))).select("block", "piece", F.col("chunk_at").alias("chunk"), "other", "print", "root")
    more = _compared(meet.unionAll(bring).distinct(), ["block", "piece", "chunk", "other"])
    stars = found.select(F.col("print").alias("a"), F.col("root").alias("b"))
    return components(stars.unionAll(more), "simhash").toDF("print", "root")


def matched(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the one row of ``facts`` (key, n, ...) of their key. ``n`` counts the rows of a key;
    at most ``BUSY`` keys hold more than one in ``BUSY`` rows, and these facts are sent to the rows."""
    busy = F.broadcast(facts.where(F.col("n") * BUSY > total))
    quiet = rows.join(busy.select(key), key, "left_anti")
    return rows.join(busy, key).unionByName(quiet.join(facts, key))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``."""
    prints = saved(fingerprints(docs), "prints")
    kinds = saved(prints.groupBy("print").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "kinds")
    linked = kinds.join(parts(kinds.select("print")), "print", "left").withColumn("root", F.coalesce("root", "print"))
    linked = saved(linked, "linked")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    inside = matched(linked.select("print", F.col("n").alias("copies"), "root"), named, "root", kinds.count())
    names = saved(inside.select("print", F.col("copies").alias("n"), "component_id"), "names")
    rows = matched(prints, names, "print", prints.count())
    return rows.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")

"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, which makes the
largest inner product the nearest in angle; queries get a zero there. Each tree splits
a sample at the median of its projections on the line between two of its members,
until ``LEAF`` are left. A query walks all trees by one priority queue, the branch with
the best margin first, until the leaves taken promise ``share`` of all vectors, counted once a
tree; the members of these leaves are then ranked by the exact product in double precision.

The trees are fitted on the ``SAMPLE`` distinct vectors first by a hash of their id; every
vector is indexed. Leaves grow with the table; a leaf is met in chunks of at most ``CHUNK``
rows, so no task holds a whole one. Equal vectors are indexed once, with the
smallest k + 1 ids they stand for, which is all that a list of k can need.

Rows without an id, and vectors null, zero or with null or non-finite components, take no
part, nor do those not of the most common length (the shorter of equals). Ties go to the
smaller id. Repeated rows count once; an id with several vectors counts with the nearest.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from routescope.llm.tables import saved
from routescope.session import ship_package

TREES, LEAF, SAMPLE = 8, 256, 32_768
SHARE = 0.18  # of the rows, summed over the leaves taken in a tree
CHUNK = 4096


@dataclass
class Tree:
    """Inner nodes by number; a child below zero is a leaf: -1 - its number."""

    normal: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray  # of the sample, by leaf

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64) if len(self.cut) else np.full(len(x), -1)
        while (open_ := np.flatnonzero(at >= 0)).size:
            node = at[open_]
            side = np.einsum("ij,ij->i", x[open_], self.normal[node]) < self.cut[node]
            at[open_] = np.where(side, self.left[node], self.right[node])
        return -1 - at


def grown(x: np.ndarray, rng: np.random.Generator, leaf: int = LEAF) -> Tree:
    normal, cut, left, right, share = [], [], [], [], []

    def grow(rows: np.ndarray) -> int:
        if len(rows) > leaf:
            for _ in range(4):
                a, b = x[rng.choice(rows, 2, replace=False)]
                line = a - b
                size = np.linalg.norm(line)
                if size == 0:
                    continue
                line = line / size
                along = x[rows] @ line
                middle = float(np.median(along))
                low = along < middle
                if 0 < low.sum() < len(rows):
                    node = len(cut)
                    normal.append(line)
                    cut.append(middle)
                    left.append(0)
                    right.append(0)
                    left[node] = grow(rows[low])
                    right[node] = grow(rows[~low])
                    return node
        share.append(len(rows) / len(x))
        return -len(share)

    grow(np.arange(len(x)))
    return Tree(np.array(normal).reshape(-1, x.shape[1]), np.array(cut), np.array(left, int), np.array(right, int), np.array(share))


def visited(trees: list[Tree], q: np.ndarray, share: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of the shared queue, until they hold ``share`` of the rows a tree."""
    margins = [t.normal @ q - t.cut for t in trees]
    queue = [(-np.inf, k, 0 if len(t.cut) else -1) for k, t in enumerate(trees)]
    heapq.heapify(queue)
    out, held = [], 0.0
    while queue and held < share * len(trees):
        bound, k, node = heapq.heappop(queue)
        if node < 0:
            out.append((k, -1 - node))
            held += trees[k].share[-1 - node]
            continue
        m = margins[k][node]
        heapq.heappush(queue, (max(bound, -m), k, int(trees[k].right[node])))
        heapq.heappush(queue, (max(bound, m), k, int(trees[k].left[node])))
    return out


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v): the rows that take part, as doubles, negative zeros made positive, each once."""
    v = F.transform(F.col(vector_column), lambda x: x.cast("double") + F.lit(0.0))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return rows.where(F.size("v") == (lengths["n"] if lengths else 0)).distinct()


def _lists(column) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def search(vectors: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector_column: str = "embedding", share: float = SHARE, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row whose id (column ``id``) ``is_query``."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = saved(usable(vectors, id_column, vector_column), "vectors")
    few = W.partitionBy("v").orderBy("id")
    ranked = rows.withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1)
    groups = saved(ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("one"), "ids", "v"), "distinct")
    asked = saved(rows.where(is_query).join(groups.select("one", "v"), "v").select("id", "one"), "asked")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    largest = groups.agg(F.max(norm)).first()[0]
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if largest is None:
        return spark.createDataFrame([], schema)

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(largest**2 - (x * x).sum(axis=1), 0.0))])

    drawn = groups.orderBy(F.xxhash64("one"), "one").limit(sample).select("v").toPandas()
    points = lifted(np.array(drawn["v"].tolist(), float))
    forest = [grown(points, np.random.default_rng(seed), leaf) for seed in range(trees)]
    first = np.cumsum([0] + [len(t.share) for t in forest])  # number of each tree's first cell
    shared = spark.sparkContext.broadcast(forest)  # its size is bounded by the sample's

    def index(batches):
        for batch in batches:
            x = lifted(_lists(batch.column("v")))
            for t, tree in enumerate(shared.value):
                yield pa.RecordBatch.from_arrays([pa.array(first[t] + tree.leaves(x)), *batch.columns], ["cell", "one", "v"])

    def walk(batches):
        for batch in batches:
            x = _lists(batch.column("v"))
            cells = [[first[t] + n for t, n in visited(shared.value, np.append(q, 0.0), share)] for q in x]
            at = np.repeat(np.arange(len(x)), [len(c) for c in cells])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array([c for own in cells for c in own], np.int64)), batch.column("one").take(pa.array(at)), batch.column("v").take(pa.array(at))],
                ["cell", "one", "v"])

    shape = "cell bigint, one bigint, v array<double>"
    members = saved(groups.select("one", "v").mapInArrow(index, shape), "cells")
    seekers = groups.join(asked.select("one").distinct(), "one", "left_semi").select("one", "v").mapInArrow(walk, shape)
    chunks = members.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("n"))  # a row for each leaf
    left = members.join(chunks, "cell").withColumn("part", F.pmod(F.xxhash64("one"), F.col("n")).cast("int")).drop("n")
    right = seekers.join(chunks, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")

    def rank(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query": [], "one": [], "score": []}).astype({"query": "int64", "one": "int64", "score": "float64"})
        x = x.sort_values("one")
        ones, a = x["one"].to_numpy(), np.array(x["v"].tolist())
        out = []
        most = min(k + 1, len(x))
        for lo in range(0, len(q), 512):
            b = np.array(q["v"].iloc[lo : lo + 512].tolist())
            s = b @ a.T
            least = np.partition(s, len(x) - most, axis=1)[:, len(x) - most]
            # rounding of a product must not cut ties: a little below the least is kept as well
            who, what = np.nonzero(s >= (least - 1e-9 * np.maximum(1.0, np.abs(least)))[:, None])
            score = np.einsum("ij,ij->i", b[who], a[what])
            out.append(pd.DataFrame({"query": q["one"].to_numpy()[lo : lo + 512][who], "one": ones[what], "score": score}))
        return pd.concat(out)

    found = left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInPandas(rank, "query bigint, one bigint, score double")
    best = W.partitionBy("query").orderBy(F.desc("score"), "one")
    kept = found.groupBy("query", "one").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    named = kept.join(groups.select("one", "ids"), "one").select("query", "score", F.explode("ids").alias("vec_id"))
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = named.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    pairs = asked.join(lists.withColumnRenamed("query", "one"), "one").where("vec_id <> id")
    pairs = pairs.groupBy(F.col("id").alias("query_id"), "vec_id").agg(F.max("score").alias("score"))
    own = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

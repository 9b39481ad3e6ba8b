"""Intermediate tables in the shared folder, and components of a link table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routescope.session import ship_package
from routescope.sources.landing import fresh_folder

CELL = 200_000  # links that a task reduces at once, some 30 MB


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """Written to the shared folder and read back: cuts the lineage, outlives executors."""
    path = fresh_folder(df.sparkSession, f"llm-{purpose}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _state(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges: their number and two sums of hashes."""
    hashes = [F.sum(F.shiftright(F.xxhash64(F.lit(seed), "u", "v"), 20)) for seed in (1, 2)]
    return tuple(edges.agg(F.count("*"), *hashes).first())


def forest(a: pa.Array, b: pa.Array) -> tuple[pa.Array, pa.Array]:
    """For the links between ``a`` and ``b``: each node that is not the smallest of its part, and the smallest."""
    nodes = pc.unique(pa.concat_arrays([a, b]))
    nodes = nodes.take(pc.sort_indices(nodes))
    u, v = pc.index_in(a, nodes).to_numpy(), pc.index_in(b, nodes).to_numpy()
    label = np.arange(len(nodes))
    while True:
        lu, lv = label[u], label[v]
        open_links = lu != lv
        if not open_links.any():
            break
        u, v, lu, lv = u[open_links], v[open_links], lu[open_links], lv[open_links]
        parent = np.arange(len(nodes))
        np.minimum.at(parent, np.maximum(lu, lv), np.minimum(lu, lv))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]
    leaf = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes.take(pa.array(leaf)), nodes.take(pa.array(label[leaf]))


def _contracted(edges: DataFrame, cells: int) -> DataFrame:
    """(u, v): the links of each of ``cells`` tasks, about ``CELL`` of them, as stars around the smallest nodes."""
    schema = edges.schema

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            whole = pa.Table.from_batches(held).combine_chunks()
            u, v = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in whole.columns)
            yield pa.RecordBatch.from_arrays(list(forest(u, v)), ["u", "v"])

    ship_package(edges.sparkSession)
    return edges.repartition(cells).mapInArrow(run, schema)


def components(links: DataFrame, purpose: str = "components", cell: int = CELL) -> DataFrame:
    """(node, root): the smallest node that each node of ``links`` (a, b) can reach.

    Links are dealt to as many tasks as hold ``cell`` each, and each task reduces its own to stars; links
    that one task can hold are so done in one pass. Between passes large and small stars alternate:
    every node hands its larger neighbours, then its smaller ones, to the smallest node it knows.
    A node's neighbours are only aggregated and joined, never gathered."""
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), purpose)
    state = _state(edges)
    while state[0]:
        cells = -(-state[0] // cell)
        edges = saved(_contracted(edges, cells), purpose)
        if cells == 1:
            break
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        )
        after = saved(small, purpose)
        edges, before, state = after, state, _state(after)
        if state == before:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionAll(stars.select(F.col("root").alias("node"), "root")).distinct()

"""Clusters around centroids by Shallot search: bounds first, then a ball of sorted neighbours.

Vectors become integers, floor(64 x), and centroids stay integers, so distances (squared
Euclidean) compare exactly and ties go to the smaller number. Every vector remembers its
nearest centroid, its second-nearest one, an upper bound of its distance to the first and a
lower bound of that to any other. A round moves the bounds by as much as centroids moved; a
vector whose upper bound lies below its lower bound, or below half of the way from its centroid to
the nearest other one, stays where it is. Any other measures both remembered centroids and starts
from the closer one: its neighbours come in ascending distance, and the scan ends when the next
one lies farther than the start's distance plus that of the second best found so far, a ball that
shrinks with each find. What the ball holds is compared in integers.

Bounds are doubles, widened by ``SLACK``, and decide only what need not be measured. Vectors
and memories are tables of the shared folder, a new one a round; a round's sums are taken in the
same pass, a row for each centroid and batch, and only sums of the few centroids reach the driver.

Vectors that are null, of another length, or hold a null or non-finite component are left out, and
so are those with a component of 2^21 or more, as distances to them would not fit a long. A null
vec_id counts as the text ``null``; repeated rows are vectors of their own. With fewer vectors
than centroids asked for there are as many centroids as vectors; with none, no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routescope.llm.tables import saved
from routescope.session import ship_package

SCALE, LENGTH = 64, 64
CENTROIDS, ROUNDS, SEED = 16, 3, 1
MOST = 1 << 27  # of a component as an integer: 64 squares of twice this fit a long
SLACK = 1e-9


def whole_vectors(embeddings: DataFrame, length: int = LENGTH) -> DataFrame:
    """(vec_id, v): the vectors that take part, in integers."""
    x = F.floor(F.lit(float(SCALE)) * F.col("x"))
    fits = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST / SCALE))
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    return rows.where((F.size("e") == length) & F.coalesce(fits, F.lit(False))).select(
        "vec_id", F.transform("e", lambda c: F.floor(F.lit(float(SCALE)) * c).cast("bigint")).alias("v"))


def seeds(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """(k, length): the vectors first by the hash of their id."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return np.array([r["v"] for r in vectors.orderBy(order, "v").select("v").limit(k).collect()], np.int64)


@dataclass
class Search:
    """Centroids, their distances and neighbours, and how far each moved since the round before."""

    centroids: np.ndarray
    moved: np.ndarray

    def __post_init__(self):
        c = self.centroids
        self.apart = np.sqrt(((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2).astype(np.float64))
        self.neighbours = np.argsort(self.apart, axis=1, kind="stable")
        others = self.apart + np.where(np.eye(len(c), dtype=bool), np.inf, 0.0)
        self.half = others.min(axis=1) / 2
        two = np.sort(self.moved)[::-1]
        # the farthest that any centroid but this one moved
        self.others_moved = np.where(self.moved == two[0], two[1] if len(two) > 1 and (self.moved == two[0]).sum() == 1 else two[0], two[0])

    def squares(self, v: np.ndarray, which: np.ndarray) -> np.ndarray:
        d = v - self.centroids[which]
        return np.einsum("ij,ij->i", d, d)

    def assign(self, v, near, other, upper, lower):
        """New (near, other, upper, lower) of each vector, and which were searched."""
        near, other = near.copy(), other.copy()
        upper, lower = upper + self.moved[near], lower - self.others_moved[near]
        open_rows = np.flatnonzero(upper * (1 + SLACK) >= np.maximum(lower, self.half[near]) * (1 - SLACK))
        if not len(open_rows):
            return near, other, upper, lower, open_rows
        x, a, b = v[open_rows], near[open_rows], other[open_rows]
        da, db = self.squares(x, a), self.squares(x, b)
        swap = (db < da) | ((db == da) & (b < a))
        first, second = np.where(swap, b, a), np.where(swap, a, b)
        d1, d2 = np.where(swap, db, da), np.where(swap, da, db)
        d2 = np.where(first == second, np.iinfo(np.int64).max, d2)  # one centroid in all, or no second known
        start, radius = first.copy(), np.sqrt(d1.astype(np.float64))
        live = np.arange(len(x))
        for turn in range(len(self.centroids)):
            j = self.neighbours[start[live], turn]
            ball = (radius[live] + np.sqrt(d2[live].astype(np.float64))) * (1 + SLACK) + SLACK
            inside = self.apart[start[live], j] <= ball
            live, j = live[inside], j[inside]
            if not len(live):
                break
            fresh = (j != a[live]) & (j != b[live])
            at, c = live[fresh], j[fresh]
            d = self.squares(x[at], c)
            best = (d < d1[at]) | ((d == d1[at]) & (c < first[at]))
            next_best = ~best & ((d < d2[at]) | ((d == d2[at]) & (c < second[at])))
            up = at[best]
            second[up], d2[up] = first[up], d1[up]
            first[up], d1[up] = c[best], d[best]
            second[at[next_best]], d2[at[next_best]] = c[next_best], d[next_best]
        near[open_rows], other[open_rows] = first, second
        upper[open_rows] = np.sqrt(d1.astype(np.float64))
        lower[open_rows] = np.where(first == second, np.inf, np.sqrt(d2.astype(np.float64)))
        return near, other, upper, lower, open_rows


_STATE = "vec_id bigint, v array<bigint>, near int, other int, upper double, lower double, n bigint, total array<bigint>"


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def assigned(vectors: DataFrame, search: Search) -> DataFrame:
    """The vectors with new memories (``n`` null), and rows of sums (``near``, ``n``, ``total``) for each batch."""
    known = "near" in vectors.columns

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            v = _matrix(batch.column("v"))
            rows = len(v)
            if known:
                memory = [batch.column(name).to_numpy() for name in ("near", "other", "upper", "lower")]
            else:
                memory = [np.zeros(rows, np.int64), np.full(rows, min(1, len(search.centroids) - 1)), np.full(rows, np.inf), np.zeros(rows)]
            near, other, upper, lower, _ = search.assign(v, *memory)
            found = np.unique(near)
            sums = np.array([v[near == k].sum(axis=0) for k in found])
            nothing = lambda kind, size: pa.nulls(size, kind)
            lists = pa.list_(pa.int64())
            laid = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, v.shape[1], dtype=np.int32), sums.ravel())
            names = [f.strip().split(" ")[0] for f in _STATE.split(",")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(near.astype(np.int32)), pa.array(other.astype(np.int32)),
                 pa.array(upper), pa.array(lower), nothing(pa.int64(), rows), nothing(lists, rows)], names)
            few = len(found)
            yield pa.RecordBatch.from_arrays(
                [nothing(pa.int64(), few), nothing(lists, few), pa.array(found.astype(np.int32)), nothing(pa.int32(), few), nothing(pa.float64(), few),
                 nothing(pa.float64(), few), pa.array(np.bincount(near)[found].astype(np.int64)), laid], names)

    ship_package(vectors.sparkSession)
    return vectors.mapInArrow(run, _STATE)


def recentred(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's vectors' mean, rounded down; one without vectors stays."""
    each = [F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(centroids.shape[1])]
    after = centroids.copy()
    for r in state.where("n IS NOT NULL").groupBy("near").agg(F.sum("n").alias("n"), *each).collect():  # a row for each centroid
        after[r["near"]] = [int(r[f"s{i}"]) // int(r["n"]) for i in range(centroids.shape[1])]
    return after


def clustered(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, length: int = LENGTH) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that takes part, and the centroids after ``rounds``."""
    spark = embeddings.sparkSession
    state = saved(whole_vectors(embeddings, length), "vectors")
    centroids = seeds(state, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), centroids
    moved = np.zeros(len(centroids))
    for _ in range(rounds):
        both = saved(assigned(state, Search(centroids, moved)), "clusters")
        after = recentred(both, centroids)
        moved = np.sqrt(((after - centroids) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
        centroids, state = after, both.where("n IS NULL").drop("n", "total")
    search = Search(centroids, moved)
    known = "near" in state.columns

    def last(batches):
        for batch in batches:
            if not len(batch):
                continue
            v = _matrix(batch.column("v"))
            if known:
                memory = [batch.column(name).to_numpy() for name in ("near", "other", "upper", "lower")]
            else:
                memory = [np.zeros(len(v), np.int64), np.full(len(v), min(1, len(centroids) - 1)), np.full(len(v), np.inf), np.zeros(len(v))]
            near = search.assign(v, *memory)[0]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(near.astype(np.int32)), pa.array(search.squares(v, near))], ["vec_id", "cluster", "distance"])

    return state.mapInArrow(last, "vec_id bigint, cluster int, distance bigint"), centroids


def described(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds each cluster's inertia, that of all, and the digest of the cluster's centroid."""
    spark = rows.sparkSession
    rows = saved(rows, "assigned")
    # sums beyond a long are given as the largest one
    own = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    most, whole = (1 << 63) - 1, sum(own.values())
    facts = [(k, min(most, s), min(most, whole), hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()) for k, s in own.items()]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def twin(k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same in SQL, by measuring every vector against every centroid."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT n, min(d * {k} + c) % {k} AS c, min(d) AS d FROM (
  SELECT l.n, m.c, sum((l.x - m.x) * (l.x - m.x)) AS d FROM long l JOIN c{r} m ON m.i = l.i GROUP BY l.n, m.c) GROUP BY n)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT m.c, m.i, CAST(coalesce(g.x, m.x) AS BIGINT) AS x FROM c{r} m LEFT JOIN (
  SELECT a.c, l.i, (sum(l.x) - ((sum(l.x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM long l JOIN a{r} a ON a.n = l.n GROUP BY a.c, l.i) g ON g.c = m.c AND g.i = m.i)""")
    return f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, v, row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), 'null')), v) AS n FROM (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {LENGTH} AND len(list_filter(embedding, lambda x: coalesce(abs(CAST(x AS DOUBLE)) < {MOST // SCALE}, false))) = {LENGTH})),
long AS MATERIALIZED (SELECT n, unnest(v) AS x, unnest(range(1, {LENGTH + 1})) AS i FROM kept),
c0 AS MATERIALIZED (SELECT n - 1 AS c, i, x FROM long WHERE n <= {k}),
{", ".join(steps)}
SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM kept k JOIN a{rounds} a ON a.n = k.n JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c) h ON h.c = a.c"""

"""Relationship probabilities of links, inferred from counted paths.

Input is (path ARRAY<STRING>, n). Links are undirected and keyed by string order of their
ends. The loops keep tables of links only, save them reliably each round, and stop when a
round changes nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routescope.functions import paths as P
from routescope.session import ship_package
from routescope.sources.landing import fresh_folder, removed

THIRD = 1.0 / 3.0


def _lo(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _hi(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _id(path: Column) -> Column:
    """A digest of a path that tells missing hops apart."""
    return F.unhex(F.md5(F.array_join(path, "\u001f", "\u0000")))


def cut_lineage(df: DataFrame, purpose: str) -> DataFrame:
    """Written to the shared folder as columns and read back."""
    path = fresh_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def meetings(counted: DataFrame) -> DataFrame:
    """(far, meet, next): link (far, meet) continues over ``meet`` to ``next``, read from both sides."""
    path = F.col("path")
    triples = F.transform(
        F.sequence(F.lit(0), F.size(path) - 3),
        lambda i: F.struct(
            F.get(path, i).alias("u"), F.get(path, i + 1).alias("v"), F.get(path, i + 2).alias("w")
        ),
    )
    t = counted.where(F.size(path) >= 3).select(F.explode(triples).alias("t")).select("t.*")
    turned = F.col("u") > F.col("w")  # a triple and its reverse are one
    t = t.select(
        F.when(turned, F.col("w")).otherwise(F.col("u")).alias("u"), "v", F.when(turned, F.col("u")).otherwise(F.col("w")).alias("w")
    ).distinct()
    way = lambda a, b: F.struct(F.col(a).alias("far"), F.col("v").alias("meet"), F.col(b).alias("next"))
    ways = F.when(F.col("u").eqNullSafe(F.col("w")), F.array(way("u", "w"))).otherwise(F.array(way("u", "w"), way("w", "u")))
    return t.select(F.explode(ways).alias("m")).select("m.*")


def core_links(counted: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(as1, as2): links left when those lacking a neighbour at either end are dropped,
    again and again until none is.

    A round is one shuffle of the meetings, by link: a link that meets others at both ends hands its
    meetings over, each turned round, to the links it meets; those of other links are gone. So a link sees
    just its living neighbours in the next round. When two rounds in a row lose nothing, both sides of every
    meeting have been asked. The rounds get smaller; each is a table of the shared folder, the one before is removed.
    """
    spark = counted.sparkSession
    folder = fresh_folder(spark, "core")

    def saved(df: DataFrame, turn: int) -> DataFrame:
        df.write.parquet(f"{folder}/{turn}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{turn}")

    left = saved(meetings(counted), 0)
    rows, turn, idle = left.count(), 0, 0
    while turn != max_rounds and idle < 2 and rows:
        left = saved(_lasting(left).select(F.col("next").alias("far"), "meet", F.col("far").alias("next")), turn + 1)
        removed(spark, f"{folder}/{turn}")
        kept = left.count()
        idle = idle + 1 if kept == rows else 0
        rows, turn = kept, turn + 1
    far, meet = F.col("far"), F.col("meet")
    ends = left.groupBy(_lo(far, meet).alias("as1"), _hi(far, meet).alias("as2")).agg(F.min("meet").alias("first_end"), F.max("meet").alias("last_end"))
    return ends.where("first_end <> last_end").select("as1", "as2")


def _lasting(meets: DataFrame) -> DataFrame:
    """Meetings of links that meet others at both ends."""
    far, meet = F.col("far"), F.col("meet")
    link = Window.partitionBy(_lo(far, meet), _hi(far, meet))
    return meets.withColumns({"_first": F.min("meet").over(link), "_last": F.max("meet").over(link)}).where("_first <> _last").drop("_first", "_last")


def _flagged(counted: DataFrame, core: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Adds ``facts``: per link of the path, in order, whether it is core (and more of it).

    A path goes to its facts by its id: only ids and links meet ``core``, and only core links come back."""
    extra = extra or []
    rows = counted.where(F.size("path") >= 2).select(_id(F.col("path")).alias("id"), "path", "n")
    keyed = rows.select("id", F.posexplode(P.adjacent_pairs(F.col("path"))).alias("pos", "p")).select(
        "id", "pos", _lo(F.col("p.as1"), F.col("p.as2")).alias("as1"), _hi(F.col("p.as1"), F.col("p.as2")).alias("as2")
    )
    hits = keyed.join(core.select("as1", "as2", *extra), ["as1", "as2"]).groupBy("id").agg(
        F.collect_list(F.struct("pos", *extra)).alias("hits")
    )

    def fact(p: Column, i: Column) -> Column:
        hit = F.get(F.filter("hits", lambda h: h["pos"] == i), F.lit(0))
        along = p["as1"] == _lo(p["as1"], p["as2"])
        return F.struct(i.alias("pos"), hit.isNotNull().alias("core"), along.alias("along"), *[hit[x].alias(x) for x in extra])

    return rows.join(hits, "id", "left").select("path", "n", F.transform(P.adjacent_pairs(F.col("path")), fact).alias("facts"))


def _span(flagged: DataFrame) -> DataFrame:
    """Adds ``left`` and ``right``: hops where the core part of a path begins and ends;
    ``left`` is -1 without one."""
    flags = F.transform("facts", lambda f: f["core"])
    left = (F.array_position(flags, True) - 1).cast("int")
    rest = F.slice(F.col("_flags"), F.col("left") + 1, F.size("_flags"))
    stop = F.array_position(rest, False)
    right = F.when(F.col("left") < 0, F.size("path") - 1).when(
        stop == 0, F.size("path") - 1
    ).otherwise((F.col("left") + stop - 1).cast("int"))
    return flagged.withColumn("_flags", flags).withColumn("left", left).withColumn("right", right).drop("_flags")


def core_paths(counted: DataFrame, core: DataFrame) -> DataFrame:
    """(path, n): each path cut to its first stretch of core links, counts added up."""
    s = _span(_flagged(counted, core)).where("left >= 0")
    return s.groupBy(F.slice("path", F.col("left") + 1, F.col("right") - F.col("left") + 1).alias("path")).agg(
        F.sum("n").alias("n")
    )


def link_contexts(counted: DataFrame) -> DataFrame:
    """(as1, as2, before, after, n): what stands beside a link, read in key order."""
    path = F.col("path")
    ctx = F.transform(
        F.sequence(F.lit(0), F.size(path) - 2),
        lambda i: F.struct(
            F.get(path, i).alias("a"), F.get(path, i + 1).alias("b"),
            F.when(i > 0, F.get(path, i - 1)).alias("l"), F.get(path, i + 2).alias("r"),
        ),
    )
    rows = counted.where(F.size(path) >= 2).select("n", F.explode(ctx).alias("c")).select("n", "c.*")
    along = F.col("a") < F.col("b")
    return rows.groupBy(
        _lo(F.col("a"), F.col("b")).alias("as1"), _hi(F.col("a"), F.col("b")).alias("as2"),
        F.when(along, F.col("l")).otherwise(F.col("r")).alias("before"),
        F.when(along, F.col("r")).otherwise(F.col("l")).alias("after"),
    ).agg(F.sum("n").alias("n"))


def initial_relations(contexts: DataFrame, edges: DataFrame) -> DataFrame:
    """(as1, as2, rel): -1 when as1 provides as2, 1 the other way, 0 peers or unknown."""
    flip = F.col("as1") > F.col("as2")
    known = edges.select(
        _lo(F.col("as1"), F.col("as2")).alias("k1"), _hi(F.col("as1"), F.col("as2")).alias("k2"),
        F.when(flip, -F.col("rel")).otherwise(F.col("rel")).alias("rel"),
    ).groupBy("k1", "k2").agg(F.min("rel").alias("rel")).toDF("as1", "as2", "rel")
    return contexts.select("as1", "as2").distinct().join(known, ["as1", "as2"], "left").select(
        "as1", "as2", F.coalesce("rel", F.lit(0)).cast("int").alias("rel")
    )


CELLS = 4_000_000  # states of links by sweeps that one task redraws
FEW_CELLS = 500_000  # while there are idle cores, and not worth a task of their own below


def _laid_out(contexts: DataFrame, start: DataFrame, parts: int) -> DataFrame:
    """Contexts by link, each with the keys of the links beside it, the signs that turn their
    relations, and whether they come before the link itself in a sweep. A missing end has nulls."""
    before, after = F.col("before"), F.col("after")
    ctx = contexts.join(start.select("as1", "as2"), ["as1", "as2"], "left_semi").select(
        "as1", "as2", "n",
        F.when(before.isNotNull(), _lo(before, F.col("as1"))).alias("b1"), F.when(before.isNotNull(), _hi(before, F.col("as1"))).alias("b2"),
        F.when(after.isNotNull(), _lo(F.col("as2"), after)).alias("a1"), F.when(after.isNotNull(), _hi(F.col("as2"), after)).alias("a2"),
        F.when(before < F.col("as1"), 1).when(before.isNotNull(), -1).otherwise(0).alias("b_sign"),
        F.when(F.col("as2") < after, 1).when(after.isNotNull(), -1).otherwise(0).alias("a_sign"),
    )

    def early(one: str, two: str) -> Column:
        return F.coalesce((F.col(one) < F.col("as1")) | ((F.col(one) == F.col("as1")) & (F.col(two) < F.col("as2"))), F.lit(False))

    return ctx.withColumns({"b_early": early("b1", "b2"), "a_early": early("a1", "a2")}).repartition(parts, "as1", "as2").sortWithinPartitions("as1", "as2")


def _histories(column: pa.Array, last: pa.Array, sign: np.ndarray, early: np.ndarray, width: int, missing: int) -> np.ndarray:
    """(rows, width): what each row's link sees of a neighbour in every sweep: its state of the same sweep
    if it comes early, else of the sweep before."""
    out = np.full((len(column), width), missing, np.int8)
    there = np.flatnonzero(sign)
    if len(there):
        own = np.frombuffer(b"".join(column.take(pa.array(there)).to_pylist()), np.int8).reshape(-1, width)
        late = ~early[there]
        own = own.copy()
        own[late, 1:] = own[late, :-1]
        own[late, 0] = last.to_numpy(zero_copy_only=False)[there][late]
        out[there] = own * sign[there, None].astype(np.int8)
    return out


_VOTES = "as1 string, as2 string, tag int, n bigint, last int, states binary, u binary, down binary, up binary"


def _votes(seen: DataFrame, width: int) -> DataFrame:
    """Sums of the votes for each link and sweep, a row for every run of a link's contexts."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
                num = {k: col[k].to_numpy(zero_copy_only=False) for k in ("n", "b_sign", "a_sign", "b_early", "a_early")}
                last = _histories(col["b_states"], col["b_last"], num["b_sign"], num["b_early"], width, 1)
                following = _histories(col["a_states"], col["a_last"], num["a_sign"], num["a_early"], width, -1)
                one, two = col["as1"].to_pylist(), col["as2"].to_pylist()
                first = [0] + [i for i in range(1, len(one)) if one[i] != one[i - 1] or two[i] != two[i - 1]]
                weight = num["n"][:, None]
                down = np.add.reduceat(((last != 1) & (following == -1)) * weight, first, axis=0)
                up = np.add.reduceat(((last == 1) & (following != -1)) * weight, first, axis=0)
                n = np.add.reduceat(num["n"], first)
                none = pa.nulls(len(first), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one[i] for i in first]), pa.array([two[i] for i in first]), pa.array([1] * len(first), pa.int32()), pa.array(n.astype(np.int64)),
                     pa.nulls(len(first), pa.int32()), none, none, pa.array([r.tobytes() for r in down.astype(np.int64)], pa.binary()),
                     pa.array([r.tobytes() for r in up.astype(np.int64)], pa.binary())],
                    ["as1", "as2", "tag", "n", "last", "states", "u", "down", "up"])

    return seen.mapInArrow(run, _VOTES)


_STATES = "as1 string, as2 string, last int, states binary, u binary, changed boolean"


def _redrawn(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """Each link's states drawn anew from its votes; a link comes first, its sums of votes follow."""

    def run(batches):
        def drawn(link, n, down, up):
            u = np.frombuffer(link["u"], np.uint32) / 4294967296.0
            states = np.where(u < down / n, -1, np.where(u < 1.0 - up / n, 0, 1)).astype(np.int8).tobytes() if n else link["states"]
            return {**{k: link[k] for k in ("as1", "as2", "last", "u")}, "states": states, "changed": states != link["states"]}

        link = None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["tag"] == 0:
                    if link is not None:
                        done.append(drawn(link, n, down, up))
                    link, n, down, up = r, 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
                elif link is not None:
                    n, down, up = n + r["n"], down + np.frombuffer(r["down"], np.int64), up + np.frombuffer(r["up"], np.int64)
            yield _state_rows(done)
        if link is not None:
            yield _state_rows([drawn(link, n, down, up)])

    ordered = rows.repartition(parts, "as1", "as2").sortWithinPartitions("as1", "as2", "tag")
    return ordered.mapInArrow(run, _STATES)


def _state_rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"as1": pa.string(), "as2": pa.string(), "last": pa.int32(), "states": pa.binary(), "u": pa.binary(), "changed": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))


def _begun(links: DataFrame, first: int, width: int, seed: int) -> DataFrame:
    """Links with their draws of the sweeps from ``first`` on, fixed by link, sweep and seed, and a first guess of their states: the last."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                digests = [hashlib.md5(f"{r['as1']}|{r['as2']}|{first + k}|{seed}".encode()).digest()[:4] for k in range(width)]
                u = np.frombuffer(b"".join(digests), ">u4").astype(np.uint32).tobytes()
                rows.append({"as1": r["as1"], "as2": r["as2"], "last": r["rel"], "states": np.full(width, r["rel"], np.int8).tobytes(), "u": u, "changed": True})
            yield _state_rows(rows)

    return links.mapInArrow(run, _STATES)


def _tallied(links: DataFrame, states: DataFrame) -> DataFrame:
    """Links with the last of their states, and the states counted."""

    def run(batches):
        for batch in batches:
            rows = [np.frombuffer(x, np.int8) for x in batch.column("states").to_pylist()]
            counts = [[int((r == k).sum()) for r in rows] for k in (-1, 0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("as1"), batch.column("as2"), pa.array([int(r[-1]) for r in rows], pa.int32()), *[pa.array(c, pa.int64()) for c in counts]],
                ["as1", "as2", "rel", "_down", "_flat", "_up"])

    counted = states.select("as1", "as2", "states").mapInArrow(run, "as1 string, as2 string, rel int, _down bigint, _flat bigint, _up bigint")
    joined = links.drop("rel").join(counted, ["as1", "as2"])
    return joined.select("as1", "as2", "rel", *[(F.col(k) + F.col(f"_{k}")).alias(k) for k in ("down", "flat", "up")])


def sample_relations(contexts: DataFrame, start: DataFrame, sweeps: int = 1000, seed: int = 42, span: int = 1000) -> DataFrame:
    """(as1, as2, p2c, p2p, c2p): shares of the states drawn over ``sweeps`` by one-by-one sampling.

    A sweep redraws the links one after the other in the order of their keys, each from what its
    neighbours are just then, by a draw fixed by link and sweep. A state so depends on states of earlier
    links in its sweep and of later ones in the sweep before, and all sweeps can be solved at once: every
    link holds its states of ``span`` sweeps, guesses at first; a round redraws all of them from the
    neighbours' guesses. What depends on right states only becomes right for good, so the rounds end, when none
    changes a state, with the very states of the one-by-one sampler. A wrong state seldom changes
    what its neighbours draw, so wrong ones die out in tens of rounds, whatever ``span``; should
    they not, a round still settles one state of every dependency chain.

    A round joins contexts with two links' histories and sums the votes before it shuffles them by link; a
    hub's contexts are summed where they lie. Histories are small tables of the shared folder, the last
    but one removed; nothing is gathered but the number of links that changed.
    """
    spark = contexts.sparkSession
    folder = fresh_folder(spark, "sweeps")
    ship_package(spark)

    def saved(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    links = saved(start.select("as1", "as2", "rel", *[F.lit(0).cast("bigint").alias(k) for k in ("down", "flat", "up")]), "links-0")
    # Rows are small on disk and grow with the sweeps in memory, so their number sets the partitions, not their bytes.
    cells = links.count() * min(span, sweeps)
    parts = max(min(spark.sparkContext.defaultParallelism, cells // FEW_CELLS + 1), cells // CELLS + 1)
    ctx = saved(_laid_out(contexts, links, parts), "contexts")
    for first in range(1, sweeps + 1, span):
        width = min(span, sweeps + 1 - first)
        state = saved(_begun(links.repartition(parts, "as1", "as2"), first, width, seed), f"states-{first}-0")
        turn = 0
        while True:
            turn += 1
            known = state.select("as1", "as2", "last", "states")
            seen = ctx.join(known.toDF("b1", "b2", "b_last", "b_states"), ["b1", "b2"], "left").join(known.toDF("a1", "a2", "a_last", "a_states"), ["a1", "a2"], "left")
            votes = _votes(seen.select("as1", "as2", "n", *[f"{x}_{k}" for x in "ba" for k in ("sign", "early", "last", "states")]), width)
            heads = state.select("as1", "as2", F.lit(0).alias("tag"), F.lit(0).cast("bigint").alias("n"), "last", "states", "u",
                                 *[F.lit(None).cast("binary").alias(k) for k in ("down", "up")])
            state = saved(_redrawn(heads.unionByName(votes), width, parts), f"states-{first}-{turn}")
            if turn > 1:
                removed(spark, f"{folder}/states-{first}-{turn - 2}")
            if state.where("changed").isEmpty():
                break
        links = saved(_tallied(links, state), f"links-{first}")
    total = F.col("down") + F.col("flat") + F.col("up")
    return links.select(
        "as1", "as2", (F.col("down") / total).alias("p2c"), (F.col("flat") / total).alias("p2p"), (F.col("up") / total).alias("c2p")
    )


def _fold(counted: DataFrame, core: DataFrame, th: float) -> DataFrame:
    """Per path: ``chains`` of edge links to follow, provider ``seeds``, and the edge
    ``pieces`` kept for later."""
    path, left, right = F.col("path"), F.col("left"), F.col("right")
    size = F.size(path)
    # the first and the last core link, read in the path's direction
    first, last = F.get("facts", left), F.get("facts", right - 1)
    first_p2c = F.when(first["along"], first["p2c"]).otherwise(first["c2p"])
    last_c2p = F.when(last["along"], last["c2p"]).otherwise(last["p2c"])
    s = _span(_flagged(counted, core, ["p2c", "c2p"])).withColumns({"open_left": first_p2c >= 1 - th, "open_right": last_c2p >= 1 - th})
    s = cut_lineage(s.select("path", "n", "left", "right", "open_left", "open_right"), "folded")  # a path once, what follows is made as it is read
    head, tail = F.slice(path, 1, left + 1), F.slice(path, right + 1, size - right)
    plain, open_left, open_right = left < 0, F.col("open_left"), F.col("open_right")

    def if_(cond: Column, value: Column) -> Column:
        return F.when(cond, value)

    chains = F.array_compact(
        F.array(
            if_(plain, path), if_(plain, F.reverse(path)),
            if_(~plain & open_left & (left > 1), head), if_(~plain & (left > 1), F.reverse(head)),
            if_(~plain & (right < size - 2), tail), if_(~plain & open_right & (right < size - 2), F.reverse(tail)),
        )
    )

    def pair(a: Column, b: Column) -> Column:
        return F.struct(a.alias("as1"), b.alias("as2"))

    seeds = F.array_compact(
        F.array(
            if_(~plain & ~open_left & (left >= 1), pair(F.get(path, left), F.get(path, left - 1))),
            if_(~plain & ~open_right & (right <= size - 2), pair(F.get(path, right), F.get(path, right + 1))),
        )
    )
    pieces = F.array_compact(
        F.array(
            if_(plain, path), if_(~plain & open_left & (left > 0), head), if_(~plain & open_right & (right < size - 1), tail)
        )
    )
    return s.select("n", chains.alias("chains"), seeds.alias("seeds"), pieces.alias("pieces"))


def provider_links(counted: DataFrame, core: DataFrame, th: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Edge links that must be provider to customer, and the edge paths left unexplained.

    ``core`` has as1, as2, p2c, p2p, c2p. Seeds lie beside the core; a link that follows a
    p2c link is p2c as well. The closure joins only newly found links each round.
    """
    folded = _fold(counted, core, th)
    hop = F.col("chain")
    steps = F.transform(
        F.sequence(F.lit(0), F.size(hop) - 3),
        lambda i: F.struct(
            F.get(hop, i).alias("as1"), F.get(hop, i + 1).alias("as2"), F.get(hop, i + 2).alias("as3")
        ),
    )
    follow = cut_lineage(
        folded.select(F.explode("chains").alias("chain")).where(F.size("chain") >= 3)
        .select(F.explode(steps).alias("s")).select("s.*").distinct(), "follow"
    )
    found = fresh = cut_lineage(folded.select(F.explode("seeds").alias("s")).select("s.*").distinct(), "provider")
    while True:
        nxt = follow.join(fresh, ["as1", "as2"]).select(F.col("as2").alias("as1"), F.col("as3").alias("as2")).distinct()
        fresh = cut_lineage(nxt.join(found, ["as1", "as2"], "left_anti"), "provider")
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh)  # tables of one round each, none is written again
    pieces = folded.select("n", F.explode("pieces").alias("path")).groupBy("path").agg(F.sum("n").alias("n"))
    return found, _trimmed(pieces, found)


def _trimmed(pieces: DataFrame, p2c: DataFrame) -> DataFrame:
    """Edge paths without their explained ends: from after the last link that is p2c
    against the path to before the first that is p2c along it."""
    rows = pieces.where(F.size("path") >= 2).select(_id(F.col("path")).alias("id"), "path", "n")
    one, two = F.col("as1"), F.col("as2")
    lo, hi = _lo(one, two), _hi(one, two)
    told = p2c.where(one.isNotNull() & two.isNotNull()).groupBy(lo.alias("lo"), hi.alias("hi")).agg(
        F.max(one == lo).alias("rising"), F.max(one == hi).alias("falling")
    )
    met = rows.select("id", F.posexplode(P.adjacent_pairs(F.col("path"))).alias("pos", "p")).select("id", "pos", "p.*")
    met = met.where(one.isNotNull() & two.isNotNull()).select("id", "pos", (one == lo).alias("rises"), lo.alias("lo"), hi.alias("hi")).join(told, ["lo", "hi"])
    down = F.when(F.col("rises"), F.col("rising")).otherwise(F.col("falling"))
    up = F.when(F.col("rises"), F.col("falling")).otherwise(F.col("rising"))
    ends = met.groupBy("id").agg(F.max(F.when(up, F.col("pos") + 1)).alias("up"), F.min(F.when(down, F.col("pos"))).alias("down"))
    g = rows.join(ends, "id", "left").select(
        "path", "n", F.coalesce("up", F.lit(0)).alias("left"), F.coalesce("down", F.size("path") - 1).alias("right")
    )
    return g.where("right > left").groupBy(
        F.slice("path", F.col("left") + 1, F.col("right") - F.col("left") + 1).alias("path")
    ).agg(F.sum("n").alias("n"))


def edge_probabilities(p2c: DataFrame, reserved: DataFrame) -> DataFrame:
    """(as1, as2, p2c, p2p, c2p, paths): provider links are certain, the others open.

    ``paths`` counts the unexplained paths a link lies on.
    """
    sure = p2c.select(
        "as1", "as2", F.lit(1.0).alias("p2c"), F.lit(0.0).alias("p2p"), F.lit(0.0).alias("c2p"), F.lit(0).cast("bigint").alias("paths")
    )
    seen = reserved.select(F.explode(P.adjacent_pairs(F.col("path"))).alias("p"))
    counted = seen.groupBy(
        _lo(F.col("p.as1"), F.col("p.as2")).alias("as1"), _hi(F.col("p.as1"), F.col("p.as2")).alias("as2")
    ).agg(F.count("*").alias("paths"))
    known = p2c.select(_lo(F.col("as1"), F.col("as2")).alias("as1"), _hi(F.col("as1"), F.col("as2")).alias("as2")).distinct()
    rest = counted.join(known, ["as1", "as2"], "left_anti").select(
        "as1", "as2", F.lit(THIRD).alias("p2c"), F.lit(THIRD).alias("p2p"), F.lit(THIRD).alias("c2p"), "paths"
    )
    return sure.unionByName(rest)


def assemble(core: DataFrame, edge: DataFrame) -> DataFrame:
    """Core and edge rows together; of a link given in both directions the lower one stays."""
    cols = ["as1", "as2", "p2c", "p2p", "c2p"]
    twin = edge.select(F.col("as2").alias("as1"), F.col("as1").alias("as2"))
    doubled = edge.join(twin, ["as1", "as2"], "left_semi").where("as1 > as2").select("as1", "as2")
    kept = edge.join(doubled, ["as1", "as2"], "left_anti")
    return core.select(*cols).unionByName(kept.select(*cols))

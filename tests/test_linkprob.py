import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from routescope.operators import linkprob as L
from tools.check import TABLES


def counted(spark, paths):
    return spark.createDataFrame([(list(p), n) for p, n in paths.items()], "path array<string>, n bigint")


def key(a, b):
    return (min(a, b), max(a, b))


def peel(paths):
    """Core links by direct repetition."""
    meets = set()
    for p in paths:
        for u, v, w in zip(p, p[1:], p[2:]):
            meets |= {(key(u, v), v, key(v, w)), (key(v, w), v, key(u, v))}
    while True:
        ends = {}
        for link, v, _ in meets:
            ends.setdefault(link, set()).add(v)
        alive = {x for x, e in ends.items() if len(e) == 2}
        kept = {m for m in meets if m[0] in alive and m[2] in alive}
        if kept == meets:
            return alive
        meets = kept


def some_paths(seed=1, n=60):
    rng = random.Random(seed)
    out = {}
    for _ in range(n):
        mid = rng.sample("abcdef", rng.randrange(1, 4))
        p = (f"e{rng.randrange(4)}", *mid, f"x{rng.randrange(6)}", f"y{rng.randrange(9)}")
        out[p] = out.get(p, 0) + rng.randrange(1, 4)
    return out


def test_core(spark, rows):
    for seed in (1, 2):
        paths = some_paths(seed)
        assert set(rows(L.core_links(counted(spark, paths)))) == peel(paths)


def test_core_rounds_carry_meetings_once(spark, rows, monkeypatch):
    """A round hands meetings on by one shuffle, without joins or checkpoints of whole rows; long chains peel link by link."""
    ring = {tuple(str(100 + (i + k) % 6) for k in range(4)): 1 for i in range(6)}
    tail = {tuple(str(100 + i + k) for k in range(3)): 1 for i in range(5, 14)}
    paths = ring | tail | {("a", "b", "a"): 2, ("100", "101", "102"): 1, ("102", "101", "100"): 1}
    frame = counted(spark, paths)
    met = rows(L.meetings(frame))
    want = {m for p in paths for u, v, w in zip(p, p[1:], p[2:]) for m in ((u, v, w), (w, v, u))}
    assert len(met) == len(want) and set(met) == want
    monkeypatch.setattr(L, "cut_lineage", None)
    assert set(rows(L.core_links(frame))) == peel(paths) != set()
    assert rows(L.core_links(frame.where("false"))) == []


def _core_cut(p, core):
    flags = [key(a, b) in core for a, b in zip(p, p[1:])]
    if True not in flags:
        return -1, len(p) - 1
    left = flags.index(True)
    right = next((i for i in range(left + 1, len(flags)) if not flags[i]), len(p) - 1)
    return left, right


def test_core_paths_and_contexts(spark, rows):
    paths = some_paths()
    core = peel(paths)
    frame = spark.createDataFrame(sorted(core), "as1 string, as2 string")
    want = {}
    for p, n in paths.items():
        left, right = _core_cut(p, core)
        if left >= 0:
            cut = p[left:right + 1]
            want[cut] = want.get(cut, 0) + n
    got = L.core_paths(counted(spark, paths), frame)
    assert {tuple(r["path"]): r["n"] for r in got.collect()} == want
    ctx = {}
    for p, n in want.items():
        for i in range(len(p) - 1):
            l, r = p[i - 1] if i else None, p[i + 2] if i + 2 < len(p) else None
            a, b = p[i], p[i + 1]
            k = (a, b, l, r) if a < b else (b, a, r, l)
            ctx[k] = ctx.get(k, 0) + n
    assert {tuple(r)[:4]: r["n"] for r in L.link_contexts(got).collect()} == ctx


def test_sampling_is_fixed_by_its_seed(spark, rows):
    ctx = L.link_contexts(counted(spark, some_paths()))
    start = L.initial_relations(ctx, spark.createDataFrame([("a", "b", -1)], "as1 string, as2 string, rel int"))
    one = rows(L.sample_relations(ctx, start, 3, seed=1))
    assert one == rows(L.sample_relations(ctx, start, 3, seed=1))
    assert all(abs(r[2] + r[3] + r[4] - 1) < 1e-9 for r in one)


def test_providers_follow(spark):
    paths = some_paths(3)
    core = peel(paths)
    rng = random.Random(9)
    prob = {c: (0.9, 0.05, 0.05) if rng.random() < 0.5 else (0.05, 0.05, 0.9) for c in core}
    frame = spark.createDataFrame([(a, b, *p) for (a, b), p in prob.items()], "as1 string, as2 string, p2c double, p2p double, c2p double")
    follow, seeds = {}, set()

    def chain(p):
        for u, v, w in zip(p, p[1:], p[2:]):
            follow.setdefault((u, v), set()).add((v, w))

    for p in paths:
        left, right = _core_cut(p, core)
        if left < 0:
            chain(p)
            chain(p[::-1])
            continue

        def oriented(a, b):
            q = prob[key(a, b)]
            return q if a < b else q[::-1]

        if oriented(p[left], p[left + 1])[0] >= 0.2:
            if left > 1:
                chain(p[:left + 1])
                chain(p[left::-1])
        elif left >= 1:
            seeds.add((p[left], p[left - 1]))
            chain(p[left::-1])
        tail = p[right:]
        if oriented(p[right - 1], p[right])[2] >= 0.2:
            chain(tail)
            chain(tail[::-1])
        elif len(tail) >= 2:
            seeds.add((tail[0], tail[1]))
            chain(tail)
    found, todo = set(), list(seeds)
    while todo:
        x = todo.pop()
        if x not in found:
            found.add(x)
            todo += follow.get(x, ())
    p2c, reserved = L.provider_links(counted(spark, paths), frame, 0.8)
    assert {tuple(r) for r in p2c.collect()} == found
    edge = L.edge_probabilities(p2c, reserved)
    assert edge.where(F.abs(F.col("p2c") + F.col("p2p") + F.col("c2p") - 1) > 1e-9).count() == 0
    table = L.assemble(frame, edge)
    assert table.count() >= frame.count()


def _draw(a, b, sweep, seed):
    return int(hashlib.md5(f"{a}|{b}|{sweep}|{seed}".encode()).hexdigest()[:8], 16) / 4294967296.0


def one_by_one(ctx, start, sweeps):
    """Plain sampling, link after link in key order: how often each link stood at -1, 0 and 1."""
    rel = {(r["as1"], r["as2"]): r["rel"] for r in start}
    around = {}
    for a, b, before, after, n in ctx:
        around.setdefault((a, b), []).append((before, after, n))
    tally = {link: [0, 0, 0] for link in rel}
    for sweep in range(1, sweeps + 1):
        for a, b in sorted(around):
            down = up = 0
            for before, after, n in around[a, b]:
                last = 1 if before is None else rel[key(before, a)] * (1 if before < a else -1)
                following = -1 if after is None else rel[key(b, after)] * (1 if b < after else -1)
                down += n * (last != 1 and following == -1)
                up += n * (last == 1 and following != -1)
            v, u = sum(r[2] for r in around[a, b]), _draw(a, b, sweep, 42)
            rel[a, b] = -1 if u < down / v else 0 if u < 1.0 - up / v else 1
            tally[a, b][rel[a, b] + 1] += 1
    return tally


@pytest.mark.parametrize("sweeps, span", [(7, 1000), (50, 1000), (50, 17)])
def test_all_sweeps_at_once_are_those_of_one_by_one_sampling(spark, sweeps, span):
    loops = [(("x", "y", "x", "z", "w"), 5), (("w", "z", "x", "y"), 2)]
    ctx = L.link_contexts(counted(spark, some_paths())).unionByName(L.link_contexts(spark.createDataFrame(loops, "path array<string>, n bigint")))
    start = L.initial_relations(ctx, spark.createDataFrame([("a", "b", -1)], "as1 string, as2 string, rel int"))
    got = {(r["as1"], r["as2"]): [round(r[k] * sweeps) for k in ("p2c", "p2p", "c2p")] for r in L.sample_relations(ctx, start, sweeps, span=span).collect()}
    assert got == one_by_one(ctx.collect(), start.collect(), sweeps)
    assert len({tuple(t) for t in got.values()}) > 2


def test_no_links_no_shares(spark):
    ctx = L.link_contexts(spark.createDataFrame([], "path array<string>, n bigint"))
    start = L.initial_relations(ctx, spark.createDataFrame([], "as1 string, as2 string, rel int"))
    assert L.sample_relations(ctx, start, 5).count() == 0


def test_the_twin_samples_one_by_one():
    from routescope.plans import q_leak
    from routescope.plans.sqlviews import with_views

    assert q_leak.SWEEPS == 1000
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    ctx = con.execute(with_views("SELECT as1, as2, bef, aft, n FROM ctx")).fetchall()
    start = [dict(zip(("as1", "as2", "rel"), r)) for r in con.execute(with_views("SELECT as1, as2, rel FROM rel0")).fetchall()]
    got = con.execute(with_views(f"SELECT * FROM ({q_leak.gibbs_twin(20)})")).fetchall()
    assert {(a, b): [round(20 * x) for x in shares] for a, b, *shares in got} == one_by_one(ctx, start, 20)


def _plain_facts(path, core):
    return [(i, key(a, b) in core, a == min(a, b), core.get(key(a, b))) for i, (a, b) in enumerate(zip(path, path[1:]))]


def test_paths_meet_links_by_their_ids(spark):
    paths = [("a", "b", "c", "d"), ("d", "c", "x"), ("q", "r"), ("b", "a", "b"), ("z",)]
    core = {("a", "b"): 0.9, ("c", "d"): 0.2}
    frame = spark.createDataFrame([(*k, v) for k, v in core.items()], "as1 string, as2 string, p2c double")
    flagged = L._flagged(spark.createDataFrame([(list(p), 2) for p in paths], "path array<string>, n bigint"), frame, ["p2c"])
    got = {tuple(r["path"]): [tuple(f) for f in r["facts"]] for r in flagged.collect()}
    assert got == {p: _plain_facts(p, core) for p in paths if len(p) > 1}
    plan = flagged._jdf.queryExecution().optimizedPlan().toString()
    lists = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert lists and not any("path#" in line for line in lists)  # paths aren't grouped link by link


def test_trimming_against_a_plain_rewrite(spark):
    paths = {("a", "b", "c", "d", "e"): 1, ("e", "d", "c"): 2, ("b", None, "c", "d"): 3, ("a", "b", "b"): 4, ("k", "l"): 5, ("l", "k", "m"): 6}
    sure = {("d", "e"), ("b", "a"), ("d", "c"), ("l", "k"), ("b", None), ("m", "k"), ("k", "m")}
    want = {}
    for p, n in paths.items():
        ends = [(i, a, b) for i, (a, b) in enumerate(zip(p, p[1:])) if a is not None and b is not None]
        left = max([i + 1 for i, a, b in ends if (b, a) in sure], default=0)
        right = min([i for i, a, b in ends if (a, b) in sure], default=len(p) - 1)
        if right > left:
            want[p[left : right + 1]] = want.get(p[left : right + 1], 0) + n
    pieces = spark.createDataFrame([(list(p), n) for p, n in paths.items()], "path array<string>, n bigint")
    got = L._trimmed(pieces, spark.createDataFrame(list(sure), "as1 string, as2 string"))
    assert {tuple(r["path"]): r["n"] for r in got.collect()} == want

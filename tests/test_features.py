import random

import pytest
from pyspark.sql import functions as F

from routescope.functions import times as T
from routescope.operators import baselines as B
from routescope.operators import features as FE
from routescope.operators import outage as O
from routescope.operators import sequences as Q
from routescope.operators.relevance import relevant_updates
from routescope.sources import updates as U

LINES = """BGP4MP|2024-01-01 00:00:01|A|192.0.2.1|100|10.0.0.0/24|100 200 300|IGP|192.0.2.1|0|0||NAG||
BGP4MP|2024-01-01 00:00:03|A|192.0.2.1|100|10.0.0.0/24|100 200 300|IGP|192.0.2.1|0|0||NAG||
BGP4MP|2024-01-01 00:00:09|W|192.0.2.1|100|10.0.0.0/24
BGP4MP|01/01/24 00:00:11|A|192.0.2.1|100|10.0.0.0/24|100 200 200 400|IGP|192.0.2.1|0|0||NAG||
BGP4MP|2024-01-01 00:05:00|W|192.0.2.1|100|10.0.1.0/24
BGP4MP|2024-01-01 00:05:02|A|192.0.2.1|100|10.0.0.0/24|100 {500,600} 400|IGP|192.0.2.1|0|0||NAG||
BAD LINE
""".splitlines()


def updates(spark, tmp_path):
    folder = tmp_path / "dump"
    folder.mkdir()
    (folder / "updates.20240101.0000.txt").write_text("\n".join(LINES) + "\n")
    return U.read_updates(spark, str(folder))


def test_fixture_buckets(spark, tmp_path):
    u = updates(spark, tmp_path)
    assert u.count() == 6
    targets = spark.createDataFrame([("t", "200"), ("t", "100")], "target string, asn string")
    for bucket in (None, 300):
        rows = relevant_updates(u, targets, FE.FEATURE_INPUT, bucket)
        got = {r["bucket"] % 86400: r for r in FE.feature_series(rows, 300, "global").collect()}
        a, b = got[0], got[300]
        assert (a["announcement_count"], a["withdrawal_count"], a["num_dup_A"], a["num_ori_change"]) == (3, 1, 1, 1)
        assert (a["flapping_prefix_count"], a["num_new_A_afterW"], a["unique_as_count"]) == (1, 1, 4)
        assert abs(a["avg_arrival_interval"] - 10 / 3) < 1e-9
        assert (a["avg_path_length"], a["min_path_length"], a["max_path_length"], a["editDis_entropy"]) == (3.0, 3, 3, 0.0)
        assert (b["announcement_count"], b["withdrawal_count"], b["num_shorter"], b["num_ori_change"]) == (1, 1, 1, 0)
        assert b["max_path_length"] == 2


def test_edit_distance_of_fixture(spark, tmp_path):
    targets = spark.createDataFrame([("t", "100")], "target string, asn string")
    rows = relevant_updates(updates(spark, tmp_path), targets, FE.FEATURE_INPUT)
    edits = [r["edit"] for r in FE.route_changes(rows, "global").where("edit IS NOT NULL").orderBy("ts").collect()]
    assert edits == [0, 1]
    per_file = [r["edit"] for r in FE.route_changes(rows, "file").where("edit IS NOT NULL").collect()]
    assert per_file == [0]  # the second bucket starts without state


def test_busy_histories_are_cut_without_a_trace(spark):
    rng = random.Random(5)
    data = [(i, rng.randrange(0, 40_000), rng.choice("ab"), rng.choice([None, 1, 2, 3])) for i in range(400)]
    df = spark.createDataFrame(data, "seq int, s bigint, k string, v int").withColumn("ts", T.from_seconds(F.col("s")))
    plain = FE._before(df, ["k"], {"p": "v"})
    cut = FE.before_across(df, ["k"], {"p": "v"}, 600, FE.busy_keys(df, ["k"], 10))
    want = {r["seq"]: r["p"] for r in plain.collect()}
    assert {r["seq"]: r["p"] for r in cut.collect()} == want
    one = FE.before_across(df, ["k"], {"p": "v"}, 600, spark.createDataFrame([("a",)], "k string"))
    assert {r["seq"]: r["p"] for r in one.collect()} == want


def test_busy_prefixes_leave_the_series_alone(spark):
    rng = random.Random(8)
    paths = ["1 2 3", "1 3", "1 4 3", "2 5", "1 2 5 3"]
    data = [(i, rng.randrange(0, 20_000), rng.choice("AAW"), rng.choice("pq"), rng.choice(paths)) for i in range(300)]
    df = spark.createDataFrame(data, "seq int, s bigint, aw string, prefix string, path string")
    path = F.when(F.col("aw") == "A", F.col("path")).otherwise("")
    u = df.select("seq", T.from_seconds(F.col("s")).alias("ts"), "aw", F.lit(1).cast("bigint").alias("peer_as"), "prefix",
                  path.alias("as_path"), F.filter(F.split(path, " "), lambda h: h != "").alias("hops"))
    targets = spark.createDataFrame([("t", "1"), ("t", "3"), ("v", "5")], "target string, asn string")
    plain = FE.feature_series(relevant_updates(u, targets, FE.FEATURE_INPUT, 5000), 5000)
    busy = FE.busy_keys(u, ["prefix"], 10)
    assert busy.count() == 2
    cut = FE.feature_series(relevant_updates(u, targets, FE.FEATURE_INPUT, 5000, busy=busy, piece=100), 5000)
    whole = FE.feature_series(relevant_updates(u, targets, FE.FEATURE_INPUT), 5000, "global", u.limit(0).select("prefix"))
    cut_whole = FE.feature_series(relevant_updates(u, targets, FE.FEATURE_INPUT, in_order=True, busy=busy, piece=100), 5000, "global", busy)

    def table(series):
        return {(r["target"], r["bucket"]): {k: round(float(v), 9) for k, v in r.asDict().items() if k not in ("target", "bucket")} for r in series.collect()}

    assert table(cut) == table(plain)
    assert table(cut_whole) == table(whole)


def test_outage_score(spark):
    cols = ", ".join(f"{n} double" for n in O.SUMMED)
    values = {n: 0.0 for n in O.SUMMED} | {"announcement_count": 10.0, "withdrawal_count": 50.0}
    totals = spark.createDataFrame([("t", *values.values())], f"target string, {cols}")
    base = spark.createDataFrame([("t", "announcement_count", 100.0, 1.0), ("t", "withdrawal_count", 10.0, 1.0), ("t", "total_messages", 0.0, 0.0)],
                                 "target string, feature string, mean double, std double")
    r = O.score(totals.join(O.wide_baseline(base, ["target"]), "target")).first()
    assert round(r["score"], 9) == 0.55
    assert r["indicators"] == ["announcement_drop", "withdrawal_surge"]


def test_sliding_windows_keep_the_tail(spark):
    n = 15
    cols = [*O.SUMMED, "avg_path_length", "max_path_length", "min_path_length"]
    df = spark.range(n).select(F.lit("t").alias("target"), (F.col("id") * 300).alias("bucket"), *[F.lit(1).alias(c) for c in cols])
    got = sorted((r["win"], r["win_start"] // 300, r["buckets"]) for r in O.sliding_totals(df, ["target"], 12, 6).collect())
    assert got == [(0, 0, 12), (1, 6, 9), (2, 12, 3)]


def test_period_plans():
    assert B.period_plan("weekly") == (4, 7 * 86400)
    assert B.period_plan("daily") == (7, 86400)
    assert B.period_plan("6h") == (4, 21600)
    assert B.period_plan("2h") == (12, 7200)
    assert B.period_plan(None) == (0, 86400)


def test_runs_and_sessions(spark, rows):
    idx = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 7, 8, 8)], "idx int").withColumn("k", F.lit("x"))
    assert rows(Q.keep_runs(idx, ["k"]), "idx") == [(1,), (2,), (3,), (4,)]
    assert rows(Q.run_windows(idx, ["k"]), "first", "last", "points") == [(1, 4, 4)]
    mins = spark.createDataFrame([(m,) for m in (0, 30, 90, 200)], "m int").select(F.lit("x").alias("k"), T.from_seconds(F.col("m").cast("bigint") * 60 + 86400 * 5).alias("ts"))
    got = Q.sessions(mins, ["k"]).select(T.text(F.col("start")), T.text(F.col("end")), "n").collect()
    assert [tuple(r) for r in got] == [("1970-01-06 00:00:00", "1970-01-06 01:30:00", 3)]
    wide = Q.widest_session(mins, ["k"]).select(T.text(F.col("start")), T.text(F.col("end"))).first()
    assert tuple(wide) == ("1970-01-05 22:00:00", "1970-01-06 03:30:00")


def test_sessions_over_pieces(spark):
    rng = random.Random(11)
    secs = sorted(rng.randrange(0, 500_000) for _ in range(250))
    df = spark.createDataFrame([(s,) for s in secs], "s bigint").select(F.lit("x").alias("k"), T.from_seconds(F.col("s")).alias("ts"))
    want, cur = [], [secs[0]]
    for s in secs[1:]:
        if s - cur[-1] <= 3600:
            cur.append(s)
        else:
            want.append(cur)
            cur = [s]
    want.append(cur)
    got = sorted((r["a"], r["b"], r["n"]) for r in Q.sessions(df, ["k"], fewest=1, piece=5000).select(
        T.seconds(F.col("start")).alias("a"), T.seconds(F.col("end")).alias("b"), "n").collect())
    assert got == [(w[0], w[-1], len(w)) for w in want]


def test_states_merge_to_any_width(spark, tmp_path):
    """Windows merged from five-minute states, written in two goes, against a plain count of what they cover."""
    rng = random.Random(5)
    rows = [(i, rng.randrange(0, 4 * 3600), rng.choice("AAAW"), rng.randrange(1, 4), f"10.0.{rng.randrange(6)}.0/24", " ".join(str(rng.randrange(1, 9)) for _ in range(3))) for i in range(400)]
    rows = [(i, s, aw, peer, prefix, path if aw == "A" else "") for i, s, aw, peer, prefix, path in rows]
    df = spark.createDataFrame(rows, "seq int, s bigint, aw string, peer_as bigint, prefix string, as_path string")
    hops = F.filter(F.split("as_path", " "), lambda h: h != "")
    df = df.select("seq", T.from_seconds(F.col("s")).alias("ts"), "aw", "peer_as", "prefix", "as_path", hops.alias("hops"), F.lit("t").alias("target"), "s")
    for part in (F.col("s") < 6000, F.col("s") >= 6000):
        FE.bucket_states(df.where(part).drop("s")).write.mode("append").parquet(str(tmp_path / "states"))
    states = spark.read.parquet(str(tmp_path / "states"))
    for width, slide in ((3600, 1800), (3600, 3600), (900, 300)):
        got = {r["bucket"]: r for r in FE.series_of(FE.merge_states(states, width, slide)).collect()}
        want = {}
        for i, s, aw, peer, prefix, path in rows:
            for k in range(width // slide):
                want.setdefault(s // slide * slide - k * slide, []).append((aw, peer, prefix, path))
        assert set(got) == set(want)
        for b, own in want.items():
            r = got[b]
            assert r["total_messages"] == len(own) and r["announcement_count"] == sum(x[0] == "A" for x in own)
            assert r["unique_prefix_count"] == len({x[2] for x in own})
            assert r["unique_peer_as_count"] == len({x[1] for x in own if x[0] == "A"})
            assert r["unique_as_count"] == len({h for x in own for h in x[3].split()})
            both = {x[2] for x in own if x[0] == "A"} & {x[2] for x in own if x[0] == "W"}
            assert r["flapping_prefix_count"] == len(both)
    with pytest.raises(ValueError):
        FE.merge_states(states, 3600, 1000)


def test_only_rows_of_a_prefix_carry_what_messages_add(spark):
    rows = [(1, 0, "A", "10.0.0.0/24", "1 2"), (2, 10, "A", "10.0.0.0/24", "1 2"), (3, 20, "W", "10.0.0.0/24", "")]
    df = spark.createDataFrame(rows, "seq int, s bigint, aw string, prefix string, as_path string")
    hops = F.filter(F.split("as_path", " "), lambda h: h != "")
    df = df.select("seq", T.from_seconds(F.col("s")).alias("ts"), "aw", F.lit(1).cast("bigint").alias("peer_as"), "prefix", "as_path", hops.alias("hops"), F.lit("t").alias("target"))
    got = {(r["kind"], r["value"]): r for r in FE.bucket_states(df).collect()}
    own = got["prefix", "10.0.0.0/24"]
    assert (own["n"], own["a"], own["w"], own["t0"], own["t1"], own["len_sum"], own["dup_a"]) == (3, 2, 1, 0, 20, 4, 1)
    hop = got["as", "2"]
    assert (hop["n"], hop["a"], hop["t0"], hop["len_sum"], hop["dup_a"]) == (2, 0, None, None, None)
    assert got["edit", "0"]["n"] == 1 and got["peer", "1"]["n"] == 2


def test_messages_meet_targets_without_a_shuffle_of_their_own(spark, tmp_path):
    from routescope.operators.relevance import relevant_updates
    from routescope.sources import adapters as A

    folder = str(tmp_path)
    spark.range(50_000).selectExpr("id AS s_suppkey", "concat('S', id) AS s_name", "CAST(id % 25 AS int) AS s_nationkey").write.parquet(f"{folder}/supplier.parquet")
    spark.range(25).selectExpr("CAST(id AS int) AS n_nationkey", "concat('N', id) AS n_name").write.parquet(f"{folder}/nation.parquet")
    u = spark.range(100).selectExpr("id AS seq", "CAST(timestamp_seconds(id) AS timestamp_ntz) AS ts", "'A' AS aw", "id AS peer_as", "'p' AS prefix", "'1 2' AS as_path", "array('1', '2') AS hops")
    targets = A.targets(spark, folder)
    assert targets.count() == 50_000
    assert "Join" not in targets._jdf.queryExecution().optimizedPlan().toString()  # its true size is known
    plan = relevant_updates(u, targets, FE.FEATURE_INPUT, bucket=300)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_messages_dealt_by_bucket_give_the_same_series_in_one_shuffle(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        hops = [str(rng.randrange(1, 7)) for _ in range(4)]
        aw = rng.choice("AAAW")
        rows.append((i % 390, rng.randrange(0, 3000), aw, int(hops[0]), f"10.0.{rng.randrange(3)}.0/24",
                     " ".join(hops) if aw == "A" else "", hops if aw == "A" else []))
    u = spark.createDataFrame(rows, "seq long, s long, aw string, peer_as long, prefix string, as_path string, hops array<string>")
    u.withColumn("ts", T.from_seconds(F.col("s"))).drop("s").write.parquet(str(tmp_path / "u"))
    u = spark.read.parquet(str(tmp_path / "u"))
    spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "3"), ("y", "1")], "target string, asn string").write.parquet(str(tmp_path / "t"))
    targets = spark.read.parquet(str(tmp_path / "t"))
    assert FE.bucket_tasks(u, 300) == 1 and FE.bucket_tasks(u, 300, per_task=100) == 4
    assert FE.bucket_tasks(u, 300, most=5) is None and FE.bucket_tasks(u.limit(0), 300) == 1
    plain = FE.feature_series(relevant_updates(u, targets, FE.FEATURE_INPUT, 300), 300)
    dealt = FE.feature_series(relevant_updates(u, targets, FE.FEATURE_INPUT, 300, spread=4), 300)
    show = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert show(plain) == show(dealt)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(bucket") == 1 and "hashpartitioning(target#" in plan and "prefix#" not in "".join(x for x in plan.split("\n") if "Exchange" in x)


def test_the_stored_series_needs_no_stored_states(spark, tmp_path, monkeypatch):
    from routescope.plans import q_features as Q_

    monkeypatch.setattr(Q_, "landed", lambda spark, d, name, build, *rest: (name, build))
    assert Q_.series(spark, "x") == ("feature_series", Q_._series)

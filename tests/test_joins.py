import ipaddress
import random

from pyspark.sql import functions as F

from routescope.functions import times as T
from routescope.operators import frequency, intervals, links, lookups, prefix_join

EDGES = [("100", "200", -1), ("200", "300", -1), ("300", "400", 0)]


def edges(spark):
    return spark.createDataFrame(EDGES, "as1 string, as2 string, rel int")


def test_parents_by_hand(spark, rows):
    owned = spark.createDataFrame([("10.0.0.0/16", 0, "300"), ("10.0.0.0/24", 0, "300"), ("2001:db8::/32", 0, "500")], "prefix string, ord int, origin string")
    kids = spark.createDataFrame([(p,) for p in ("10.0.1.0/24", "10.0.0.0/25", "2001:db8:1::/48", "11.0.0.0/8", "10.0.0.0/16")], "prefix string")
    assert rows(prefix_join.longest_parent(kids, owned)) == [
        ("10.0.0.0/25", "10.0.0.0/24"), ("10.0.1.0/24", "10.0.0.0/16"), ("2001:db8:1::/48", "2001:db8::/32"),
    ]


def test_parents_against_ipaddress(spark):
    rng = random.Random(7)

    def v4():
        n = rng.randrange(4, 30)
        return str(ipaddress.ip_network((rng.getrandbits(6) << 26, n), strict=False))

    def v6():
        n = rng.randrange(8, 60)
        return str(ipaddress.ip_network(((rng.getrandbits(5) << 123) | (rng.getrandbits(8) << 80), n), strict=False))

    owned = sorted({v4() for _ in range(60)} | {v6() for _ in range(40)})
    kids = sorted({v4() for _ in range(80)} | {v6() for _ in range(40)})
    got = {
        r["prefix"]: r["parent"]
        for r in prefix_join.longest_parent(
            spark.createDataFrame([(k,) for k in kids], "prefix string"), spark.createDataFrame([(o,) for o in owned], "prefix string")
        ).collect()
    }
    for k in kids:
        net = ipaddress.ip_network(k)
        over = [o for o in map(ipaddress.ip_network, owned) if o.version == net.version and o.prefixlen < net.prefixlen and o.supernet_of(net)]
        want = str(max(over, key=lambda o: o.prefixlen)) if over else None
        assert got.get(k) == want, k


def test_fake_links(spark, rows):
    u = spark.createDataFrame([(1, ["100", "200", "400"]), (2, ["300", "200", "100"]), (3, ["7"])], "seq int, hops array<string>")
    fakes = links.fake_links(u, edges(spark), ["seq"])
    assert rows(fakes, "seq", "as1", "as2") == [(1, "200", "400")]


def test_neighbours(spark):
    got = {r["asn"]: r for r in lookups.relationship_summary(edges(spark)).collect()}
    assert got["100"]["customers"] == [200]
    assert got["400"]["peers"] == [300]
    assert got["200"]["providers"] == [100]


def test_unknown_organisation(spark):
    aut = spark.createDataFrame([("200", "NET-TWO", "ORG-2")], "asn string, aut_name string, org_id string")
    org = spark.createDataFrame([("ORG-2", "20240101", "Two Networks", "NL", "RIR")], "org_id string, changed string, name string, country string, source string")
    asns = spark.createDataFrame([("200",), ("9",)], "asn string")
    got = {r["asn"]: (r["found"], r["org_name"], r["country"]) for r in lookups.organisations(asns, aut, org).collect()}
    assert got == {"200": (True, "Two Networks", "NL"), "9": (False, "Unknown", "Unknown")}


def test_snapshots(spark):
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-20",), ("2024-03-05",)], "day string").select(F.col("day").cast("date").alias("day"))
    snaps = spark.createDataFrame([("2024-01-10",), ("2024-01-15",)], "snap string").select(F.col("snap").cast("date").alias("snap"))
    got = {str(r["day"]): str(r["snapshot"]) for r in lookups.snapshot_as_of(days, snaps).collect()}
    assert got == {"2024-01-01": "2024-01-10", "2024-01-20": "2024-01-15", "2024-03-05": "2024-01-15"}


def _times(spark, secs, **extra):
    cols = ", ".join(f"{v} as {k}" for k, v in extra.items())
    df = spark.createDataFrame([(s,) for s in secs], "s bigint").withColumn("ts", T.from_seconds(F.col("s")))
    return df.selectExpr("*", *([cols] if cols else []))


def test_near_in_time(spark, rows):
    left = _times(spark, [0, 3600, 10_000, 20_000])
    near = intervals.near_in_time(left, _times(spark, [3599, 12_000]))
    assert rows(near, "s") == [(0,), (10_000,), (3600,)]


def test_windows_cross_slots(spark):
    win = _times(spark, [0]).select(F.lit("w").alias("event_name"), T.from_seconds(F.lit(80_000)).alias("start"), T.from_seconds(F.lit(260_000)).alias("end"))
    pts = _times(spark, [79_999, 80_000, 200_000, 260_000, 260_001])
    assert sorted(r["s"] for r in intervals.in_windows(pts, win).collect()) == [80_000, 200_000, 260_000]


def test_updates_until(spark):
    rng = random.Random(3)
    secs = [rng.randrange(0, 400_000) for _ in range(300)]
    asked = [rng.randrange(-10, 420_000) for _ in range(50)]
    got = {r["t"]: r["until"] for r in frequency.updates_until(_times(spark, secs), spark.createDataFrame([(a,) for a in asked], "t bigint")).collect()}
    assert got == {a: sum(s <= a for s in secs) for a in asked}


def test_pair_never_seen_is_suspicious(spark):
    u = _times(spark, [0, 60]).withColumn("hops", F.array(F.lit("1"), F.lit("2")))
    pairs = spark.createDataFrame([("8", "9"), ("1", "2")], "as1 string, as2 string")
    got = {(r["as1"], r["as2"]): (r["n"], r["total"], r["suspicious"]) for r in frequency.rarity_verdicts(u, pairs).collect()}
    assert got == {("8", "9"): (0, 0, True), ("1", "2"): (2, 2, False)}


def test_facts_of_paths_are_found_once_and_joined_by_path(spark):
    u = spark.createDataFrame([(1, ["100", "200", "400"]), (2, ["100", "200", "400"]), (3, ["400", "200", "9"]), (4, ["7"]), (5, []), (6, None)], "seq int, hops array<string>")
    assert links.path_dictionary(u).count() == 2
    known = links.with_path_facts(u, links.fake_paths(u, edges(spark)), "left").select("seq", links.fake_link_text("fakes").alias("t"), links.fake_link_text("fakes", True).alias("f"))
    got = {r["seq"]: (r["t"], r["f"]) for r in known.collect()}
    assert got[1] == got[2] == ("200-400", "200-400") and got[3] == ("400-200;200-9", "400-200") and got[4][1] is None and got[6][1] is None
    assert "hashpartitioning(seq" not in known._jdf.queryExecution().executedPlan().toString()


def test_verdicts_as_of_asked_times(spark):
    day = 86400
    seen = [(1, 0, "1 2 3"), (2, day, "1 2"), (3, day + 5, "4 5"), (4, 8 * day, "1 2 1 2"), (5, 8 * day + 1, "4 5"), (6, 30 * day, "1 2")]
    u = spark.createDataFrame(seen, "seq int, s bigint, p string").select("seq", T.from_seconds(F.col("s")).alias("ts"), F.split("p", " ").alias("hops"))
    asked = [("1", "2", 0, 0), ("1", "2", 1, 8 * day), ("1", "2", 8, None), ("1", "2", 8, 100 * day), ("9", "8", 8, 8 * day + 1), ("1", "2", 50, 100 * day), ("1", "2", 1, 8 * day)]
    q = spark.createDataFrame(asked, "as1 string, as2 string, d int, t_end bigint").select("as1", "as2", F.date_from_unix_date("d").alias("day"), "t_end")
    got = {(r["as1"], r["day"].toordinal() - 719163, r["t_end"]): (r["coverage"], r["n"], r["total"]) for r in frequency.rarity_as_of(u, q).collect()}
    assert got == {
        ("1", 0, 0): ("7d_window", 1, 1), ("1", 1, 8 * day): ("7d_window", 2, 3), ("1", 8, None): ("single_day", 1, 2),
        ("1", 8, 100 * day): ("single_day", 1, 2), ("9", 8, 8 * day + 1): ("7d_window", 0, 3), ("1", 50, 100 * day): ("insufficient", 0, 0)}


def test_related_hops_against_all_pairs(spark):
    paths = [["1", "2", "3"], ["3", "1", "1"], ["1", None, "2"], ["1", "2"], ["7"], [], ["2", "1", "2"], ["4", "5"], ["1", "2", "3"]]
    edges = [("1", "2"), ("3", "2"), ("2", "3"), ("5", "5"), ("4", None)]
    tied = {frozenset(e) for e in edges if None not in e and e[0] != e[1]}
    want = {(tuple(p), a) for p in paths for a in p for b in p if frozenset((a, b)) in tied}
    r = links.related_to_path(
        spark.createDataFrame([(p,) for p in paths], "hops array<string>"), spark.createDataFrame(edges, "as1 string, as2 string")
    )
    got = [(tuple(x["hops"]), x["asn"]) for x in r.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    plan = r._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Join LeftSemi" in line)
    assert "hops#" not in plan[at + 1].split("filter(")[0]  # pairs travel under the path's id

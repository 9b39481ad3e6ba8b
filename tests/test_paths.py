import random

from pyspark.sql import functions as F

from routescope.functions import paths as P
from routescope.functions import prefixes as X
from routescope.functions import text as W
from routescope.functions import times as T


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("x")).first()["x"]


def test_parse_and_collapse(spark):
    c = F.col("p")
    assert one(spark, P.parse_path(c), p="174|20946|1299|7922") == ["174", "20946", "1299", "7922"]
    assert one(spark, P.parse_path(c), p="") == []
    assert one(spark, P.collapse_prepends(P.parse_path(c)), p="1 1 2 2 1") == ["1", "2", "1"]
    assert one(spark, P.numeric_hops(c), p="100 {500,600} 400 100") == ["100", "400"]


def test_pairs_guard_short_paths(spark):
    c = P.parse_path(F.col("p"))
    assert one(spark, P.adjacent_pairs(c), p="1") == []
    assert [tuple(r) for r in one(spark, P.adjacent_pairs(c), p="1 2 3")] == [("1", "2"), ("2", "3")]
    assert one(spark, P.returns_to_hop(c), p="1 2 1") == 1
    assert one(spark, P.returns_to_hop(c), p="1 2") == 0


def test_membership_is_by_token(spark):
    c = P.parse_path(F.col("p"))
    assert one(spark, P.path_has_any(c, ["12"]), p="312 4") is False
    assert one(spark, P.path_has_any(c, ["312"]), p="312 4") is True


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_both_ways(spark):
    rng = random.Random(1)
    cases = [([str(rng.randrange(6)) for _ in range(rng.randrange(7))], [str(rng.randrange(6)) for _ in range(rng.randrange(7))]) for _ in range(60)]
    long = [str(i) for i in range(170)]
    cases.append((long, long[5:] + ["x"]))  # more hops than letters
    df = spark.createDataFrame(cases, "a array<string>, b array<string>")
    got = df.select(P.edit_distance(F.col("a"), F.col("b")).alias("d"), P.edit_distance_rows(F.col("a"), F.col("b")).alias("r")).collect()
    want = [_levenshtein(a, b) for a, b in cases]
    assert [g["d"] for g in got] == want
    assert [g["r"] for g in got] == want


def test_leak_fold(spark):
    kind = "array<struct<pos:int,p2c:double,c2p:double>>"
    df = spark.createDataFrame([([(0, 0.1, 0.8), (1, 0.7, 0.2)],), ([(2, 0.5, 0.2)],), ([],)], f"links {kind}")
    got = [round(r["p"], 9) for r in df.select(P.leak_probability(F.col("links")).alias("p")).collect()]
    assert got == [0.94, 1.0, 1.0]


def test_prefix_bits(spark):
    c = F.col("p")
    assert one(spark, X.bits(c), p="10.0.0.0/8") == "00001010"
    assert one(spark, X.bits(c), p="2001:db8::/32") == "00100000000000010000110110111000"
    assert one(spark, X.bits(c), p="::/0") == ""
    assert one(spark, X.bits(c), p="10.0.0.0/40") is None
    assert one(spark, X.bits(c), p="nonsense") is None
    assert one(spark, X.is_subprefix(F.col("a"), F.col("b")), a="10.0.0.0/24", b="10.0.0.0/16") is True
    assert one(spark, X.is_subprefix(F.col("a"), F.col("b")), a="10.0.0.0/16", b="10.0.0.0/16") is False
    assert one(spark, X.overlaps(F.col("a"), F.col("b")), a="10.0.0.0/8", b="10.2.0.0/16") is True


def test_times(spark):
    c = F.col("t")
    for raw in ("2024/01/02 03:04", "2024-01-02 03:04:00", "2024:01:02 03:04", "2024-01-02T03:04:00Z", "01/02/24 03:04:00", "1704164640"):
        assert one(spark, T.text(T.parse_time(c)), t=raw) == "2024-01-02 03:04:00", raw
    assert one(spark, T.text(T.parse_two_digit_year(c)), t="12/31/99 23:59") == "1999-12-31 23:59:00"
    assert one(spark, T.parse_time(c), t="no time") is None
    assert one(spark, T.text(T.bucket_start(T.parse_time(c))), t="2024-01-01 00:09:59") == "2024-01-01 00:05:00"


def test_text(spark):
    c = F.col("t")
    assert one(spark, W.parse_as_list(c), t="AS100、200, as300") == ["100", "200", "300"]
    assert one(spark, W.parse_as_list(c), t="") == []
    assert one(spark, W.normalise_asn(c), t="AS0200") == "200"
    assert one(spark, W.as_list_text(c), t="as1、2") == "AS1 / AS2"
    start, end = W.time_range(c)
    text = "network outage in Norland from 2024-1-2 3:04 to 2024-01-02 05:06 at AS10 and as2"
    assert one(spark, start, t=text) == "2024-01-02 03:04"
    assert one(spark, end, t=text) == "2024-01-02 05:06"
    assert one(spark, W.region(c), t=text) == "Norland"
    assert one(spark, W.mentioned_asns(c), t=text) == ["2", "10"]


def test_dominant_paths_of_whole_prefixes(spark, rows, monkeypatch):
    from routescope.plans import catalog
    from routescope.sources import adapters

    seen = {"10.0.1.0/24": ["1 2"] * 3 + ["1 3 3 3 3 3 2"] * 2, "10.0.2.0/24": ["5 6"] * 4, "2001:db8::/32": ["7 8"] * 3 + ["7 9 8"] * 2, "2001:db9::/32": ["4 8"] * 9}
    data = [("A", prefix, path, path.split(" ")) for prefix, paths in seen.items() for path in paths]
    u = spark.createDataFrame(data, "aw string, prefix string, as_path string, hops array<string>")
    monkeypatch.setattr(adapters, "updates", lambda spark, d: u)
    got = rows(catalog.QUERIES["D17_dominant_path_prefix"](spark, ""), "prefix", "expected", "expected_n", "path", "n")
    assert got == [("10.0.1.0/24", "1 2", 3, "1 3 3 3 3 3 2", 2), ("2001:db8::/32", "7 8", 3, "7 9 8", 2)]
    assert rows(catalog.QUERIES["F34_path_length_tags_prefix"](spark, "")) == [("10.0.1.0/24", "1 3 3 3 3 3 2", 5)]

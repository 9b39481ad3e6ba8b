"""Routing-shaped views of the supplied tables.

``derive_*`` state the views; ``paths``, ``updates``, ``prefix2as``, ``asrel`` and
``asprob`` are those views landed once in the shared folder (see ``landing``).

Nothing here is collected or broadcast by hint. A path is the hops of an order, one
per line number, so it is short however many lines an order has: lines are dealt by order
once, and the first grouping leaves one row per (order, line number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routescope.functions import paths as P
from routescope.functions import times as T
from routescope.sources.landing import landed, landed_feed, landed_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def derive_paths(spark: SparkSession, folder: str) -> DataFrame:
    """(l_orderkey, raw, hops): raw repeats a hop whose line has a large quantity."""
    hops = (
        table(spark, folder, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
        .repartition("l_orderkey")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_suppkey").alias("hop"), F.max("l_quantity").alias("q"))
    )
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "hop", "q")))
    raw = F.flatten(
        F.transform(
            F.col("lines"),
            lambda x: F.array_repeat(
                x["hop"].cast("string"), F.when(x["q"] >= 45, 2).otherwise(1)
            ),
        )
    )
    return (
        hops.groupBy("l_orderkey")
        .agg(lines.alias("lines"))
        .select("l_orderkey", raw.alias("raw"))
        .select("l_orderkey", "raw", P.collapse_prepends(F.col("raw")).alias("hops"))
    )


def _subnet(user: Column, tail: str) -> Column:
    high = (F.lit(10) + F.pmod(F.expr("user_id div 65536"), F.lit(200))).cast("string")
    mid = F.pmod(F.expr("user_id div 256"), F.lit(256)).cast("string")
    if tail == "/16":
        return F.concat(high, F.lit("."), mid, F.lit(".0.0/16"))
    return F.concat(high, F.lit("."), mid, F.lit("."), F.pmod(user, F.lit(256)).cast("string"), F.lit(".0"), F.lit(tail))


def derive_updates(spark: SparkSession, folder: str) -> DataFrame:
    """Update messages: an event carries the path of the order with its number."""
    e = table(spark, folder, "events")
    user = F.col("user_id")
    announced = F.col("event_type") != "error"
    empty = F.array().cast("array<string>")
    return (
        e.join(paths(spark, folder), e["event_id"] == F.col("l_orderkey"))
        .select(
            F.col("event_id").alias("seq"),
            F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"),
            F.when(announced, "A").otherwise("W").alias("aw"),
            F.concat(F.lit("192.0.2."), F.pmod(user, F.lit(256)).cast("string")).alias("peer_ip"),
            F.get("raw", F.lit(0)).cast("bigint").alias("peer_as"),
            F.when(F.col("value") >= 100, _subnet(user, "/25")).otherwise(_subnet(user, "/24")).alias("prefix"),
            F.when(announced, F.array_join("raw", " ")).otherwise("").alias("as_path"),
            F.when(announced, F.col("hops")).otherwise(empty).alias("hops"),
            user.alias("user_id"),
            F.col("value").alias("volume"),
        )
        .withColumn("origin_as", P.origin(F.col("hops")))
        .withColumn("date", F.col("ts").cast("date"))
    )


def _time_ordered_updates(spark: SparkSession, folder: str) -> DataFrame:
    """Split by time, so each task writes one or two days, a busy day is spread over
    several files, and the files' time bounds are narrow."""
    return derive_updates(spark, folder).repartitionByRange("ts", "seq").sortWithinPartitions("ts", "seq")


def paths(spark: SparkSession, folder: str) -> DataFrame:
    return landed(spark, folder, "paths", derive_paths)


def updates(spark: SparkSession, folder: str) -> DataFrame:
    return landed(spark, folder, "updates", _time_ordered_updates, ("date",))


def updates_path(spark: SparkSession, folder: str) -> str:
    return landed_path(spark, folder, "updates", _time_ordered_updates, ("date",))


SLICES, SLICE_FILES = 6, 2  # of a feed: streams take it in so many batches
LATE_EVERY, LATE_BY = 50, 3  # in the late feed one update in so many comes so many slices late


def _slices(spark: SparkSession, folder: str) -> DataFrame:
    """Updates with the part of the covered time they fall in."""
    u = updates(spark, folder).drop("date")
    s = T.seconds(F.col("ts"))
    first, last = u.agg(F.min(s), F.max(s)).first()  # two numbers
    span = 1 if first is None else last - first + 1
    return u.withColumn("slice", F.floor((s - F.lit(first or 0)) * SLICES / F.lit(span)).cast("int"))


def _late_slices(spark: SparkSession, folder: str) -> DataFrame:
    late = F.pmod("seq", F.lit(LATE_EVERY)) == 7
    return _slices(spark, folder).withColumn("slice", F.when(late, F.least(F.col("slice") + LATE_BY, F.lit(SLICES - 1))).otherwise(F.col("slice")))


def feed_path(spark: SparkSession, folder: str) -> str:
    return landed_feed(spark, folder, "feed", _slices, SLICES, SLICE_FILES)


def late_feed_path(spark: SparkSession, folder: str) -> str:
    return landed_feed(spark, folder, "late_feed", _late_slices, SLICES, SLICE_FILES)


def prefix2as(spark: SparkSession, folder: str) -> DataFrame:
    return landed(spark, folder, "prefix2as", derive_prefix2as)


def asrel(spark: SparkSession, folder: str) -> DataFrame:
    return landed(spark, folder, "asrel", derive_asrel)


def asprob(spark: SparkSession, folder: str) -> DataFrame:
    return landed(spark, folder, "asprob", derive_asprob)


def derive_prefix2as(spark: SparkSession, folder: str) -> DataFrame:
    """(prefix, ord, origin): /24s of even users, with a second owner on every fourth,
    and a /16 over every block of users."""
    a = updates(spark, folder).where("aw = 'A'")
    order = F.struct("ts", "seq")
    user = F.col("user_id")
    exact = (
        a.where("user_id % 2 = 0")
        .groupBy("user_id")
        .agg(F.min_by("origin_as", order).alias("o1"), F.max_by("origin_as", order).alias("o2"))
        .select(
            _subnet(user, "/24").alias("prefix"),
            F.when((user % 4 == 0) & (F.col("o1") != F.col("o2")), F.array("o1", "o2"))
            .otherwise(F.array("o1")).alias("o"),
        )
    )
    block = (
        a.groupBy(_subnet(user, "/16").alias("prefix"), "origin_as")
        .count()
        .groupBy("prefix")
        .agg(F.max_by("origin_as", F.struct("count", -F.col("origin_as").cast("bigint"))).alias("o1"))
        .select("prefix", F.array("o1").alias("o"))
    )
    return exact.unionByName(block).select("prefix", F.posexplode("o").alias("ord", "origin"))


def links(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct undirected links of all paths, as numbers lo < hi."""
    pair = F.explode(P.adjacent_pairs(F.col("hops"))).alias("p")
    both = paths(spark, folder).select(pair).select(
        F.col("p.as1").cast("bigint").alias("a"), F.col("p.as2").cast("bigint").alias("b")
    )
    return both.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()


def derive_asrel(spark: SparkSession, folder: str) -> DataFrame:
    """Relationship edges; a quarter of the observed links has none."""
    x = F.pmod(3 * F.col("lo") + 5 * F.col("hi"), F.lit(8))
    lo, hi = F.col("lo").cast("string"), F.col("hi").cast("string")
    swapped = x.isin(2, 3)
    return (
        links(spark, folder)
        .where(x < 6)
        .select(
            F.when(swapped, hi).otherwise(lo).alias("as1"),
            F.when(swapped, lo).otherwise(hi).alias("as2"),
            F.when(x < 4, -1).otherwise(0).alias("rel"),
        )
    )


def derive_asprob(spark: SparkSession, folder: str) -> DataFrame:
    """Link probabilities in numeric order of the ends; some links are unknown."""
    x = F.pmod(7 * F.col("lo") + 3 * F.col("hi"), F.lit(11))
    return (
        links(spark, folder)
        .where(x < 10)
        .select(
            F.col("lo").cast("string").alias("as1"),
            F.col("hi").cast("string").alias("as2"),
            (x / 10.0).alias("p2c"),
            ((10 - x) / 20.0).alias("p2p"),
            ((10 - x) / 20.0).alias("c2p"),
        )
    )


def aut(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("string").alias("asn"),
        F.col("s_name").alias("aut_name"),
        F.concat(F.lit("ORG-"), F.col("s_nationkey").cast("string")).alias("org_id"),
    )


def org(spark: SparkSession, folder: str) -> DataFrame:
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        F.concat(F.lit("ORG-"), F.col("n_nationkey").cast("string")).alias("org_id"),
        F.lit("20240101").alias("changed"),
        F.col("n_name").alias("name"),
        F.col("r_name").alias("country"),
        F.lit("RIR").alias("source"),
    )


def targets(spark: SparkSession, folder: str) -> DataFrame:
    """Target sets, stored: the planner overrates the size of a join's outcome, and would shuffle the messages to meet it."""
    return landed(spark, folder, "targets", derive_targets)


def derive_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Target sets: the ASes of each nation."""
    s, n = table(spark, folder, "supplier"), table(spark, folder, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        F.col("n_name").alias("target"), F.col("s_suppkey").cast("string").alias("asn")
    )


# Three events of January 2024.
EVENTS = (
    ("hijack", "ev1", "2024/01/08 06:00", "2024-01-09 06:00:00", "AS1、2, as3"),
    ("leak", "ev2", "2024-01-15 00:00", "2024-01-16T00:00:00Z", "AS4/AS5; 6"),
    ("outage", "ev3", "01/25/24 00:00", "1706400000", "AS7, AS8 9"),
)


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    raw = spark.createDataFrame(
        EVENTS, "event_type string, event_name string, start_time string, end_time string, outage_as string"
    )
    return raw.select(
        "event_type", "event_name", "outage_as",
        T.parse_time(F.col("start_time")).alias("start"),
        T.parse_time(F.col("end_time")).alias("end"),
    )


def traffic(spark: SparkSession, folder: str, step: int = 3600) -> DataFrame:
    return landed(spark, folder, f"traffic_{step}", lambda s, f: derive_traffic(s, f, step))


def derive_traffic(spark: SparkSession, folder: str, step: int = 3600) -> DataFrame:
    """(series, idx, ts, value): one point per step, empty steps 0, scaled to the series' top.

    A series has one row per step of the covered time, so it is bounded by the length
    of that time, not by the number of events.
    """
    e = table(spark, folder, "events")
    points = e.groupBy(
        F.col("event_type").alias("series"), T.bucket_seconds(F.col("ts"), step).alias("t")
    ).agg(F.sum("value").alias("v"))
    span = points.groupBy("series").agg(F.max("v").alias("top"))
    t0, t1 = points.agg(F.min("t")).scalar(), points.agg(F.max("t")).scalar()
    grid = span.select("series", "top", t0.alias("t0"), t1.alias("t1")).select(
        "series", "top", "t0", F.explode(F.sequence("t0", "t1", F.lit(step).cast("bigint"))).alias("t")
    )
    return grid.join(points, ["series", "t"], "left").select(
        "series",
        F.expr(f"(t - t0) div {step}").alias("idx"),
        T.from_seconds(F.col("t")).alias("ts"),
        F.coalesce(F.try_divide("v", "top"), F.lit(0.0)).alias("value"),
    )

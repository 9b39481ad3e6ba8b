"""Who an AS is: organisation, neighbours, snapshot choice, country search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "Unknown"


def organisations(asns: DataFrame, aut: DataFrame, org: DataFrame) -> DataFrame:
    """Adds found, aut_name, org_id, org_name, country, source to each ``asn``."""
    orgs = org.select("org_id", F.col("name").alias("org_name"), "country", "source")
    joined = asns.join(aut, "asn", "left").join(orgs, "org_id", "left")
    fill = {n: F.coalesce(n, F.lit(UNKNOWN)) for n in ("aut_name", "org_name", "country", "source")}
    return joined.withColumn("found", F.col("org_id").isNotNull()).withColumns(fill)


def neighbours(edges: DataFrame) -> DataFrame:
    """(asn, kind, other): providers, peers and customers of every AS."""
    p2c, p2p = edges.where("rel = -1"), edges.where("rel = 0")

    def rows(df: DataFrame, me: str, other: str, kind: str) -> DataFrame:
        return df.select(F.col(me).alias("asn"), F.lit(kind).alias("kind"), F.col(other).alias("other"))

    return (
        rows(p2c, "as1", "as2", "customer")
        .unionByName(rows(p2c, "as2", "as1", "provider"))
        .unionByName(rows(p2p, "as1", "as2", "peer"))
        .unionByName(rows(p2p, "as2", "as1", "peer"))
        .distinct()
    )


def relationship_summary(edges: DataFrame) -> DataFrame:
    """Per AS: sorted providers, peers and customers, and their numbers.

    A list holds at most every other AS; edges are distinct before they are gathered.
    """
    def listed(kind: str):
        member = F.when(F.col("kind") == kind, F.col("other").try_cast("bigint"))
        return F.array_sort(F.collect_list(member)).alias(f"{kind}s")

    g = neighbours(edges).groupBy("asn").agg(*[listed(k) for k in ("provider", "peer", "customer")])
    return g.select("*", *[F.size(f"{k}s").cast("bigint").alias(f"n_{k}s") for k in ("provider", "peer", "customer")])


def snapshot_as_of(days: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(day, snapshot): the latest snapshot not after the day, else the earliest.

    Matched within the month; months without one inherit from the last month that had
    one. Days and months are calendar-bounded, so the running choice over months is small.
    """
    d = days.select("day").distinct().withColumn("month", F.trunc("day", "month"))
    s = snapshots.select("snap").distinct().withColumn("month", F.trunc("snap", "month"))
    in_month = d.join(s, "month", "left").groupBy("month", "day").agg(
        F.max(F.when(F.col("snap") <= F.col("day"), F.col("snap"))).alias("own")
    )
    last = s.groupBy("month").agg(F.max("snap").alias("last"))
    months = d.select("month").distinct().join(last, "month", "full").selectExpr(
        "month", "max(last) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier"
    )
    first = s.agg(F.min("snap")).scalar()
    return in_month.join(months, "month", "left").select(
        "day", F.coalesce("own", "earlier", first).alias("snapshot")
    )


def ases_of_country(country: str, aut: DataFrame, org: DataFrame) -> DataFrame:
    """ASes whose country, organisation or own name contains the text."""
    who = organisations(aut.select("asn"), aut, org)
    needle = country.lower()
    hit = F.lit(False)
    for name in ("country", "org_name", "aut_name"):
        hit = hit | F.contains(F.lower(F.col(name)), F.lit(needle))
    return who.where(hit).select("asn", "aut_name", "org_name", "country", "source")


def enrich(results: DataFrame, aut: DataFrame, org: DataFrame, edges: DataFrame, prefix2as: DataFrame) -> DataFrame:
    """Adds organisation, neighbour counts and owned-prefix count to rows with ``asn``."""
    rel = relationship_summary(edges).select("asn", "n_providers", "n_peers", "n_customers")
    owned = prefix2as.select(F.col("origin").alias("asn"), "prefix").distinct().groupBy("asn").agg(
        F.count("*").alias("n_prefixes")
    )
    joined = organisations(results, aut, org).join(rel, "asn", "left").join(owned, "asn", "left")
    return joined.fillna(0, ["n_providers", "n_peers", "n_customers", "n_prefixes"])

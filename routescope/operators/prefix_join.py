"""Prefix lookups as equi-joins.

A prefix is joined to what contains it by listing its possible containers (at most 32
or 128 bit strings, and only the lengths that occur on the other side) and matching
them exactly. Only distinct prefixes are listed out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routescope.functions import prefixes as X


def prefix_origins(prefix2as: DataFrame) -> DataFrame:
    """(prefix, origins): each owner once, in file order, the primary one first.

    Repeated lines are merged before the owners are gathered, so a list is no longer
    than the number of different owners.
    """
    owners = prefix2as.groupBy("prefix", "origin").agg(F.min("ord").alias("ord"))
    listed = F.array_sort(F.collect_list(F.struct("ord", "origin")))
    return owners.groupBy("prefix").agg(F.transform(listed, lambda s: s["origin"]).alias("origins"))


def _keyed(df: DataFrame, name: str) -> DataFrame:
    prefix = F.col(name)
    return df.select(
        name, X.version(prefix).alias("ver"), X.length(prefix).alias("len"), X.bits(prefix).alias("bits")
    ).where(F.col("bits").isNotNull())


def containers(children: DataFrame, parents: DataFrame, strict: bool = True) -> DataFrame:
    """(prefix, parent, parent_len): every parent holding each distinct child prefix."""
    child = _keyed(children.select("prefix").distinct(), "prefix")
    parent = _keyed(parents.select(F.col("prefix").alias("parent")).distinct(), "parent")
    # at most 33 + 129 different values, whatever the size of the table
    known = parent.agg(F.collect_set(F.struct("ver", "len"))).scalar()
    longest = F.col("len") - 1 if strict else F.col("len")
    wanted = F.filter(
        F.sequence(F.lit(0), F.greatest(longest, F.lit(0))),
        lambda n: (n <= longest)
        & F.array_contains(F.col("known"), F.struct(F.col("ver").alias("ver"), n.alias("len"))),
    )
    options = child.select("*", known.alias("known")).select(
        "prefix", "ver", "bits", F.explode(wanted).alias("len")
    )
    options = options.select("prefix", "ver", "len", F.substring("bits", F.lit(1), F.col("len")).alias("bits"))
    return options.join(parent, ["ver", "len", "bits"]).select(
        "prefix", "parent", F.col("len").alias("parent_len")
    )


def longest_parent(children: DataFrame, parents: DataFrame, strict: bool = True) -> DataFrame:
    """(prefix, parent): the most specific container of each child that has one."""
    return containers(children, parents, strict).groupBy("prefix").agg(
        F.max_by("parent", "parent_len").alias("parent")
    )


def covered(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows of ``children`` whose prefix equals or lies under some parent."""
    inside = containers(children, parents, strict=False).select("prefix").distinct()
    return children.join(inside, "prefix", "left_semi")


def conflicts(prefixes: DataFrame, owned: DataFrame) -> DataFrame:
    """(prefix, owned): pairs where either contains the other."""
    down = containers(prefixes, owned, strict=False).select("prefix", F.col("parent").alias("owned"))
    up = containers(owned, prefixes, strict=True).select(
        F.col("parent").alias("prefix"), F.col("prefix").alias("owned")
    )
    return down.unionByName(up).distinct()


def resolve_owners(prefixes: DataFrame, prefix2as: DataFrame) -> DataFrame:
    """(prefix, checked_prefix, origins) by exact match, else by the closest parent."""
    owners = prefix_origins(prefix2as)
    distinct = prefixes.select("prefix").distinct()
    exact = distinct.join(owners, "prefix").select("prefix", F.col("prefix").alias("checked_prefix"), "origins")
    rest = distinct.join(owners, "prefix", "left_anti")
    parents = longest_parent(rest, owners)
    by_parent = parents.join(owners.withColumnRenamed("prefix", "parent"), "parent").select(
        "prefix", F.col("parent").alias("checked_prefix"), "origins"
    )
    return exact.unionByName(by_parent)


def legitimacy(announcements: DataFrame, prefix2as: DataFrame) -> DataFrame:
    """Adds legit, expected_origin and matched_prefix to (prefix, origin_as) rows."""
    found = resolve_owners(announcements, prefix2as)
    owners: Column = F.col("origins")
    legit = F.coalesce(F.array_contains(owners, F.col("origin_as")), F.lit(False))
    return (
        announcements.join(found, "prefix", "left")
        .withColumn("legit", legit)
        .withColumn(
            "expected_origin",
            F.when(legit, F.col("origin_as")).otherwise(F.coalesce(F.get(owners, F.lit(0)), F.lit(""))),
        )
        .withColumn("matched_prefix", F.coalesce("checked_prefix", F.lit("")))
        .drop("checked_prefix", "origins")
    )


def owned_prefixes(prefix2as: DataFrame, asns: DataFrame) -> DataFrame:
    """(asn, prefix): what each wanted AS owns."""
    owners = prefix2as.select(F.col("origin").alias("asn"), "prefix").distinct()
    return owners.join(asns.select("asn").distinct(), "asn", "left_semi")


def existence(prefixes: DataFrame, prefix2as: DataFrame) -> DataFrame:
    """(prefix, present) for each distinct wanted prefix."""
    known = prefix2as.select("prefix").distinct().withColumn("hit", F.lit(True))
    return prefixes.select("prefix").distinct().join(known, "prefix", "left").select(
        "prefix", F.coalesce("hit", F.lit(False)).alias("present")
    )

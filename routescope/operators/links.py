"""Joins of path links with relationship edges and link probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routescope.functions import paths as P


def both_ways(edges: DataFrame) -> DataFrame:
    """(as1, as2) for every related pair, in either order."""
    ab = edges.select("as1", "as2")
    return ab.unionByName(ab.select(F.col("as2").alias("as1"), F.col("as1").alias("as2"))).distinct()


def exploded_links(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per adjacent pair of ``hops``, with its position."""
    return rows.select(*keep, F.posexplode(P.adjacent_pairs(F.col("hops"))).alias("pos", "p")).select(
        *keep, "pos", "p.as1", "p.as2"
    )


def path_id(hops: Column | str = "hops") -> Column:
    """The id of a path in a path dictionary: a digest of its hops."""
    return F.unhex(F.md5(F.array_join(hops, " ")))


def path_dictionary(rows: DataFrame) -> DataFrame:
    """(path_id, hops): every distinct path of two hops or more, once; repeats combine before they are shuffled."""
    long = rows.where(F.size("hops") >= 2).select(path_id().alias("path_id"), "hops")
    return long.groupBy("path_id").agg(F.any_value("hops").alias("hops"))


def fake_paths(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(path_id, fakes): the paths of ``rows`` with links that no relationship explains, and these (pos, as1, as2) in order."""
    unknown = exploded_links(path_dictionary(rows), ["path_id"]).join(both_ways(edges), ["as1", "as2"], "left_anti")
    return unknown.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("pos", "as1", "as2"))).alias("fakes"))


def with_path_facts(rows: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the facts of their paths (path_id, ...), found per path and joined back once."""
    return rows.withColumn("path_id", path_id()).join(facts, "path_id", how).drop("path_id")


def fake_links(rows: DataFrame, edges: DataFrame, keep: list[str]) -> DataFrame:
    """(keep…, pos, as1, as2): links of a path that no relationship explains; each distinct path is looked up once."""
    named = rows.select(*keep, path_id().alias("path_id")).join(fake_paths(rows, edges), "path_id")
    return named.select(*keep, F.explode("fakes").alias("f")).select(*keep, "f.*")


def fake_link_text(fakes: Column | str, first_only: bool = False) -> Column:
    """Fake links in path order as ``a-b;c-d`` (or only the first)."""
    names = F.transform(fakes, lambda s: F.concat_ws("-", s["as1"], s["as2"]))
    return F.get(names, F.lit(0)) if first_only else F.concat_ws(";", names)


def fake_link_list(fakes: DataFrame, key: list[str], first_only: bool = False) -> DataFrame:
    """Per key, the fake links in path order as ``a-b;c-d`` (or only the first)."""
    if first_only:
        name = F.min_by(F.concat_ws("-", "as1", "as2"), "pos")
        return fakes.groupBy(*key).agg(name.alias("fake_links"), F.count("*").alias("n_fake"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "as1", "as2")))
    text = F.concat_ws(";", F.transform(ordered, lambda s: F.concat_ws("-", s["as1"], s["as2"])))
    return fakes.groupBy(*key).agg(text.alias("fake_links"), F.count("*").alias("n_fake"))


def canonical_probabilities(asprob: DataFrame) -> DataFrame:
    """Key each link by string order of its ends, flipping p2c and c2p with it."""
    flip = F.col("as1") > F.col("as2")
    return asprob.select(
        F.least("as1", "as2").alias("k1"),
        F.greatest("as1", "as2").alias("k2"),
        F.when(flip, F.col("c2p")).otherwise(F.col("p2c")).alias("p2c"),
        "p2p",
        F.when(flip, F.col("p2c")).otherwise(F.col("c2p")).alias("c2p"),
    )


def link_probabilities(links: DataFrame, asprob: DataFrame, orientation: str = "travelled") -> DataFrame:
    """Adds p2c and c2p of each link, null where unknown; ``travelled`` reads them in the
    path's direction, ``stored`` as in the file."""
    prob = canonical_probabilities(asprob)
    keyed = links.withColumns(
        {"k1": F.least("as1", "as2"), "k2": F.greatest("as1", "as2")}
    ).join(prob, ["k1", "k2"], "left")
    if orientation == "travelled":
        against = F.col("as1") > F.col("as2")
        up, down = F.col("c2p"), F.col("p2c")
        keyed = keyed.withColumns(
            {"p2c": F.when(against, up).otherwise(down), "c2p": F.when(against, down).otherwise(up)}
        )
    return keyed.drop("k1", "k2")


def leak_scores(paths: DataFrame, asprob: DataFrame, orientation: str = "travelled") -> DataFrame:
    """(hops, prob) of every distinct path with two hops or more; 1.0 where no link is known.

    Work is per distinct path; the list gathered for one is as long as the path.
    """
    distinct = paths.where(F.size("hops") >= 2).select("hops").distinct()
    known = link_probabilities(exploded_links(distinct, ["hops"]), asprob, orientation)
    link = F.when(F.col("p2c").isNotNull(), F.struct("pos", "p2c", "c2p"))
    return known.groupBy("hops").agg(
        P.leak_probability(F.array_sort(F.collect_list(link))).alias("prob")
    )


def related_to_path(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(hops, asn): hops of a path that have a relationship with another hop of it.

    Pairs of hops meet the relationships under the path's id, each pair once; the hops come back to the id at the end."""
    known = F.unhex(F.md5(F.array_join("hops", "\u001f", "\u0000")))  # tells missing hops apart
    dictionary = paths.where(F.size("hops") >= 2).select(known.alias("id"), "hops").groupBy("id").agg(F.any_value("hops").alias("hops"))
    one = dictionary.select("id", F.array_distinct("hops").alias("met")).select("id", "met", F.explode("met").alias("as1"))
    pairs = one.select("id", "as1", F.explode(F.filter("met", lambda h: h > F.col("as1"))).alias("as2"))
    tied = edges.where("as1 <> as2").select(F.least("as1", "as2").alias("as1"), F.greatest("as1", "as2").alias("as2"))
    hits = pairs.join(tied, ["as1", "as2"], "left_semi").select("id", F.explode(F.array("as1", "as2")).alias("asn"))
    related = hits.groupBy("id").agg(F.collect_set("asn").alias("related"))  # as many as a path has hops
    return dictionary.join(related, "id").select("hops", F.explode("related").alias("asn"))

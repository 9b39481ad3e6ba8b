"""Multisets of paths: counts and common endings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def path_counts(announcements: DataFrame, min_length: int = 2) -> DataFrame:
    """(path, n): distinct paths of at least ``min_length`` hops, written with bars."""
    return (
        announcements.where(F.size("hops") >= min_length)
        .groupBy(F.array_join("hops", "|").alias("path"))
        .agg(F.count("*").alias("n"))
    )


def common_endings(paths: DataFrame, share: float = 0.5, maximal: bool = True, shortest: int = 2) -> DataFrame:
    """(ending, length, n, share): endings shared by at least ``max(2, share of paths)``.

    ``paths`` has one row per path in ``hops``. With ``maximal`` an ending is dropped
    when a longer one is shared by the same paths. Every path of a longer ending has the
    shorter one too, so equal counts mean the same paths, and it is enough to look one
    hop further. Endings are counted before the shuffle; no list of paths is kept.
    """
    n = F.size("hops")
    cuts = paths.where(n >= shortest).select(
        "hops", F.explode(F.sequence(F.lit(shortest), n)).alias("length")
    )
    counts = cuts.groupBy(F.slice("hops", -F.col("length"), F.col("length")).alias("tail")).agg(
        F.count("*").alias("n")
    )
    total = paths.agg(F.count("*")).scalar()
    valid = counts.select("tail", "n", total.alias("total")).where(
        F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("total") * share))
    )
    if maximal:
        longer = valid.where(F.size("tail") > shortest).select(
            F.slice("tail", F.lit(2), F.size("tail")).alias("tail"), "n"
        )
        valid = valid.join(longer, ["tail", "n"], "left_anti")
    return valid.select(
        F.array_join("tail", " ").alias("ending"),
        F.size("tail").cast("bigint").alias("length"),
        "n",
        (F.col("n") / F.col("total")).alias("share"),
    )


def best_ending(endings: DataFrame) -> DataFrame:
    """The ending most shared, longest on a tie."""
    return endings.orderBy(F.desc("n"), F.desc("length"), "ending").limit(1)

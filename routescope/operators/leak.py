"""Route leaks: paths whose links make a valley."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routescope.functions import scores as S
from routescope.operators import intervals, links

THRESHOLD = 0.4


def leaks(announcements: DataFrame, asprob: DataFrame, threshold: float = THRESHOLD, orientation: str = "travelled") -> DataFrame:
    """Announcements whose path is valley-free with probability under ``threshold``.

    Each distinct path is scored once.
    """
    scored = links.leak_scores(announcements, asprob, orientation)
    bad = scored.where(F.round("prob", 9) < threshold)
    return announcements.join(bad, "hops").select(
        "*", F.size("hops").alias("path_length"), F.lit(threshold).alias("threshold")
    ).withColumnRenamed("prob", "leak_probability")


def candidates(announcements: DataFrame, windows: DataFrame, targets: DataFrame) -> DataFrame:
    """Announcements crossing a target within its window; repeats of one path, prefix and
    time are dropped. ``windows`` has target, start and end; ``targets`` target and asn."""
    wanted = windows.join(targets, "target")
    crossing = announcements.select("*", F.explode(F.array_distinct("hops")).alias("asn"))
    rows = intervals.in_windows(crossing, wanted, on=["asn"])
    return rows.dropDuplicates(["target", "as_path", "prefix", "ts"])


def leak_groups(found: DataFrame, by: list[str]) -> DataFrame:
    """Leaks per prefix: number, lowest probability, first and last seen, distinct paths."""
    per_path = found.groupBy(*by, "prefix", "as_path").agg(
        F.count("*").alias("n"), F.min("leak_probability").alias("p"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    )
    g = per_path.groupBy(*by, "prefix").agg(
        F.sum("n").alias("n"), F.min("p").alias("min_prob"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), F.count("*").alias("paths"),
    )
    return g.withColumn("band", S.leak_band(F.col("min_prob")))

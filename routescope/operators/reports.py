"""Grouped tables behind the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routescope.functions import scores as S
from routescope.functions import times as T


def hijack_groups(alerts: DataFrame) -> DataFrame:
    """Alerts of one type on one prefix: first and last seen, number, band."""
    g = alerts.groupBy("type", "prefix").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )
    return g.withColumn("band", S.count_band(F.col("n")))


def first_rows(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows per group; each task keeps only ``k`` before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)


def groups_by_origin(alerts: DataFrame, examples: int = 3) -> DataFrame:
    """Alerts per (prefix, origin) with up to three example paths, earliest first."""
    by = ["prefix", "origin_as"]
    counts = alerts.groupBy(*by).agg(F.count("*").alias("n"))
    few = first_rows(alerts.select(*by, "ts", "seq", "type", "target_as", "as_path"), by,
                     ["ts", "seq", "type", "target_as"], examples)
    listed = F.array_sort(F.collect_list(F.struct("_rank", "as_path")))
    shown = few.groupBy(*by).agg(F.transform(listed, lambda s: s["as_path"]).alias("examples"))
    return counts.join(shown, by)


def clustered_alerts(alerts: DataFrame, by: list[str], gap: int = 60, chunk: int = 86400) -> DataFrame:
    """Whether all alerts of a group follow each other within ``gap`` seconds.

    Distinct seconds are compared inside day-sized pieces; between pieces only the first
    and last second of each are compared, so a busy group is spread over its days.
    """
    secs = alerts.groupBy(*by, T.seconds(F.col("ts")).alias("t")).agg(F.count("*").alias("n"))
    pieces = secs.withColumn("piece", F.floor(F.col("t") / chunk))
    inside = Window.partitionBy(*by, "piece").orderBy("t")
    per_piece = pieces.withColumn("step", F.col("t") - F.lag("t").over(inside)).groupBy(*by, "piece").agg(
        F.sum("n").alias("n"), F.max("step").alias("step"), F.min("t").alias("t0"), F.max("t").alias("t1")
    )
    across = Window.partitionBy(*by).orderBy("piece")
    joined = per_piece.withColumn("bridge", F.col("t0") - F.lag("t1").over(across))
    widest = F.greatest(F.max("step"), F.max("bridge"))
    return joined.groupBy(*by).agg(F.sum("n").alias("n"), widest.alias("widest")).select(
        *by, "n", F.when(F.col("n") > 1, F.coalesce(F.col("widest"), F.lit(0)) < gap).otherwise(False).alias("clustered")
    )

"""Runs, sessions and gaps in ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routescope.functions import times as T


def gaps(rows: DataFrame, keys: list[str], piece: int = 3600, busy: DataFrame | None = None) -> DataFrame:
    """Adds ``gap``, the seconds since the previous row of the group.

    Busy groups are cut into pieces of time; the last second of each piece is carried on.
    """
    from routescope.operators.features import before_across

    timed = rows.withColumn("_t", T.seconds(F.col("ts")))
    return before_across(timed, keys, {"_before": "_t"}, piece, busy).withColumn(
        "gap", F.col("_t") - F.col("_before")
    ).drop("_t", "_before")


def runs(rows: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    """Adds ``run``, the same for rows of consecutive ``idx``.

    ``idx`` counts the steps of a series, so a group is bounded by the time it covers.
    """
    w = Window.partitionBy(*keys).orderBy(idx)
    return rows.withColumn("run", F.col(idx) - F.dense_rank().over(w))


def keep_runs(rows: DataFrame, keys: list[str], idx: str = "idx", shortest: int = 4) -> DataFrame:
    """Rows whose index belongs to at least ``shortest`` consecutive ones.

    Windows over the same grouping only: one shuffle, no join.
    """
    w = Window.partitionBy(*keys, "run")
    length = F.max(idx).over(w) - F.min(idx).over(w) + 1
    return runs(rows, keys, idx).withColumn("_n", length).where(F.col("_n") >= shortest).drop("run", "_n")


def run_windows(rows: DataFrame, keys: list[str], idx: str = "idx", shortest: int = 4) -> DataFrame:
    """(keys…, first, last, points) of each run of at least ``shortest``."""
    g = runs(rows, keys, idx).groupBy(*keys, "run").agg(F.min(idx).alias("first"), F.max(idx).alias("last"))
    points = (F.col("last") - F.col("first") + 1).cast("bigint")
    return g.withColumn("points", points).where(F.col("points") >= shortest).drop("run")


def sessions(rows: DataFrame, keys: list[str], max_gap: int = 3600, fewest: int = 3, piece: int = 86400) -> DataFrame:
    """(keys…, start, end, n) of rows following each other within ``max_gap`` seconds.

    A gap of exactly ``max_gap`` still joins. Sessions are first formed inside pieces of
    time, then neighbouring pieces are joined up from one row per session: a busy group is
    spread over its pieces.
    """
    timed = rows.groupBy(*keys, T.seconds(F.col("ts")).alias("t")).agg(F.count("*").alias("n"))
    cut = timed.withColumn("_piece", F.floor(F.col("t") / piece))

    def number(df: DataFrame, part: list[str], start: str, end: str) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(start)
        starts = F.when(F.col(start) - F.lag(end).over(w) <= max_gap, 0).otherwise(1)
        return df.withColumn("_new", starts).withColumn("_sid", F.sum("_new").over(w))

    inside = number(cut, [*keys, "_piece"], "t", "t").groupBy(*keys, "_piece", "_sid").agg(
        F.min("t").alias("t0"), F.max("t").alias("t1"), F.sum("n").alias("n")
    ).drop("_sid")
    whole = number(inside, keys, "t0", "t1").groupBy(*keys, "_sid").agg(
        F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("n").alias("n")
    )
    return whole.where(F.col("n") >= fewest).select(
        *keys, T.from_seconds(F.col("t0")).alias("start"), T.from_seconds(F.col("t1")).alias("end"), "n"
    )


def widest_session(rows: DataFrame, keys: list[str], pad_hours: int = 2, consecutive: bool = True, **kw) -> DataFrame:
    """The longest session of each group (the first on a tie), padded on both sides; or,
    without sessions, first to last row."""
    if consecutive:
        s = sessions(rows, keys, **kw)
        length = T.seconds(F.col("end")) - T.seconds(F.col("start"))
        pick = F.max(F.struct(length.alias("len"), (-T.seconds(F.col("start"))).alias("first"), "start", "end"))
        w = s.groupBy(*keys).agg(pick.alias("p")).select(*keys, "p.start", "p.end")
    else:
        w = rows.groupBy(*keys).agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    pad = F.expr(f"INTERVAL {int(pad_hours)} HOURS")
    return w.withColumns({"start": F.col("start") - pad, "end": F.col("end") + pad})


def first_window(windows: DataFrame, keys: list[str]) -> DataFrame:
    """The earliest window of each group."""
    return windows.groupBy(*keys).agg(F.min(F.struct("first", "last", "points")).alias("w")).select(*keys, "w.*")


def inside(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows within a closed time window."""
    return rows.where((F.col("ts") >= start) & (F.col("ts") <= end))

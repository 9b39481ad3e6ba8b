"""Interval joins as equi-joins on time slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routescope.functions import times as T


def in_windows(
    rows: DataFrame, windows: DataFrame, ts: str = "ts", start: str = "start", end: str = "end",
    on: list[str] | None = None, closed: bool = True, slot: int = 86400,
) -> DataFrame:
    """Rows joined to each window holding their time.

    A window is listed once per slot it touches (its length over ``slot``), so the join
    is on equal slots and the exact bounds only filter.
    """
    first = F.floor(T.seconds(F.col(start)) / slot)
    last = F.floor(T.seconds(F.col(end)) / slot)
    listed = windows.withColumn("_slot", F.explode(F.sequence(first, last)))
    keyed = rows.withColumn("_slot", F.floor(T.seconds(F.col(ts)) / slot))
    upper: Column = F.col(ts) <= F.col(end) if closed else F.col(ts) < F.col(end)
    return keyed.join(listed, ["_slot", *(on or [])]).where((F.col(ts) >= F.col(start)) & upper).drop("_slot")


def near_in_time(rows: DataFrame, others: DataFrame, within: int = 3600, on: list[str] | None = None) -> DataFrame:
    """Rows with some other row strictly closer than ``within`` seconds (semi-join).

    ``rows`` and ``others`` have ``ts``; each distinct other time is listed in its own
    and the two neighbouring slots.
    """
    on = on or []
    spread = others.select(*on, T.seconds(F.col("ts")).alias("_o")).distinct().withColumn(
        "_slot", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("_o") / within) + k))
    )
    left = rows.withColumns({"_s": T.seconds(F.col("ts"))}).withColumn("_slot", F.floor(F.col("_s") / within))
    cond = left["_slot"] == spread["_slot"]
    for name in on:
        cond = cond & (left[name] == spread[name])
    cond = cond & (F.abs(left["_s"] - spread["_o"]) < within)
    return left.join(spread, cond, "left_semi").drop("_s", "_slot")

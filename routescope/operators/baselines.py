"""Baselines of feature series, and what departs from them.

A series has ``target``, ``bucket`` (epoch seconds) and feature columns. Windows are
tables: an event has ``event_name``, ``start``, ``end``; its baselines have ``period``,
``lo`` and ``hi`` as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routescope.functions import times as T
from routescope.operators.features import SERIES_FEATURES

# Periods taken for each periodicity; "Nh" takes max(4, 24 // N).
PERIODS = {"weekly": (4, 7 * 86400), "daily": (7, 86400)}


def period_plan(periodicity: str | None) -> tuple[int, int]:
    """(number of periods, seconds between them); (0, 86400) means the day before."""
    if periodicity in PERIODS:
        return PERIODS[periodicity]
    if periodicity and periodicity.endswith("h") and periodicity[:-1].isdigit():
        hours = int(periodicity[:-1])
        if hours > 0:
            return max(4, 24 // hours), hours * 3600
    return 0, 86400


def baseline_periods(events: DataFrame, periodicity: str | None) -> DataFrame:
    """One row per event and earlier period: the event's window moved back."""
    n, gap = period_plan(periodicity)
    if n == 0:
        return events.withColumns(
            {"period": F.lit(1), "lo": F.col("start") - F.expr("INTERVAL 24 HOURS"), "hi": F.col("start")}
        )
    back = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("period") * gap).cast("decimal(18,6)"))
    return events.withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumns(
        {"lo": F.col("start") - back, "hi": F.col("end") - back}
    )


def _slots(lo: Column, hi: Column, slot: int) -> Column:
    return F.explode(F.sequence(F.floor(lo / slot), F.floor(hi / slot)))


def event_buckets(series: DataFrame, events: DataFrame, slot: int = 86400) -> DataFrame:
    """Series rows inside each event's closed window."""
    w = events.select("event_name", T.seconds(F.col("start")).alias("s0"), T.seconds(F.col("end")).alias("s1"))
    w = w.withColumn("_slot", _slots(F.col("s0"), F.col("s1"), slot))
    keyed = series.withColumn("_slot", F.floor(F.col("bucket") / slot))
    return keyed.join(w, "_slot").where("bucket BETWEEN s0 AND s1").drop("_slot", "s1")


def baseline_buckets(series: DataFrame, periods: DataFrame, slot: int = 86400) -> DataFrame:
    """Series rows inside each half-open baseline period, event rows left out."""
    w = periods.select(
        "event_name", "period", T.seconds(F.col("lo")).alias("p0"), T.seconds(F.col("hi")).alias("p1"),
        T.seconds(F.col("start")).alias("s0"), T.seconds(F.col("end")).alias("s1"),
    ).withColumn("_slot", _slots(F.col("p0"), F.col("p1"), slot))
    keyed = series.withColumn("_slot", F.floor(F.col("bucket") / slot))
    inside = "bucket >= p0 AND bucket < p1 AND NOT (bucket BETWEEN s0 AND s1)"
    return keyed.join(w, "_slot").where(inside).drop("_slot", "p1", "s0", "s1")


def long_form(series: DataFrame, ids: list[str], features=SERIES_FEATURES) -> DataFrame:
    """(ids…, feature, value)."""
    doubles = series.select(*ids, *[F.col(f).cast("double").alias(f) for f in features])
    return doubles.unpivot(ids, list(features), "feature", "value")


def stats(values: DataFrame, by: list[str]) -> DataFrame:
    """Mean, population deviation, least and greatest of ``value`` per group."""
    return values.groupBy(*by).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"),
    )


def period_stats(period_totals: DataFrame, by: list[str], features) -> DataFrame:
    """Statistics over periods of each period's totals."""
    return stats(long_form(period_totals, [*by, "period"], features), [*by, "feature"])


def slot_stats(baseline: DataFrame, by: list[str], width: int) -> DataFrame:
    """Statistics per slot of the window, over all periods.

    Slots are counted from each period's own start.
    """
    slotted = baseline.withColumn("slot", F.expr(f"(bucket - p0) div {width}"))
    return stats(long_form(slotted, [*by, "slot"]), [*by, "slot", "feature"])


def baseline_names(totals: DataFrame, ids: list[str]) -> DataFrame:
    """Window totals under their baseline names; windows without messages have none."""
    renamed = [
        F.col(n).alias(f"avg_{n}")
        for n in ("announcement_count", "withdrawal_count", "announced_prefix_count", "withdrawn_prefix_count",
                  "unique_prefix_count", "flapping_prefix_count", "total_messages")
    ]
    return totals.where("total_messages > 0").select(*ids, *renamed, "avg_path_length")


def z_anomalies(values: DataFrame, base: DataFrame, on: list[str], threshold: float = 3.0, flat: bool = True) -> DataFrame:
    """Values at least ``threshold`` deviations off; with ``flat``, any change of a constant too.

    Deviations and scores are rounded to nine digits before they are compared, so that the
    order in which a mean was summed cannot decide a borderline case.
    """
    x, mean, std = F.col("value"), F.round("mean", 9), F.round("std", 9)
    z = F.when(std > 0, F.round((x - F.col("mean")) / F.col("std"), 9)).otherwise(0.0)
    joined = values.join(base.select(*on, "mean", "std"), on).withColumn("z", z)
    hit = F.abs(F.col("z")) >= threshold
    rising = F.col("z") > 0
    if flat:
        hit = hit | ((std == 0) & (x != mean))
        rising = rising | ((std == 0) & (x > mean))
    return joined.where(hit).withColumns(
        {"anomaly_type": F.when(rising, "high_increase").otherwise("high_decrease"), "severity": F.lit("high")}
    )


def total_anomalies(event_values: DataFrame, base: DataFrame, on: list[str], threshold: float = 3.0) -> DataFrame:
    """Rules on window totals: z-score, something from nothing, and three ratio patterns.

    ``event_values`` is long form; one row per rule that fires.
    """
    x, mean, std = F.col("value"), F.round("mean", 9), F.round("std", 9)
    f = F.col("feature")
    j = event_values.join(base.select(*on, "mean", "std"), on)
    z = F.when(std > 0, F.round((x - F.col("mean")) / F.col("std"), 9)).otherwise(0.0)
    ratio = F.when(mean > 0, F.round(x / F.col("mean"), 9)).otherwise(0.0)

    def rule(cond: Column, kind: Column | str) -> Column:
        return F.when(cond, kind if isinstance(kind, Column) else F.lit(kind))

    fired = F.array_compact(
        F.array(
            rule((mean == 0) & (x > 0), "non_zero_when_baseline_zero"),
            rule((mean != 0) & (F.abs(z) >= threshold), F.when(z > 0, "high_increase").otherwise("high_decrease")),
            rule((f == "withdrawal_count") & (ratio > 5), "withdrawal_surge"),
            rule((f == "flapping_prefix_count") & (ratio > 3) & (x > 10), "route_flapping"),
            rule((f == "announcement_count") & (ratio < 0.5) & (mean > 100), "announcement_drop"),
        )
    )
    return j.select("*", z.alias("z"), F.explode(fired).alias("anomaly_type"))


def anomalies_by_feature(anomalies: DataFrame, by: list[str]) -> DataFrame:
    """Per feature: anomalies, greatest |z| with its value and mean, distinct buckets."""
    per_bucket = anomalies.groupBy(*by, "feature", "bucket").agg(
        F.count("*").alias("n"),
        F.max(F.struct(F.abs("z").alias("z"), (-F.col("bucket")).alias("_first"), "value", "mean")).alias("top"),
    )
    return per_bucket.groupBy(*by, "feature").agg(
        F.sum("n").alias("n"), F.max("top").alias("top"), F.count("*").alias("buckets")
    ).select(*by, "feature", "n", F.col("top.z").alias("max_z"), F.col("top.value").alias("value"),
             F.col("top.mean").alias("mean"), "buckets")


def anomaly_matrix(anomalies: DataFrame, by: list[str], features=SERIES_FEATURES) -> DataFrame:
    """Greatest |z| per bucket, one column per feature."""
    return anomalies.groupBy(*by, "bucket").pivot("feature", list(features)).agg(F.max(F.abs("z")))


def phase(bucket: Column, start: Column, end: Column) -> Column:
    """before, event or after."""
    return F.when(bucket < T.seconds(start), "before").when(bucket <= T.seconds(end), "event").otherwise("after")

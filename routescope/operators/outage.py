"""Outage scoring from window totals, sliding windows and series anomalies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routescope.operators import baselines as B
from routescope.operators.features import SUMMED, totals

# Totals that get a mean and deviation over the baseline periods.
PERIOD_FEATURES = (*SUMMED, "avg_path_length", "max_path_length", "min_path_length")


@dataclass(frozen=True)
class Rule:
    """An indicator: a total's ratio to its baseline mean, and what it weighs."""

    name: str
    feature: str
    weight: float
    below: float | None = None
    above: float | None = None
    more_than: int | None = None


# Fixed values of the outage rules.
RULES = (
    Rule("announcement_drop", "announcement_count", 0.3, below=0.5),
    Rule("withdrawal_surge", "withdrawal_count", 0.25, above=4.0),
    Rule("flapping_spike", "flapping_prefix_count", 0.2, above=3.0, more_than=20),
    Rule("prefix_disappearance", "unique_prefix_count", 0.15, below=0.6),
    Rule("message_drop", "total_messages", 0.1, below=0.5),
)
TIMESERIES_WEIGHT = 0.2
SUSPECT = 0.25
MIN_BUCKETS = 6


def wide_baseline(base: DataFrame, by: list[str]) -> DataFrame:
    """Period statistics with one mean and one deviation column per rule feature."""
    picked = []
    for rule in RULES:
        mine = F.col("feature") == rule.feature
        picked.append(F.max(F.when(mine, F.col("mean"))).alias(f"mean_{rule.feature}"))
        picked.append(F.max(F.when(mine, F.col("std"))).alias(f"std_{rule.feature}"))
    return base.groupBy(*by).agg(*picked)


def _fires(rule: Rule) -> Column:
    mean, x = F.col(f"mean_{rule.feature}"), F.col(rule.feature)
    ratio = F.when(mean > 0, F.round(x / mean, 9))
    cond = ratio < rule.below if rule.below is not None else ratio > rule.above
    if rule.more_than is not None:
        cond = cond & (x > rule.more_than)
    return F.coalesce(cond, F.lit(False))


def score(rows: DataFrame, anomalies: Column | None = None) -> DataFrame:
    """Adds ``indicators`` and ``score`` to totals joined with their wide baseline.

    ``anomalies`` is the number of series anomalies, when they count.
    """
    marks = [(r.name, _fires(r), r.weight) for r in RULES]
    if anomalies is not None:
        marks.insert(4, ("timeseries_anomaly", F.coalesce(anomalies > 0, F.lit(False)), TIMESERIES_WEIGHT))
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c, _ in marks]))
    points = sum((F.when(c, F.lit(w)).otherwise(0.0) for _, c, w in marks), F.lit(0.0))
    return rows.withColumns({"indicators": names, "score": F.least(F.lit(1.0), points)})


def rule_details(rows: DataFrame, ids: list[str]) -> DataFrame:
    """One row per rule: value, baseline, ratio, z and whether it fires."""
    parts = []
    for rule in RULES:
        mean, std, x = F.col(f"mean_{rule.feature}"), F.col(f"std_{rule.feature}"), F.col(rule.feature)
        z = F.when(std > 0, (x - mean) / std)
        parts.append(
            F.struct(
                F.lit(rule.name).alias("rule"), x.cast("double").alias("value"), mean.alias("mean"), std.alias("std"),
                F.when(mean > 0, x / mean).otherwise(0.0).alias("ratio"), (mean > 0).alias("ratio_valid"),
                z.alias("z"), _fires(rule).alias("triggered"), F.lit(rule.weight).alias("weight"),
            )
        )
    return rows.select(*ids, F.explode(F.array(*parts)).alias("r")).select(*ids, "r.*")


def adaptive_bounds(base: DataFrame) -> DataFrame:
    """Adds mean ± 2 deviations; null where the baseline is empty of signal."""
    mean, std = F.col("mean"), F.col("std")
    known = (mean != 0) | (std != 0)
    return base.withColumns(
        {
            "lower": F.when(known, F.when(std > 0, mean - 2 * std).otherwise(0.0)),
            "upper": F.when(known & (std > 0), mean + 2 * std),
        }
    )


def sliding_totals(event_series: DataFrame, by: list[str], window: int = 12, slide: int = 6) -> DataFrame:
    """Totals of windows of ``window`` buckets, one every ``slide``, by bucket position.

    The last windows are cut short, not dropped. A series has one row per bucket, so an
    event's rows number its length over the bucket width.
    """
    w = Window.partitionBy(*by).orderBy("bucket")
    placed = event_series.withColumn("pos", F.row_number().over(w) - 1)
    last = F.expr(f"pos div {slide}")
    first = F.greatest(F.lit(0), F.expr(f"(pos - {window} + {slide}) div {slide}"))
    listed = placed.withColumn("win", F.explode(F.sequence(first.cast("bigint"), last)))
    bounds = listed.groupBy(*by, "win").agg(F.min("bucket").alias("win_start"), F.max("bucket").alias("win_end"))
    return totals(listed, [*by, "win"]).join(bounds, [*by, "win"])


def sliding_scores(event_series: DataFrame, base: DataFrame, by: list[str], window: int = 12, slide: int = 6) -> DataFrame:
    """(by…, win, win_start, win_end, score) of every sliding window."""
    t = sliding_totals(event_series, by, window, slide)
    return score(t.join(wide_baseline(base, by), by)).select(*by, "win", "win_start", "win_end", "indicators", "score")


def detect(
    series: DataFrame, events: DataFrame, periodicity: str | None = "daily", width: int = 300,
    min_buckets: int = MIN_BUCKETS,
) -> DataFrame:
    """The outage verdict of every (target, event), all in one plan."""
    by = ["target", "event_name"]
    ev = B.event_buckets(series, events)
    bl = B.baseline_buckets(series, B.baseline_periods(events, periodicity))
    event_totals = totals(ev, by)
    base = B.period_stats(totals(bl, [*by, "period"]), by, PERIOD_FEATURES)
    slots = B.slot_stats(bl, by, width)
    slotted = ev.withColumn("slot", F.expr(f"(bucket - s0) div {width}"))
    values = B.long_form(slotted, [*by, "bucket", "slot"])
    # these anomalies all have |z| >= 3, so they also meet the milder limit of 2.5
    odd = B.z_anomalies(values, slots, [*by, "slot", "feature"], flat=False)
    per_feature = odd.groupBy(*by, "feature").agg(F.count("*").alias("n"))
    odd_counts = per_feature.groupBy(*by).agg(
        F.sum("n").alias("anomalies"), F.count("*").alias("odd_features"),
        F.sum(F.when(F.col("feature") != "min_path_length", F.col("n"))).alias("scoring"),
    )
    slide = sliding_scores(ev, base, by).groupBy(*by).agg(
        F.max("score").alias("slide_max"), F.avg("score").alias("slide_avg")
    )
    rows = event_totals.join(wide_baseline(base, by), by, "left").join(odd_counts, by, "left").join(slide, by, "left")
    rows = rows.fillna(0, ["anomalies", "odd_features", "scoring", "slide_max", "slide_avg"])
    rows = score(rows, F.col("scoring")).withColumn("final", F.greatest("score", "slide_max"))
    by_score = F.col("final") >= SUSPECT
    by_z = ~by_score & (F.col("anomalies") >= 2)
    by_breadth = ~by_score & ~by_z & (F.col("odd_features") >= 3)
    enough = F.col("buckets") >= min_buckets
    return rows.select(
        *by, "buckets", "anomalies", "odd_features", "indicators", "score", "slide_max", "slide_avg",
        enough.alias("has_data"),
        (enough & (by_score | by_z | by_breadth)).alias("suspected"),
        F.when(~enough, 0.0)
        .when(by_z, F.greatest("final", F.lit(0.4)))
        .when(by_breadth, F.greatest("final", F.lit(0.35)))
        .otherwise(F.col("final")).alias("outage_score"),
    )

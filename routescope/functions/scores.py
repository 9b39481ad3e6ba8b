"""Scalar scoring rules. All thresholds are fixed values of the detection rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def guarded_std(mean: Column, std: Column) -> Column:
    """The deviation, or a floor from the mean when the history is flat."""
    floor = F.greatest(0.05 * F.greatest(F.abs(mean), F.lit(1.0)), F.lit(0.02))
    return F.when(std > 1e-6, std).otherwise(floor)


def z_severity(z: Column) -> Column:
    return F.when(z > 5, "high").when(z > 3, "medium").otherwise("low")


def path_length_score(length: Column, expected: Column) -> Column:
    """0, .3, .6 or .9 for 0, 1, 2 or more hops too many."""
    extra = length - expected
    return F.when(extra <= 0, 0.0).when(extra == 1, 0.3).when(extra == 2, 0.6).otherwise(0.9)


def pattern_score(anomalies: Column) -> Column:
    return F.least(F.lit(1.0), anomalies * 0.3)


def interception_risk(insertions: Column, length_score: Column, pattern: Column) -> Column:
    """Weights: unexpected hops .4, length .3, pattern .3."""
    return F.least(
        F.lit(1.0), 0.4 * F.least(F.lit(1.0), insertions * 0.5) + 0.3 * length_score + 0.3 * pattern
    )


def risk_confidence(risk: Column) -> Column:
    return F.when(risk > 0.7, "high").when(risk > 0.5, "medium").otherwise("low")


def forge_threshold(activity_ratio: Column) -> Column:
    """Rarity threshold: the busier the AS, the stricter."""
    return (
        F.when(activity_ratio >= 0.1, 0.0005)
        .when(activity_ratio >= 0.01, 0.001)
        .when(activity_ratio >= 0.001, 0.002)
        .otherwise(0.005)
    )


def count_confidence(n: Column, lone: Column) -> Column:
    """Group confidence by size; a lone alert keeps its own."""
    return F.when(n >= 5, "high").when(n >= 2, "medium").otherwise(lone)


def alert_severity(total: Column, high: Column) -> Column:
    return (
        F.when(total == 0, "none")
        .when((total >= 10) | (high >= 5), "critical")
        .when((total >= 5) | (high >= 2), "high")
        .when((total >= 2) | (high >= 1), "medium")
        .otherwise("low")
    )


def count_band(n: Column) -> Column:
    return F.when(n >= 50, "critical").when(n >= 20, "high").when(n >= 5, "medium").otherwise("low")


def leak_band(prob: Column) -> Column:
    return F.when(prob >= 0.8, "high").when(prob >= 0.5, "medium").otherwise("low")


def duration_severity(minutes: Column) -> Column:
    return F.when(minutes > 120, "High").when(minutes > 10, "Medium").otherwise("Low")


def as_severity(routing: Column, traffic: Column) -> Column:
    """Severity of one AS in a batch by its anomaly counts."""
    total = routing + traffic
    return (
        F.when((total > 15) | (routing > 8), "high")
        .when((total > 5) | (routing > 2), "medium")
        .otherwise("low")
    )


def routing_impact(events: Column, prefixes: Column) -> Column:
    return F.greatest(F.least(F.lit(1.0), events / 5.0), F.least(F.lit(1.0), prefixes / 3.0))


def traffic_severity(percent_change: Column, anomalies: Column) -> Column:
    return F.greatest(
        F.least(F.lit(1.0), F.abs(percent_change) / 40.0), F.least(F.lit(1.0), anomalies / 3.0)
    )

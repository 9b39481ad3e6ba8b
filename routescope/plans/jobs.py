"""Whole detection jobs, each one lazy plan over all targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routescope.functions.paths import touched_asns
from routescope.functions.text import parse_as_list
from routescope.functions.times import extended_window, from_seconds, seconds, text
from routescope.operators import baselines, features, frequency, hijack, intervals, leak, learned, links, prefix_join
from routescope.operators import sequences as Q
from routescope.operators import traffic as TR
from routescope.session import cut_lineage

ALERT_COLUMNS = (
    "type", "seq", "ts", "prefix", "origin_as", "as_path", "target_as", "victim_as", "hijacker_as", "confidence",
)


def hijack_alerts(
    announcements: DataFrame, edges: DataFrame, prefix2as: DataFrame, targets: DataFrame, forged: bool = True
) -> DataFrame:
    """Origin and forged-path alerts in one shape."""
    rows = hijack.origin_hijacks(announcements, prefix2as, targets).select(*ALERT_COLUMNS)
    if forged:
        more = hijack.forged_paths(announcements, edges, prefix2as, targets)
        rows = rows.unionByName(more.select(*ALERT_COLUMNS))
    return rows


def relevant_announcements(announcements: DataFrame, prefix2as: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_as, seq): announcements crossing a target, or for space a target owns
    (exactly or under one of its prefixes)."""
    names = targets.select(F.col("asn").alias("target_as")).distinct()
    crossing = announcements.select("seq", F.explode(F.array_distinct("hops")).alias("target_as")).join(
        names, "target_as", "left_semi"
    )
    owned = prefix2as.select(F.col("origin").alias("target_as"), F.col("prefix").alias("parent")).distinct().join(
        names, "target_as", "left_semi"
    )
    held = prefix_join.containers(announcements, owned.select(F.col("parent").alias("prefix")), strict=False)
    space = announcements.select("seq", "prefix").join(
        held.join(owned, "parent").select("prefix", "target_as").distinct(), "prefix"
    )
    return crossing.select("target_as", "seq").unionByName(space.select("target_as", "seq")).distinct()


def hijack_job(
    announcements: DataFrame, edges: DataFrame, prefix2as: DataFrame, targets: DataFrame
) -> DataFrame:
    """Per target AS: relevant announcements and alerts of each kind."""
    alerts = hijack_alerts(announcements, edges, prefix2as, targets)
    per_kind = alerts.groupBy("target_as").agg(
        *[F.count_if(F.col("type") == k).alias(k) for k in ("origin_hijacked", "origin_hijacking", "forge_hijacked")]
    )
    seen = relevant_announcements(announcements, prefix2as, targets).groupBy("target_as").agg(
        F.count("*").alias("announcements")
    )
    names = targets.select(F.col("asn").alias("target_as")).distinct()
    kinds = ["origin_hijacked", "origin_hijacking", "forge_hijacked", "announcements"]
    return names.join(per_kind, "target_as", "left").join(seen, "target_as", "left").fillna(0, kinds)


def revalidate(alerts: DataFrame, updates: DataFrame, threshold: float = 0.001) -> DataFrame:
    """Forged-path alerts with a second look at how common their first fake link is."""
    link = F.split("fake_connection", r"\|")
    keyed = alerts.withColumns({"as1": link[0], "as2": link[1]})
    verdicts = frequency.rarity_verdicts(updates, keyed).select("as1", "as2", "ratio")
    legit = F.col("ratio") > threshold
    return keyed.join(verdicts, ["as1", "as2"]).withColumns(
        {"is_legitimate": legit, "detection_status": F.when(legit, "legitimate").otherwise("confirmed")}
    )


# Columns of the per-event feature table, in file order.
CSV_FEATURES = (
    "announcement_count", "withdrawal_count", "flapping_prefix_count", "ori_change_rate", "path_change_rate",
    "dup_A_rate", "avg_arrival_interval", "editDis_entropy", "unique_as_count", "avg_path_length",
)


def event_series(updates: DataFrame, events: DataFrame, bucket: int = 300, around: str = "INTERVAL 1 DAY") -> DataFrame:
    """Feature series of every event's own ASes, from a day before it to a day after.

    All events share one pass over the updates.
    """
    wide = events.select(
        "event_name",
        (F.col("start") - F.expr(around)).alias("start"),
        (F.col("end") + F.expr(around)).alias("end"),
        F.explode(parse_as_list(F.col("outage_as"))).alias("asn"),
    )
    columns = features.FEATURE_INPUT
    touched = updates.select(*columns, F.explode(touched_asns(F.col("peer_as"), F.col("hops"))).alias("asn"))
    rows = intervals.in_windows(touched, wide, on=["asn"]).select(F.col("event_name").alias("target"), *columns)
    return features.feature_series(rows.dropDuplicates(["target", "seq"]), bucket)


def event_anomalies(updates: DataFrame, events: DataFrame, bucket: int = 300) -> DataFrame:
    """Which features of an event's ASes departed from the day before it."""
    series = event_series(updates, events, bucket)
    times = events.select(F.col("event_name").alias("target"), "event_name", seconds(F.col("start")).alias("s0"),
                          seconds(F.col("end")).alias("s1"))
    long = baselines.long_form(series.join(times, "target"), ["event_name", "bucket", "s0", "s1"])
    base = baselines.stats(long.where("bucket < s0"), ["event_name", "feature"])
    inside = long.where("bucket BETWEEN s0 AND s1")
    return baselines.z_anomalies(inside, base, ["event_name", "feature"])


def feature_table(series: DataFrame) -> DataFrame:
    """The chosen features with a readable time, in time order."""
    return series.select(
        F.col("target").alias("event_name"), text(from_seconds(F.col("bucket"))).alias("timestamp"), *CSV_FEATURES
    ).orderBy("event_name", "timestamp")


def widened(windows: DataFrame) -> DataFrame:
    """Windows from a day before to six hours after."""
    start, end = extended_window(F.col("start"), F.col("end"))
    return windows.withColumns({"start": start, "end": end})


def _modes(traffic: DataFrame, windows: DataFrame, periods: DataFrame) -> DataFrame:
    """(series, event_name, mode): the period to compare with; series without one fall
    back to weekly when two earlier weeks have data."""
    weeks = TR.history(traffic, windows, 7 * 86400, 4).groupBy(*TR.KEY).agg(F.count_distinct("period").alias("weeks"))
    keys = traffic.select("series").distinct().join(periods, "series", "left")
    cases = TR.current_points(traffic, windows).select(*TR.KEY).distinct().join(keys, "series").join(weeks, TR.KEY, "left")
    named = F.coalesce("period_name", F.lit("none"))
    mode = F.when(named.isin("daily", "weekly"), named).when(F.col("weeks") >= 2, "weekly").otherwise("none")
    return cases.select(*TR.KEY, mode.alias("mode"))


def traffic_points(traffic: DataFrame, windows: DataFrame, periods: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points with mean and std, the history behind them, points without history)."""
    modes = _modes(traffic, windows, periods)
    current = TR.current_points(traffic, windows)
    past = None
    for name, (n, gap) in (("daily", (7, 86400)), ("weekly", (4, 7 * 86400))):
        rows = TR.history(traffic, windows, gap, n).join(modes.where(F.col("mode") == name).select(*TR.KEY), TR.KEY, "left_semi")
        past = rows if past is None else past.unionByName(rows)
    alone = current.join(modes.where("mode = 'none'").select(*TR.KEY), TR.KEY, "left_semi")
    return TR.align_by_position(current, past), past, alone


def traffic_anomalies(traffic: DataFrame, windows: DataFrame, periods: DataFrame, forest: bool = True) -> DataFrame:
    """Anomalous points of every series in every window, by the detector its period calls for."""
    points, past, alone = traffic_points(traffic, windows, periods)
    return _anomalies(points, past, alone, forest)


def _anomalies(points: DataFrame, past: DataFrame, alone: DataFrame, forest: bool) -> DataFrame:
    odd = learned.isolation_forest(points, past) if forest else None
    shape = [*TR.KEY, "idx", "method", "confidence", "severity", "z"]
    found = TR.combined(points, odd).select(*shape)
    rest = TR.non_periodic(alone, TR.KEY).withColumn("method", F.lit("combined_non_periodic")).select(*shape)
    return found.unionByName(rest)


def traffic_job(
    traffic: DataFrame, windows: DataFrame, periods: DataFrame, forest: bool = True
) -> DataFrame:
    """Per (series, event): number of anomalies and of windows, change against history, and
    the widened time span of the anomalies.

    The points and the anomalies are each used several times, so both are saved first.
    """
    wide = widened(windows)
    points, past, alone = traffic_points(traffic, wide, periods)
    points = cut_lineage(points)
    found = cut_lineage(_anomalies(points, past, alone, forest))
    counts = found.groupBy(*TR.KEY).agg(F.count("*").alias("anomaly_count"))
    spans = Q.run_windows(found, TR.KEY).groupBy(*TR.KEY).agg(F.count("*").alias("windows"), F.max("points").alias("longest"))
    grown = TR.expand_boundaries(found, points)
    cases = TR.current_points(traffic, wide).select(*TR.KEY).distinct()
    joined = cases.join(TR.statistics(points), TR.KEY, "left").join(counts, TR.KEY, "left").join(spans, TR.KEY, "left")
    joined = joined.join(grown.select(*TR.KEY, F.col("start").alias("anomaly_start"), F.col("end").alias("anomaly_end")), TR.KEY, "left")
    numbers = ["anomaly_count", "windows", "longest", "data_points", "current_avg", "historical_avg", "percent_change"]
    return joined.fillna(0, numbers).withColumn("anomalies_detected", F.col("anomaly_count") > 0)


def role_job(points: DataFrame, threshold: float = 2.5) -> DataFrame:
    """Role-aware anomalies; series where none are found are looked at by the combined
    detector at ``threshold``."""
    mine = TR.role_anomalies(points).select(*TR.KEY, "idx", "severity", F.lit("role").alias("found_by"))
    silent = points.join(mine.select(*TR.KEY).distinct(), TR.KEY, "left_anti")
    rest = TR.combined(silent, None, threshold).select(*TR.KEY, "idx", "severity", F.lit("combined").alias("found_by"))
    return mine.unionByName(rest)


def leak_job(announcements: DataFrame, asprob: DataFrame, windows: DataFrame, targets: DataFrame,
             threshold: float = leak.THRESHOLD) -> DataFrame:
    """Per (target, event): announcements in the window, those crossing the target, leaks."""
    cases = windows.select("event_name", "start", "end", "target")
    total = intervals.in_windows(announcements.select("ts"), windows.select("event_name", "start", "end").distinct())
    totals = total.groupBy("event_name").agg(F.count("*").alias("total"))
    found = leak.candidates(announcements, cases, targets)
    scored = found.join(links.leak_scores(found, asprob), "hops", "left")
    counts = scored.groupBy("target", "event_name").agg(
        F.count("*").alias("filtered"), F.count_if(F.round("prob", 9) < threshold).alias("leaks")
    )
    return cases.select("target", "event_name").distinct().join(totals, "event_name", "left").join(
        counts, ["target", "event_name"], "left"
    ).fillna(0, ["total", "filtered", "leaks"])

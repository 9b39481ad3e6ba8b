"""Putting routing and traffic findings of an AS together.

An incident row has asn, the alert counts origin_hijacked, forge_hijacked,
origin_hijacking, forge_hijacking and route_leaks, outage, prefixes, routing_times,
first_seen, last_seen, and from traffic traffic_anomalies, percent_change, data_points,
traffic_times; overlap says how many routing times have a traffic anomaly within the hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routescope.functions import scores as S
from routescope.functions import times as T
from routescope.operators.intervals import near_in_time

KINDS = ("origin_hijacked", "forge_hijacked", "origin_hijacking", "forge_hijacking")


def _c(name: str) -> Column:
    return F.col(name)


def routing_summary(alerts: DataFrame) -> DataFrame:
    """Per AS: alerts of each kind, distinct prefixes and times, first and last seen.

    Distinct values are grouped first; the second grouping only counts them.
    """
    per_value = alerts.select(
        F.col("target_as").alias("asn"), "type", "ts",
        F.explode(F.array(
            F.struct(F.lit("prefix").alias("kind"), _c("prefix").alias("value")),
            F.struct(F.lit("time").alias("kind"), T.seconds(_c("ts")).cast("string").alias("value")),
        )).alias("e"),
    ).groupBy("asn", "e.kind", "e.value").agg(
        *[F.count_if(_c("type") == k).alias(k) for k in KINDS], F.min("ts").alias("t0"), F.max("ts").alias("t1")
    )
    by_prefix = _c("kind") == "prefix"
    return per_value.groupBy("asn").agg(
        *[F.sum(F.when(by_prefix, _c(k))).alias(k) for k in KINDS],
        F.count_if(by_prefix).alias("prefixes"), F.count_if(~by_prefix).alias("routing_times"),
        F.min("t0").alias("first_seen"), F.max("t1").alias("last_seen"),
    )


def traffic_summary(points: DataFrame, anomalies: DataFrame, split: str) -> DataFrame:
    """Per AS: points, change of the mean from before ``split`` to after it, anomalies."""
    late = _c("ts") >= F.lit(split).cast("timestamp_ntz")
    g = points.groupBy("asn").agg(
        F.count("*").alias("data_points"),
        F.avg(F.when(late, _c("value"))).alias("now"), F.avg(F.when(~late, _c("value"))).alias("then"),
    )
    n = anomalies.groupBy("asn").agg(F.count("*").alias("traffic_anomalies"), F.count_distinct("ts").alias("traffic_times"))
    change = F.coalesce(F.try_divide(_c("now") - _c("then"), _c("then")) * 100, F.lit(0.0))
    return g.join(n, "asn", "left").select(
        "asn", "data_points", change.alias("percent_change"),
        F.coalesce("traffic_anomalies", F.lit(0).cast("bigint")).alias("traffic_anomalies"),
        F.coalesce("traffic_times", F.lit(0).cast("bigint")).alias("traffic_times"),
    )


def temporal_overlap(alerts: DataFrame, anomalies: DataFrame, within: int = 3600) -> DataFrame:
    """(asn, overlap): distinct alert times with a traffic anomaly closer than ``within``."""
    times = alerts.select(F.col("target_as").alias("asn"), "ts").distinct()
    return near_in_time(times, anomalies.select("asn", "ts"), within, on=["asn"]).groupBy("asn").agg(
        F.count("*").alias("overlap")
    )


def incidents(routing: DataFrame, leaks: DataFrame, traffic: DataFrame, overlap: DataFrame, outages: DataFrame) -> DataFrame:
    """One row per AS known to any side. ``leaks`` is (asn, route_leaks), ``outages`` (asn, outage)."""
    r = routing.withColumn("routing_available", F.lit(True))
    t = traffic.withColumn("traffic_available", F.lit(True))
    rows = r.join(t, "asn", "full").join(leaks, "asn", "left").join(overlap, "asn", "left").join(outages, "asn", "left")
    counts = [*KINDS, "prefixes", "routing_times", "route_leaks", "traffic_anomalies", "traffic_times", "data_points", "overlap"]
    filled = rows.fillna(0, counts).fillna(0.0, ["percent_change"]).fillna(
        False, ["routing_available", "traffic_available", "outage"]
    )
    return filled.withColumn("events", sum((_c(k) for k in KINDS[1:]), _c(KINDS[0])))


def _has_routing() -> Column:
    return _c("events") > 0


def _has_traffic() -> Column:
    return _c("traffic_anomalies") > 0


def classify(rows: DataFrame) -> DataFrame:
    """Adds classification, correlation, severity, data quality, insight and cross-check."""
    routing, traffic = _has_routing(), _has_traffic()
    minutes = (T.seconds(_c("last_seen")) - T.seconds(_c("first_seen"))) / 60
    origin = (_c("origin_hijacked") + _c("origin_hijacking")) > 0
    forged = (_c("forge_hijacked") + _c("forge_hijacking")) > 0
    found = sum(
        (F.when(x, 1).otherwise(0) for x in (
            _c("routing_available"), _c("routing_available") & routing, _c("traffic_available"), _c("traffic_available") & traffic,
        )), F.lit(0),
    )
    issues = routing | _c("outage")
    all_routing = _c("events") + _c("route_leaks") + F.when(_c("outage"), 1).otherwise(0)
    calm_traffic, calm_routing = _c("traffic_available") & ~traffic, all_routing == 0
    return rows.withColumns(
        {
            "classification": F.when(origin, "Origin Hijacking").when(forged, "Path Forgery").otherwise("No BGP Anomaly Detected"),
            "correlation": F.when(routing & traffic, "Correlated BGP and Traffic Anomalies")
            .when(routing, "BGP Anomaly Without Traffic Impact")
            .when(traffic, "Traffic Anomaly Without BGP Events").otherwise("No Anomalies Detected"),
            "severity": S.duration_severity(F.coalesce(minutes, F.lit(0))),
            "data_quality": F.when(found >= 3, "High").when(found >= 2, "Medium").otherwise("Low"),
            "primary": F.when(routing, "Route Hijack").when(_c("route_leaks") > 0, "Route Leak")
            .when(traffic, "Traffic Anomaly").otherwise("Normal Operation"),
            "primary_cause": F.when(traffic & issues, "routing_related").when(traffic, "non_routing_related")
            .when(issues, "routing_issues_without_traffic_impact").otherwise("unknown"),
            "insight_confidence": F.when(traffic & issues, "high").when(traffic | issues, "medium").otherwise("low"),
            "cross_check": F.when(calm_traffic & ~calm_routing, "traffic_ok_routing_anomaly")
            .when(~calm_traffic & ~calm_routing, "both_anomalous").when(calm_traffic & calm_routing, "both_ok"),
            "quality_score": quality_score(),
        }
    )


def quality_score() -> Column:
    """0..1 from which sides answered and which found something."""
    r, t = _c("routing_available"), _c("traffic_available")
    points = (
        F.when(t, 0.3).otherwise(0.0) + F.when(t & _has_traffic(), 0.2).otherwise(0.0)
        + F.when(r, 0.3).otherwise(0.0) + F.when(r & _has_routing(), 0.2).otherwise(0.0)
    )
    sides = F.when(r, 1).otherwise(0) + F.when(t, 1).otherwise(0)
    return F.when(sides > 0, F.least(F.lit(1.0), F.try_divide(points, sides * 0.5))).otherwise(0.0)


def impact(rows: DataFrame) -> DataFrame:
    """Adds routing_impact and traffic_severity, both 0..1."""
    return rows.withColumns(
        {
            "routing_impact": S.routing_impact(_c("events"), _c("prefixes")),
            "traffic_severity": S.traffic_severity(_c("percent_change"), _c("traffic_anomalies")),
        }
    )


def confidence(rows: DataFrame) -> DataFrame:
    """Adds the confidence after each of three rounds, and the one concluded with.

    Round two looks at overlap in time, round three at whether the first two agreed; the
    first round reaching .8 ends the analysis. Input is the output of ``impact``.
    """
    agree = F.when(_has_routing() == _has_traffic(), 0.9).otherwise(0.6)
    base = F.when(_has_routing(), 0.8).otherwise(0.7)
    gap = _c("traffic_severity") - _c("routing_impact")
    lowered = F.greatest(F.lit(0.1), base - F.least(F.lit(0.4), gap))
    certain = F.when((_c("traffic_severity") >= 0.6) & (_c("routing_impact") < 0.3), lowered).otherwise(base)
    ratio = F.try_divide(_c("overlap"), F.greatest(F.lit(1), "routing_times", "traffic_times"))
    matched = _c("overlap") > 0
    second = (
        F.when(matched & (ratio > 0.5), F.least(F.lit(0.95), agree + 0.1))
        .when(matched & (ratio > 0.2), F.least(F.lit(0.9), agree + 0.05)).otherwise(agree)
    )

    def overall(consistency: Column, round_no: int) -> Column:
        lift = F.when(consistency >= 0.8, min(1.15, 1.0 + (round_no - 1) * 0.05)).otherwise(1.0)
        return F.least(consistency, F.least(F.lit(0.95), certain * lift))

    r = rows.withColumns({"round_1": overall(agree, 1), "round_2": overall(second, 2)})
    steady = F.abs(_c("round_1") - _c("round_2")) < 0.1
    third = F.when(steady, F.least(F.lit(0.95), second + 0.05)).otherwise(second)
    r = r.withColumn("round_3", overall(third, 3))
    final = F.when(_c("round_1") >= 0.8, _c("round_1")).when(_c("round_2") >= 0.8, _c("round_2")).otherwise(_c("round_3"))
    used = F.when(_c("round_1") >= 0.8, 1).when(_c("round_2") >= 0.8, 2).otherwise(3)
    r = r.withColumns({"confidence": final, "rounds": used})
    return r.withColumn("level", F.when(_c("confidence") >= 0.8, "High").when(_c("confidence") >= 0.6, "Medium").otherwise("Low"))


# Fixed values of the weighted confidence.
TYPE_BASE = {"route_hijack": 0.8, "route_leak": 0.7, "route_flap": 0.6, "unknown": 0.3}
CORRELATION_FACTOR = {"strong_correlation": 1.0, "weak_correlation": 0.8, "no_correlation": 0.6}
SEVERITY_FACTOR = {"critical": 1.0, "high": 0.9, "medium": 0.8, "low": 0.7}


def _lookup(c: Column, values: dict[str, float], other: float) -> Column:
    out = None
    for key, value in values.items():
        out = F.when(c == key, value) if out is None else out.when(c == key, value)
    return out.otherwise(other)


def weighted_confidence(rows: DataFrame, aligned: Column | None = None) -> DataFrame:
    """The other scoring: incident type, correlation and severity weighed into one number.

    ``aligned`` tells whether both sides covered the same time.
    """
    hijack, leak = _has_routing(), _c("route_leaks") > 0
    impact_ = F.least(F.lit(1.0), 0.5 + F.when(hijack, 0.3).otherwise(0.0) + F.when(leak, 0.2).otherwise(0.0))
    severe = F.least(F.lit(1.0), _c("traffic_anomalies") / 10.0 + F.abs("percent_change") / 50.0)
    both, any_ = hijack & _has_traffic(), hijack | _has_traffic()
    mean = (_c("w_impact") + _c("w_severity")) / 2
    r = rows.withColumns(
        {
            "incident_type": F.when(hijack, "route_hijack").when(leak, "route_leak").otherwise("unknown"),
            "traffic_correlation": F.when(both, "strong_correlation").when(any_, "weak_correlation").otherwise("no_correlation"),
            "w_impact": impact_, "w_severity": severe,
        }
    ).withColumn("incident_severity", F.when(mean > 0.8, "critical").when(mean > 0.6, "high").when(mean > 0.4, "medium").otherwise("low"))
    ok, some = _c("routing_available") & _c("traffic_available"), _c("routing_available") | _c("traffic_available")
    timing = F.lit(0.5) if aligned is None else F.when(aligned, 1.0).otherwise(0.5)
    consistency = (
        timing + F.when(both, 1.0).when(any_, 0.6).otherwise(0.3) + F.when(ok, 1.0).when(some, 0.7).otherwise(0.3)
    ) / 3
    kind = (
        _lookup(_c("incident_type"), TYPE_BASE, 0.3) * _lookup(_c("traffic_correlation"), CORRELATION_FACTOR, 0.6)
        * _lookup(_c("incident_severity"), SEVERITY_FACTOR, 0.5)
    )
    total = (consistency * 0.3 + kind * 0.3 + _c("w_impact") * 0.2 + _c("w_severity") * 0.2) * 0.95
    n = F.col("weighted_confidence")
    return r.withColumn("weighted_confidence", total).withColumn(
        "weighted_level",
        F.when(n >= 0.9, "very_high").when(n >= 0.8, "high").when(n >= 0.7, "moderate").when(n >= 0.6, "low").otherwise("very_low"),
    ).drop("w_impact", "w_severity")


def evidence(rows: DataFrame) -> DataFrame:
    """Adds conflicts, gaps and completeness of the evidence.

    ``traffic_anomalies`` and ``events`` stand for the anomaly lists, ``country`` for the
    place, ``prefixes`` for the affected networks; absent columns count as missing.
    """
    have = set(rows.columns)

    def present(name: str) -> Column:
        return _c(name).isNotNull() if name in have else F.lit(False)

    routing, traffic = _has_routing(), _has_traffic()
    conflicts = F.array_compact(
        F.array(
            F.when((_c("origin_hijacked") + _c("forge_hijacked") > 0) & ~traffic, F.lit("BGP anomalies without traffic impact")),
            F.when(routing != traffic, F.lit("inconsistent_anomaly_detection")),
        )
    )
    gaps = F.array_compact(
        F.array(
            F.when(~_c("routing_available"), F.lit("routing_details")),
            F.when(~_c("traffic_available"), F.lit("traffic_patterns")),
            F.when(~(routing & traffic), F.lit("temporal_correlation")),
            F.when(~present("country"), F.lit("geographic_impact")),
            F.when(_c("prefixes") == 0, F.lit("affected_networks")),
        )
    )

    def share(parts: list[Column]) -> Column:
        return sum((F.when(p, 1).otherwise(0) for p in parts), F.lit(0)) / float(len(parts))

    r_parts = [F.lit(True), _c("events") > 0, present("country"), _c("prefixes") > 0]
    t_parts = [F.lit(True), present("period_name"), present("anomaly_start"), _c("data_points") > 0]
    complete = (
        F.when(_c("routing_available"), share(r_parts) * 0.5).otherwise(0.0)
        + F.when(_c("traffic_available"), share(t_parts) * 0.5).otherwise(0.0)
    )
    return rows.withColumns({"conflicts": conflicts, "gaps": gaps, "completeness": complete})


def rule_tags(alerts: DataFrame, rows: DataFrame, orgs: DataFrame) -> DataFrame:
    """(asn, tag): what the rule book says of each AS.

    Campaign: one hijacker, several victims. Cross-border: hijacker and victim registered
    in different countries. The rest comes from the incident row.
    """
    pairs = alerts.where("hijacker_as IS NOT NULL AND victim_as IS NOT NULL AND hijacker_as <> victim_as").groupBy(
        "hijacker_as", "victim_as"
    ).agg(F.count("*").alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    victims = pairs.groupBy(F.col("hijacker_as").alias("asn")).agg(F.count("*").alias("victims"))
    campaign = victims.where("victims > 1").select("asn", F.lit("systematic_campaign").alias("tag"))
    recurring = pairs.where("n > 1").select(F.col("victim_as").alias("asn"), F.lit("recurring_pattern").alias("tag")).distinct()
    place = orgs.select("asn", "country").where("country IS NOT NULL")
    abroad = (
        pairs.join(place.toDF("hijacker_as", "c1"), "hijacker_as").join(place.toDF("victim_as", "c2"), "victim_as")
        .where("c1 <> c2").select(F.col("victim_as").alias("asn"), F.lit("cross_border").alias("tag")).distinct()
    )
    minutes = (T.seconds(_c("last_seen")) - T.seconds(_c("first_seen"))) / 60
    routing, pc = _has_routing(), _c("percent_change")
    own = F.array_compact(
        F.array(
            F.when(_c("origin_hijacked") + _c("origin_hijacking") > 0, F.lit("origin_hijack")),
            F.when(_c("forge_hijacked") + _c("forge_hijacking") > 0, F.lit("path_forgery")),
            F.when((_c("forge_hijacked") + _c("forge_hijacking") > 0) & _has_traffic(), F.lit("active_interception")),
            F.when((_c("origin_hijacked") > 0) & (minutes > 120), F.lit("persistent_attack")),
            F.when(routing & (pc > 200), F.lit("active_exploitation")),
            F.when(routing & (pc < -50), F.lit("service_disruption")),
            F.when(~routing & _has_traffic(), F.lit("non_routing_incident")),
            F.when(routing & (minutes < 10), F.lit("likely_misconfiguration"))
            .when(routing & (minutes <= 120), F.lit("moderate_impact")).when(routing, F.lit("high_impact")),
        )
    )
    mine = rows.select("asn", F.explode(own).alias("tag"))
    return mine.unionByName(campaign).unionByName(recurring).unionByName(abroad)


def path_length_tags(observed: DataFrame, more_than: int = 3) -> DataFrame:
    """(prefix, path, difference): paths over ``more_than`` hops off the prefix's usual one."""
    gap = F.abs(F.size("path") - F.size("expected"))
    return observed.where(gap > more_than).select("prefix", "path", gap.alias("difference"))


def merged_anomalies(alerts: DataFrame, leaks: DataFrame, outages: DataFrame, traffic: DataFrame) -> DataFrame:
    """All findings in one list, newest first."""

    def part(df: DataFrame, asn: str, ts: str, kind: str, sub: Column, severity: Column, conf: Column, source: str) -> DataFrame:
        return df.select(
            F.col(asn).alias("asn"), F.col(ts).alias("timestamp"), F.lit(kind).alias("type"), sub.alias("subtype"),
            severity.alias("severity"), conf.alias("confidence"), F.lit(source).alias("source"),
        )

    none = F.lit(None).cast("string")
    rows = (
        part(alerts, "target_as", "ts", "hijack", _c("type"), F.lit("high"), _c("confidence"), "routing")
        .unionByName(part(leaks, "origin_as", "ts", "route_leak", none, F.lit("medium"), F.lit("medium"), "routing"))
        .unionByName(part(outages, "target", "ts", "outage", none, F.lit("high"), F.lit("medium"), "routing"))
        .unionByName(part(traffic, "asn", "ts", "traffic", none, _c("severity"), F.lit("medium"), "traffic"))
    )
    return rows.orderBy(F.desc("timestamp"), "asn", "type", "subtype")


def batch_totals(rows: DataFrame) -> DataFrame:
    """One row over all ASes: how many, how many analysed, how many with findings of each kind."""
    routing_n = _c("events") + _c("route_leaks")
    high = S.as_severity(routing_n, _c("traffic_anomalies")) == "high"
    g = rows.agg(
        F.count("*").alias("as_count"),
        F.count_if(_c("traffic_available")).alias("success_count"),
        F.count_if(_has_traffic()).alias("anomaly_count"),
        F.count_if(_has_traffic() & _has_routing()).alias("correlated"),
        F.sum(routing_n).alias("routing_anomalies"),
        F.sum("traffic_anomalies").alias("traffic_points"),
        F.count_if(high).alias("high_severity"),
    )

    def status(c: Column, limit: int) -> Column:
        return F.when(c > limit, "critical").when(c > 0, "warning").otherwise("normal")

    return g.withColumns(
        {
            "routing_status": status(_c("routing_anomalies"), 10),
            "traffic_status": status(_c("traffic_points"), 10),
            "severity_status": status(_c("high_severity"), 3),
        }
    )


def kind_summary(alerts: DataFrame, rows: DataFrame) -> DataFrame:
    """Per AS the alerts of each kind, leaks and the outage flag, and a row of grand totals."""
    kinds = alerts.groupBy(F.col("target_as").alias("asn")).pivot("type", list(KINDS)).agg(F.count(F.lit(1)))
    base = rows.select("asn", "route_leaks", F.when(_c("outage"), 1).otherwise(0).alias("outages"))
    joined = base.join(kinds, "asn", "left").fillna(0, list(KINDS))
    sums = [F.sum(k).cast("bigint").alias(k) for k in (*KINDS, "route_leaks", "outages")]
    return joined.rollup("asn").agg(*sums).fillna("all", ["asn"])


def set_metrics(predicted: DataFrame, truth: DataFrame, cases: DataFrame, key: str = "event_id") -> DataFrame:
    """Precision, recall and F1 per case of (case, member) rows.

    Counted by joins on members, so no set is gathered. Both empty scores 1, only the
    prediction empty 0.
    """
    p, t = predicted.select(key, "member").distinct(), truth.select(key, "member").distinct()
    np_ = p.groupBy(key).agg(F.count("*").alias("n_pred"))
    nt = t.groupBy(key).agg(F.count("*").alias("n_true"))
    hit = p.join(t, [key, "member"]).groupBy(key).agg(F.count("*").alias("hits"))
    j = cases.select(key).distinct().join(np_, key, "left").join(nt, key, "left").join(hit, key, "left").fillna(0)
    empty = (_c("n_pred") == 0) & (_c("n_true") == 0)
    precision = F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide("hits", "n_pred"), F.lit(0.0)))
    recall = F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide("hits", "n_true"), F.lit(0.0)))
    scored = j.withColumns({"precision": precision, "recall": recall})
    f1 = F.coalesce(F.try_divide(2 * _c("precision") * _c("recall"), _c("precision") + _c("recall")), F.lit(0.0))
    return scored.withColumn("f1", f1)


def macro_mean(scored: DataFrame) -> DataFrame:
    return scored.agg(*[F.avg(n).alias(f"{n}_macro") for n in ("precision", "recall", "f1")])


def event_counts(results: DataFrame) -> DataFrame:
    """Analyses per event type and event, done and failed, with subtotals."""
    g = results.rollup("event_type", "event_name").agg(
        F.count("*").alias("analyses"), F.count_if(_c("has_data")).alias("successful"),
        F.count_if(~_c("has_data")).alias("failed"), F.sum("anomalies").alias("anomalies"),
    )
    return g.fillna("all", ["event_type", "event_name"])

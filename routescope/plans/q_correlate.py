"""Queries over correlated findings: classification, confidence, reports, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from routescope.functions import times as T
from routescope.operators import correlate as C
from routescope.operators import hijack, leak, lookups
from routescope.operators import outage as O
from routescope.operators import traffic as TR
from routescope.plans import q_features, q_hijack
from routescope.plans.registry import query
from routescope.plans.sqlviews import add_view
from routescope.sources import adapters as A
from routescope.sources.landing import landed

c = F.col
FMT = "'%Y-%m-%d %H:%M:%S'"
SPLIT = "2024-01-21 00:00:00"
SLOT = 21600

# ---------------------------------------------------------------- SQL side
add_view(
    "atraf",
    f"""SELECT origin_as AS asn, s // {SLOT} * {SLOT} AS t, make_timestamp(s // {SLOT} * {SLOT} * 1000000) AS ts, sum(volume) AS value,
  row_number() OVER (PARTITION BY origin_as ORDER BY s // {SLOT}) - 1 AS idx FROM updates WHERE aw = 'A' GROUP BY origin_as, s // {SLOT}""",
)
add_view(
    "aanom",
    """SELECT asn, ts, t, z, CASE WHEN abs(z) > 3.0 THEN 'high' ELSE 'medium' END AS severity FROM (
  SELECT asn, ts, t, round((value - m) / greatest(sd, 0.05 * abs(m), 0.02), 9) AS z FROM (
    SELECT asn, ts, t, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(*) OVER w AS n FROM atraf WINDOW w AS (PARTITION BY asn ORDER BY idx ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) WHERE n = 12)
WHERE abs(z) > 2.5""",
)
add_view(
    "rsum",
    """SELECT target_as AS asn, count(*) FILTER (type = 'origin_hijacked') AS origin_hijacked, count(*) FILTER (type = 'forge_hijacked') AS forge_hijacked,
  count(*) FILTER (type = 'origin_hijacking') AS origin_hijacking, 0 AS forge_hijacking, count(DISTINCT prefix) AS prefixes, count(DISTINCT ts) AS routing_times, min(ts) AS first_seen, max(ts) AS last_seen
FROM alerts GROUP BY 1""",
)
add_view(
    "tsum",
    f"""SELECT x.asn, x.data_points, coalesce((x.now - x.thn) / nullif(x.thn, 0) * 100, 0.0) AS percent_change, coalesce(y.n, 0) AS traffic_anomalies, coalesce(y.d, 0) AS traffic_times FROM (
  SELECT asn, count(*) AS data_points, avg(value) FILTER (ts >= TIMESTAMP '{SPLIT}') AS now, avg(value) FILTER (ts < TIMESTAMP '{SPLIT}') AS thn FROM atraf GROUP BY 1) x
LEFT JOIN (SELECT asn, count(*) AS n, count(DISTINCT ts) AS d FROM aanom GROUP BY 1) y ON y.asn = x.asn""",
)
add_view("aover", "SELECT asn, count(DISTINCT ts) AS overlap FROM (SELECT a.target_as AS asn, a.ts FROM alerts a JOIN aanom q ON q.asn = a.target_as AND abs(q.t - a.s) < 3600) GROUP BY 1")
add_view("aleak", "SELECT origin_as AS asn, count(*) AS route_leaks FROM leaks GROUP BY 1")
add_view("aout", "SELECT t.asn, bool_or(o.suspected) AS outage FROM targets t JOIN outages o ON o.target = t.target GROUP BY 1")
add_view(
    "inc",
    """SELECT coalesce(r.asn, t.asn) AS asn, coalesce(r.origin_hijacked, 0) AS origin_hijacked, coalesce(r.forge_hijacked, 0) AS forge_hijacked, coalesce(r.origin_hijacking, 0) AS origin_hijacking, 0 AS forge_hijacking,
  coalesce(r.prefixes, 0) AS prefixes, coalesce(r.routing_times, 0) AS routing_times, r.first_seen, r.last_seen, r.asn IS NOT NULL AS ra, t.asn IS NOT NULL AS ta,
  coalesce(t.data_points, 0) AS data_points, coalesce(t.percent_change, 0.0) AS percent_change, coalesce(t.traffic_anomalies, 0) AS tn, coalesce(t.traffic_times, 0) AS traffic_times,
  coalesce(l.route_leaks, 0) AS route_leaks, coalesce(v.overlap, 0) AS overlap, coalesce(o.outage, false) AS outage,
  coalesce(r.origin_hijacked, 0) + coalesce(r.forge_hijacked, 0) + coalesce(r.origin_hijacking, 0) AS events, (epoch_us(r.last_seen) - epoch_us(r.first_seen)) / 60000000.0::DOUBLE AS minutes
FROM rsum r FULL JOIN tsum t ON t.asn = r.asn LEFT JOIN aleak l ON l.asn = coalesce(r.asn, t.asn) LEFT JOIN aover v ON v.asn = coalesce(r.asn, t.asn) LEFT JOIN aout o ON o.asn = coalesce(r.asn, t.asn)""",
)
add_view(
    "imp",
    """SELECT *, greatest(least(1.0, events / 5.0), least(1.0, prefixes / 3.0))::DOUBLE AS ri, greatest(least(1.0, abs(percent_change) / 40.0), least(1.0, tn / 3.0))::DOUBLE AS tsv FROM inc""",
)


# ---------------------------------------------------------------- Spark side
def as_traffic(spark, d):
    """(asn, ts, value, idx): volume announced by each origin per six hours."""
    from pyspark.sql import Window

    slots = A.updates(spark, d).where("aw = 'A'").groupBy(
        c("origin_as").alias("asn"), T.bucket_start(c("ts"), SLOT).alias("ts")
    ).agg(F.sum("volume").alias("value"))
    return slots.withColumn("idx", F.row_number().over(Window.partitionBy("asn").orderBy("ts")) - 1)


def as_anomalies(spark, d):
    return TR.moving_average(as_traffic(spark, d), ["asn"])


def leaks(spark, d):
    return leak.leaks(A.updates(spark, d).where("aw = 'A'"), A.asprob(spark, d))


def outages(spark, d):
    return O.detect(q_features.series(spark, d), A.catalogue(spark, d), "daily", q_features.WIDE)


def _incidents(spark, d):
    alerts = q_hijack.all_alerts(spark, d)
    odd = as_anomalies(spark, d)
    per_as = leaks(spark, d).groupBy(c("origin_as").alias("asn")).agg(F.count("*").alias("route_leaks"))
    down = outages(spark, d).groupBy("target").agg(F.max("suspected").alias("outage")).join(A.targets(spark, d), "target")
    return C.incidents(
        C.routing_summary(alerts), per_as, C.traffic_summary(as_traffic(spark, d), odd, SPLIT),
        C.temporal_overlap(alerts, odd), down.groupBy("asn").agg(F.max("outage").alias("outage")),
    )


def incidents(spark, d):
    """The table of incidents is stored once; scores and reports read it."""
    return landed(spark, d, "incidents", _incidents)


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


@query(
    "F22_incident_table",
    f"""SELECT asn, origin_hijacked, forge_hijacked, origin_hijacking, CAST(forge_hijacking AS BIGINT) AS forge_hijacking, prefixes, routing_times, strftime(first_seen, {FMT}) AS first_seen, data_points,
          round(percent_change, 6) AS percent_change, tn AS traffic_anomalies, route_leaks, overlap, outage FROM inc""",
)
def f22a(spark, d):
    r = _incidents(spark, d).select(
        "asn", *C.KINDS, "prefixes", "routing_times", T.text(c("first_seen")).alias("first_seen"), "data_points", "percent_change",
        "traffic_anomalies", "route_leaks", "overlap", "outage",
    )
    return rounded(r, "percent_change")


@query(
    "F22_classification",
    """SELECT asn, CASE WHEN origin_hijacked + origin_hijacking > 0 THEN 'Origin Hijacking' WHEN forge_hijacked > 0 THEN 'Path Forgery' ELSE 'No BGP Anomaly Detected' END AS classification,
         CASE WHEN events > 0 AND tn > 0 THEN 'Correlated BGP and Traffic Anomalies' WHEN events > 0 THEN 'BGP Anomaly Without Traffic Impact' WHEN tn > 0 THEN 'Traffic Anomaly Without BGP Events' ELSE 'No Anomalies Detected' END AS correlation,
         CASE WHEN coalesce(minutes, 0) > 120 THEN 'High' WHEN coalesce(minutes, 0) > 10 THEN 'Medium' ELSE 'Low' END AS severity,
         CASE WHEN f >= 3 THEN 'High' WHEN f >= 2 THEN 'Medium' ELSE 'Low' END AS data_quality,
         CASE WHEN events > 0 THEN 'Route Hijack' WHEN route_leaks > 0 THEN 'Route Leak' WHEN tn > 0 THEN 'Traffic Anomaly' ELSE 'Normal Operation' END AS "primary",
         CASE WHEN tn > 0 AND (events > 0 OR outage) THEN 'routing_related' WHEN tn > 0 THEN 'non_routing_related' WHEN events > 0 OR outage THEN 'routing_issues_without_traffic_impact' ELSE 'unknown' END AS primary_cause,
         CASE WHEN ta AND tn = 0 AND events + route_leaks + outage::INT > 0 THEN 'traffic_ok_routing_anomaly' WHEN events + route_leaks + outage::INT > 0 THEN 'both_anomalous' WHEN ta AND tn = 0 THEN 'both_ok' END AS cross_check,
         round(CASE WHEN ra::INT + ta::INT > 0 THEN least(1.0, (0.3 * ta::INT + 0.2 * (ta AND tn > 0)::INT + 0.3 * ra::INT + 0.2 * (ra AND events > 0)::INT) / ((ra::INT + ta::INT) * 0.5)) ELSE 0 END, 6)::DOUBLE AS quality_score
       FROM (SELECT *, ra::INT + (ra AND events > 0)::INT + ta::INT + (ta AND tn > 0)::INT AS f FROM inc)""",
)
def f22(spark, d):
    r = C.classify(incidents(spark, d))
    return rounded(r.select("asn", "classification", "correlation", "severity", "data_quality", "primary", "primary_cause", "cross_check", "quality_score"), "quality_score")


@query("F23_impact_scores", "SELECT asn, round(ri, 6) AS routing_impact, round(tsv, 6) AS traffic_severity FROM imp")
def f23(spark, d):
    r = C.impact(incidents(spark, d)).select("asn", "routing_impact", "traffic_severity")
    return rounded(r, "routing_impact", "traffic_severity")


add_view(
    "conf1",
    """SELECT *, CASE WHEN (events > 0) = (tn > 0) THEN 0.9 ELSE 0.6 END::DOUBLE AS ag, CASE WHEN tsv >= 0.6 AND ri < 0.3 THEN greatest(0.1, b - least(0.4, tsv - ri)) ELSE b END::DOUBLE AS ce,
  overlap / greatest(1, routing_times, traffic_times)::DOUBLE AS ratio FROM (SELECT *, CASE WHEN events > 0 THEN 0.8 ELSE 0.7 END::DOUBLE AS b FROM imp)""",
)
add_view(
    "conf2",
    """SELECT *, least(ag, least(0.95, ce))::DOUBLE AS r1, least(c2, least(0.95, ce * CASE WHEN c2 >= 0.8 THEN 1.05 ELSE 1.0 END))::DOUBLE AS r2 FROM (
  SELECT *, CASE WHEN overlap > 0 AND ratio > 0.5 THEN least(0.95, ag + 0.1) WHEN overlap > 0 AND ratio > 0.2 THEN least(0.9, ag + 0.05) ELSE ag END::DOUBLE AS c2 FROM conf1)""",
)
add_view(
    "conf3",
    """SELECT *, least(c3, least(0.95, ce * CASE WHEN c3 >= 0.8 THEN 1.1 ELSE 1.0 END))::DOUBLE AS r3 FROM (
  SELECT *, CASE WHEN abs(r1 - r2) < 0.1 THEN least(0.95, c2 + 0.05) ELSE c2 END::DOUBLE AS c3 FROM conf2)""",
)


@query(
    "F24_confidence",
    """SELECT asn, round(r1, 6) AS round_1, round(r2, 6) AS round_2, round(r3, 6) AS round_3, round(f, 6) AS confidence, CASE WHEN f >= 0.8 THEN 'High' WHEN f >= 0.6 THEN 'Medium' ELSE 'Low' END AS level
       FROM (SELECT *, CASE WHEN r1 >= 0.8 THEN r1 WHEN r2 >= 0.8 THEN r2 ELSE r3 END AS f FROM conf3)""",
)
def f24(spark, d):
    r = C.confidence(C.impact(incidents(spark, d))).select("asn", "round_1", "round_2", "round_3", "confidence", "level")
    return rounded(r, "round_1", "round_2", "round_3", "confidence")


add_view(
    "wconf",
    """SELECT *, ((0.5 + CASE WHEN events > 0 AND tn > 0 THEN 1.0 WHEN events > 0 OR tn > 0 THEN 0.6 ELSE 0.3 END + CASE WHEN ra AND ta THEN 1.0 WHEN ra OR ta THEN 0.7 ELSE 0.3 END) / 3 * 0.3
    + CASE ty WHEN 'route_hijack' THEN 0.8 WHEN 'route_leak' THEN 0.7 ELSE 0.3 END * CASE WHEN events > 0 AND tn > 0 THEN 1.0 WHEN events > 0 OR tn > 0 THEN 0.8 ELSE 0.6 END
      * CASE sev WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.8 ELSE 0.7 END * 0.3 + wi * 0.2 + ws * 0.2)::DOUBLE * 0.95 AS w
FROM (SELECT *, CASE WHEN (wi + ws) / 2 > 0.8 THEN 'critical' WHEN (wi + ws) / 2 > 0.6 THEN 'high' WHEN (wi + ws) / 2 > 0.4 THEN 'medium' ELSE 'low' END AS sev FROM (
  SELECT *, CASE WHEN events > 0 THEN 'route_hijack' WHEN route_leaks > 0 THEN 'route_leak' ELSE 'unknown' END AS ty,
    least(1.0, 0.5 + CASE WHEN events > 0 THEN 0.3 ELSE 0 END + CASE WHEN route_leaks > 0 THEN 0.2 ELSE 0 END)::DOUBLE AS wi, least(1.0, tn / 10.0 + abs(percent_change) / 50.0)::DOUBLE AS ws FROM inc))""",
)


@query(
    "F24_weighted_confidence",
    """SELECT asn, ty AS incident_type, sev AS incident_severity, round(w, 6) AS weighted_confidence,
         CASE WHEN w >= 0.9 THEN 'very_high' WHEN w >= 0.8 THEN 'high' WHEN w >= 0.7 THEN 'moderate' WHEN w >= 0.6 THEN 'low' ELSE 'very_low' END AS weighted_level FROM wconf""",
)
def f24b(spark, d):
    r = C.weighted_confidence(incidents(spark, d))
    return rounded(r.select("asn", "incident_type", "incident_severity", "weighted_confidence", "weighted_level"), "weighted_confidence")


def located(spark, d):
    orgs = lookups.organisations(A.aut(spark, d).select("asn"), A.aut(spark, d), A.org(spark, d)).select("asn", "country")
    return incidents(spark, d).join(orgs, "asn", "left")


@query(
    "F25_evidence",
    """SELECT asn, array_to_string(list_filter([CASE WHEN origin_hijacked + forge_hijacked > 0 AND tn = 0 THEN 'BGP anomalies without traffic impact' END,
           CASE WHEN (events > 0) <> (tn > 0) THEN 'inconsistent_anomaly_detection' END], lambda x: x IS NOT NULL), ',') AS conflicts,
         array_to_string(list_filter([CASE WHEN NOT ra THEN 'routing_details' END, CASE WHEN NOT ta THEN 'traffic_patterns' END, CASE WHEN NOT (events > 0 AND tn > 0) THEN 'temporal_correlation' END,
           CASE WHEN country IS NULL THEN 'geographic_impact' END, CASE WHEN prefixes = 0 THEN 'affected_networks' END], lambda x: x IS NOT NULL), ',') AS gaps,
         round(CASE WHEN ra THEN (1 + (events > 0)::INT + (country IS NOT NULL)::INT + (prefixes > 0)::INT) / 4.0 * 0.5 ELSE 0 END + CASE WHEN ta THEN (1 + (data_points > 0)::INT) / 4.0 * 0.5 ELSE 0 END, 6)::DOUBLE AS completeness
       FROM (SELECT inc.*, org.country FROM inc LEFT JOIN aut ON aut.asn = inc.asn LEFT JOIN org ON org.org_id = aut.org_id)""",
)
def f25(spark, d):
    r = C.evidence(located(spark, d))
    return rounded(r.select("asn", F.array_join("conflicts", ",").alias("conflicts"), F.array_join("gaps", ",").alias("gaps"), "completeness"), "completeness")


@query(
    "F26_merged_anomalies",
    f"""SELECT asn, strftime(ts, {FMT}) AS timestamp, type, coalesce(subtype, '') AS subtype, severity, source, count(*) AS n FROM (
         SELECT target_as AS asn, ts, 'hijack' AS type, type AS subtype, 'high' AS severity, 'routing' AS source FROM alerts
         UNION ALL SELECT origin_as, ts, 'route_leak', NULL, 'medium', 'routing' FROM leaks
         UNION ALL SELECT o.target, k."start", 'outage', NULL, 'high', 'routing' FROM outages o JOIN catalogue k ON k.event_name = o.event_name WHERE o.suspected
         UNION ALL SELECT asn, ts, 'traffic', NULL, severity, 'traffic' FROM aanom) GROUP BY ALL""",
)
def f26(spark, d):
    down = outages(spark, d).where("suspected").join(A.catalogue(spark, d), "event_name").withColumn("ts", c("start"))
    m = C.merged_anomalies(q_hijack.all_alerts(spark, d), leaks(spark, d), down, as_anomalies(spark, d))
    shown = m.select("asn", T.text(c("timestamp")).alias("timestamp"), "type", F.coalesce("subtype", F.lit("")).alias("subtype"), "severity", "source")
    return shown.groupBy(*shown.columns).agg(F.count("*").alias("n"))


add_view(
    "hv",
    """SELECT h, v, count(*) AS n FROM (SELECT origin_as AS h, victim_as AS v FROM origin_alerts UNION ALL SELECT (list_sort(ends))[1], victim_as FROM forge_alerts) WHERE h <> v GROUP BY 1, 2""",
)


@query(
    "F34_rule_tags",
    """SELECT asn, tag FROM (SELECT asn, unnest(list_filter([CASE WHEN origin_hijacked + origin_hijacking > 0 THEN 'origin_hijack' END, CASE WHEN forge_hijacked > 0 THEN 'path_forgery' END,
           CASE WHEN forge_hijacked > 0 AND tn > 0 THEN 'active_interception' END, CASE WHEN origin_hijacked > 0 AND minutes > 120 THEN 'persistent_attack' END,
           CASE WHEN events > 0 AND percent_change > 200 THEN 'active_exploitation' END, CASE WHEN events > 0 AND percent_change < -50 THEN 'service_disruption' END,
           CASE WHEN events = 0 AND tn > 0 THEN 'non_routing_incident' END,
           CASE WHEN events > 0 AND minutes < 10 THEN 'likely_misconfiguration' WHEN events > 0 AND minutes <= 120 THEN 'moderate_impact' WHEN events > 0 THEN 'high_impact' END], lambda x: x IS NOT NULL)) AS tag FROM inc)
       UNION ALL SELECT h, 'systematic_campaign' FROM hv GROUP BY h HAVING count(*) > 1
       UNION ALL SELECT DISTINCT v, 'recurring_pattern' FROM hv WHERE n > 1
       UNION ALL SELECT DISTINCT v, 'cross_border' FROM hv JOIN aut a ON a.asn = hv.h JOIN org p ON p.org_id = a.org_id JOIN aut b ON b.asn = hv.v JOIN org q ON q.org_id = b.org_id WHERE p.country <> q.country""",
)
def f34(spark, d):
    orgs = lookups.organisations(A.aut(spark, d).select("asn"), A.aut(spark, d), A.org(spark, d))
    return C.rule_tags(q_hijack.all_alerts(spark, d), incidents(spark, d), orgs)


@query(
    "F34_path_length_tags",
    """SELECT prefix, array_to_string(path, ' ') AS path, abs(len(path) - len(expected)) AS difference FROM dompair WHERE abs(len(path) - len(expected)) > 3""",
)
def f34b(spark, d):
    # blocks of networks, whole paths with their prepends
    u = A.updates(spark, d).where("aw = 'A'").withColumns(
        {"prefix": F.regexp_extract("prefix", r"^(\d+\.\d+)", 1), "hops": F.array_repeat(F.lit("h"), F.size(F.split("as_path", " ")))}
    )
    r = C.path_length_tags(hijack.dominant_paths(u))
    return r.select("prefix", F.array_join("path", " ").alias("path"), c("difference").cast("bigint").alias("difference"))


@query(
    "F34_path_length_tags_prefix",
    """SELECT prefix, array_to_string(path, ' ') AS path, abs(len(path) - len(expected)) AS difference FROM wdom WHERE abs(len(path) - len(expected)) > 3""",
)
def f34_prefix(spark, d):
    # whole prefixes, whole paths with their prepends
    u = A.updates(spark, d).where("aw = 'A'").withColumn("hops", F.split("as_path", " "))
    r = C.path_length_tags(hijack.dominant_paths(u))
    return r.select("prefix", F.array_join("path", " ").alias("path"), c("difference").cast("bigint").alias("difference"))


add_view("wcount", "SELECT prefix, string_split(as_path, ' ') AS hops, count(*) AS n FROM updates WHERE aw = 'A' GROUP BY 1, 2")
add_view(
    "wdom",
    """SELECT x.prefix, b.expected, x.hops AS path, x.n FROM wcount x JOIN (SELECT prefix, (list(hops ORDER BY n DESC, hops))[1] AS expected FROM wcount GROUP BY prefix) b ON b.prefix = x.prefix
WHERE x.n >= 2 AND x.hops <> b.expected""",
)
add_view(
    "hcount",
    """SELECT regexp_extract(prefix, '^(\\d+\\.\\d+)', 1) AS prefix, list_transform(string_split(as_path, ' '), lambda h: 'h') AS hops, count(*) AS n FROM updates WHERE aw = 'A' GROUP BY 1, 2""",
)
add_view(
    "dompair",
    """SELECT x.prefix, b.expected, x.hops AS path, x.n FROM hcount x JOIN (SELECT prefix, (list(hops ORDER BY n DESC, hops))[1] AS expected FROM hcount GROUP BY prefix) b ON b.prefix = x.prefix
WHERE x.n >= 2 AND x.hops <> b.expected""",
)


@query(
    "D27_batch_totals",
    """SELECT *, CASE WHEN routing_anomalies > 10 THEN 'critical' WHEN routing_anomalies > 0 THEN 'warning' ELSE 'normal' END AS routing_status, CASE WHEN traffic_points > 10 THEN 'critical' WHEN traffic_points > 0 THEN 'warning' ELSE 'normal' END AS traffic_status,
         CASE WHEN high_severity > 3 THEN 'critical' WHEN high_severity > 0 THEN 'warning' ELSE 'normal' END AS severity_status FROM (
         SELECT count(*) AS as_count, count(*) FILTER (ta) AS success_count, count(*) FILTER (tn > 0) AS anomaly_count, count(*) FILTER (tn > 0 AND events > 0) AS correlated, CAST(sum(events + route_leaks) AS BIGINT) AS routing_anomalies,
           CAST(sum(tn) AS BIGINT) AS traffic_points, count(*) FILTER (events + route_leaks + tn > 15 OR events + route_leaks > 8) AS high_severity FROM inc)""",
)
def d27(spark, d):
    return C.batch_totals(incidents(spark, d))


@query("D27_anomalous_ases", "SELECT asn, tn AS traffic_anomalies, CASE WHEN events + route_leaks + tn > 15 OR events + route_leaks > 8 THEN 'high' WHEN events + route_leaks + tn > 5 OR events + route_leaks > 2 THEN 'medium' ELSE 'low' END AS severity FROM inc WHERE tn > 0")
def d27b(spark, d):
    from routescope.functions.scores import as_severity

    r = incidents(spark, d).where("traffic_anomalies > 0")
    return r.select("asn", "traffic_anomalies", as_severity(c("events") + c("route_leaks"), c("traffic_anomalies")).alias("severity"))


@query(
    "D32_kind_summary",
    """SELECT coalesce(asn, 'all') AS asn, CAST(sum(origin_hijacked) AS BIGINT) AS origin_hijacked, CAST(sum(forge_hijacked) AS BIGINT) AS forge_hijacked, CAST(sum(origin_hijacking) AS BIGINT) AS origin_hijacking, CAST(0 AS BIGINT) AS forge_hijacking,
         CAST(sum(route_leaks) AS BIGINT) AS route_leaks, CAST(sum(outage::INT) AS BIGINT) AS outages FROM inc GROUP BY ROLLUP (asn)""",
)
def d32(spark, d):
    return C.kind_summary(q_hijack.all_alerts(spark, d), incidents(spark, d))


# Attackers named by alerts on a prefix, against those who announced it without owning it.
add_view("pred", "SELECT DISTINCT prefix AS event_id, origin_as AS member FROM alerts")
add_view(
    "truth",
    "SELECT DISTINCT u.prefix AS event_id, u.origin_as AS member FROM updates u LEFT JOIN owners o ON o.prefix = u.prefix WHERE u.aw = 'A' AND (o.origins IS NULL OR o.origins[1] <> u.origin_as)",
)
add_view(
    "smet",
    """SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END::DOUBLE AS f FROM (SELECT event_id, CASE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN np = 0 THEN 0.0 ELSE h / np::DOUBLE END::DOUBLE AS p,
  CASE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN nt = 0 THEN 0.0 ELSE h / nt::DOUBLE END::DOUBLE AS r FROM (
  SELECT c.event_id, (SELECT count(*) FROM pred x WHERE x.event_id = c.event_id) AS np, (SELECT count(*) FROM truth x WHERE x.event_id = c.event_id) AS nt,
    (SELECT count(*) FROM pred x JOIN truth y ON y.event_id = x.event_id AND y.member = x.member WHERE x.event_id = c.event_id) AS h FROM (SELECT DISTINCT prefix AS event_id FROM updates) c))""",
)


def metrics(spark, d):
    from routescope.operators import prefix_join

    u = A.updates(spark, d)
    pred = q_hijack.all_alerts(spark, d).select(c("prefix").alias("event_id"), c("origin_as").alias("member"))
    a = u.where("aw = 'A'").select("prefix", "origin_as").distinct()
    owned = prefix_join.resolve_owners(a, A.prefix2as(spark, d))
    wrong = c("origins").isNull() | (F.get("origins", F.lit(0)) != c("origin_as"))
    truth = a.join(owned, "prefix", "left").where(wrong).select(c("prefix").alias("event_id"), c("origin_as").alias("member"))
    return C.set_metrics(pred, truth, u.select(c("prefix").alias("event_id")))


@query("D28_set_metrics", "SELECT event_id, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM smet")
def d28(spark, d):
    return rounded(metrics(spark, d).select("event_id", "precision", "recall", "f1"), "precision", "recall", "f1")


@query("D28_macro_mean", "SELECT round(avg(p), 6) AS precision_macro, round(avg(r), 6) AS recall_macro, round(avg(f), 6) AS f1_macro FROM smet")
def d28b(spark, d):
    return rounded(C.macro_mean(metrics(spark, d)), "precision_macro", "recall_macro", "f1_macro")


@query(
    "D29_event_counts",
    """SELECT coalesce(k.event_type, 'all') AS event_type, coalesce(o.event_name, 'all') AS event_name, count(*) AS analyses, count(*) FILTER (o.buckets >= 6) AS successful,
         count(*) FILTER (o.buckets < 6) AS failed, CAST(sum(o.anomalies) AS BIGINT) AS anomalies FROM outages o JOIN catalogue k ON k.event_name = o.event_name GROUP BY ROLLUP (k.event_type, o.event_name)""",
)
def d29(spark, d):
    return C.event_counts(outages(spark, d).join(A.catalogue(spark, d).select("event_name", "event_type"), "event_name"))

"""Queries over hijack, forged-path and interception detection, and alert roll-ups."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from routescope.functions import scores as S
from routescope.functions import times as T
from routescope.operators import frequency, hijack, pathsets, reports
from routescope.plans import jobs
from routescope.plans.registry import query
from routescope.plans.sqlviews import VIEWS, add_view
from routescope.sources import adapters as A
from routescope.sources.landing import landed

c = F.col
FMT = "'%Y-%m-%d %H:%M:%S'"

add_view(
    "origin_alerts",
    """SELECT CASE WHEN t.asn = x.origin_as THEN 'origin_hijacking' ELSE 'origin_hijacked' END AS type,
  x.seq, x.ts, x.s, x.prefix, x.checked_prefix, x.origin_as, x.as_path, t.asn AS target_as, x.origins,
  CASE WHEN t.asn = x.origin_as THEN x.origins[1] ELSE t.asn END AS victim_as,
  CASE WHEN t.asn = x.origin_as THEN x.origins ELSE list_concat([t.asn], list_filter(x.origins, lambda a: a <> t.asn)) END AS victim_ases,
  'low' AS confidence
FROM (SELECT u.*, o.checked_prefix, o.origins FROM updates u JOIN owners o ON o.prefix = u.prefix
      WHERE u.aw = 'A' AND NOT list_contains(o.origins, u.origin_as)) x
JOIN targets t ON t.asn = x.origin_as OR list_contains(x.origins, t.asn)""",
)
add_view(
    "forge_alerts",
    """SELECT 'forge_hijacked' AS type, x.seq, x.ts, x.s, x.prefix, x.origin_as, x.as_path, t.asn AS target_as,
  coalesce(x.origins, CAST([] AS VARCHAR[])) AS victim_ases, x.ends, x.fake_links, x.first_link,
  coalesce(x.origins[1], t.asn) AS victim_as, 'medium' AS confidence
FROM (SELECT u.*, m.ends, m.fake_links, m.first_link, p2a.origins FROM updates u JOIN marked m ON m.seq = u.seq AND m.suspicious
      LEFT JOIN p2a ON p2a.prefix = u.prefix) x
JOIN targets t ON list_contains(x.hops, t.asn)""",
)
add_view(
    "alerts",
    """SELECT type, seq, ts, s, prefix, origin_as, as_path, target_as, victim_as, confidence FROM origin_alerts
UNION ALL SELECT type, seq, ts, s, prefix, origin_as, as_path, target_as, victim_as, confidence FROM forge_alerts""",
)
add_view(
    "agroups",
    """SELECT type, prefix, s // 300 * 300 AS window_start, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen,
  CASE WHEN count(*) >= 5 THEN 'high' WHEN count(*) >= 2 THEN 'medium' ELSE min(confidence) END AS confidence
FROM alerts GROUP BY 1, 2, 3""",
)


def announcements(spark, d):
    return A.updates(spark, d).where("aw = 'A'")


def origin_alerts(spark, d):
    return hijack.origin_hijacks(announcements(spark, d), A.prefix2as(spark, d), A.targets(spark, d))


def _alerts(spark, d):
    return jobs.hijack_alerts(
        announcements(spark, d), A.asrel(spark, d), A.prefix2as(spark, d), A.targets(spark, d)
    )


def all_alerts(spark, d):
    """Reports read the stored alerts, as they would those of an earlier detection run."""
    return landed(spark, d, "alerts", _alerts)


@query(
    "F1_origin_hijack",
    f"""SELECT type, seq, strftime(ts, {FMT}) AS ts, prefix, checked_prefix, origin_as, target_as,
               array_to_string(origins, ' ') AS legitimate_origins, victim_as, array_to_string(victim_ases, ' ') AS victim_ases
        FROM origin_alerts""",
)
def f1(spark, d):
    return origin_alerts(spark, d).select(
        "type", "seq", T.text(c("ts")).alias("ts"), "prefix", "checked_prefix", "origin_as", "target_as",
        F.array_join("legitimate_origins", " ").alias("legitimate_origins"), "victim_as",
        F.array_join("victim_ases", " ").alias("victim_ases"),
    )


def forge_alerts(spark, d):
    return hijack.forged_paths(
        announcements(spark, d), A.asrel(spark, d), A.prefix2as(spark, d), A.targets(spark, d)
    )


@query(
    "F2_forged_path",
    f"""SELECT type, seq, strftime(ts, {FMT}) AS ts, prefix, target_as, victim_as, fake_links, first_link AS fake_connection,
               array_to_string(victim_ases, ' ') AS victim_ases FROM forge_alerts""",
)
def f2(spark, d):
    text = F.concat_ws(";", F.transform("fakes", lambda f: F.concat_ws("-", f["as1"], f["as2"])))
    return forge_alerts(spark, d).select(
        "type", "seq", T.text(c("ts")).alias("ts"), "prefix", "target_as", "victim_as", text.alias("fake_links"),
        "fake_connection", F.array_join("victim_ases", " ").alias("victim_ases"),
    )


@query(
    "B28_alert_actors",
    """SELECT u.seq, array_to_string(list_sort(m.ends), ' ') AS attacker_ases, (list_sort(m.ends))[1] AS hijacker_as,
              CAST(len(list_distinct(list_append(m.ends, u.origin_as))) AS BIGINT) AS n_hijackers, m.first_link AS fake_connection
       FROM updates u JOIN marked m ON m.seq = u.seq AND m.suspicious""",
)
def b28(spark, d):
    u = announcements(spark, d)
    marked = frequency.mark_updates(u, A.asrel(spark, d)).where("suspicious")
    acted = hijack.alert_actors(marked, A.prefix2as(spark, d))
    return acted.select(
        "seq", F.array_join("attacker_ases", " ").alias("attacker_ases"),
        F.get("hijacker_as_list", F.lit(0)).alias("hijacker_as"),
        F.size("hijacker_as_list").cast("bigint").alias("n_hijackers"), "fake_connection",
    )


@query(
    "F3_batch_hijack_job",
    """SELECT t.asn AS target_as,
         (SELECT count(*) FROM alerts a WHERE a.target_as = t.asn AND a.type = 'origin_hijacked') AS origin_hijacked,
         (SELECT count(*) FROM alerts a WHERE a.target_as = t.asn AND a.type = 'origin_hijacking') AS origin_hijacking,
         (SELECT count(*) FROM alerts a WHERE a.target_as = t.asn AND a.type = 'forge_hijacked') AS forge_hijacked,
         (SELECT count(*) FROM (SELECT u.seq FROM updates u WHERE aw = 'A' AND list_contains(u.hops, t.asn)
                                UNION SELECT u.seq FROM updates u JOIN cover c ON c.prefix = u.prefix AND c.asn = t.asn WHERE aw = 'A')) AS announcements
       FROM targets t""",
)
def f3(spark, d):
    return jobs.hijack_job(announcements(spark, d), A.asrel(spark, d), A.prefix2as(spark, d), A.targets(spark, d))


add_view(
    "cover",
    """SELECT x.prefix, q.origin AS asn FROM pfx x JOIN prefix2as q ON q.prefix = x.prefix
UNION SELECT i.prefix, q.origin FROM inside i JOIN prefix2as q ON q.prefix = i.parent""",
)


@query(
    "F3_revalidated_alerts",
    """SELECT a.seq, a.target_as, a.first_link AS fake_connection, v.ratio > 0.001 AS is_legitimate,
              CASE WHEN v.ratio > 0.001 THEN 'legitimate' ELSE 'confirmed' END AS detection_status
       FROM forge_alerts a JOIN verdicts v ON v.as1 || '|' || v.as2 = a.first_link""",
)
def f3b(spark, d):
    u = announcements(spark, d)
    return jobs.revalidate(forge_alerts(spark, d), u).select(
        "seq", "target_as", "fake_connection", "is_legitimate", "detection_status"
    )


# Paths of a block of networks repeat far more than those of one network do.
def _by_block(spark, d):
    return announcements(spark, d).withColumn("prefix", F.regexp_extract("prefix", r"^(\d+\.\d+)", 1))


add_view(
    "bupd",
    """SELECT regexp_extract(prefix, '^(\\d+\\.\\d+)', 1) AS prefix, hops FROM updates WHERE aw = 'A'""",
)
add_view("bpathn", "SELECT prefix, hops, count(*) AS n FROM bupd GROUP BY 1, 2")
add_view(
    "bdom",
    """SELECT x.prefix, b.expected, b.expected_n, x.hops AS path, x.n FROM bpathn x JOIN (
  SELECT prefix, (list(hops ORDER BY n DESC, hops))[1] AS expected, max(n) AS expected_n FROM bpathn GROUP BY prefix) b
ON b.prefix = x.prefix WHERE x.n >= 2 AND x.hops <> b.expected""",
)


@query(
    "D17_dominant_path",
    """SELECT prefix, array_to_string(expected, ' ') AS expected, expected_n, array_to_string(path, ' ') AS path, n FROM bdom""",
)
def d17(spark, d):
    r = hijack.dominant_paths(_by_block(spark, d))
    return r.withColumns({"expected": F.array_join("expected", " "), "path": F.array_join("path", " ")})


add_view(
    "mitm",
    """SELECT *, least(1.0, 0.4 * least(1.0, ins * 0.5) + 0.3 * len_score + 0.3 * pat) AS risk FROM (
  SELECT prefix, target_as, scenario, n, path, expected,
    CASE WHEN scenario = 'victim' THEN len(list_filter(path, lambda h: NOT list_contains(expected, h)))
         ELSE len(list_filter(path, lambda h, i: i <> list_position(path, target_as) AND NOT list_contains(expected, h) AND NOT list_contains(rel, h))) END AS ins,
    CASE WHEN len(path) - len(expected) <= 0 THEN 0.0 WHEN len(path) - len(expected) = 1 THEN 0.3 WHEN len(path) - len(expected) = 2 THEN 0.6 ELSE 0.9 END AS len_score,
    CASE WHEN scenario = 'victim' THEN 0.8 ELSE least(1.0, 0.3 * (bad
      + len(list_filter(range(1, len(path) - 1), lambda i: path[i] = path[i + 2] AND path[i] <> path[i + 1]))
      + CASE WHEN len(list_filter(path, lambda h: h = target_as)) > 1 THEN 1 ELSE 0 END)) END AS pat
  FROM (SELECT x.*, CASE WHEN list_contains(x.path, x.target_as) THEN 'attacker' ELSE 'victim' END AS scenario,
          coalesce(r.rel, CAST([] AS VARCHAR[])) AS rel, coalesce(b.bad, 0) AS bad
        FROM (SELECT *, unnest(list_distinct(list_concat(path, expected))) AS target_as FROM bdom) x
        JOIN targets t ON t.asn = x.target_as
        LEFT JOIN (SELECT hops, list(DISTINCT a) AS rel FROM (SELECT hops, a, unnest(hops) AS b FROM (SELECT hops, unnest(hops) AS a FROM (SELECT DISTINCT hops FROM bupd))) z
                   JOIN edges2 e ON e.as1 = z.a AND e.as2 = z.b WHERE z.a <> z.b GROUP BY hops) r ON r.hops = x.path
        LEFT JOIN (SELECT hops, count(*) AS bad FROM (SELECT hops, unnest(range(1, len(hops))) AS i FROM (SELECT DISTINCT hops FROM bupd)) z
                   ANTI JOIN edges2 e ON e.as1 = z.hops[z.i] AND e.as2 = z.hops[z.i + 1] GROUP BY hops) b ON b.hops = x.path))""",
)


@query(
    "F4_interception_patterns",
    """SELECT prefix, target_as, scenario, array_to_string(path, ' ') AS path, array_to_string(expected, ' ') AS expected, n,
              CAST(ins AS BIGINT) AS insertions, round(risk, 6)::DOUBLE AS risk,
              CASE WHEN risk > 0.7 THEN 'high' WHEN risk > 0.5 THEN 'medium' ELSE 'low' END AS confidence
       FROM mitm WHERE risk > CASE WHEN scenario = 'victim' THEN 0.2 ELSE 0.3 END""",
)
def f4(spark, d):
    r = hijack.interception_patterns(_by_block(spark, d), A.asrel(spark, d), A.targets(spark, d))
    return r.select(
        "prefix", "target_as", "scenario", F.array_join("path", " ").alias("path"),
        F.array_join("expected", " ").alias("expected"), "n", c("insertions").cast("bigint").alias("insertions"),
        F.round("risk", 6).alias("risk"), "confidence",
    )


# The same by whole prefixes, IPv6 ones included.
add_view("pupd", "SELECT prefix, hops FROM updates WHERE aw = 'A'")
for _from, _to in (("bpathn", "ppathn"), ("bdom", "pdom"), ("mitm", "pmitm")):
    add_view(_to, re.sub(r"\bb(upd|pathn|dom)\b", r"p\1", VIEWS[_from]))


@query(
    "D17_dominant_path_prefix",
    """SELECT prefix, array_to_string(expected, ' ') AS expected, expected_n, array_to_string(path, ' ') AS path, n FROM pdom""",
)
def d17_prefix(spark, d):
    r = hijack.dominant_paths(announcements(spark, d))
    return r.withColumns({"expected": F.array_join("expected", " "), "path": F.array_join("path", " ")})


@query(
    "F4_interception_patterns_prefix",
    """SELECT prefix, target_as, scenario, array_to_string(path, ' ') AS path, array_to_string(expected, ' ') AS expected, n,
              CAST(ins AS BIGINT) AS insertions, round(risk, 6)::DOUBLE AS risk,
              CASE WHEN risk > 0.7 THEN 'high' WHEN risk > 0.5 THEN 'medium' ELSE 'low' END AS confidence
       FROM pmitm WHERE risk > CASE WHEN scenario = 'victim' THEN 0.2 ELSE 0.3 END""",
)
def f4_prefix(spark, d):
    r = hijack.interception_patterns(announcements(spark, d), A.asrel(spark, d), A.targets(spark, d))
    return r.select(
        "prefix", "target_as", "scenario", F.array_join("path", " ").alias("path"),
        F.array_join("expected", " ").alias("expected"), "n", c("insertions").cast("bigint").alias("insertions"),
        F.round("risk", 6).alias("risk"), "confidence",
    )


add_view("pathlist", "SELECT hops FROM paths WHERE len(hops) > 0")
add_view(
    "suffixes",
    """SELECT tail, count(*) AS n FROM (SELECT hops[len(hops) - k + 1:] AS tail FROM (SELECT hops, unnest(range(2, len(hops) + 1)) AS k FROM pathlist))
GROUP BY tail""",
)


@query(
    "D16_common_endings",
    """SELECT array_to_string(tail, ' ') AS ending, CAST(len(tail) AS BIGINT) AS length, n, round(n / total::DOUBLE, 8) AS share
       FROM suffixes s, (SELECT count(*) AS total FROM pathlist)
       WHERE n >= greatest(2, floor(total * 0.0002))
         AND NOT EXISTS (SELECT 1 FROM suffixes l WHERE len(l.tail) = len(s.tail) + 1 AND l.tail[2:] = s.tail AND l.n = s.n)""",
)
def d16(spark, d):
    r = pathsets.common_endings(A.paths(spark, d).where("size(hops) > 0"), share=0.0002)
    return r.withColumn("share", F.round("share", 8))


@query(
    "D16_common_endings_all",
    """SELECT array_to_string(tail, ' ') AS ending, CAST(len(tail) AS BIGINT) AS length, n, round(n / total::DOUBLE, 8) AS share
       FROM (SELECT tail, count(*) AS n FROM (SELECT hops[len(hops) - k + 1:] AS tail FROM (SELECT hops, unnest(range(1, len(hops) + 1)) AS k FROM pathlist)) GROUP BY tail),
            (SELECT count(*) AS total FROM pathlist) WHERE n >= greatest(2, floor(total * 0.0002))""",
)
def d16b(spark, d):
    r = pathsets.common_endings(A.paths(spark, d).where("size(hops) > 0"), share=0.0002, maximal=False, shortest=1)
    return r.withColumn("share", F.round("share", 8))


@query(
    "D18_alert_aggregation",
    f"""SELECT type, prefix, CAST(window_start AS BIGINT) AS window_start, n, strftime(first_seen, {FMT}) AS first_seen,
               strftime(last_seen, {FMT}) AS last_seen, confidence FROM agroups""",
)
def d18(spark, d):
    g = hijack.aggregate_alerts(all_alerts(spark, d))
    return g.withColumns({k: T.text(c(k)) for k in ("first_seen", "last_seen")}).withColumn("window_start", c("window_start").cast("bigint"))


@query(
    "D19_alert_severity",
    """SELECT target_as, total, high, CASE WHEN total >= 10 OR high >= 5 THEN 'critical' WHEN total >= 5 OR high >= 2 THEN 'high'
              WHEN total >= 2 OR high >= 1 THEN 'medium' ELSE 'low' END AS severity
       FROM (SELECT target_as, count(*) AS total, count(*) FILTER (confidence = 'high') AS high FROM alerts GROUP BY 1)""",
)
def d19(spark, d):
    return hijack.severity_of_alerts(all_alerts(spark, d), ["target_as"])


@query(
    "D20_alert_report",
    """SELECT coalesce(type, 'all') AS type, coalesce(confidence, 'all') AS confidence, count(*) AS n, count(DISTINCT prefix) AS prefixes
       FROM alerts GROUP BY CUBE (type, confidence)""",
)
def d20(spark, d):
    return hijack.alert_report(all_alerts(spark, d))


@query(
    "D21_hijack_groups",
    f"""SELECT type, prefix, count(*) AS n, strftime(min(ts), {FMT}) AS first_seen, strftime(max(ts), {FMT}) AS last_seen,
              CASE WHEN count(*) >= 50 THEN 'critical' WHEN count(*) >= 20 THEN 'high' WHEN count(*) >= 5 THEN 'medium' ELSE 'low' END AS band
       FROM alerts GROUP BY 1, 2""",
)
def d21(spark, d):
    g = reports.hijack_groups(all_alerts(spark, d))
    return g.withColumns({k: T.text(c(k)) for k in ("first_seen", "last_seen")})


@query(
    "D23_hijack_groups_by_origin",
    """SELECT prefix, origin_as, count(*) AS n, array_to_string((list(as_path ORDER BY ts, seq, type, target_as))[1:3], ',') AS examples
       FROM alerts GROUP BY 1, 2""",
)
def d23(spark, d):
    g = reports.groups_by_origin(all_alerts(spark, d))
    return g.withColumn("examples", F.array_join("examples", ","))


@query(
    "C15_alert_validation",
    """SELECT a.type, count(*) AS total, count(*) FILTER (EXISTS (SELECT 1 FROM updates u WHERE u.ts = a.ts AND u.prefix = a.prefix AND u.aw = 'A')) AS valid,
              count(*) = count(*) FILTER (EXISTS (SELECT 1 FROM updates u WHERE u.ts = a.ts AND u.prefix = a.prefix AND u.aw = 'A')) AS passed
       FROM origin_alerts a GROUP BY 1""",
)
def c15(spark, d):
    return hijack.validate_alerts(origin_alerts(spark, d), announcements(spark, d))


@query(
    "E17_clustered_alerts",
    """SELECT target_as, count(*) AS n, coalesce(bool_and(gap < 60), false) AS clustered FROM (
         SELECT target_as, s - lag(s) OVER (PARTITION BY target_as ORDER BY s) AS gap FROM alerts) GROUP BY 1""",
)
def e17(spark, d):
    return reports.clustered_alerts(all_alerts(spark, d), ["target_as"])

"""Queries over prefix, relationship, organisation and time joins (C rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from routescope.functions import paths as P
from routescope.functions import scores as S
from routescope.functions import times as T
from routescope.operators import frequency, intervals, links, lookups, prefix_join
from routescope.operators.relevance import relevant_updates
from routescope.plans.registry import query
from routescope.plans.sqlviews import add_view
from routescope.sources import adapters as A

c = F.col
big = lambda e: e.cast("bigint")

add_view("p2a", "SELECT prefix, list(origin ORDER BY ord) AS origins FROM prefix2as GROUP BY prefix")
add_view("ppx", "SELECT DISTINCT x.prefix, x.plen, x.num FROM pfx x JOIN prefix2as q ON q.prefix = x.prefix")
# every strictly shorter container among the owned prefixes
add_view(
    "inside",
    """SELECT ch.prefix, pa.prefix AS parent, pa.plen AS parent_len FROM pfx ch JOIN ppx pa
ON pa.plen < ch.plen AND (ch.num >> (32 - pa.plen)) = (pa.num >> (32 - pa.plen))""",
)
add_view("parent", "SELECT prefix, arg_max(parent, parent_len) AS parent FROM inside GROUP BY prefix")
add_view(
    "owners",
    """SELECT x.prefix, x.prefix AS checked_prefix, p2a.origins FROM pfx x JOIN p2a ON p2a.prefix = x.prefix
UNION ALL SELECT x.prefix, pr.parent, p2a.origins FROM pfx x JOIN parent pr ON pr.prefix = x.prefix
JOIN p2a ON p2a.prefix = pr.parent WHERE x.prefix NOT IN (SELECT prefix FROM p2a)""",
)
add_view("edges2", "SELECT as1, as2 FROM asrel UNION SELECT as2, as1 FROM asrel")
add_view(
    "hoplinks",
    """SELECT seq, ts, s, prefix, as_path, hops, i - 1 AS pos, hops[i] AS as1, hops[i + 1] AS as2
FROM (SELECT *, unnest(range(1, len(hops))) AS i FROM updates)""",
)
add_view("fakes", "SELECT h.* FROM hoplinks h ANTI JOIN edges2 e ON h.as1 = e.as1 AND h.as2 = e.as2")


@query(
    "B14_prefix_overlap",
    """SELECT DISTINCT a.prefix, b.prefix AS owned FROM pfx a JOIN ppx b
       ON (a.num >> (32 - least(a.plen, b.plen))) = (b.num >> (32 - least(a.plen, b.plen)))
       WHERE a.prefix IN (SELECT prefix FROM updates)""",
)
def b14(spark, d):
    return prefix_join.conflicts(A.updates(spark, d), A.prefix2as(spark, d))


@query(
    "C1_exact_origin_join",
    "SELECT u.seq, u.prefix, array_to_string(p2a.origins, ' ') AS origins FROM updates u LEFT JOIN p2a ON p2a.prefix = u.prefix",
)
def c1(spark, d):
    owners = prefix_join.prefix_origins(A.prefix2as(spark, d))
    return A.updates(spark, d).join(owners, "prefix", "left").select(
        "seq", "prefix", F.when(c("origins").isNotNull(), F.array_join("origins", " ")).alias("origins")
    )


@query(
    "C2_longest_prefix_match",
    "SELECT prefix, parent FROM parent WHERE prefix IN (SELECT prefix FROM updates)",
)
def c2(spark, d):
    return prefix_join.longest_parent(A.updates(spark, d), A.prefix2as(spark, d))


@query(
    "C3_covered_by_any",
    """SELECT seq, prefix FROM updates WHERE prefix IN (SELECT prefix FROM ppx WHERE plen > 16)
       OR prefix IN (SELECT prefix FROM inside WHERE parent_len > 16)""",
)
def c3(spark, d):
    owned = A.prefix2as(spark, d).where(~F.endswith("prefix", F.lit("/16")))
    return prefix_join.covered(A.updates(spark, d), owned).select("seq", "prefix")


def _fake_lists(spark, d, first_only):
    u = A.updates(spark, d).select("seq", "hops")
    known = links.with_path_facts(u, links.fake_paths(u, A.asrel(spark, d)))
    return known.select("seq", links.fake_link_text("fakes", first_only).alias("fake_links"), F.size("fakes").cast("bigint").alias("n_fake"))


@query(
    "C4_fake_links",
    """SELECT seq, string_agg(as1 || '-' || as2, ';' ORDER BY pos) AS fake_links, count(*) AS n_fake FROM fakes GROUP BY seq""",
)
def c4(spark, d):
    return _fake_lists(spark, d, False)


@query(
    "C4_fake_links_first_only",
    "SELECT seq, arg_min(as1 || '-' || as2, pos) AS fake_links, count(*) AS n_fake FROM fakes GROUP BY seq",
)
def c4b(spark, d):
    return _fake_lists(spark, d, True)


@query(
    "B15_path_relationship_validity",
    """SELECT u.seq, f.n IS NULL AS valid, coalesce(f.bad, '') AS bad_pairs FROM updates u LEFT JOIN
       (SELECT seq, count(*) AS n, string_agg(as1 || '-' || as2, ';' ORDER BY pos) AS bad FROM fakes GROUP BY seq) f
       ON f.seq = u.seq WHERE u.aw = 'A'""",
)
def b15(spark, d):
    u = A.updates(spark, d).where("aw = 'A'")
    known = links.with_path_facts(u.select("seq", "hops"), links.fake_paths(u, A.asrel(spark, d)), "left")
    return known.select("seq", c("fakes").isNull().alias("valid"), F.coalesce(links.fake_link_text("fakes"), F.lit("")).alias("bad_pairs"))


@query(
    "B17_routing_pattern_anomaly",
    """SELECT l_orderkey, CAST(n AS BIGINT) AS anomalies, round(least(1.0, n * 0.3), 6)::DOUBLE AS score FROM (
         SELECT p.l_orderkey, coalesce(b.bad, 0)
           + len(list_filter(range(1, len(p.hops) - 1), lambda i: p.hops[i] = p.hops[i + 2] AND p.hops[i] <> p.hops[i + 1]))
           + CASE WHEN len(list_filter(p.hops, lambda h: h = p.hops[len(p.hops)])) > 1 THEN 1 ELSE 0 END AS n
         FROM paths p LEFT JOIN (
           SELECT l_orderkey, count(*) AS bad FROM (SELECT l_orderkey, hops, unnest(range(1, len(hops))) AS i FROM paths) x
           ANTI JOIN edges2 e ON x.hops[i] = e.as1 AND x.hops[i + 1] = e.as2 GROUP BY 1) b ON b.l_orderkey = p.l_orderkey)""",
)
def b17(spark, d):
    p = A.paths(spark, d)
    bad = links.fake_links(p, A.asrel(spark, d), ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("bad"))
    twice = F.when(P.occurrences(c("hops"), P.origin(c("hops"))) > 1, 1).otherwise(0)
    n = F.coalesce("bad", F.lit(0)) + P.returns_to_hop(c("hops")) + twice
    return p.join(bad, "l_orderkey", "left").select(
        "l_orderkey", big(n).alias("anomalies"), F.round(S.pattern_score(n), 6).alias("score")
    )


add_view(
    "linkprob",
    """SELECT l.key, l.pos, CASE WHEN l.as1 > l.as2 THEN pr.c2p ELSE pr.p2c END AS p2c,
       CASE WHEN l.as1 > l.as2 THEN pr.p2c ELSE pr.c2p END AS c2p
FROM (SELECT array_to_string(hops, ' ') AS key, i AS pos, hops[i] AS as1, hops[i + 1] AS as2
      FROM (SELECT hops, unnest(range(1, len(hops))) AS i FROM (SELECT DISTINCT hops FROM updates))) l
JOIN prob pr ON pr.k1 = least(l.as1, l.as2) AND pr.k2 = greatest(l.as1, l.as2)""",
)
add_view(
    "leakprob",
    """SELECT key, least(1.0, min(p2c + up - p2c * up)) AS prob
FROM (SELECT key, p2c, coalesce(lag(c2p) OVER (PARTITION BY key ORDER BY pos), 1.0) AS up FROM linkprob) GROUP BY key""",
)


@query(
    "C5_link_probability_join",
    "SELECT key AS path, CAST(pos - 1 AS BIGINT) AS pos, round(p2c, 6) AS p2c, round(c2p, 6) AS c2p FROM linkprob",
)
def c5(spark, d):
    u = A.updates(spark, d).where("size(hops) >= 2").select("hops").distinct()
    rows = links.link_probabilities(links.exploded_links(u, ["hops"]), A.asprob(spark, d)).where("p2c IS NOT NULL")
    return rows.select(
        F.array_join("hops", " ").alias("path"), big(c("pos")).alias("pos"),
        F.round("p2c", 6).alias("p2c"), F.round("c2p", 6).alias("c2p"),
    )


@query(
    "B19_leak_fold",
    """SELECT u.path, round(coalesce(l.prob, 1.0), 6) AS prob, coalesce(l.prob, 1.0) < 0.4 AS is_leak
       FROM (SELECT DISTINCT array_to_string(hops, ' ') AS path FROM updates WHERE len(hops) >= 2) u
       LEFT JOIN leakprob l ON l.key = u.path""",
)
def b19(spark, d):
    s = links.leak_scores(A.updates(spark, d), A.asprob(spark, d))
    return s.select(
        F.array_join("hops", " ").alias("path"), F.round("prob", 6).alias("prob"), (c("prob") < 0.4).alias("is_leak")
    )


@query(
    "C6_as_organisation",
    """SELECT u.asn, aut.asn IS NOT NULL AS found, coalesce(aut.aut_name, 'Unknown') AS aut_name,
              coalesce(org.name, 'Unknown') AS org_name, coalesce(org.country, 'Unknown') AS country
       FROM (SELECT DISTINCT CAST(CAST(peer_as AS BIGINT) + 3 AS VARCHAR) AS asn FROM updates) u
       LEFT JOIN aut ON aut.asn = u.asn LEFT JOIN org ON org.org_id = aut.org_id""",
)
def c6(spark, d):
    asns = A.updates(spark, d).select((c("peer_as") + 3).cast("string").alias("asn")).distinct()
    return lookups.organisations(asns, A.aut(spark, d), A.org(spark, d)).select(
        "asn", "found", "aut_name", "org_name", "country"
    )


add_view(
    "neigh",
    """SELECT as1 AS asn, 'customer' AS kind, as2 AS other FROM asrel WHERE rel = -1
UNION SELECT as2, 'provider', as1 FROM asrel WHERE rel = -1
UNION SELECT as1, 'peer', as2 FROM asrel WHERE rel = 0
UNION SELECT as2, 'peer', as1 FROM asrel WHERE rel = 0""",
)


@query(
    "C7_as_neighbours",
    """SELECT asn, coalesce(string_agg(other, ' ' ORDER BY CAST(other AS BIGINT)) FILTER (kind = 'provider'), '') AS providers,
              coalesce(string_agg(other, ' ' ORDER BY CAST(other AS BIGINT)) FILTER (kind = 'peer'), '') AS peers,
              coalesce(string_agg(other, ' ' ORDER BY CAST(other AS BIGINT)) FILTER (kind = 'customer'), '') AS customers,
              count(*) FILTER (kind = 'provider') AS n_providers, count(*) FILTER (kind = 'peer') AS n_peers,
              count(*) FILTER (kind = 'customer') AS n_customers
       FROM neigh GROUP BY asn""",
)
def c7(spark, d):
    g = lookups.relationship_summary(A.asrel(spark, d))
    lists = [F.array_join(c(f"{k}s").cast("array<string>"), " ").alias(f"{k}s") for k in ("provider", "peer", "customer")]
    return g.select("asn", *lists, "n_providers", "n_peers", "n_customers")


@query("C8_owned_prefixes", "SELECT DISTINCT origin AS asn, prefix FROM prefix2as WHERE origin IN (SELECT asn FROM targets)")
def c8(spark, d):
    return prefix_join.owned_prefixes(A.prefix2as(spark, d), A.targets(spark, d))


@query(
    "C9_snapshot_as_of",
    """SELECT strftime(q.day, '%Y-%m-%d') AS day, strftime(coalesce(max(s.snap), (SELECT min(snap) FROM snaps)), '%Y-%m-%d') AS snapshot
       FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) q LEFT JOIN snaps s ON s.snap <= q.day GROUP BY q.day""",
)
def c9(spark, d):
    o = A.table(spark, d, "orders")
    days = o.select(c("o_orderdate").cast("date").alias("day"))
    snaps = o.where("o_orderpriority = '1-URGENT'").groupBy(F.year("o_orderdate"), F.quarter("o_orderdate")).agg(
        F.min(c("o_orderdate").cast("date")).alias("snap")
    )
    r = lookups.snapshot_as_of(days, snaps.select("snap"))
    return r.select(c("day").cast("string").alias("day"), c("snapshot").cast("string").alias("snapshot"))


add_view(
    "snaps",
    """SELECT min(CAST(o_orderdate AS DATE)) AS snap FROM orders WHERE o_orderpriority = '1-URGENT'
GROUP BY year(o_orderdate), quarter(o_orderdate)""",
)


@query(
    "C10_windows_to_buckets",
    """SELECT event_name, CASE WHEN ts <= "end" AND ts >= "start" THEN 'event' ELSE 'baseline' END AS part, count(*) AS n
       FROM updates JOIN catalogue ON ts >= "start" - INTERVAL 1 DAY AND ts <= "end" GROUP BY 1, 2""",
)
def c10(spark, d):
    w = A.catalogue(spark, d).withColumn("lo", c("start") - F.expr("INTERVAL 1 DAY"))
    rows = intervals.in_windows(A.updates(spark, d), w, start="lo")
    part = F.when(c("ts") >= c("start"), "event").otherwise("baseline")
    return rows.groupBy("event_name", part.alias("part")).agg(F.count("*").alias("n"))


@query(
    "C14_temporal_correlation",
    """SELECT count(*) AS n, sum(seq)::BIGINT AS seqs FROM updates u WHERE aw = 'W' AND EXISTS (
         SELECT 1 FROM updates v WHERE v.prefix LIKE '%/25' AND v.user_id = u.user_id AND abs(v.s - u.s) < 3600 AND v.aw = 'A')""",
)
def c14(spark, d):
    u = A.updates(spark, d)
    others = u.where("aw = 'A' AND prefix LIKE '%/25'").select("user_id", "ts")
    near = intervals.near_in_time(u.where("aw = 'W'"), others, 3600, on=["user_id"])
    return near.agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query(
    "C16_country_search",
    """SELECT aut.asn, aut.aut_name, org.name AS org_name, org.country FROM aut JOIN org ON org.org_id = aut.org_id
       WHERE contains(lower(org.country), 'asia') OR contains(lower(org.name), 'asia') OR contains(lower(aut.aut_name), 'asia')""",
)
def c16(spark, d):
    return lookups.ases_of_country("Asia", A.aut(spark, d), A.org(spark, d)).select("asn", "aut_name", "org_name", "country")


@query(
    "C17_prefix_legitimacy",
    """SELECT u.seq, coalesce(list_contains(o.origins, u.origin_as), false) AS legit,
              CASE WHEN coalesce(list_contains(o.origins, u.origin_as), false) THEN u.origin_as ELSE coalesce(o.origins[1], '') END AS expected_origin,
              coalesce(o.checked_prefix, '') AS matched_prefix
       FROM updates u LEFT JOIN owners o ON o.prefix = u.prefix WHERE u.aw = 'A'""",
)
def c17(spark, d):
    a = A.updates(spark, d).where("aw = 'A'").select("seq", "prefix", "origin_as")
    return prefix_join.legitimacy(a, A.prefix2as(spark, d)).select("seq", "legit", "expected_origin", "matched_prefix")


@query(
    "C18_legitimate_transit",
    """SELECT DISTINCT array_to_string(x.hops, ' ') AS path, x.a AS asn FROM (
         SELECT hops, a, unnest(hops) AS b FROM (SELECT hops, unnest(hops) AS a FROM (SELECT DISTINCT hops FROM updates))) x
       JOIN edges2 e ON e.as1 = x.a AND e.as2 = x.b WHERE x.a <> x.b""",
)
def c18(spark, d):
    r = links.related_to_path(A.updates(spark, d), A.asrel(spark, d))
    return r.select(F.array_join("hops", " ").alias("path"), "asn")


@query(
    "C19_prefix_exists",
    "SELECT DISTINCT prefix, prefix IN (SELECT prefix FROM prefix2as) AS present FROM updates",
)
def c19(spark, d):
    return prefix_join.existence(A.updates(spark, d), A.prefix2as(spark, d))


@query(
    "C20_shared_scan",
    """SELECT r.target, e.event_name, count(*) AS n FROM (
         SELECT DISTINCT t.target, u.seq, u.ts
         FROM (SELECT seq, ts, unnest(list_distinct(list_append(hops, CAST(peer_as AS VARCHAR)))) AS asn FROM updates) u
         JOIN targets t ON t.asn = u.asn) r JOIN catalogue e ON r.ts BETWEEN e."start" AND e."end" GROUP BY 1, 2""",
)
def c20(spark, d):
    rows = relevant_updates(A.updates(spark, d), A.targets(spark, d), ["seq", "ts"])
    return intervals.in_windows(rows, A.catalogue(spark, d)).groupBy("target", "event_name").agg(F.count("*").alias("n"))


@query(
    "C21_enrichment",
    """SELECT r.asn, r.n, coalesce(org.name, 'Unknown') AS org_name, coalesce(org.country, 'Unknown') AS country,
         (SELECT count(*) FROM neigh x WHERE x.asn = r.asn AND kind = 'provider') AS n_providers,
         (SELECT count(*) FROM neigh x WHERE x.asn = r.asn AND kind = 'customer') AS n_customers,
         (SELECT count(*) FROM neigh x WHERE x.asn = r.asn AND kind = 'peer') AS n_peers,
         (SELECT count(DISTINCT prefix) FROM prefix2as x WHERE x.origin = r.asn) AS n_prefixes
       FROM (SELECT origin_as AS asn, count(*) AS n FROM updates WHERE aw = 'A' GROUP BY 1) r
       LEFT JOIN aut ON aut.asn = r.asn LEFT JOIN org ON org.org_id = aut.org_id""",
)
def c21(spark, d):
    r = A.updates(spark, d).where("aw = 'A'").groupBy(c("origin_as").alias("asn")).agg(F.count("*").alias("n"))
    e = lookups.enrich(r, A.aut(spark, d), A.org(spark, d), A.asrel(spark, d), A.prefix2as(spark, d))
    return e.select("asn", "n", "org_name", "country", "n_providers", "n_customers", "n_peers", "n_prefixes")


@query(
    "D11_pair_frequency",
    """SELECT p.as1, p.as2, coalesce(f.n, 0) AS n, t.total, round(coalesce(f.n, 0) / t.total, 6)::DOUBLE AS ratio
       FROM (SELECT DISTINCT as1, as2 FROM asrel) p
       LEFT JOIN (SELECT as1, as2, count(DISTINCT seq) AS n FROM hoplinks GROUP BY 1, 2) f ON f.as1 = p.as1 AND f.as2 = p.as2,
       (SELECT count(*) AS total FROM updates) t""",
)
def d11(spark, d):
    r = frequency.pair_counts(A.updates(spark, d), A.asrel(spark, d))
    return r.withColumn("ratio", F.round("ratio", 6))


add_view("fpairs", "SELECT DISTINCT as1, as2 FROM fakes")
add_view("fsight", "SELECT DISTINCT h.as1, h.as2, h.seq, h.s FROM hoplinks h JOIN fpairs f ON f.as1 = h.as1 AND f.as2 = h.as2")
add_view(
    "verdicts",
    """SELECT v.as1, v.as2, v.n, v.total, v.n / v.total::DOUBLE AS ratio,
  CASE WHEN v.act >= 0.1 THEN 0.0005 WHEN v.act >= 0.01 THEN 0.001 WHEN v.act >= 0.001 THEN 0.002 ELSE 0.005 END::DOUBLE AS threshold
FROM (SELECT x.as1, x.as2, x.n, tw.total, coalesce(ac.active, 0) / dt.day_total::DOUBLE AS act
  FROM (SELECT s1.as1, s1.as2, l.t_end, count(*) AS n FROM fsight s1
        JOIN (SELECT as1, as2, max(s) AS t_end FROM fsight GROUP BY 1, 2) l ON l.as1 = s1.as1 AND l.as2 = s1.as2
        WHERE s1.s >= l.t_end - 604800 GROUP BY 1, 2, 3) x
  JOIN (SELECT e.t_end, count(*) AS total FROM (SELECT DISTINCT t_end FROM (SELECT max(s) AS t_end FROM fsight GROUP BY as1, as2)) e
        JOIN updates u ON u.s BETWEEN e.t_end - 604800 AND e.t_end WHERE u.aw = 'A' GROUP BY 1) tw ON tw.t_end = x.t_end
  JOIN (SELECT s // 86400 AS day, count(*) AS day_total FROM updates WHERE aw = 'A' GROUP BY 1) dt ON dt.day = x.t_end // 86400
  LEFT JOIN (SELECT day, asn, count(*) AS active FROM (SELECT DISTINCT seq, s // 86400 AS day, unnest(hops) AS asn FROM updates) GROUP BY 1, 2) ac
    ON ac.day = x.t_end // 86400 AND ac.asn = x.as1) v""",
)


@query(
    "D12_connection_frequency_verdict",
    "SELECT as1, as2, n, total, round(ratio, 8) AS ratio, threshold, ratio <= threshold AS suspicious FROM verdicts",
)
def d12(spark, d):
    u = A.updates(spark, d).where("aw = 'A'")
    v = frequency.rarity_verdicts(u, links.fake_links(u, A.asrel(spark, d), ["seq"]))
    return v.withColumn("ratio", F.round("ratio", 8))


add_view(
    "marked",
    """SELECT f.seq, string_agg(f.as1 || '-' || f.as2, ';' ORDER BY f.pos) AS fake_links, arg_min(f.as1 || '|' || f.as2, f.pos) AS first_link,
  bool_or(v.ratio <= v.threshold) AS suspicious, list_distinct(list_concat(list(f.as1), list(f.as2))) AS ends
FROM fakes f JOIN verdicts v ON v.as1 = f.as1 AND v.as2 = f.as2 GROUP BY f.seq""",
)


@query("D13_batch_verdicts", "SELECT seq, fake_links, suspicious, true AS has_fake FROM marked")
def d13(spark, d):
    m = frequency.mark_updates(A.updates(spark, d).where("aw = 'A'"), A.asrel(spark, d))
    text = F.concat_ws(";", F.transform("fakes", lambda f: F.concat_ws("-", f["as1"], f["as2"])))
    return m.select("seq", text.alias("fake_links"), "suspicious", "has_fake")


# Questions about the verdict at some time: three days after a link's last sighting, without a time,
# or after all data, by the first AS.
add_view(
    "asked",
    """SELECT as1, as2, CAST(make_timestamp(last * 1000000) AS DATE) AS day, CASE CAST(as1 AS BIGINT) % 3 WHEN 0 THEN last + 259200 WHEN 2 THEN last + 90 * 86400 END AS t_end
FROM (SELECT as1, as2, max(s) AS last FROM fakes GROUP BY 1, 2)""",
)
add_view(
    "answered",
    """SELECT q.as1, q.as2, q.day, q.t_end, w.total AS wt, w.n AS wn, d.total AS dt, d.n AS dn, coalesce(ac.active, 0) AS active
FROM asked q
LEFT JOIN (SELECT q.as1, q.as2, q.t_end, count(*) AS total, count(h.seq) AS n FROM (SELECT DISTINCT as1, as2, t_end FROM asked) q JOIN updates u ON u.s BETWEEN q.t_end - 604800 AND q.t_end AND u.aw = 'A'
  LEFT JOIN (SELECT DISTINCT seq, as1, as2 FROM hoplinks) h ON h.seq = u.seq AND h.as1 = q.as1 AND h.as2 = q.as2 GROUP BY 1, 2, 3) w ON w.as1 = q.as1 AND w.as2 = q.as2 AND w.t_end = q.t_end
LEFT JOIN (SELECT q.as1, q.as2, q.day, count(*) AS total, count(h.seq) AS n FROM (SELECT DISTINCT as1, as2, day FROM asked) q JOIN updates u ON u.s // 86400 = date_diff('day', DATE '1970-01-01', q.day) AND u.aw = 'A'
  LEFT JOIN (SELECT DISTINCT seq, as1, as2 FROM hoplinks) h ON h.seq = u.seq AND h.as1 = q.as1 AND h.as2 = q.as2 GROUP BY 1, 2, 3) d ON d.as1 = q.as1 AND d.as2 = q.as2 AND d.day = q.day
LEFT JOIN (SELECT s // 86400 AS day, asn, count(*) AS active FROM (SELECT seq, s, unnest(list_distinct(hops)) AS asn FROM updates WHERE aw = 'A') GROUP BY 1, 2) ac ON ac.day = date_diff('day', DATE '1970-01-01', q.day) AND ac.asn = q.as1""",
)


@query(
    "D12_verdict_as_of",
    """SELECT as1, as2, CAST(day AS VARCHAR) AS day, coalesce(t_end, -1) AS t_end, coverage, n, total, round(ratio, 8) AS ratio, threshold, ratio <= threshold AS suspicious FROM (
         SELECT *, n / total::DOUBLE AS ratio, CASE WHEN act >= 0.1 THEN 0.0005 WHEN act >= 0.01 THEN 0.001 WHEN act >= 0.001 THEN 0.002 ELSE 0.005 END::DOUBLE AS threshold FROM (
           SELECT as1, as2, day, t_end, CASE WHEN wt > 0 THEN '7d_window' ELSE 'single_day' END AS coverage, CASE WHEN wt > 0 THEN wn ELSE dn END AS n, CASE WHEN wt > 0 THEN wt ELSE dt END AS total, active / dt::DOUBLE AS act FROM answered))""",
)
def d12_as_of(spark, d):
    u = A.updates(spark, d).where("aw = 'A'")
    last = links.fake_links(u, A.asrel(spark, d), ["ts"]).groupBy("as1", "as2").agg(F.max(T.seconds(c("ts"))).alias("last"))
    kind = c("as1").cast("bigint") % 3
    asked = last.select("as1", "as2", T.from_seconds(c("last")).cast("date").alias("day"), F.when(kind == 0, c("last") + 259200).when(kind == 2, c("last") + 90 * 86400).alias("t_end"))
    v = frequency.rarity_as_of(u, asked)
    return v.withColumns({"day": c("day").cast("string"), "t_end": F.coalesce("t_end", F.lit(-1).cast("bigint")), "ratio": F.round("ratio", 8)})


add_view(
    "flgroups",
    """SELECT t AS target_as, prefix, as1, as2, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n, count(DISTINCT as_path) AS n_paths
FROM (SELECT *, unnest(list_distinct(hops)) AS t FROM fakes) GROUP BY 1, 2, 3, 4""",
)


def _fake_rows(spark, d):
    f = links.fake_links(A.updates(spark, d), A.asrel(spark, d), ["ts", "prefix", "as_path", "hops"])
    return f.withColumn("target_as", F.explode(F.array_distinct("hops")))


@query(
    "D14_fake_link_groups",
    "SELECT target_as, prefix, as1, as2, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, n, n_paths FROM flgroups",
)
def d14(spark, d):
    g = frequency.fake_link_groups(_fake_rows(spark, d))
    return g.withColumns({k: T.text(c(k)) for k in ("first_seen", "last_seen")})


@query(
    "D14_fake_link_groups_across_targets",
    """SELECT prefix, as1, as2, strftime(min(first_seen), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(last_seen), '%Y-%m-%d %H:%M:%S') AS last_seen,
              max(n) AS n, max(n_paths) AS n_paths, count(*) AS n_targets FROM flgroups GROUP BY 1, 2, 3""",
)
def d14b(spark, d):
    g = frequency.fake_link_groups_across(frequency.fake_link_groups(_fake_rows(spark, d)))
    return g.withColumns({k: T.text(c(k)) for k in ("first_seen", "last_seen")})


@query(
    "D26_weekly_interception",
    """SELECT x.as1, x.as2, x.week, x.recent, strftime(min(f.ts), '%Y-%m-%d %H:%M:%S') AS first_seen,
              array_to_string(list_sort(list(DISTINCT f.prefix)), ' ') AS prefixes,
              array_to_string((list(f.as_path ORDER BY f.ts, f.seq, f.pos))[1:5], ',') AS paths,
              CASE WHEN x.recent > 3 THEN 'high' ELSE 'medium' END AS confidence
       FROM (SELECT as1, as2, count(*) AS week, count(*) FILTER (ts >= TIMESTAMP '2024-01-20 00:00:00') AS recent FROM fakes
             WHERE ts >= TIMESTAMP '2024-01-13 00:00:00' AND ts <= TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1, 2) x
       JOIN fakes f ON f.as1 = x.as1 AND f.as2 = x.as2 AND f.ts >= TIMESTAMP '2024-01-20 00:00:00' AND f.ts <= TIMESTAMP '2024-01-30 00:00:00'
       WHERE x.week < 5 AND x.recent > 0 GROUP BY x.as1, x.as2, x.week, x.recent""",
)
def d26(spark, d):
    r = frequency.weekly_interception(A.updates(spark, d), A.asrel(spark, d), "2024-01-20 00:00:00", "2024-01-30 00:00:00")
    return r.withColumns({
        "first_seen": T.text(c("first_seen")), "prefixes": F.array_join("prefixes", " "), "paths": F.array_join("paths", ","),
    })

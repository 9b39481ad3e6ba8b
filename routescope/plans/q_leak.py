"""Queries over leaks and link-probability inference."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from routescope.functions import times as T
from routescope.operators import leak, linkprob, pathsets
from routescope.plans import jobs
from routescope.plans.registry import query
from routescope.plans.sqlviews import VIEWS, add_view
from routescope.sources import adapters as A
from routescope.sources.landing import landed

c = F.col
FMT = "'%Y-%m-%d %H:%M:%S'"


def announcements(spark, d):
    return A.updates(spark, d).where("aw = 'A'")


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


@query(
    "D15_path_counts",
    "SELECT array_to_string(hops, '|') AS path, count(*) AS n FROM updates WHERE aw = 'A' AND len(hops) >= 2 GROUP BY 1",
)
def d15(spark, d):
    return pathsets.path_counts(announcements(spark, d))


add_view(
    "leaks",
    """SELECT u.*, l.prob FROM updates u JOIN leakprob l ON l.key = array_to_string(u.hops, ' ') WHERE u.aw = 'A' AND round(l.prob, 9) < 0.4""",
)


@query(
    "F5_leaks",
    f"SELECT seq, strftime(ts, {FMT}) AS ts, prefix, origin_as, CAST(len(hops) AS BIGINT) AS path_length, round(prob, 6) AS leak_probability FROM leaks",
)
def f5(spark, d):
    r = leak.leaks(announcements(spark, d), A.asprob(spark, d))
    return rounded(
        r.select("seq", T.text(c("ts")).alias("ts"), "prefix", "origin_as", c("path_length").cast("bigint").alias("path_length"), "leak_probability"),
        "leak_probability",
    )


@query(
    "F5_route_leak_job",
    """SELECT t.target, k.event_name, (SELECT count(*) FROM updates u WHERE u.aw = 'A' AND u.ts BETWEEN k."start" AND k."end") AS total,
         count(DISTINCT (x.as_path, x.prefix, x.ts)) FILTER (x.as_path IS NOT NULL) AS filtered,
         count(DISTINCT (x.as_path, x.prefix, x.ts)) FILTER (x.as_path IS NOT NULL AND round(x.prob, 9) < 0.4) AS leaks
       FROM (SELECT DISTINCT target FROM targets) t JOIN catalogue k ON true
       LEFT JOIN (SELECT tt.target, e.event_name, u.as_path, u.prefix, u.ts, coalesce(l.prob, 1.0) AS prob
                  FROM updates u JOIN targets tt ON list_contains(u.hops, tt.asn) JOIN catalogue e ON u.ts BETWEEN e."start" AND e."end"
                  LEFT JOIN leakprob l ON l.key = array_to_string(u.hops, ' ') WHERE u.aw = 'A') x ON x.target = t.target AND x.event_name = k.event_name
       GROUP BY t.target, k.event_name, k."start", k."end\"""",
)
def f5b(spark, d):
    cat = A.catalogue(spark, d).select("event_name", "start", "end")
    names = A.targets(spark, d).groupBy("target").agg(F.count("*").alias("_n")).select("target")
    listed = names.withColumn("event_name", F.explode(F.array(*[F.lit(e[1]) for e in A.EVENTS])))
    windows = listed.join(cat, "event_name")
    return jobs.leak_job(announcements(spark, d), A.asprob(spark, d), windows, A.targets(spark, d))


@query(
    "D22_leak_groups",
    f"""SELECT prefix, count(*) AS n, round(min(prob), 6) AS min_prob, strftime(min(ts), {FMT}) AS first_seen, strftime(max(ts), {FMT}) AS last_seen,
          count(DISTINCT as_path) AS paths, CASE WHEN min(prob) >= 0.8 THEN 'high' WHEN min(prob) >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM leaks GROUP BY 1""",
)
def d22(spark, d):
    g = leak.leak_groups(leak.leaks(announcements(spark, d), A.asprob(spark, d)), [])
    return rounded(g.withColumns({k: T.text(c(k)) for k in ("first_seen", "last_seen")}), "min_prob")


# Paths with access networks at both ends, so that there is something to peel.
add_view(
    "cpaths",
    """SELECT path, count(*) AS n FROM (SELECT list_concat(list_concat(['e' || (l_orderkey % 97)], hops), ['x' || (l_orderkey % 499), 'y' || (l_orderkey % 997)]) AS path FROM paths) GROUP BY 1""",
)


def counted_paths(spark, d):
    key = c("l_orderkey")
    head = F.array(F.concat(F.lit("e"), (key % 97).cast("string")))
    tail = F.array(F.concat(F.lit("x"), (key % 499).cast("string")), F.concat(F.lit("y"), (key % 997).cast("string")))
    return A.paths(spark, d).groupBy(F.concat(head, c("hops"), tail).alias("path")).agg(F.count("*").alias("n"))


add_view(
    "meet",
    """SELECT DISTINCT least(u, v) AS as1, greatest(u, v) AS as2, v AS m, least(v, w) AS n1, greatest(v, w) AS n2 FROM (
  SELECT path[i] AS u, path[i + 1] AS v, path[i + 2] AS w FROM (SELECT path, unnest(range(1, len(path) - 1)) AS i FROM cpaths)
  UNION ALL SELECT path[i + 2], path[i + 1], path[i] FROM (SELECT path, unnest(range(1, len(path) - 1)) AS i FROM cpaths))""",
)
add_view("alive0", "SELECT as1, as2 FROM meet GROUP BY as1, as2 HAVING count(DISTINCT m) = 2")
ROUNDS = 40  # more than the supplied tables need
for _k in range(1, ROUNDS + 1):
    add_view(
        f"alive{_k}",
        f"""SELECT x.as1, x.as2 FROM meet x JOIN alive{_k - 1} a ON a.as1 = x.as1 AND a.as2 = x.as2 JOIN alive{_k - 1} b ON b.as1 = x.n1 AND b.as2 = x.n2
GROUP BY x.as1, x.as2 HAVING count(DISTINCT x.m) = 2""",
    )
CORE = f"alive{ROUNDS}"


def core(spark, d):
    return linkprob.core_links(counted_paths(spark, d))


@query("F27_core_links", f"SELECT as1, as2 FROM {CORE}")
def f27(spark, d):
    return core(spark, d)


add_view(
    "cflags",
    f"""SELECT x.path, x.n, list(y.as1 IS NOT NULL ORDER BY x.i) AS flags FROM (SELECT path, n, unnest(range(1, len(path))) AS i FROM cpaths) x
LEFT JOIN {CORE} y ON y.as1 = least(x.path[x.i], x.path[x.i + 1]) AND y.as2 = greatest(x.path[x.i], x.path[x.i + 1]) GROUP BY 1, 2""",
)
add_view(
    "cspan",
    """SELECT path, n, l - 1 AS lft, CASE WHEN l IS NULL OR coalesce(list_position(flags[l:], false), 0) = 0 THEN len(path) - 1 ELSE l - 1 + list_position(flags[l:], false) - 1 END AS rgt
FROM (SELECT path, n, flags, nullif(coalesce(list_position(flags, true), 0), 0) AS l FROM cflags)""",
)
add_view("corep", "SELECT path[lft + 1:rgt + 1] AS path, CAST(sum(n) AS BIGINT) AS n FROM cspan WHERE lft IS NOT NULL GROUP BY 1")


@query("F28_core_paths", "SELECT array_to_string(path, '|') AS path, n FROM corep")
def f28(spark, d):
    counted = counted_paths(spark, d)
    return linkprob.core_paths(counted, core(spark, d)).withColumn("path", F.array_join("path", "|"))


add_view(
    "ctx",
    """SELECT least(a, b) AS as1, greatest(a, b) AS as2, CASE WHEN a < b THEN l ELSE r END AS bef, CASE WHEN a < b THEN r ELSE l END AS aft, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT n, path[i] AS a, path[i + 1] AS b, CASE WHEN i > 1 THEN path[i - 1] END AS l, CASE WHEN i + 2 <= len(path) THEN path[i + 2] END AS r
      FROM (SELECT path, n, unnest(range(1, len(path))) AS i FROM corep)) GROUP BY 1, 2, 3, 4""",
)


def contexts(spark, d):
    return linkprob.link_contexts(linkprob.core_paths(counted_paths(spark, d), core(spark, d)))


@query("F29_link_contexts", "SELECT as1, as2, coalesce(bef, '') AS before, coalesce(aft, '') AS after, n FROM ctx")
def f29(spark, d):
    return contexts(spark, d).fillna("", ["before", "after"])


add_view(
    "rel0",
    """SELECT q.as1, q.as2, coalesce(r.rel, 0) AS rel FROM (SELECT DISTINCT as1, as2 FROM ctx) q LEFT JOIN (
  SELECT least(as1, as2) AS as1, greatest(as1, as2) AS as2, min(CASE WHEN as1 > as2 THEN -rel ELSE rel END) AS rel FROM asrel GROUP BY 1, 2) r ON r.as1 = q.as1 AND r.as2 = q.as2""",
)
SWEEPS = 1000
# Links numbered in the order of their keys, contexts by numbers, and pairs of links that share a context.
add_view("lnk", "SELECT row_number() OVER (ORDER BY as1, as2) AS id, as1, as2, rel FROM rel0")
add_view(
    "cx",
    """SELECT t.id, x.n, b.id AS b, CASE WHEN x.bef < x.as1 THEN 1 ELSE -1 END AS bs, a.id AS a, CASE WHEN x.as2 < x.aft THEN 1 ELSE -1 END AS sgn
FROM ctx x JOIN lnk t ON t.as1 = x.as1 AND t.as2 = x.as2
LEFT JOIN lnk b ON b.as1 = least(x.bef, x.as1) AND b.as2 = greatest(x.bef, x.as1) AND x.bef IS NOT NULL
LEFT JOIN lnk a ON a.as1 = least(x.aft, x.as2) AND a.as2 = greatest(x.aft, x.as2) AND x.aft IS NOT NULL""",
)
add_view("beside", "SELECT DISTINCT * FROM (SELECT id, b AS o FROM cx WHERE b <> id UNION ALL SELECT b, id FROM cx WHERE b <> id UNION ALL SELECT id, a FROM cx WHERE a <> id UNION ALL SELECT a, id FROM cx WHERE a <> id)")


def gibbs_twin(sweeps):
    """One-by-one sampling in SQL: a link is redrawn as soon as all links beside it stand where its turn finds
    them, those of smaller numbers one sweep ahead and the others level with it."""
    return f"""WITH RECURSIVE g AS (
  SELECT id, 0 AS t, CAST(rel AS INTEGER) AS rel, 0 AS dn, 0 AS fl, 0 AS up FROM lnk
  UNION ALL
  SELECT s.id, s.t + CASE WHEN w.id IS NULL THEN 0 ELSE 1 END, coalesce(w.rel, s.rel), s.dn + CASE WHEN w.rel = -1 THEN 1 ELSE 0 END, s.fl + CASE WHEN w.rel = 0 THEN 1 ELSE 0 END, s.up + CASE WHEN w.rel = 1 THEN 1 ELSE 0 END
  FROM g s LEFT JOIN (
    SELECT q.id, CAST(CASE WHEN q.u < q.dn / q.v THEN -1 WHEN q.u < 1.0 - q.up / q.v THEN 0 ELSE 1 END AS INTEGER) AS rel FROM (
      SELECT z.id, ('0x' || substr(md5(l.as1 || '|' || l.as2 || '|' || (z.t + 1) || '|42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u, z.dn, z.up, z.v FROM (
        SELECT id, t, coalesce(sum(n) FILTER (lst <> 1 AND nxt = -1), 0)::DOUBLE AS dn, coalesce(sum(n) FILTER (lst = 1 AND nxt <> -1), 0)::DOUBLE AS up, sum(n)::DOUBLE AS v FROM (
          SELECT r.id, r.t, x.n, CASE WHEN x.b IS NULL THEN 1 ELSE x.bs * b.rel END AS lst, CASE WHEN x.a IS NULL THEN -1 ELSE x.sgn * a.rel END AS nxt
          FROM (SELECT y.id, y.t FROM g y WHERE y.t < {sweeps} AND NOT EXISTS (
                  SELECT 1 FROM beside p JOIN g o ON o.id = p.o WHERE p.id = y.id AND o.t <> y.t + CASE WHEN p.o < p.id THEN 1 ELSE 0 END)) r
          JOIN cx x ON x.id = r.id LEFT JOIN g b ON b.id = x.b LEFT JOIN g a ON a.id = x.a) GROUP BY id, t) z JOIN lnk l ON l.id = z.id) q) w ON w.id = s.id
  WHERE (SELECT min(t) FROM g) < {sweeps})
SELECT l.as1, l.as2, g.dn / {sweeps}.0::DOUBLE AS p2c, g.fl / {sweeps}.0::DOUBLE AS p2p, g.up / {sweeps}.0::DOUBLE AS c2p
FROM (SELECT id, max(dn) AS dn, max(fl) AS fl, max(up) AS up FROM g GROUP BY id) g JOIN lnk l ON l.id = g.id"""


add_view("gibbs", f"SELECT * FROM ({gibbs_twin(SWEEPS)})")


def sampled(spark, d, sweeps=SWEEPS):
    ctx = contexts(spark, d)
    return linkprob.sample_relations(ctx, linkprob.initial_relations(ctx, A.asrel(spark, d)), sweeps)


def stored_shares(spark, d):
    """Stored at first use: the queries after F30 read the same shares."""
    return landed(spark, d, "relation_shares", sampled)


@query("F30_relationship_sampling", "SELECT * FROM gibbs")
def f30(spark, d):
    return sampled(spark, d)


add_view(
    "folded",
    """SELECT s.path, s.n, s.lft, s.rgt, len(s.path) AS sz, CASE WHEN f.as1 = s.path[s.lft + 1] THEN f.p2c ELSE f.c2p END AS fp, CASE WHEN l.as1 = s.path[s.rgt] THEN l.c2p ELSE l.p2c END AS lc
FROM cspan s LEFT JOIN gibbs f ON f.as1 = least(s.path[s.lft + 1], s.path[s.lft + 2]) AND f.as2 = greatest(s.path[s.lft + 1], s.path[s.lft + 2])
LEFT JOIN gibbs l ON s.lft IS NOT NULL AND l.as1 = least(s.path[s.rgt], s.path[s.rgt + 1]) AND l.as2 = greatest(s.path[s.rgt], s.path[s.rgt + 1])""",
)
add_view(
    "seeds",
    """SELECT path[lft + 1] AS as1, path[lft] AS as2 FROM folded WHERE lft >= 1 AND NOT fp >= 0.2
UNION SELECT path[rgt + 1], path[rgt + 2] FROM folded WHERE lft IS NOT NULL AND rgt <= sz - 2 AND NOT lc >= 0.2""",
)
add_view(
    "chains",
    """SELECT path AS ch FROM folded WHERE lft IS NULL UNION SELECT list_reverse(path) FROM folded WHERE lft IS NULL
UNION SELECT path[1:lft + 1] FROM folded WHERE lft > 1 AND fp >= 0.2 UNION SELECT list_reverse(path[1:lft + 1]) FROM folded WHERE lft > 1
UNION SELECT path[rgt + 1:] FROM folded WHERE lft IS NOT NULL AND rgt < sz - 2 UNION SELECT list_reverse(path[rgt + 1:]) FROM folded WHERE lft IS NOT NULL AND rgt < sz - 2 AND lc >= 0.2""",
)
add_view("follow", "SELECT DISTINCT ch[i] AS as1, ch[i + 1] AS as2, ch[i + 2] AS as3 FROM (SELECT ch, unnest(range(1, len(ch) - 1)) AS i FROM chains WHERE len(ch) >= 3)")
add_view("pc", "SELECT * FROM (WITH RECURSIVE p AS (SELECT as1, as2 FROM seeds UNION SELECT f.as2, f.as3 FROM follow f JOIN p ON p.as1 = f.as1 AND p.as2 = f.as2) SELECT * FROM p)")
add_view(
    "pieces",
    """SELECT path, CAST(sum(n) AS BIGINT) AS n FROM (SELECT path, n FROM folded WHERE lft IS NULL UNION ALL SELECT path[1:lft + 1], n FROM folded WHERE lft > 0 AND fp >= 0.2
UNION ALL SELECT path[rgt + 1:], n FROM folded WHERE lft IS NOT NULL AND rgt < sz - 1 AND lc >= 0.2) GROUP BY 1""",
)
add_view(
    "reserved",
    """SELECT path[lft + 1:rgt + 1] AS path, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT x.path, x.n, coalesce(max(x.i) FILTER (u.as1 IS NOT NULL), 0) AS lft, coalesce(min(x.i - 1) FILTER (w.as1 IS NOT NULL), len(x.path) - 1) AS rgt
  FROM (SELECT path, n, unnest(range(1, len(path))) AS i FROM pieces) x
  LEFT JOIN pc w ON w.as1 = x.path[x.i] AND w.as2 = x.path[x.i + 1] LEFT JOIN pc u ON u.as1 = x.path[x.i + 1] AND u.as2 = x.path[x.i] GROUP BY x.path, x.n)
WHERE rgt > lft GROUP BY 1""",
)
add_view(
    "edgep",
    """SELECT as1, as2, 1.0::DOUBLE AS p2c, 0.0::DOUBLE AS p2p, 0.0::DOUBLE AS c2p, 0 AS paths FROM pc
UNION ALL SELECT a, b, 1 / 3::DOUBLE, 1 / 3::DOUBLE, 1 / 3::DOUBLE, count(*) FROM (
  SELECT least(path[i], path[i + 1]) AS a, greatest(path[i], path[i + 1]) AS b FROM (SELECT path, unnest(range(1, len(path))) AS i FROM reserved)) q
WHERE NOT EXISTS (SELECT 1 FROM pc p WHERE (p.as1 = q.a AND p.as2 = q.b) OR (p.as1 = q.b AND p.as2 = q.a)) GROUP BY 1, 2""",
)


def provider_edges(spark, d):
    return linkprob.provider_links(counted_paths(spark, d), stored_shares(spark, d), 0.8)


@query("F31_provider_links", "SELECT as1, as2 FROM pc")
def f31(spark, d):
    return provider_edges(spark, d)[0]


@query("F31_unexplained_paths", "SELECT array_to_string(path, '|') AS path, n FROM reserved")
def f31b(spark, d):
    return provider_edges(spark, d)[1].withColumn("path", F.array_join("path", "|"))


@query("F32_edge_probabilities", "SELECT as1, as2, round(p2c, 6) AS p2c, round(p2p, 6) AS p2p, round(c2p, 6) AS c2p, CAST(paths AS BIGINT) AS paths FROM edgep")
def f32(spark, d):
    return rounded(linkprob.edge_probabilities(*provider_edges(spark, d)), "p2c", "p2p", "c2p")


@query(
    "F33_probability_table",
    """SELECT as1, as2, round(p2c, 6) AS p2c, round(p2p, 6) AS p2p, round(c2p, 6) AS c2p FROM gibbs
       UNION ALL SELECT as1, as2, round(p2c, 6), round(p2p, 6), round(c2p, 6) FROM edgep e
       WHERE NOT (e.as1 > e.as2 AND EXISTS (SELECT 1 FROM edgep r WHERE r.as1 = e.as2 AND r.as2 = e.as1))""",
)
def f33(spark, d):
    probs = stored_shares(spark, d)
    p2c, reserved = linkprob.provider_links(counted_paths(spark, d), probs, 0.8)
    return rounded(linkprob.assemble(probs, linkprob.edge_probabilities(p2c, reserved)), "p2c", "p2p", "c2p")

"""The adapter views written again in DuckDB SQL, for the side-by-side checks."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "paths": """
SELECT l_orderkey, raw,
       list_filter(raw, lambda h, i: i = 1 OR h <> raw[i - 1]) AS hops
FROM (SELECT l_orderkey,
             flatten(list(CASE WHEN q >= 45 THEN [h, h] ELSE [h] END ORDER BY l_linenumber)) AS raw
      FROM (SELECT l_orderkey, l_linenumber, CAST(min(l_suppkey) AS VARCHAR) AS h, max(l_quantity) AS q
            FROM lineitem GROUP BY l_orderkey, l_linenumber)
      GROUP BY l_orderkey)""",
    "updates": """
SELECT e.event_id AS seq, date_trunc('second', e.ts) AS ts,
       CASE WHEN e.event_type <> 'error' THEN 'A' ELSE 'W' END AS aw,
       '192.0.2.' || (e.user_id % 256) AS peer_ip,
       CAST(p.raw[1] AS BIGINT) AS peer_as,
       (10 + (e.user_id // 65536) % 200) || '.' || ((e.user_id // 256) % 256) || '.' || (e.user_id % 256) || '.0'
         || CASE WHEN e.value >= 100 THEN '/25' ELSE '/24' END AS prefix,
       CASE WHEN e.event_type <> 'error' THEN array_to_string(p.raw, ' ') ELSE '' END AS as_path,
       CASE WHEN e.event_type <> 'error' THEN p.hops ELSE CAST([] AS VARCHAR[]) END AS hops,
       e.user_id AS user_id, e.value AS volume,
       CASE WHEN e.event_type <> 'error' THEN p.hops[len(p.hops)] END AS origin_as,
       CAST(epoch_us(date_trunc('second', e.ts)) // 1000000 AS BIGINT) AS s
FROM events e JOIN paths p ON e.event_id = p.l_orderkey""",
    "prefix2as": """
SELECT prefix, ord, o[ord + 1] AS origin FROM (
  SELECT prefix, o, unnest(range(len(o))) AS ord FROM (
    SELECT (10 + (user_id // 65536) % 200) || '.' || ((user_id // 256) % 256) || '.' || (user_id % 256) || '.0/24' AS prefix,
           CASE WHEN user_id % 4 = 0 AND o1 <> o2 THEN [o1, o2] ELSE [o1] END AS o
    FROM (SELECT user_id, arg_min(origin_as, (ts, seq)) AS o1, arg_max(origin_as, (ts, seq)) AS o2
          FROM updates WHERE aw = 'A' AND user_id % 2 = 0 GROUP BY user_id)
    UNION ALL
    SELECT prefix, [arg_max(origin_as, (n, -CAST(origin_as AS BIGINT)))] AS o
    FROM (SELECT (10 + (user_id // 65536) % 200) || '.' || ((user_id // 256) % 256) || '.0.0/16' AS prefix,
                 origin_as, count(*) AS n
          FROM updates WHERE aw = 'A' GROUP BY 1, 2)
    GROUP BY prefix))""",
    "links": """
SELECT DISTINCT least(a, b) AS lo, greatest(a, b) AS hi
FROM (SELECT CAST(hops[i] AS BIGINT) AS a, CAST(hops[i + 1] AS BIGINT) AS b
      FROM (SELECT hops, unnest(range(1, len(hops))) AS i FROM paths))""",
    "asrel": """
SELECT CASE WHEN x IN (2, 3) THEN CAST(hi AS VARCHAR) ELSE CAST(lo AS VARCHAR) END AS as1,
       CASE WHEN x IN (2, 3) THEN CAST(lo AS VARCHAR) ELSE CAST(hi AS VARCHAR) END AS as2,
       CASE WHEN x < 4 THEN -1 ELSE 0 END AS rel
FROM (SELECT lo, hi, (3 * lo + 5 * hi) % 8 AS x FROM links) WHERE x < 6""",
    "asprob": """
SELECT CAST(lo AS VARCHAR) AS as1, CAST(hi AS VARCHAR) AS as2,
       x / 10.0::DOUBLE AS p2c, (10 - x) / 20.0::DOUBLE AS p2p, (10 - x) / 20.0::DOUBLE AS c2p
FROM (SELECT lo, hi, (7 * lo + 3 * hi) % 11 AS x FROM links) WHERE x < 10""",
    # keyed by string order of the ends, as the probability file reader leaves it
    "prob": """
SELECT least(as1, as2) AS k1, greatest(as1, as2) AS k2,
       CASE WHEN as1 > as2 THEN c2p ELSE p2c END AS p2c, p2p,
       CASE WHEN as1 > as2 THEN p2c ELSE c2p END AS c2p
FROM asprob""",
    "aut": """
SELECT CAST(s_suppkey AS VARCHAR) AS asn, s_name AS aut_name, 'ORG-' || s_nationkey AS org_id FROM supplier""",
    "org": """
SELECT 'ORG-' || n_nationkey AS org_id, '20240101' AS changed, n_name AS name, r_name AS country, 'RIR' AS source
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "targets": """
SELECT n_name AS target, CAST(s_suppkey AS VARCHAR) AS asn
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "catalogue": """
SELECT * FROM (VALUES
  ('hijack', 'ev1', 'AS1、2, as3', TIMESTAMP '2024-01-08 06:00:00', TIMESTAMP '2024-01-09 06:00:00'),
  ('leak', 'ev2', 'AS4/AS5; 6', TIMESTAMP '2024-01-15 00:00:00', TIMESTAMP '2024-01-16 00:00:00'),
  ('outage', 'ev3', 'AS7, AS8 9', TIMESTAMP '2024-01-25 00:00:00', TIMESTAMP '2024-01-28 00:00:00'))
  AS c(event_type, event_name, outage_as, "start", "end")""",
    "traffic": """
SELECT g.series, (g.t - g.t0) // 3600 AS idx, make_timestamp(g.t * 1000000) AS ts, g.t AS t,
       coalesce(p.v / g.top, 0.0) AS value
FROM (SELECT series, top, t0, unnest(range(t0, t1 + 1, 3600)) AS t
      FROM (SELECT series, max(v) AS top FROM points GROUP BY series),
           (SELECT min(t) AS t0, max(t) AS t1 FROM points)) g
LEFT JOIN points p ON p.series = g.series AND p.t = g.t""",
    "points": """
SELECT event_type AS series, CAST(epoch_us(ts) // 3600000000 * 3600 AS BIGINT) AS t, sum(value) AS v
FROM events GROUP BY 1, 2""",
}


ONCE = {"ctx", "rel0", "lnk", "cx", "beside", "gibbs"}  # costly views with many readers


def add_view(name: str, body: str) -> None:
    VIEWS[name] = body


def _needed(body: str, have: list[str]) -> list[str]:
    for name in VIEWS:
        if name not in have and re.search(rf"\b(FROM|JOIN)\s+{name}\b", body):
            _needed(VIEWS[name], have)
            if name not in have:
                have.append(name)
    return have


def with_views(body: str) -> str:
    """Prefix the body with the views it names, dependencies first."""
    names = _needed(body, [])
    ctes = ", ".join(f"{n} AS {'MATERIALIZED ' if n in ONCE else ''}({VIEWS[n].strip()})" for n in names)
    body = body.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"

"""Queries over the column functions (B rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from routescope.functions import paths as P
from routescope.functions import prefixes as X
from routescope.functions import scores as S
from routescope.functions import text as W
from routescope.functions import times as T
from routescope.plans.registry import query
from routescope.plans.sqlviews import add_view
from routescope.sources import adapters as A

c = F.col


@query(
    "B1_collapse_prepending",
    "SELECT seq, array_to_string(hops, ' ') AS path, CAST(len(hops) AS BIGINT) AS n FROM updates WHERE aw = 'A'",
)
def b1(spark, d):
    hops = P.collapse_prepends(P.parse_path(c("as_path")))
    u = A.updates(spark, d).where("aw = 'A'").select("seq", hops.alias("h"))
    return u.select("seq", F.array_join("h", " ").alias("path"), F.size("h").cast("bigint").alias("n"))


@query(
    "B2_numeric_path_asns",
    """SELECT seq, array_to_string(list_filter(t, lambda h, i: list_position(t, h) = i), ' ') AS asns
       FROM (SELECT seq, list_filter(string_split_regex(trim(regexp_replace(
                 as_path || ' {64512,64513} i ' || peer_as, '\\{[^}]+\\}', '', 'g')), '\\s+'),
                 lambda h: regexp_matches(h, '^\\d+$')) AS t FROM updates)""",
)
def b2(spark, d):
    raw = F.concat("as_path", F.lit(" {64512,64513} i "), c("peer_as").cast("string"))
    return A.updates(spark, d).select("seq", F.array_join(P.numeric_hops(raw), " ").alias("asns"))


@query(
    "B3_parse_path",
    """SELECT seq, array_to_string(h, ',') AS hops, CAST(len(h) AS BIGINT) AS n
       FROM (SELECT seq, list_filter(string_split(as_path, ' '), lambda x: x <> '') AS h FROM updates)""",
)
def b3(spark, d):
    text = F.when(c("seq") % 2 == 1, F.replace("as_path", F.lit(" "), F.lit("| "))).otherwise(c("as_path"))
    u = A.updates(spark, d).select("seq", P.parse_path(text).alias("h"))
    return u.select("seq", F.array_join("h", ",").alias("hops"), F.size("h").cast("bigint").alias("n"))


@query(
    "B4_adjacent_pairs",
    """SELECT seq, i - 1 AS pos, hops[i] AS as1, hops[i + 1] AS as2
       FROM (SELECT seq, hops, unnest(range(1, len(hops))) AS i FROM updates)""",
)
def b4(spark, d):
    u = A.updates(spark, d).select("seq", F.posexplode(P.adjacent_pairs(c("hops"))).alias("pos", "p"))
    return u.select("seq", c("pos").cast("bigint").alias("pos"), "p.as1", "p.as2")


@query("B5_origin_as", "SELECT seq, hops[len(hops)] AS origin FROM updates WHERE aw = 'A'")
def b5(spark, d):
    return A.updates(spark, d).where("aw = 'A'").select("seq", P.origin(c("hops")).alias("origin"))


@query(
    "B6_exact_path_membership",
    "SELECT seq, list_has_any(hops, ['1', '5', '20']) AS crosses FROM updates",
)
def b6(spark, d):
    return A.updates(spark, d).select("seq", P.path_has_any(c("hops"), ["1", "5", "20"]).alias("crosses"))


@query(
    "B7_relevance",
    """SELECT target, count(*) AS n, count(*) FILTER (aw = 'A') AS announced FROM (
         SELECT DISTINCT t.target, u.seq, u.aw
         FROM (SELECT seq, aw, unnest(list_distinct(list_append(hops, CAST(peer_as AS VARCHAR)))) AS asn FROM updates) u
         JOIN targets t ON t.asn = u.asn) GROUP BY target""",
)
def b7(spark, d):
    from routescope.operators.relevance import relevant_updates

    rows = relevant_updates(A.updates(spark, d), A.targets(spark, d), ["seq", "aw"])
    return rows.groupBy("target").agg(
        F.count("*").alias("n"), F.count_if(c("aw") == "A").alias("announced")
    )


@query(
    "B8_time_bucket",
    """SELECT strftime(make_timestamp(s // 300 * 300 * 1000000), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS n
       FROM updates GROUP BY 1""",
)
def b8(spark, d):
    return A.updates(spark, d).groupBy(T.text(T.bucket_start(c("ts"))).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "B9_parse_as_list",
    """SELECT seq, array_to_string(list_filter(t, lambda h, i: list_position(t, h) = i), ' ') AS asns,
              'AS' || peer_as || ' / AS' || (user_id % 7) || ' AS00' || seq || ' / ASX' || user_id || 'Y1' AS listed
       FROM (SELECT seq, peer_as, user_id, [CAST(peer_as AS VARCHAR), CAST(user_id % 7 AS VARCHAR), CAST(seq AS VARCHAR),
                          CAST(user_id AS VARCHAR), '1'] AS t FROM updates)""",
)
def b9(spark, d):
    s = [c(n).cast("string") for n in ("peer_as", "seq", "user_id")]
    raw = F.concat(F.lit("AS"), s[0], F.lit("、"), (c("user_id") % 7).cast("string"), F.lit(" as00"), s[1], F.lit("; x"), s[2], F.lit("y1"))
    return A.updates(spark, d).select(
        "seq", F.array_join(W.parse_as_list(raw), " ").alias("asns"), W.as_list_text(raw).alias("listed")
    )


@query(
    "B10_parse_datetime",
    "SELECT seq, strftime(CASE WHEN seq % 7 IN (1, 3, 4) THEN date_trunc('minute', ts) ELSE ts END, '%Y-%m-%d %H:%M:%S') AS parsed FROM updates",
)
def b10(spark, d):
    layouts = ["yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy:MM:dd HH:mm",
               "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss'Z'", "MM/dd/yy HH:mm:ss"]
    k = c("seq") % 7
    raw = F.coalesce(*[F.when(k == i, F.date_format("ts", f)) for i, f in enumerate(layouts)])
    return A.updates(spark, d).select("seq", T.text(T.parse_time(raw)).alias("parsed"))


@query(
    "B11_two_digit_year",
    """SELECT seq, strftime(CASE WHEN seq % 2 = 0 THEN ts ELSE ts + INTERVAL 46 YEAR - INTERVAL 100 YEAR END, '%Y-%m-%d %H:%M:%S') AS parsed
       FROM updates""",
)
def b11(spark, d):
    year = F.when(c("seq") % 2 == 0, "24").otherwise("70")
    raw = F.concat(F.date_format("ts", "MM/dd/"), year, F.date_format("ts", " HH:mm:ss"))
    return A.updates(spark, d).select("seq", T.text(T.parse_two_digit_year(raw)).alias("parsed"))


@query("B12_normalise_asn", "SELECT seq, CAST(peer_as AS VARCHAR) AS asn, 'x' || seq AS other FROM updates")
def b12(spark, d):
    u = A.updates(spark, d)
    return u.select(
        "seq",
        W.normalise_asn(F.concat(F.lit(" as00"), c("peer_as").cast("string"))).alias("asn"),
        W.normalise_asn(F.concat(F.lit("ASx"), c("seq").cast("string"))).alias("other"),
    )


# Prefix text as (number, length), for the SQL side.
add_view(
    "pfx",
    """SELECT DISTINCT prefix, CAST(string_split(prefix, '/')[2] AS BIGINT) AS plen,
       CAST(o[1] AS BIGINT) * 16777216 + CAST(o[2] AS BIGINT) * 65536 + CAST(o[3] AS BIGINT) * 256 + CAST(o[4] AS BIGINT) AS num
FROM (SELECT prefix, string_split(string_split(prefix, '/')[1], '.') AS o
      FROM (SELECT prefix FROM updates UNION SELECT prefix FROM prefix2as))""",
)


@query(
    "B13_subprefix_test",
    """SELECT u.seq, u.prefix, u.plen > 24 AS inside24, true AS inside16, u.plen > 25 AS inside25
       FROM (SELECT seq, prefix, CAST(string_split(prefix, '/')[2] AS BIGINT) AS plen FROM updates) u""",
)
def b13(spark, d):
    ip = F.split("prefix", "/")[0]
    block = F.concat(F.regexp_extract("prefix", r"^(\d+\.\d+)", 1), F.lit(".0.0/16"))
    return A.updates(spark, d).select(
        "seq", "prefix",
        X.is_subprefix(c("prefix"), F.concat(ip, F.lit("/24"))).alias("inside24"),
        X.is_subprefix(c("prefix"), block).alias("inside16"),
        X.is_subprefix(c("prefix"), F.concat(ip, F.lit("/25"))).alias("inside25"),
    )


@query(
    "B16_path_length_anomaly",
    """SELECT seq, CASE WHEN x <= 0 THEN 0.0 WHEN x = 1 THEN 0.3 WHEN x = 2 THEN 0.6 ELSE 0.9 END::DOUBLE AS score
       FROM (SELECT seq, len(string_split(as_path, ' ')) - len(hops) AS x FROM updates WHERE aw = 'A')""",
)
def b16(spark, d):
    u = A.updates(spark, d).where("aw = 'A'")
    return u.select("seq", S.path_length_score(F.size(F.split("as_path", " ")), F.size("hops")).alias("score"))


@query(
    "B18_interception_risk",
    """SELECT seq, round(least(1.0, 0.4 * least(1.0, (len(hops) - 1) * 0.5)
              + 0.3 * CASE WHEN x <= 0 THEN 0.0 WHEN x = 1 THEN 0.3 WHEN x = 2 THEN 0.6 ELSE 0.9 END
              + 0.3 * least(1.0, x * 0.3)), 6)::DOUBLE AS risk
       FROM (SELECT seq, hops, len(string_split(as_path, ' ')) - len(hops) AS x FROM updates WHERE aw = 'A')""",
)
def b18(spark, d):
    u = A.updates(spark, d).where("aw = 'A'")
    raw, n = F.size(F.split("as_path", " ")), F.size("hops")
    risk = S.interception_risk(n - 1, S.path_length_score(raw, n), S.pattern_score(raw - n))
    return u.select("seq", F.round(risk, 6).alias("risk"))


@query(
    "B20_edit_distance",
    """SELECT l_orderkey, CAST(levenshtein(
              array_to_string(list_transform(raw, lambda h: chr(47 + CAST(list_position(hops, h) AS INTEGER))), ''),
              array_to_string(list_transform(list_reverse(hops), lambda h: chr(47 + CAST(list_position(hops, h) AS INTEGER))), '')) AS BIGINT) AS dist
       FROM paths""",
)
def b20(spark, d):
    return A.paths(spark, d).select(
        "l_orderkey", P.edit_distance(c("raw"), F.reverse("hops")).cast("bigint").alias("dist")
    )


@query(
    "B21_guarded_std",
    """SELECT series, t // 86400 AS day, round(CASE WHEN sd > 1e-6 THEN sd ELSE greatest(0.05 * greatest(abs(m), 1.0), 0.02) END, 6) AS std
       FROM (SELECT series, t, avg(value) AS m, CASE WHEN (t // 86400) % 2 = 0 THEN stddev_pop(value) ELSE 0 END AS sd
             FROM (SELECT series, t // 86400 * 86400 AS t, value FROM traffic) GROUP BY series, t)""",
)
def b21(spark, d):
    day = F.expr("unix_timestamp(ts) div 86400")
    g = A.traffic(spark, d).groupBy("series", day.alias("day")).agg(
        F.avg("value").alias("m"), F.stddev_pop("value").alias("sd")
    )
    sd = F.when(c("day") % 2 == 0, c("sd")).otherwise(F.lit(0.0))
    return g.select("series", "day", F.round(S.guarded_std(c("m"), sd), 6).alias("std"))


@query(
    "B22_z_severity",
    """SELECT series, CASE WHEN z > 5 THEN 'high' WHEN z > 3 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n
       FROM (SELECT series, abs(value - avg(value) OVER w) / stddev_pop(value) OVER w AS z
             FROM traffic WINDOW w AS (PARTITION BY series)) GROUP BY 1, 2""",
)
def b22(spark, d):
    t = A.traffic(spark, d)
    stats = t.groupBy("series").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    z = F.abs(c("value") - c("m")) / c("sd")
    return t.join(stats, "series").groupBy("series", S.z_severity(z).alias("severity")).agg(F.count("*").alias("n"))




@query(
    "B23_request_extraction",
    r"""SELECT conv_id, turn,
         array_to_string(list_transform(list_sort(list_distinct(list_transform(
            regexp_extract_all(t, '(?i)AS(\d+)', 1), lambda x: CAST(x AS HUGEINT)))), lambda x: CAST(x AS VARCHAR)), ' ') AS asns,
         '2024-01-05 08:30' AS start_time, '2024-01-06 09:45' AS end_time,
         trim(regexp_extract(t, '(?i)in\s+([A-Za-z\s]+?)\s+(?:from|between|during)', 1)) AS region
       FROM (SELECT conv_id, turn, text || ' Outage in Norland from 2024/1/5 8:30 to 2024/01/6 09:45 for AS' || conv_id || ', as' || turn AS t
             FROM conversations)""",
)
def b23(spark, d):
    t = A.table(spark, d, "conversations").select(
        "conv_id", "turn",
        F.concat("text", F.lit(" Outage in Norland from 2024/1/5 8:30 to 2024/01/6 09:45 for AS"),
                 c("conv_id").cast("string"), F.lit(", as"), c("turn").cast("string")).alias("t"),
    )
    start, end = W.time_range(c("t"))
    return t.select(
        "conv_id", "turn", F.array_join(W.mentioned_asns(c("t")), " ").alias("asns"),
        start.alias("start_time"), end.alias("end_time"), W.region(c("t")).alias("region"),
    )


@query(
    "B24_event_sentence",
    """SELECT 'ev' || seq || ': network outage in AS' || peer_as || ' / AS' || origin_as || ' from '
              || strftime(ts, '%Y-%m-%d %H:%M') || ' to ' || strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS sentence
       FROM updates WHERE aw = 'A'""",
)
def b24(spark, d):
    name = F.concat(F.lit("ev"), c("seq").cast("string"))
    listed = F.concat(c("peer_as").cast("string"), F.lit("、as"), c("origin_as"))
    s = W.event_sentence(name, listed, c("ts"), c("ts") + F.expr("INTERVAL 1 HOUR"))
    return A.updates(spark, d).select(s.alias("sentence")).where(c("sentence").isNotNull())


@query(
    "B25_adaptive_threshold",
    """SELECT origin_as, n, CASE WHEN r >= 0.1 THEN 0.0005 WHEN r >= 0.01 THEN 0.001 WHEN r >= 0.001 THEN 0.002 ELSE 0.005 END::DOUBLE AS threshold
       FROM (SELECT origin_as, count(*) AS n, count(*) / (SELECT count(*) FROM updates WHERE aw = 'A')::DOUBLE AS r
             FROM updates WHERE aw = 'A' GROUP BY origin_as)""",
)
def b25(spark, d):
    a = A.updates(spark, d).where("aw = 'A'")
    total = a.agg(F.count("*")).scalar()
    g = a.groupBy("origin_as").agg(F.count("*").alias("n"))
    return g.select("origin_as", "n", S.forge_threshold(c("n") / total).alias("threshold"))


@query(
    "B26_extended_window",
    """SELECT user_id, strftime(min(ts) - INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS win_start,
              strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS win_end FROM updates GROUP BY user_id""",
)
def b26(spark, d):
    g = A.updates(spark, d).groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    start, end = T.extended_window(c("a"), c("b"))
    return g.select("user_id", T.text(start).alias("win_start"), T.text(end).alias("win_end"))


@query(
    "B27_json_round_trip",
    "SELECT seq, prefix, origin_as, CAST(len(hops) AS BIGINT) AS n, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen FROM updates",
)
def b27(spark, d):
    u = A.updates(spark, d)
    doc = F.to_json(F.struct("prefix", "origin_as", "hops", T.text(c("ts")).alias("seen")))
    back = F.from_json(doc, "prefix string, origin_as string, hops array<string>, seen string")
    return u.select("seq", back.alias("j")).select(
        "seq", "j.prefix", "j.origin_as", F.size("j.hops").cast("bigint").alias("n"), "j.seen"
    )


@query(
    "B29_earlier_later",
    """SELECT user_id, strftime(least(a, w), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(greatest(a, w), '%Y-%m-%d %H:%M:%S') AS last_seen
       FROM (SELECT user_id, min(ts) FILTER (aw = 'A') AS a, max(ts) FILTER (aw = 'W') AS w FROM updates GROUP BY user_id)""",
)
def b29(spark, d):
    g = A.updates(spark, d).groupBy("user_id").agg(
        F.min(F.when(c("aw") == "A", c("ts"))).alias("a"), F.max(F.when(c("aw") == "W", c("ts"))).alias("w")
    )
    return g.select(
        "user_id", T.text(T.earlier(c("a"), c("w"))).alias("first_seen"), T.text(T.later(c("a"), c("w"))).alias("last_seen")
    )

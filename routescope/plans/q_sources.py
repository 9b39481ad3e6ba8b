"""Queries over sources, the document table, verdict tables and sinks (A rows).

File lines are spelled out from the supplied tables, so every parser reads as many lines
as the tables have rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from routescope.functions import times as T
from routescope.operators import pathsets, prefix_join
from routescope.plans.registry import query
from routescope.plans.sqlviews import add_view
from routescope.sources import adapters as A
from routescope.sources import documents as D
from routescope.sources import dumps as DU
from routescope.sources import reference as R
from routescope.sources import sinks as S
from routescope.sources import updates as U
from routescope.sources import verdicts as V
from routescope.sources.landing import landed, landed_files

c = F.col
FMT = "'%Y-%m-%d %H:%M:%S'"


def dump_lines(spark, d):
    """Every update as a dump line; some lines are unreadable, short or too long."""
    stamp = F.when(c("seq") % 3 == 0, F.date_format("ts", "MM/dd/yy HH:mm:ss")).otherwise(T.text(c("ts")))
    six = [F.lit("BGP4MP"), stamp, c("aw"), c("peer_ip"), c("peer_as").cast("string"), c("prefix")]
    rest = [c("as_path"), F.lit("IGP"), c("peer_ip"), F.lit("0"), (c("seq") % 11).cast("string"), F.lit(""), F.lit("NAG"), F.lit(""), F.lit("")]
    long = F.concat_ws("|", *six, *rest, F.when(c("seq") % 5 == 0, F.lit("more")))
    value = F.when(c("seq") % 97 == 0, F.lit("BAD LINE")).when(c("aw") == "W", F.concat_ws("|", *six)).otherwise(long)
    return A.updates(spark, d).select(value.alias("value"), c("seq").cast("string").alias("seq"))


@query(
    "A1_read_update_dump",
    """SELECT CAST(seq AS VARCHAR) AS seq, aw, peer_ip, CAST(peer_as AS VARCHAR) AS peer_as, prefix, as_path, CASE WHEN aw = 'A' THEN 'IGP' ELSE '' END AS origin,
         CASE WHEN aw = 'A' THEN CAST(seq % 11 AS VARCHAR) ELSE '' END AS med, '' AS unknown FROM updates WHERE seq % 97 <> 0""",
)
def a1(spark, d):
    return U.split_fields(dump_lines(spark, d)).select("seq", "aw", "peer_ip", "peer_as", "prefix", "as_path", "origin", "med", "unknown")


@query(
    "A1_announcements_only",
    "SELECT CAST(seq AS VARCHAR) AS seq, prefix FROM updates WHERE seq % 97 <> 0 AND aw = 'A'",
)
def a1b(spark, d):
    return U.split_fields(dump_lines(spark, d), announcements_only=True).select("seq", "prefix")


@query(
    "A2_parse_updates",
    f"""SELECT CAST(seq AS VARCHAR) AS seq, strftime(ts, {FMT}) AS ts, aw, peer_as, prefix, array_to_string(hops, ' ') AS hops, origin_as, CASE WHEN aw = 'A' THEN seq % 11 ELSE -1 END AS med
        FROM updates WHERE seq % 97 <> 0""",
)
def a2(spark, d):
    t = U.typed(U.split_fields(dump_lines(spark, d)))
    return t.select("seq", T.text(c("ts")).alias("ts"), "aw", "peer_as", "prefix", F.array_join("hops", " ").alias("hops"), "origin_as", F.coalesce("med", F.lit(-1)).cast("bigint").alias("med"))


@query(
    "A3_time_range_scan",
    f"SELECT seq, strftime(ts, {FMT}) AS ts FROM updates WHERE ts >= TIMESTAMP '2024-01-07 13:35:00' AND ts <= TIMESTAMP '2024-01-19 02:11:40'",
)
def a3(spark, d):
    return U.scan(A.updates(spark, d), "2024-01-07 13:37:21", "2024-01-19 02:11:40").select("seq", T.text(c("ts")).alias("ts"))


def dump_folder(spark, d):
    """The updates as dump files of five minutes, written at first use."""
    return landed_files(spark, d, "dumps", lambda spark, d, folder: DU.write(A.updates(spark, d), folder))


READ_BACK = f"strftime(ts, {FMT}) AS ts, aw, peer_ip, peer_as, prefix, as_path, array_to_string(hops, ' ') AS hops, origin_as FROM updates"


def read_back(rows):
    return rows.select(T.text(c("ts")).alias("ts"), "aw", "peer_ip", "peer_as", "prefix", "as_path", F.array_join("hops", " ").alias("hops"), "origin_as")


@query("A1_dump_files", f"SELECT {READ_BACK}")
def a1_files(spark, d):
    return read_back(DU.read_updates(spark, dump_folder(spark, d)))


@query("A3_dump_range", f"SELECT {READ_BACK} WHERE ts >= TIMESTAMP '2024-01-07 13:35:00' AND ts <= TIMESTAMP '2024-01-19 02:11:40'")
def a3_files(spark, d):
    return read_back(DU.read_updates(spark, dump_folder(spark, d), "2024-01-07 13:37:21", "2024-01-19 02:11:40"))


@query("A8_dump_audit", "SELECT DISTINCT 'updates.' || strftime(make_timestamp(s // 300 * 300 * 1000000), '%Y%m%d.%H%M') AS name, 'valid' AS status FROM updates")
def a8_files(spark, d):
    audited = DU.audit(spark, dump_folder(spark, d))
    return audited.select(F.regexp_replace("name", r"\.p\d+\.txt\.gz$", "").alias("name"), "status").distinct()


def dump_files(spark, d):
    name = F.concat(F.lit("updates."), F.date_format(T.bucket_start(c("ts")), "yyyyMMdd.HHmm"), F.lit(".gz"))
    return A.updates(spark, d).groupBy(name.alias("name")).agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))


add_view(
    "dumps",
    "SELECT 'updates.' || strftime(b, '%Y%m%d.%H%M') || '.gz' AS name, b, first_seq FROM (SELECT make_timestamp(s // 300 * 300 * 1000000) AS b, min(seq) AS first_seq FROM updates GROUP BY 1)",
)


@query(
    "A5_archive_range",
    """SELECT name FROM dumps WHERE b <= TIMESTAMP '2024-01-21 00:00:00' AND b >= (SELECT max(b) FROM dumps WHERE b < TIMESTAMP '2024-01-09 10:02:00')""",
)
def a5(spark, d):
    return U.archive_range(dump_files(spark, d), "2024-01-09 10:02:00", "2024-01-21 00:00:00").select("name")


@query(
    "A6_window_coverage",
    f"""SELECT w.event_name, strftime(w.t, {FMT}) AS file_time, x.b IS NOT NULL AS present FROM (
         SELECT event_name, unnest(generate_series("start" - INTERVAL 2 DAY, "end" + INTERVAL 1 DAY, INTERVAL 5 MINUTE)) AS t FROM catalogue) w LEFT JOIN dumps x ON x.b = w.t""",
)
def a6(spark, d):
    r = U.coverage(A.catalogue(spark, d), dump_files(spark, d), 2, 1)
    return r.withColumn("file_time", T.text(c("file_time")))


@query("A7_undecoded_files", "SELECT name FROM dumps WHERE first_seq % 4 = 3")
def a7(spark, d):
    raw = dump_files(spark, d)
    done = raw.where("first_seq % 4 <> 3").select(F.replace("name", F.lit(".gz"), F.lit(".txt")).alias("name"))
    return U.undecoded(raw, done)


def blobs(spark, d):
    """Documents as files: every third with a gzip mark, every seventh empty."""
    text = F.when(c("doc_id") % 7 == 0, F.lit("")).otherwise(c("text"))
    mark = F.when((c("doc_id") % 3 == 0) & (c("doc_id") % 7 != 0), F.unhex(F.lit("1F8B"))).otherwise(F.unhex(F.lit("")))
    body = F.concat(mark, F.encode(text, "UTF-8"))
    return A.table(spark, d, "documents").select(
        F.concat(F.lit("f"), c("doc_id").cast("string")).alias("name"), body.alias("content"), F.octet_length(body).cast("bigint").alias("length")
    )


add_view(
    "blobs",
    """SELECT 'f' || doc_id AS name, n AS length, CASE WHEN n = 0 THEN 'empty' WHEN n < 400 THEN 'too_small' WHEN doc_id % 3 <> 0 THEN 'not_gzip' ELSE 'valid' END AS status
FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE CAST(octet_length(encode(text)) AS BIGINT) + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END END AS n FROM documents)""",
)


@query("A8_file_audit", "SELECT name, length, status FROM blobs")
def a8(spark, d):
    return U.audit(blobs(spark, d), 400)


@query("D30_audit_totals", "SELECT status, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes FROM blobs GROUP BY 1")
def d30(spark, d):
    return U.audit_totals(U.audit(blobs(spark, d), 400))


def _lines(df, value):
    return df.select(value.alias("value"))


@query("A9_asrel_file", "SELECT as1, as2, CAST(rel AS INTEGER) AS rel FROM asrel")
def a9(spark, d):
    edges = A.asrel(spark, d)
    lines = _lines(edges, F.concat_ws("|", F.concat(F.lit("AS0"), c("as1")), "as2", c("rel").cast("string")))
    notes = _lines(edges, F.concat(F.lit("# "), c("as1")))
    return R.parse_asrel(lines.unionByName(notes))


def org_lines(spark, d):
    aut = _lines(A.aut(spark, d), F.concat_ws("|", F.concat(F.lit("AS0"), c("asn")), F.lit("20240101"), "aut_name", "org_id", F.lit("x"), F.lit("RIR")))
    org = _lines(A.org(spark, d), F.concat_ws("|", "org_id", "changed", "name", "country", "source"))
    head = _lines(A.org(spark, d), F.lit("# format:org_id|changed|org_name|country|source"))
    return aut.unionByName(head).unionByName(org)


@query("A10_asorg_file", "SELECT aut.asn, aut.aut_name, aut.org_id, org.name AS org_name, org.country FROM aut JOIN org ON org.org_id = aut.org_id")
def a10(spark, d):
    aut, org = R.parse_asorg(org_lines(spark, d))
    return aut.join(org, "org_id").select("asn", "aut_name", "org_id", c("name").alias("org_name"), "country")


@query("A11_prefix2as_file", "SELECT prefix, string_agg(origin, ' ' ORDER BY ord) AS origins FROM prefix2as GROUP BY 1")
def a11(spark, d):
    p = F.split("prefix", "/")
    lines = A.prefix2as(spark, d).select(
        F.concat_ws("\t", p[0], p[1], F.concat(c("origin"), F.lit("_99999"))).alias("value"), c("ord").alias("seq")
    )
    owners = prefix_join.prefix_origins(R.parse_prefix2as(lines))
    return owners.select("prefix", F.array_join("origins", " ").alias("origins"))


@query("A12_probability_file", "SELECT k1 AS as1, k2 AS as2, round(p2c, 6) AS p2c, round(p2p, 6) AS p2p, round(c2p, 6) AS c2p FROM prob")
def a12(spark, d):
    p = A.asprob(spark, d)
    real = p.select(F.concat_ws("|", "as1", "as2", *[c(n).cast("string") for n in ("p2c", "p2p", "c2p")]).alias("value"), F.lit(2).alias("seq"))
    stale = p.select(F.concat_ws("|", "as2", "as1", F.lit("0.1|0.1|0.8")).alias("value"), F.lit(1).alias("seq"))
    r = R.parse_asprob(stale.unionByName(real))
    return r.withColumns({n: F.round(n, 6) for n in ("p2c", "p2p", "c2p")})


@query("A13_path_count_file", "SELECT array_to_string(hops, '|') AS path, CAST(sum(1 + l_orderkey % 3) AS BIGINT) AS n FROM paths GROUP BY 1")
def a13(spark, d):
    path, extra = F.array_join("hops", "|"), c("l_orderkey") % 3
    lines = _lines(A.paths(spark, d), F.when(extra == 0, path).otherwise(F.concat_ws(" ", path, (extra + 1).cast("string"))))
    return R.parse_path_counts(lines).withColumn("path", F.array_join("path", "|"))


# ---------------------------------------------------------------- document table
add_view(
    "docs",
    f"""SELECT DISTINCT md5(strftime(ts, {FMT}) || '|' || peer_as || '|' || prefix || '|' || as_path) AS _id, ts AS timestamp, s, aw AS type, peer_ip, CAST(peer_as AS VARCHAR) AS peer_as, prefix, as_path,
  list_filter(string_split(as_path, ' '), lambda h: h <> '') AS arr, coalesce(origin_as, '') AS origin FROM updates""",
)
add_view(
    "docp",
    "SELECT *, list_transform(range(1, len(arr)), lambda i: arr[i] || '-' || arr[i + 1]) AS pairs FROM docs",
)


def received(spark, d):
    u = A.updates(spark, d)
    return u.unionByName(u.where("seq % 10 = 0"))  # some messages arrive twice


def docs(spark, d):
    return D.build(received(spark, d))


def stored_docs(spark, d):
    """The documents as written, by date."""
    return landed(spark, d, "documents_by_date", lambda spark, d: D.build_by_time(received(spark, d)), ("date",))


def stored_index(spark, d):
    return landed(spark, d, "postings_by_date", lambda spark, d: D.sorted_postings(stored_docs(spark, d)), ("date",))


@query(
    "A20_build_documents",
    f"SELECT _id, strftime(timestamp, {FMT}) AS timestamp, type, peer_as, prefix, array_to_string(arr, ' ') AS path, array_to_string(pairs, ' ') AS pairs, origin FROM docp",
)
def a20(spark, d):
    return docs(spark, d).select(
        "_id", T.text(c("timestamp")).alias("timestamp"), "type", "peer_as", "prefix",
        F.array_join("as_path_array", " ").alias("path"), F.array_join("as_pairs", " ").alias("pairs"), "origin",
    )


@query(
    "A16_filtered_scan",
    """SELECT _id FROM docp WHERE timestamp BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-29 00:00:00'
         AND list_has_any(pairs, ['1-2', '5-9', '11-5', '0-11', '3-8', '20-4', '0-0']) AND list_has_all(arr, ['0'])""",
)
def a16(spark, d):
    pairs = ["1-2", "5-9", "11-5", "0-11", "3-8", "20-4", "0-0"]
    r = D.search_indexed(stored_docs(spark, d), stored_index(spark, d), "2024-01-02 00:00:00", "2024-01-29 00:00:00", as_pairs=pairs, path_contains=["0"])
    return r.select("_id")


@query(
    "A16_filtered_scan_peer_prefix",
    """SELECT 'peer' AS by, _id FROM docp WHERE timestamp BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-29 00:00:00' AND peer_as = '3'
       UNION ALL SELECT 'prefix', _id FROM docp WHERE timestamp BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-29 00:00:00' AND prefix = '10.0.41.0/24'""",
)
def a16b(spark, d):
    when = ("2024-01-02 00:00:00", "2024-01-29 00:00:00")
    t, index = stored_docs(spark, d), stored_index(spark, d)
    peer = D.search_indexed(t, index, *when, peer_as="3").select(F.lit("peer").alias("by"), "_id")
    return peer.unionByName(D.search_indexed(t, index, *when, prefix="10.0.41.0/24").select(F.lit("prefix").alias("by"), "_id"))


@query(
    "A17_leak_candidates",
    """SELECT _id, as_path FROM docp WHERE type = 'A' AND timestamp BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00' AND list_contains(arr, '7')""",
)
def a17(spark, d):
    when = ("2024-01-05 00:00:00", "2024-01-25 00:00:00")
    r = D.search_indexed(stored_docs(spark, d), stored_index(spark, d), *when, path_contains=["7"], announced=True)
    return r.orderBy("timestamp", "_id").select("_id", "as_path")


@query(
    "A18_hijack_candidates",
    """SELECT _id, prefix FROM docp WHERE type = 'A' AND timestamp BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00'
         AND (list_contains(arr, '7') OR prefix IN (SELECT prefix FROM prefix2as WHERE origin IN ('7', '12', '40')))""",
)
def a18(spark, d):
    owned = A.prefix2as(spark, d).where(c("origin").isin("7", "12", "40"))
    r = D.candidates_indexed(stored_docs(spark, d), stored_index(spark, d), "7", owned, "2024-01-05 00:00:00", "2024-01-25 00:00:00")
    return r.orderBy("timestamp", "_id").select("_id", "prefix")


@query(
    "A19_document_columns",
    f"SELECT _id AS seq, strftime(timestamp, {FMT}) AS ts, type AS aw, CAST(peer_as AS BIGINT) AS peer_as, prefix, as_path, nullif(origin, '') AS origin_as FROM docp",
)
def a19(spark, d):
    r = D.as_updates(stored_docs(spark, d))
    return r.select("seq", T.text(c("ts")).alias("ts"), "aw", "peer_as", "prefix", "as_path", "origin_as")


@query(
    "A21_count_and_delete",
    """SELECT 'deleted' AS part, count(*) AS n FROM docp WHERE type = 'W' OR list_contains(arr, '9') UNION ALL SELECT 'kept', count(*) FROM docp WHERE NOT (type = 'W' OR list_contains(arr, '9'))""",
)
def a21(spark, d):
    t = docs(spark, d)
    cond = (c("type") == "W") | F.array_contains("as_path_array", "9")
    gone = t.where(cond).agg(F.count("*").alias("n")).select(F.lit("deleted").alias("part"), "n")
    return gone.unionByName(D.without(t, cond).agg(F.count("*").alias("n")).select(F.lit("kept").alias("part"), "n"))


@query(
    "A23_path_count_lines",
    "SELECT path || CASE WHEN n > 1 THEN ' ' || n ELSE '' END AS value FROM (SELECT array_to_string(hops, '|') AS path, count(*) AS n FROM updates WHERE aw = 'A' AND len(hops) >= 2 GROUP BY 1)",
)
def a23(spark, d):
    return S.path_count_lines(pathsets.path_counts(A.updates(spark, d).where("aw = 'A'")))


@query(
    "A23_alert_documents",
    """SELECT type, seq, prefix, target_as, victim_as, array_to_string(victim_ases, ' ') AS victims FROM origin_alerts""",
)
def a23b(spark, d):
    from routescope.plans.q_hijack import origin_alerts

    docs_ = S.alert_documents(origin_alerts(spark, d))
    back = F.from_json("value", "type string, seq bigint, prefix string, target_as string, victim_as string, victim_ases array<string>")
    return docs_.select(back.alias("j")).select("j.*").withColumn("victims", F.array_join("victim_ases", " ")).drop("victim_ases")


# ---------------------------------------------------------------- verdict tables
add_view(
    "cacherows",
    """SELECT as1 || '|' || as2 AS fake_connection, strftime(ts, '%Y-%m-%d') AS date_str, seq % 2 AS half, count(*) AS n, max(ts) AS updated_at FROM hoplinks GROUP BY 1, 2, 3""",
)


def cache_rows(spark, d, half):
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.size("hops") - 2), lambda i: F.concat_ws("|", F.get("hops", i), F.get("hops", i + 1))))
    u = A.updates(spark, d).where("size(hops) >= 2").where(c("seq") % 2 == half)
    return u.select(pair.alias("fake_connection"), F.date_format("ts", "yyyy-MM-dd").alias("date_str"), "ts").groupBy(
        "fake_connection", "date_str"
    ).agg(F.to_json(F.struct(F.count("*").alias("count"))).alias("frequency_data"), F.max("ts").alias("updated_at"))


add_view(
    "upserted",
    "SELECT fake_connection, date_str, arg_max(n, (updated_at, half)) AS n, max(updated_at) AS updated_at FROM cacherows GROUP BY 1, 2",
)


def merged(spark, d):
    return V.upsert(cache_rows(spark, d, 0), cache_rows(spark, d, 1), V.FREQUENCY_KEY)


def _shown(rows):
    n = F.from_json("frequency_data", "count bigint")["count"]
    return rows.select("fake_connection", "date_str", n.alias("n"), T.text(c("updated_at")).alias("updated_at"))


@query("A26_verdict_upsert", f"SELECT fake_connection, date_str, n, strftime(updated_at, {FMT}) AS updated_at FROM upserted")
def a26(spark, d):
    return _shown(merged(spark, d))


@query(
    "A25_verdict_expiry",
    f"SELECT fake_connection, date_str, n, strftime(updated_at, {FMT}) AS updated_at FROM upserted WHERE updated_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 12 DAY",
)
def a25(spark, d):
    return _shown(V.expire(merged(spark, d), F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00")), 12))


@query(
    "A24_newest_verdicts",
    f"SELECT fake_connection, date_str, n, strftime(updated_at, {FMT}) AS updated_at FROM upserted ORDER BY updated_at DESC, fake_connection LIMIT 10",
)
def a24(spark, d):
    return _shown(V.newest(merged(spark, d), 10, tie=("fake_connection",)))


@query("A24_table_counts", "SELECT 'updates' AS name, count(*) AS rows FROM updates UNION ALL SELECT 'asrel', count(*) FROM asrel UNION ALL SELECT 'prefix2as', count(*) FROM prefix2as")
def a24b(spark, d):
    return V.row_counts({"updates": A.updates(spark, d), "asrel": A.asrel(spark, d), "prefix2as": A.prefix2as(spark, d)})


add_view("edgehash", """SELECT count(*) AS n, CAST(sum(('0x' || substr(md5(as1 || '|' || as2 || '|' || rel), 1, 12))::BIGINT) AS VARCHAR) AS s FROM asrel""")


@query("A26_relationship_version", "SELECT n, md5(n || '|' || s) AS version FROM edgehash")
def a26b(spark, d):
    return R.relationship_version(A.asrel(spark, d))


@query(
    "D31_verdict_statistics",
    """SELECT count(*) AS total, count(*) FILTER (is_fake) AS fake, count(*) FILTER (NOT is_fake) AS legitimate, count(DISTINCT date_str) AS dates, 1 AS versions
       FROM (SELECT DISTINCT h.as1, h.as2, strftime(h.ts, '%Y-%m-%d') AS date_str, e.as1 IS NULL AS is_fake FROM hoplinks h LEFT JOIN edges2 e ON e.as1 = h.as1 AND e.as2 = h.as2)""",
)
def d31(spark, d):
    from routescope.operators.links import both_ways, exploded_links

    edges = A.asrel(spark, d)
    known = both_ways(edges).withColumn("known", F.lit(True))
    rows = exploded_links(A.updates(spark, d), ["ts"]).select("as1", "as2", F.date_format("ts", "yyyy-MM-dd").alias("date_str")).distinct()
    version = R.relationship_version(edges).select("version").scalar()
    pairs = rows.join(known, ["as1", "as2"], "left").select(
        "as1", "as2", "date_str", c("known").isNull().alias("is_fake"), version.alias("asrel_hash")
    )
    return V.pair_statistics(pairs)

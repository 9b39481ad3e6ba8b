"""Streaming queries run to their end over the stored updates, against their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from routescope.operators import hijack
from routescope.operators.features import FEATURE_INPUT
from routescope.plans.registry import query
from routescope.plans.sqlviews import add_view
from routescope.sources import adapters as A
from routescope.sources.landing import fresh_folder
from routescope.streaming import jobs as J
from routescope.streaming import state as K
from routescope.streaming.late import late_rows

c = F.col
FMT = "'%Y-%m-%d %H:%M:%S'"

# Event time up to which a stream that has seen everything has closed its windows.
add_view("mark", "SELECT max(s) - 600 AS m FROM updates")


def stream(spark, d, path=A.feed_path):
    """The stored updates as they come in, a slice of time a batch."""
    return J.update_stream(spark, path(spark, d), A.updates(spark, d).drop("date").schema, A.SLICE_FILES)


def big(df, *names):
    return df.withColumns({n: c(n).cast("bigint") for n in names})


@query(
    "J1_update_source",
    f"SELECT seq, strftime(ts, {FMT}) AS ts, aw, prefix FROM updates",
)
def j1(spark, d):
    out = J.drain(stream(spark, d).select("seq", "ts", "aw", "prefix"), fresh_folder(spark, "j1"))
    return out.withColumn("ts", J.zone_less("ts"))


@query(
    "J2_tumbling_counts",
    f"""SELECT strftime(make_timestamp(s // 300 * 300 * 1000000), {FMT}) AS bucket, count(*) FILTER (aw = 'A') AS announcement_count, count(*) FILTER (aw = 'W') AS withdrawal_count, count(*) AS total_messages
        FROM updates GROUP BY s // 300 HAVING s // 300 * 300 + 300 <= (SELECT m FROM mark)""",
)
def j2(spark, d):
    out = J.drain(J.bucket_counts(stream(spark, d), []), fresh_folder(spark, "j2"))
    return out.withColumn("bucket", J.zone_less("bucket"))


@query(
    "J3_sliding_counts",
    f"""SELECT strftime(make_timestamp(w * 1000000), {FMT}) AS win_start, peer_as, count(*) FILTER (aw = 'A') AS announcement_count, count(*) FILTER (aw = 'W') AS withdrawal_count
        FROM (SELECT peer_as, aw, unnest([s // 1800 * 1800, s // 1800 * 1800 - 1800]) AS w FROM updates) WHERE w + 3600 <= (SELECT m FROM mark) GROUP BY w, peer_as""",
)
def j3(spark, d):
    out = J.drain(J.sliding_counts(stream(spark, d), ["peer_as"]), fresh_folder(spark, "j3"))
    return out.drop("win_end").withColumn("win_start", J.zone_less("win_start"))


@query(
    "J4_sessions",
    f"""SELECT user_id, strftime(make_timestamp(a * 1000000), {FMT}) AS first_seen, strftime(make_timestamp(b * 1000000), {FMT}) AS last_seen, n FROM (
          SELECT user_id, sid, min(s) AS a, max(s) AS b, count(*) AS n FROM (
            SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, seq ROWS UNBOUNDED PRECEDING) AS sid FROM (
              SELECT user_id, s, seq, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, seq) < 7200 THEN 0 ELSE 1 END AS fresh FROM updates)) GROUP BY 1, 2)
        WHERE n >= 3 AND b + 7200 <= (SELECT m FROM mark)""",
)
def j4(spark, d):
    out = J.drain(J.anomaly_sessions(stream(spark, d), ["user_id"], "120 minutes"), fresh_folder(spark, "j4"))
    return out.withColumns({n: J.zone_less(n) for n in ("first_seen", "last_seen")})


@query(
    "J5_route_state",
    """SELECT target, prefix, seq, CASE WHEN live AND p_path = as_path THEN 1 ELSE 0 END AS dup_a, CASE WHEN aw = 'A' AND p_origin IS NOT NULL AND p_origin <> origin_as THEN 1 ELSE 0 END AS ori_change,
         CASE WHEN live AND len(asns) > len(p_asns) THEN 1 ELSE 0 END AS longer, CASE WHEN live AND len(asns) < len(p_asns) THEN 1 ELSE 0 END AS shorter,
         CASE WHEN aw = 'A' AND p_aw = 'W' THEN 1 ELSE 0 END AS new_after_w, CASE WHEN aw = 'W' AND p_aw = 'W' THEN 1 ELSE 0 END AS dup_w FROM stg""",
)
def j5(spark, d):
    folder = fresh_folder(spark, "j5")
    rows = K.touching(stream(spark, d).select(*FEATURE_INPUT), A.targets(spark, d))
    K.route_state(rows, folder).awaitTermination()
    return spark.read.parquet(f"{folder}/table").select("target", "prefix", "seq", *K.CHANGES)


@query(
    "J6_alert_groups",
    f"""SELECT prefix, strftime(make_timestamp(w * 1000000), {FMT}) AS window_start, n, CASE WHEN n >= 5 THEN 'high' WHEN n >= 2 THEN 'medium' ELSE 'low' END AS confidence
        FROM (SELECT prefix, s // 3600 * 3600 AS w, count(*) AS n FROM updates WHERE aw = 'W' GROUP BY 1, 2) WHERE w + 3600 <= (SELECT m FROM mark)""",
)
def j6(spark, d):
    s = stream(spark, d).where("aw = 'W'")
    twice = s.select("seq", "ts", "prefix", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))  # every alert is sent twice
    alerts = twice.select("ts", "prefix", F.lit("withdrawn").alias("type"), F.lit("low").alias("confidence"), c("seq").alias("_id"))
    out = J.drain(J.alert_groups(alerts, "1 hour", id_column="_id"), fresh_folder(spark, "j6"))
    return out.select("prefix", J.zone_less("window_start").alias("window_start"), "n", "confidence")


@query(
    "J7_stream_static_joins",
    """SELECT u.seq, coalesce(NOT list_contains(q.origins, u.origin_as), false) AS wrong_origin, len(u.hops) > 1 AND e.as1 IS NULL AS unknown_first_link
       FROM updates u LEFT JOIN p2a q ON q.prefix = u.prefix LEFT JOIN edges2 e ON e.as1 = u.hops[1] AND e.as2 = u.hops[2] WHERE u.aw = 'A'""",
)
def j7(spark, d):
    s = stream(spark, d).where("aw = 'A'")
    out = J.drain(J.with_static(s, A.prefix2as(spark, d), A.asrel(spark, d)), fresh_folder(spark, "j7"))
    return out.select("seq", "wrong_origin", "unknown_first_link")


@query("J7_origin_hijacks", "SELECT type, seq, target_as, victim_as FROM origin_alerts")
def j7b(spark, d):
    folder = fresh_folder(spark, "j7b")
    owners, targets = A.prefix2as(spark, d), A.targets(spark, d)
    J.per_batch(
        stream(spark, d).where("aw = 'A'"), folder, lambda rows: hijack.origin_hijacks(rows, owners, targets)
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/table").select("type", "seq", "target_as", "victim_as")


# In the late feed a slice is a batch. A row is late when it lies at or behind the watermark that the
# batch before its own had: ten minutes before the newest row of all batches before that one.
add_view(
    "arrivals",
    f"""SELECT seq, s, CASE WHEN seq % {A.LATE_EVERY} = 7 THEN least(k + {A.LATE_BY}, {A.SLICES - 1}) ELSE k END AS batch
FROM (SELECT seq, s, (s - min(s) OVER ()) * {A.SLICES} // (max(s) OVER () - min(s) OVER () + 1) AS k FROM updates)""",
)
add_view("marks", "SELECT b.batch, max(a.s) - 600 AS m FROM (SELECT DISTINCT batch FROM arrivals) b JOIN arrivals a ON a.batch <= b.batch - 2 GROUP BY 1")


@query(
    "J8_late_rows",
    """SELECT count(*) FILTER (late) AS late, count(*) FILTER (NOT late) AS n FROM (
         SELECT coalesce(a.s <= m.m, false) AS late FROM arrivals a LEFT JOIN marks m ON m.batch = a.batch)""",
)
def j8(spark, d):
    s = stream(spark, d, A.late_feed_path).select("ts", c("seq").alias("_id"))
    folder = fresh_folder(spark, "j8")
    q = J.run_to_table(J.distinct_messages(s), folder)
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/table").agg(F.count("*").alias("n")).select(F.lit(late_rows(q)).cast("bigint").alias("late"), "n")

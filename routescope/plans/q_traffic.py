"""Queries over traffic series: alignment, anomaly detectors, runs and sessions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from routescope.functions import times as T
from routescope.operators import baselines as B
from routescope.operators import learned, periods, reports
from routescope.operators import sequences as Q
from routescope.operators import traffic as TR
from routescope.plans import jobs
from routescope.plans.registry import SQL_OF, query
from routescope.plans.sqlviews import add_view
from routescope.sources import adapters as A

c = F.col
KEY = TR.KEY
DAY = 86400
FMT = "'%Y-%m-%d %H:%M:%S'"


def point_views(tag: str, windows: str) -> None:
    """SQL views of current points, history and the two joined by position."""
    add_view(f"{tag}cur", f"""SELECT t.series, k.event_name, t.ts, t.t, t.value, row_number() OVER (PARTITION BY t.series, k.event_name ORDER BY t.ts) - 1 AS idx
FROM traffic t JOIN {windows} k ON t.ts BETWEEN k."start" AND k."end\"""")
    add_view(f"{tag}hist", f"""SELECT t.series, k.event_name, p.period, t.t, t.value, row_number() OVER (PARTITION BY t.series, k.event_name, p.period ORDER BY t.ts) - 1 AS idx
FROM traffic t JOIN {windows} k ON true JOIN (SELECT unnest(range(1, 8)) AS period) p ON t.ts BETWEEN k."start" - p.period * INTERVAL 1 DAY AND k."end" - p.period * INTERVAL 1 DAY""")
    add_view(f"{tag}pts", f"""SELECT x.*, h.mean, h.std, CASE WHEN h.std > 1e-6 THEN h.std ELSE greatest(0.05 * greatest(abs(h.mean), 1.0), 0.02) END AS eff
FROM {tag}cur x JOIN (SELECT series, event_name, min(n) AS shortest FROM (SELECT series, event_name, period, count(*) AS n FROM {tag}hist GROUP BY 1, 2, 3) GROUP BY 1, 2) m
  ON m.series = x.series AND m.event_name = x.event_name AND x.idx < m.shortest
JOIN (SELECT series, event_name, idx, avg(value) AS mean, stddev_pop(value) AS std FROM {tag}hist GROUP BY 1, 2, 3) h ON h.series = x.series AND h.event_name = x.event_name AND h.idx = x.idx""")


add_view("widewin", """SELECT event_type, event_name, "start" - INTERVAL 1 DAY AS "start", "end" + INTERVAL 6 HOUR AS "end" FROM catalogue""")
point_views("n", "catalogue")
point_views("w", "widewin")


def keep_runs_sql(src: str, keys: str = "series, event_name", shortest: int = 4) -> str:
    """Rows of ``src`` whose idx lies in a run."""
    on = " AND ".join(f"r.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    return f"""SELECT s.* FROM {src} s JOIN (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {keys}, run) AS run_n FROM (
  SELECT {keys}, idx, idx - row_number() OVER (PARTITION BY {keys} ORDER BY idx) AS run FROM (SELECT DISTINCT {keys}, idx FROM {src}))) WHERE run_n >= {shortest}) r ON {on} AND r.idx = s.idx"""


def windows(spark, d):
    return A.catalogue(spark, d)


def points(spark, d):
    t, w = A.traffic(spark, d), windows(spark, d)
    return TR.align_by_position(TR.current_points(t, w), TR.history(t, w, DAY, 7))


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


def big(df, *names):
    return df.withColumns({n: c(n).cast("bigint") for n in names})


@query(
    "A14_traffic_fetch",
    f"SELECT series, strftime(ts, {FMT}) AS ts, round(value, 6) AS value FROM traffic WHERE series = 'click' AND ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'",
)
def a14(spark, d):
    r = TR.fetch(A.traffic(spark, d), "click", "2024-01-03 00:00:00", "2024-01-20 12:00:00")
    return rounded(r.withColumn("ts", T.text(c("ts"))), "value")


@query("C12_positional_alignment", "SELECT series, event_name, idx, round(value, 6) AS value, round(mean, 6) AS mean, round(std, 6) AS std FROM npts")
def c12(spark, d):
    return rounded(big(points(spark, d), "idx").drop("ts"), "value", "mean", "std")


add_view(
    "aligned",
    """SELECT series, event_name, idx, avg(o) AS mean, stddev_pop(o) AS std FROM (
  SELECT series, event_name, idx, coalesce(last_value(old IGNORE NULLS) OVER (PARTITION BY series, event_name, period ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(old IGNORE NULLS) OVER (PARTITION BY series, event_name, period ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS o
  FROM (SELECT x.series, x.event_name, x.idx, x.t, p.period, h.value AS old FROM wcur x
        JOIN (SELECT DISTINCT series, event_name, period FROM whist) p ON p.series = x.series AND p.event_name = x.event_name
        LEFT JOIN whist h ON h.series = x.series AND h.event_name = x.event_name AND h.period = p.period AND h.t + p.period * 86400 = x.t)) GROUP BY 1, 2, 3""",
)


@query("C11_time_alignment", "SELECT series, event_name, idx, round(mean, 6) AS mean, round(std, 6) AS std FROM aligned")
def c11(spark, d):
    t, w = A.traffic(spark, d), jobs.widened(windows(spark, d))
    r = TR.align_by_time(TR.current_points(t, w), TR.history(t, w, DAY, 7), DAY)
    return rounded(big(r.select(*KEY, "idx", "mean", "std"), "idx"), "mean", "std")


@query(
    "D25_traffic_statistics",
    """SELECT series, event_name, round(a, 6) AS current_avg, round(h, 6) AS historical_avg, n AS data_points, round(CASE WHEN h > 0 THEN (a - h) / h * 100 ELSE 0 END, 6) AS percent_change
       FROM (SELECT series, event_name, avg(value) AS a, avg(mean) AS h, count(*) AS n FROM npts GROUP BY 1, 2)""",
)
def d25(spark, d):
    return rounded(TR.statistics(points(spark, d)), "current_avg", "historical_avg", "percent_change")


add_view("tstat", "SELECT *, round(abs(value - mean) / eff, 9) AS z FROM npts WHERE round(abs(value - mean) / eff, 9) > 2.0")


@query(
    "F12_traffic_statistical",
    "SELECT series, event_name, idx, round(z, 6) AS z, CASE WHEN z > 5 THEN 'high' WHEN z > 3 THEN 'medium' ELSE 'low' END AS severity FROM tstat",
)
def f12(spark, d):
    return rounded(big(TR.statistical(points(spark, d), 2.0).select(*KEY, "idx", "z", "severity"), "idx"), "z")


@query(
    "F13_sustained_outage",
    "SELECT series, event_name, idx, round(abs(value - mean) / eff, 6) AS z FROM npts WHERE mean >= 0.04 AND value <= 0.03",
)
def f13(spark, d):
    return rounded(big(TR.sustained_outage(points(spark, d)).select(*KEY, "idx", "z"), "idx"), "z")


def drop_sql(tag: str) -> str:
    return f"""SELECT l.series, l.event_name, l.idx, r.drop_start, r.drop_end, r.n AS points, CASE WHEN r.v / r.p < 0.01 THEN 'critical' ELSE 'high' END AS severity FROM {tag}low l
JOIN (SELECT series, event_name, run, min(idx) AS drop_start, max(idx) AS drop_end, count(*) AS n, arg_min(value, idx) AS v, arg_min(coalesce(prev, -1), idx) AS p, arg_min(mean, idx) AS m FROM {tag}low GROUP BY 1, 2, 3) r
ON r.series = l.series AND r.event_name = l.event_name AND r.run = l.run WHERE r.p >= 0.10 AND r.m >= 0.05 AND r.n >= 3"""


for _tag in ("n", "w"):
    add_view(f"{_tag}low", f"""SELECT *, idx - row_number() OVER (PARTITION BY series, event_name ORDER BY idx) AS run
FROM (SELECT *, lag(value) OVER (PARTITION BY series, event_name ORDER BY idx) AS prev FROM {_tag}pts) WHERE value < 0.03""")
    add_view(f"{_tag}drop", drop_sql(_tag))


@query("E11_sudden_drop", "SELECT series, event_name, idx, drop_start, drop_end, points, severity FROM ndrop")
def e11(spark, d):
    r = TR.sudden_drop(points(spark, d)).select(*KEY, "idx", "drop_start", "drop_end", "points", "severity")
    return big(r, "idx", "drop_start", "drop_end")


def combined_views(tag: str, threshold: float, name: str | None = None) -> None:
    """Views ``name``all and ``name``comb over the points and drops of ``tag``."""
    name = name or tag
    add_view(
        f"{name}all",
        f"""SELECT series, event_name, idx, max(z) FILTER (k = 1) AS stat_z, bool_or(k = 2) AS low, bool_or(k = 3) AS drp, max(sev) FILTER (k = 3) AS drop_sev FROM (
  SELECT series, event_name, idx, round(abs(value - mean) / eff, 9) AS z, 1 AS k, NULL AS sev FROM {tag}pts WHERE round(abs(value - mean) / eff, 9) > {threshold}
  UNION ALL SELECT series, event_name, idx, NULL, 2, NULL FROM {tag}pts WHERE mean >= 0.04 AND value <= 0.03
  UNION ALL SELECT series, event_name, idx, NULL, 3, severity FROM {tag}drop) GROUP BY 1, 2, 3""",
    )
    add_view(f"{name}comb", keep_runs_sql(f"{name}all"))


combined_views("n", 1.2)


@query(
    "F15_combined_without_forest",
    """SELECT series, event_name, idx, CASE WHEN stat_z IS NOT NULL THEN 'combined' WHEN low THEN 'sustained_outage' ELSE 'sudden_drop_to_zero' END AS method,
         CASE WHEN stat_z > 5 THEN 'high' WHEN stat_z > 3 THEN 'medium' WHEN stat_z IS NOT NULL THEN 'low' WHEN low THEN 'high' ELSE drop_sev END AS severity,
         low AS sustained_outage, drp AS sudden_drop FROM ncomb""",
)
def f15(spark, d):
    r = TR.combined(points(spark, d), None, 1.2)
    return big(r.select(*KEY, "idx", "method", "severity", "sustained_outage", "sudden_drop"), "idx")


def forest(spark, d):
    t, w = A.traffic(spark, d), windows(spark, d)
    return learned.isolation_forest(points(spark, d), TR.history(t, w, DAY, 7))


@query("F14_isolation_forest")
def f14(spark, d):
    return rounded(big(forest(spark, d), "idx"), "ml_score")


@query("F15_combined_detector")
def f15b(spark, d):
    r = TR.combined(points(spark, d), forest(spark, d), 1.2).drop("ts")
    return rounded(big(r, "idx"), "value", "mean", "std", "z", "ml_score")


@query("E7_consecutive_runs", "SELECT series, event_name, idx FROM (" + keep_runs_sql("eseven") + ")")
def e7(spark, d):
    odd = points(spark, d).where(c("value") < c("mean"))
    return big(Q.keep_runs(odd.select(*KEY, "idx"), KEY), "idx")


add_view("eseven", "SELECT series, event_name, idx FROM npts WHERE value < mean")


@query(
    "E7_run_windows",
    """SELECT series, event_name, "first", "last", points FROM (SELECT series, event_name, min(idx) AS "first", max(idx) AS "last", count(*) AS points FROM (
         SELECT *, idx - row_number() OVER (PARTITION BY series, event_name ORDER BY idx) AS run FROM eseven) GROUP BY series, event_name, run) WHERE points >= 4""",
)
def e7b(spark, d):
    odd = points(spark, d).where(c("value") < c("mean"))
    return big(Q.run_windows(odd, KEY), "first", "last")


add_view(
    "sess",
    """SELECT user_id, sid, min(s) AS a, max(s) AS b, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, seq ROWS UNBOUNDED PRECEDING) AS sid FROM (
    SELECT user_id, s, seq, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, seq) <= 7200 THEN 0 ELSE 1 END AS fresh FROM updates))
GROUP BY 1, 2 HAVING count(*) >= 3""",
)


@query(
    "E8_gap_sessions",
    f"SELECT user_id, strftime(make_timestamp(a * 1000000), {FMT}) AS start_time, strftime(make_timestamp(b * 1000000), {FMT}) AS end_time, n FROM sess",
)
def e8(spark, d):
    s = Q.sessions(A.updates(spark, d), ["user_id"], 7200)
    return s.select("user_id", T.text(c("start")).alias("start_time"), T.text(c("end")).alias("end_time"), "n")


@query(
    "E8_widest_session",
    f"""SELECT user_id, strftime(make_timestamp(arg_max(a, (b - a, -a)) * 1000000) - INTERVAL 2 HOUR, {FMT}) AS start_time,
          strftime(make_timestamp(arg_max(b, (b - a, -a)) * 1000000) + INTERVAL 2 HOUR, {FMT}) AS end_time FROM sess GROUP BY 1""",
)
def e8b(spark, d):
    s = Q.widest_session(A.updates(spark, d), ["user_id"], max_gap=7200)
    return s.select("user_id", T.text(c("start")).alias("start_time"), T.text(c("end")).alias("end_time"))


add_view(
    "ma",
    """SELECT series, idx, value, m AS baseline, round((value - m) / greatest(sd, 0.05 * abs(m), 0.02), 9) AS z FROM (
  SELECT series, idx, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(*) OVER w AS n FROM traffic
  WINDOW w AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) WHERE n = 12""",
)


def whole(spark, d):
    return A.traffic(spark, d).select("series", "idx", "value")


@query(
    "E9_moving_average",
    "SELECT series, idx, round(baseline, 6) AS baseline, round(z, 6) AS z, CASE WHEN abs(z) > 3.0 THEN 'high' ELSE 'medium' END AS severity FROM ma WHERE abs(z) > 2.5",
)
def e9(spark, d):
    return rounded(TR.moving_average(whole(spark, d), ["series"]).select("series", "idx", "baseline", "z", "severity"), "baseline", "z")


# the smoothed value written out as a sum instead of a recurrence
add_view(
    "sm",
    """SELECT a.series, a.idx, max(a.value) AS value, sum(CASE WHEN b.idx = 0 THEN 1.0 ELSE 0.1 END * pow(0.9, a.idx - b.idx) * b.value) AS smoothed
FROM traffic a JOIN traffic b ON b.series = a.series AND b.idx <= a.idx GROUP BY 1, 2""",
)
add_view(
    "ew",
    """SELECT * FROM (SELECT series, idx, value, smoothed, residual, avg(residual) OVER w AS m, stddev_pop(residual) OVER w AS sd FROM (
  SELECT *, abs(value - smoothed) AS residual FROM sm WHERE idx > 0) WINDOW w AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
WHERE idx >= 10 AND round(residual - m - 2.5 * sd, 9) > 0""",
)


@query("E10_ewma_smoothing", "SELECT series, idx, round(smoothed, 6) AS smoothed FROM sm")
def e10s(spark, d):
    return rounded(TR.smooth(whole(spark, d), ["series"], block=100).select("series", "idx", "smoothed"), "smoothed")


@query("E10_ewma_band", "SELECT series, idx, round(smoothed, 6) AS baseline, round(residual, 6) AS residual FROM ew")
def e10(spark, d):
    return rounded(TR.ewma(whole(spark, d), ["series"]).select("series", "idx", "baseline", "residual"), "baseline", "residual")


@query(
    "C13_detector_agreement",
    """SELECT coalesce(m.series, e.series) AS series, coalesce(m.idx, e.idx) AS idx, CASE WHEN e.idx IS NULL THEN 'average only' WHEN m.idx IS NULL THEN 'smoothed only' ELSE 'both' END AS found
       FROM (SELECT * FROM ma WHERE abs(z) > 2.5) m FULL JOIN ew e ON e.series = m.series AND e.idx = m.idx""",
)
def c13(spark, d):
    a = TR.moving_average(whole(spark, d), ["series"]).select("series", "idx")
    b = TR.ewma(whole(spark, d), ["series"]).select("series", "idx")
    key = ["series", "idx"]
    return (
        a.join(b, key, "left_semi").withColumn("found", F.lit("both"))
        .unionByName(a.join(b, key, "left_anti").withColumn("found", F.lit("average only")))
        .unionByName(b.join(a, key, "left_anti").withColumn("found", F.lit("smoothed only")))
    )


add_view(
    "ewmild",
    """SELECT * FROM (SELECT series, idx, residual, avg(residual) OVER w AS m, stddev_pop(residual) OVER w AS sd FROM (
  SELECT *, abs(value - smoothed) AS residual FROM sm WHERE idx > 0) WINDOW w AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
WHERE idx >= 10 AND round(residual - m - 0.2 * sd, 9) > 0""",
)
add_view("npboth", "SELECT m.series, m.idx, m.z, e.residual FROM ma m JOIN ewmild e ON e.series = m.series AND e.idx = m.idx WHERE abs(m.z) > 0.2")


@query("F16_non_periodic", "SELECT series, idx, round(z, 6) AS z, round(residual, 6) AS residual FROM (" + keep_runs_sql("npboth", "series") + ")")
def f16(spark, d):
    r = TR.non_periodic(whole(spark, d), ["series"], 0.2).select("series", "idx", "z", "residual")
    return rounded(r, "z", "residual")


add_view(
    "roles",
    """SELECT p.*, k.event_type, CASE p.series WHEN 'click' THEN 'victim' WHEN 'view' THEN 'hijacker' WHEN 'purchase' THEN 'transit' WHEN 'signup' THEN 'destination' ELSE 'source' END AS as_role
FROM npts p JOIN catalogue k ON k.event_name = p.event_name""",
)
add_view(
    "ruled",
    """SELECT *, round((value - mean) / (mean + 1e-10), 9) AS change, round(abs((value - mean) / (eff + 1e-10)), 9) AS z,
  CASE WHEN event_type = 'outage' THEN 'drop_to_zero' WHEN event_type = 'hijack' AND as_role = 'victim' THEN 'decrease' WHEN event_type = 'hijack' AND as_role = 'hijacker' THEN 'increase'
       WHEN event_type = 'leak' AND as_role = 'transit' THEN 'increase' WHEN event_type = 'leak' AND as_role = 'destination' THEN 'decrease' ELSE 'any' END AS direction,
  CASE WHEN event_type = 'outage' THEN -0.8 WHEN event_type = 'hijack' AND as_role = 'victim' THEN -0.2 WHEN event_type = 'hijack' AND as_role = 'hijacker' THEN 0.2
       WHEN event_type = 'leak' AND as_role IN ('source', 'origin') THEN 0.25 WHEN event_type = 'leak' AND as_role = 'destination' THEN -0.2 ELSE 0.3 END AS lim,
  CASE WHEN event_type = 'outage' THEN 2.0 WHEN event_type = 'hijack' AND as_role IN ('victim', 'hijacker') THEN 2.5
       WHEN event_type = 'leak' AND as_role IN ('source', 'origin', 'transit', 'destination') THEN 2.5 ELSE 3.0 END AS zlim FROM roles""",
)
add_view(
    "rolehit",
    """SELECT *, CASE WHEN z > 3 OR abs(change) > 0.5 THEN 'high' ELSE 'medium' END AS severity FROM ruled
WHERE z > zlim OR CASE WHEN direction IN ('decrease', 'drop_to_zero') THEN change < lim WHEN direction = 'increase' THEN change > lim ELSE abs(change) > lim END""",
)
add_view("rolerun", keep_runs_sql("rolehit"))


def role_points(spark, d):
    role = (
        F.when(c("series") == "click", "victim").when(c("series") == "view", "hijacker").when(c("series") == "purchase", "transit")
        .when(c("series") == "signup", "destination").otherwise("source")
    )
    kinds = windows(spark, d).select("event_name", "event_type")
    return points(spark, d).join(kinds, "event_name").withColumn("as_role", role)


@query(
    "F17_role_aware",
    "SELECT series, event_name, idx, as_role, direction, round(change, 6) AS change, round(z, 6) AS z, severity FROM rolerun",
)
def f17(spark, d):
    r = TR.role_anomalies(role_points(spark, d)).select(*KEY, "idx", "as_role", "direction", "change", "z", "severity")
    return rounded(big(r, "idx"), "change", "z")


@query(
    "F21_role_job",
    """SELECT series, event_name, idx, severity, 'role' AS found_by FROM rolerun
       UNION ALL SELECT series, event_name, idx, CASE WHEN stat_z > 5 THEN 'high' WHEN stat_z > 3 THEN 'medium' WHEN stat_z IS NOT NULL THEN 'low' WHEN low THEN 'high' ELSE drop_sev END, 'combined'
       FROM ncomb x WHERE NOT EXISTS (SELECT 1 FROM rolerun r WHERE r.series = x.series AND r.event_name = x.event_name)""",
)
def f21(spark, d):
    return big(jobs.role_job(role_points(spark, d), 1.2), "idx")


@query(
    "E14_boundary_expansion",
    """SELECT x.series, x.event_name, x.f AS first_idx, x.l AS last_idx, strftime(a.ts, '%Y-%m-%d %H:%M:%S') AS start_time, strftime(b.ts, '%Y-%m-%d %H:%M:%S') AS end_time FROM (
         SELECT p.series, p.event_name, coalesce(max(p.idx) FILTER (p.idx <= s.a AND abs(p.value - p.mean) <= 2 * p.std), 0) AS f,
                coalesce(min(p.idx) FILTER (p.idx >= s.b AND abs(p.value - p.mean) <= 2 * p.std), max(s.lst)) AS l
         FROM npts p JOIN (SELECT n.series, n.event_name, greatest(0, min(n.idx) - 8) AS a, least(max(z.lst), max(n.idx) + 8) AS b, max(z.lst) AS lst
                           FROM ncomb n JOIN (SELECT series, event_name, max(idx) AS lst FROM npts GROUP BY 1, 2) z ON z.series = n.series AND z.event_name = n.event_name GROUP BY 1, 2) s
           ON s.series = p.series AND s.event_name = p.event_name GROUP BY 1, 2) x
       JOIN npts a ON a.series = x.series AND a.event_name = x.event_name AND a.idx = x.f JOIN npts b ON b.series = x.series AND b.event_name = x.event_name AND b.idx = x.l""",
)
def e14(spark, d):
    p = points(spark, d)
    r = TR.expand_boundaries(TR.combined(p, None, 1.2), p)
    return big(r.select(*KEY, "first_idx", "last_idx", T.text(c("start")).alias("start_time"), T.text(c("end")).alias("end_time")), "first_idx", "last_idx")


@query(
    "E15_baseline_periods",
    f"""SELECT event_name, CAST(p.i AS BIGINT) AS period, strftime(k."start" - p.i * INTERVAL 6 HOUR, {FMT}) AS lo, strftime(k."end" - p.i * INTERVAL 6 HOUR, {FMT}) AS hi,
          (SELECT count(*) FROM updates u WHERE u.ts >= k."start" - p.i * INTERVAL 6 HOUR AND u.ts < k."end" - p.i * INTERVAL 6 HOUR) AS n
        FROM catalogue k, (SELECT unnest(range(1, 5)) AS i) p""",
)
def e15(spark, d):
    from routescope.operators.intervals import in_windows

    p = B.baseline_periods(windows(spark, d), "6h").select("event_name", "period", "lo", "hi")
    n = in_windows(A.updates(spark, d), p, start="lo", end="hi", closed=False).groupBy("event_name", "period").agg(F.count("*").alias("n"))
    r = p.join(n, ["event_name", "period"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return big(r.withColumns({k: T.text(c(k)) for k in ("lo", "hi")}), "period")


@query(
    "E16_inside_event",
    """SELECT x.series, x.event_name, x.idx FROM wcomb x JOIN wcur p ON p.series = x.series AND p.event_name = x.event_name AND p.idx = x.idx
       JOIN catalogue k ON k.event_name = x.event_name WHERE p.ts BETWEEN k."start" AND k."end\"""",
)
def e16(spark, d):
    t, w = A.traffic(spark, d), jobs.widened(windows(spark, d))
    p = TR.align_by_position(TR.current_points(t, w), TR.history(t, w, DAY, 7))
    found = TR.combined(p).join(windows(spark, d), "event_name")
    return big(Q.inside(found, c("start"), c("end")).select(*KEY, "idx"), "idx")


combined_views("w", 3.0)


@query(
    "E13_longest_run",
    """SELECT series, event_name, idx AS "first", n AS points FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY n DESC, event_name, idx) AS r FROM (
         SELECT series, event_name, min(idx) AS idx, count(*) AS n FROM (SELECT *, idx - row_number() OVER (PARTITION BY series, event_name ORDER BY idx) AS run FROM eseven)
         GROUP BY series, event_name, run HAVING count(*) >= 4)) WHERE r = 1""",
)
def e13(spark, d):
    w = Q.run_windows(points(spark, d).where(c("value") < c("mean")), KEY).withColumn("neg", -c("points"))
    return big(reports.first_rows(w, ["series"], ["neg", "event_name", "first"], 1).select(*KEY, "first", "points"), "first")


@query(
    "E13_first_window",
    """SELECT series, min(("event_name", "first"))[1] AS event_name FROM (SELECT series, event_name, min(idx) AS "first" FROM (
         SELECT *, idx - row_number() OVER (PARTITION BY series, event_name ORDER BY idx) AS run FROM eseven) GROUP BY series, event_name, run HAVING count(*) >= 4) GROUP BY series""",
)
def e13b(spark, d):
    w = Q.run_windows(points(spark, d).where(c("value") < c("mean")), KEY)
    return Q.first_window(w, KEY).groupBy("series").agg(F.min("event_name").alias("event_name"))


@query(
    "F18_period_detection",
    """WITH p0 AS (SELECT series, value, row_number() OVER (PARTITION BY series ORDER BY ts, value) - 1 AS p FROM traffic WHERE value IS NOT NULL AND NOT isnan(value)),
      sz AS (SELECT series, count(*) AS n, avg(value) AS m, coalesce(regr_slope(value, p), 0) AS slope, avg(p) AS mp FROM p0 GROUP BY 1),
      pts AS (SELECT series, p, n, value, value - m AS d, value - m - slope * (p - mp) AS r FROM p0 JOIN sz USING (series) WHERE n >= 24),
      asked AS (SELECT series, 'weekly' AS name, cycle, lag FROM sz, range(1, 4) a(cycle), range(0, 529) b(lag) WHERE n >= 24 AND lag < n AND lag BETWEEN 168 * cycle - 12 AND 168 * cycle + 11
        UNION ALL SELECT series, 'daily', cycle, lag FROM sz, range(1, 28) a(cycle), range(0, 529) b(lag) WHERE n >= 24 AND lag < n AND lag BETWEEN 24 * cycle - 6 AND 24 * cycle + 5 AND cycle < least(n, 529) // 24),
      acf AS (SELECT a.series, l.lag, sum(a.d * b.d) / any_value(v.v) AS acf FROM (SELECT DISTINCT series, lag FROM asked) l JOIN pts a ON a.series = l.series JOIN pts b ON b.series = a.series AND b.p = a.p + l.lag
        JOIN (SELECT series, sum(d * d) AS v FROM pts GROUP BY 1) v ON v.series = a.series AND v.v > 0 GROUP BY 1, 2),
      tops AS (SELECT series, name, cycle, round(max(acf), 9) AS top FROM asked JOIN acf USING (series, lag) GROUP BY 1, 2, 3),
      peak AS (SELECT series, name, round(avg(top), 9) AS score, 'acf_' || name || '_' || count(*) || 'peaks' AS method, CASE name WHEN 'weekly' THEN 1 ELSE 2 END AS place FROM tops
        WHERE top > CASE name WHEN 'weekly' THEN 0.08 ELSE 0.12 END GROUP BY 1, 2 HAVING round(avg(top), 9) > CASE name WHEN 'weekly' THEN 0.10 ELSE 0.15 END),
      spec AS (SELECT series, n, k, round(sqrt(pow(sum(r * cos(2 * pi() * ((k * p) % n) / n)), 2) + pow(sum(r * sin(2 * pi() * ((k * p) % n) / n)), 2)), 9) AS power
        FROM pts JOIN range(1, (SELECT max(n) // 2 + 1 FROM pts)) f(k) ON k <= n // 2 GROUP BY 1, 2, 3),
      freq AS (SELECT s.series, round_even(s.n / s.k, 0) AS size, round(s.power / m.most, 9) AS score FROM spec s JOIN (SELECT series, max(power) AS most FROM spec GROUP BY 1) m ON m.series = s.series AND most > 0
        WHERE s.k < s.n // 2 QUALIFY row_number() OVER (PARTITION BY s.series ORDER BY s.power DESC, s.k) = 1),
      freq2 AS (SELECT series, CASE WHEN abs(size - 24) < 24 * 0.4 THEN 'daily' WHEN abs(size - 168) < 168 * 0.4 THEN 'weekly' END AS name, score FROM freq WHERE score > 0.03),
      rest AS (SELECT series, p % 6 AS phase, value - ma AS x FROM (SELECT *, (sum(value) OVER w5 + (lag(value, 3) OVER o + lead(value, 3) OVER o) / 2) / 6 AS ma FROM pts WHERE n >= 168
        WINDOW o AS (PARTITION BY series ORDER BY p), w5 AS (PARTITION BY series ORDER BY p ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) WHERE ma IS NOT NULL),
      stl AS (SELECT series, round(var_pop(m) / var_pop(x), 9) AS score FROM (SELECT *, avg(x) OVER (PARTITION BY series, phase) AS m FROM rest) GROUP BY 1 HAVING var_pop(x) > 0),
      ev AS (SELECT series, name, score, method, place FROM peak UNION ALL SELECT series, name, score, 'fft_' || name, 3 FROM freq2 WHERE name IS NOT NULL
        UNION ALL SELECT series, 'daily', score, 'stl_daily', 4 FROM stl WHERE score > 0.12),
      best AS (SELECT *, avg(score) OVER (PARTITION BY series, name) AS c FROM ev QUALIFY row_number() OVER (PARTITION BY series ORDER BY score DESC, place) = 1)
    SELECT sz.series, coalesce(name, 'none') AS period_name, round(coalesce(c, 0), 6) AS confidence, coalesce(method, CASE WHEN n >= 24 THEN 'no_clear_period' ELSE 'insufficient_data' END) AS method,
      name IS NOT NULL AND c < 0.25 AS best_effort FROM sz LEFT JOIN best ON best.series = sz.series""",
)
def f18(spark, d):
    # 24 points a day: the supplied events are too few for 15-minute points
    return rounded(periods.detect_periods(A.traffic(spark, d), ["series"], 24, 168), "confidence")


def weekback(p: int) -> str:
    return f"""SELECT t.series, k.event_name, {p} AS period, avg(t.value) AS m, stddev_pop(t.value) AS sd, count(*) AS n FROM traffic t JOIN catalogue k
ON t.ts BETWEEN k."start" - INTERVAL {7 * p} DAY AND k."end" - INTERVAL {7 * p} DAY GROUP BY 1, 2 HAVING count(*) >= 5"""


@query(
    "F19_quick_screening",
    f"""SELECT series, event_name, round(score, 6)::DOUBLE AS quick_score, array_to_string(sig, ',') AS signals, round(score, 9) >= 0.5 OR (round(score, 9) >= 0.2 AND len(sig) > 0) AS need_full_analysis FROM (
      SELECT series, event_name, least(1.0, CASE WHEN ch > 50 THEN 0.4 WHEN ch > 30 THEN 0.25 WHEN ch > 15 THEN 0.1 ELSE 0 END + CASE WHEN wild THEN 0.2 ELSE 0 END + CASE WHEN sparse THEN 0.15 ELSE 0 END) AS score,
        list_filter([CASE WHEN ch > 50 THEN 'large_change' WHEN ch > 30 THEN 'medium_change' WHEN ch > 15 THEN 'small_change' END, CASE WHEN wild THEN 'volatile' END, CASE WHEN sparse THEN 'sparse' END], lambda x: x IS NOT NULL) AS sig
      FROM (SELECT x.series, x.event_name, CASE WHEN x.m > 0 AND r.m > 0 THEN abs(x.m - r.m) / r.m * 100 END AS ch, coalesce(r.m > 0 AND x.sd / r.m > 2, false) AS wild,
              x.n < 0.5 * ((epoch_us(k."end") - epoch_us(k."start")) // (SELECT mode(gap) FROM (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY series ORDER BY ts) AS gap FROM traffic)) + 1) AS sparse
            FROM (SELECT series, event_name, avg(value) AS m, stddev_pop(value) AS sd, count(*) AS n FROM ncur GROUP BY 1, 2) x JOIN catalogue k ON k.event_name = x.event_name
            LEFT JOIN (SELECT series, event_name, arg_min(m, period) AS m FROM ({weekback(1)} UNION ALL {weekback(2)}) GROUP BY 1, 2) r ON r.series = x.series AND r.event_name = x.event_name))""",
)
def f19(spark, d):
    r = TR.quick_screening(A.traffic(spark, d), windows(spark, d), step=3600)  # the series are hourly
    return rounded(r.select(*KEY, "quick_score", F.array_join("signals", ",").alias("signals"), "need_full_analysis"), "quick_score")


@query(
    "F20_traffic_job_daily",
    """SELECT s.series, s.event_name, s.n AS data_points, round(s.a, 6) AS current_avg, round(s.h, 6) AS historical_avg, round(CASE WHEN s.h > 0 THEN (s.a - s.h) / s.h * 100 ELSE 0 END, 6) AS percent_change,
         coalesce(f.n, 0) AS anomaly_count, coalesce(f.n, 0) > 0 AS anomalies_detected, coalesce(r.n, 0) AS windows
       FROM (SELECT series, event_name, avg(value) AS a, avg(mean) AS h, count(*) AS n FROM wpts GROUP BY 1, 2) s
       LEFT JOIN (SELECT series, event_name, count(*) AS n FROM wcomb GROUP BY 1, 2) f ON f.series = s.series AND f.event_name = s.event_name
       LEFT JOIN (SELECT series, event_name, count(DISTINCT run) AS n FROM (SELECT *, idx - row_number() OVER (PARTITION BY series, event_name ORDER BY idx) AS run FROM wcomb) GROUP BY 1, 2) r
         ON r.series = s.series AND r.event_name = s.event_name""",
)
def f20(spark, d):
    t = A.traffic(spark, d)
    daily = t.select("series").distinct().withColumn("period_name", F.lit("daily"))
    r = jobs.traffic_job(t, windows(spark, d), daily, forest=False)
    r = r.select(*KEY, "data_points", "current_avg", "historical_avg", "percent_change", "anomaly_count", "anomalies_detected", "windows")
    return rounded(r, "current_avg", "historical_avg", "percent_change")


@query("F20_traffic_job")
def f20b(spark, d):
    t = A.traffic(spark, d)
    named = periods.detect_periods(t, ["series"], 24, 168).select("series", "period_name")
    r = jobs.traffic_job(t, windows(spark, d), named)
    return rounded(r.drop("anomaly_start", "anomaly_end"), "current_avg", "historical_avg", "percent_change")


# ---------------------------------------------------------------- at the default thresholds
@query(
    "F12_traffic_statistical_default",
    """SELECT series, event_name, idx, round(z, 6) AS z, CASE WHEN z > 5 THEN 'high' WHEN z > 3 THEN 'medium' ELSE 'low' END AS severity FROM (
         SELECT *, round(abs(value - mean) / eff, 9) AS z FROM npts WHERE round(abs(value - mean) / eff, 9) > 3.0)""",
)
def f12_default(spark, d):
    return rounded(big(TR.statistical(points(spark, d)).select(*KEY, "idx", "z", "severity"), "idx"), "z")


combined_views("n", 2.5, "role")


@query("F21_role_job_default", re.sub(r"\bncomb\b", "rolecomb", SQL_OF["F21_role_job"]))
def f21_default(spark, d):
    return big(jobs.role_job(role_points(spark, d)), "idx")

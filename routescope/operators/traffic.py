"""Anomalies of per-AS traffic series.

A series has one row per (series, step). Every grouping by series below is therefore
bounded by the time covered, never by the number of flows or events behind it.
Windows of interest come as a table (event_name, start, end) shared by all series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routescope.functions import scores as S
from routescope.functions import times as T
from routescope.operators import sequences as Q
from routescope.operators.intervals import in_windows

KEY = ["series", "event_name"]

# Fixed values of the traffic rules (values are shares of the series' top).
NEAR_ZERO = 0.03
OUTAGE_BASELINE = 0.04
DROP_BASELINE = 0.05
DROP_FROM = 0.10
DROP_RUN = 3
RUN = 4

# What each role in each event is expected to show.
# (event_type, as_role, direction, change threshold, z threshold)
ROLE_RULES = (
    ("hijack", "victim", "decrease", -0.20, 2.5),
    ("hijack", "hijacker", "increase", 0.20, 2.5),
    ("leak", "source", "any", 0.25, 2.5),
    ("leak", "origin", "any", 0.25, 2.5),
    ("leak", "transit", "increase", 0.30, 2.5),
    ("leak", "destination", "decrease", -0.20, 2.5),
)
OUTAGE_RULE = ("drop_to_zero", -0.80, 2.0)
OTHER_RULE = ("any", 0.30, 3.0)


def fetch(traffic: DataFrame, series: str, start: str, end: str) -> DataFrame:
    """One series in a closed time window."""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return traffic.where((F.col("series") == series) & F.col("ts").between(lo, hi)).select("series", "ts", "value")


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("ts")
    return rows.withColumn("idx", F.row_number().over(w) - 1)


def current_points(traffic: DataFrame, windows: DataFrame) -> DataFrame:
    """(series, event_name, idx, ts, value): points of every series in every window."""
    rows = in_windows(traffic.select("series", "ts", "value"), windows.select("event_name", "start", "end"))
    return _numbered(rows.select(*KEY, "ts", "value"), KEY)


def shifted_windows(windows: DataFrame, gap: int, n: int) -> DataFrame:
    """Each window moved back by 1..n periods of ``gap`` seconds."""
    back = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("period") * gap).cast("decimal(18,6)"))
    return windows.select("event_name", "start", "end", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("period")).withColumns(
        {"start": F.col("start") - back, "end": F.col("end") - back}
    )


def history(traffic: DataFrame, windows: DataFrame, gap: int, n: int) -> DataFrame:
    """(series, event_name, period, idx, ts, value): the same window in earlier periods."""
    rows = in_windows(traffic.select("series", "ts", "value"), shifted_windows(windows, gap, n))
    keys = [*KEY, "period"]
    return _numbered(rows.select(*keys, "ts", "value"), keys)


def align_by_position(current: DataFrame, past: DataFrame) -> DataFrame:
    """Current points with mean and deviation of the points at the same position.

    All lists are cut to the shortest of them.
    """
    lengths = past.groupBy(*KEY, "period").agg(F.count("*").alias("n")).groupBy(*KEY).agg(F.min("n").alias("shortest"))
    stats = past.groupBy(*KEY, "idx").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return current.join(lengths, KEY).where(F.col("idx") < F.col("shortest")).join(stats, [*KEY, "idx"]).drop("shortest")


def align_by_time(current: DataFrame, past: DataFrame, gap: int) -> DataFrame:
    """Current points with statistics of the points whole periods earlier.

    Missing points take the period's last known value, else its next.
    """
    periods = past.select(*KEY, "period").distinct()
    moved = past.select(*KEY, "period", (T.seconds(F.col("ts")) + F.col("period") * gap).alias("t"), F.col("value").alias("old"))
    grid = current.withColumn("t", T.seconds(F.col("ts"))).join(periods, KEY)
    joined = grid.join(moved, [*KEY, "period", "t"], "left")
    w = Window.partitionBy(*KEY, "period").orderBy("t")
    back = F.last("old", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("old", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    filled = joined.withColumn("old", F.coalesce(back, ahead))
    return filled.groupBy(*KEY, "idx", "ts", "value").agg(
        F.avg("old").alias("mean"), F.stddev_pop("old").alias("std")
    )


def _effective(points: DataFrame) -> DataFrame:
    return points.withColumn("eff", S.guarded_std(F.col("mean"), F.col("std")))


def statistical(points: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Points farther than ``threshold`` guarded deviations from the mean."""
    off = F.round(F.abs(F.col("value") - F.col("mean")) / F.col("eff"), 9)
    return _effective(points).withColumn("z", off).where(F.col("z") > threshold).drop("eff").withColumn(
        "severity", S.z_severity(F.col("z"))
    )


def sustained_outage(points: DataFrame) -> DataFrame:
    """Points near zero where history had traffic."""
    off = F.abs(F.col("value") - F.col("mean")) / F.col("eff")
    hit = (F.col("mean") >= OUTAGE_BASELINE) & (F.col("value") <= NEAR_ZERO)
    return _effective(points.where(hit)).withColumn("z", off).drop("eff").withColumn("severity", F.lit("high"))


def _with_drops(points: DataFrame) -> DataFrame:
    """Adds ``sudden_drop`` and the bounds and severity of the stretch a point lies in.

    A stretch is a maximal run near zero; it counts when the point before it had traffic,
    history had some where it began, and it has ``DROP_RUN`` points or more.
    """
    order = Window.partitionBy(*KEY).orderBy("idx")
    stretch = Window.partitionBy(*KEY, "_low", "_run")
    low = F.when(F.col("value") < NEAR_ZERO, 1).otherwise(0)
    marked = points.withColumns({"_prev": F.lag("value").over(order), "_low": low}).withColumn(
        "_run", F.when(F.col("_low") == 1, F.col("idx") - F.sum("_low").over(order)).otherwise(F.col("idx"))
    )
    marked = marked.withColumns(
        {
            "drop_start": F.min("idx").over(stretch),
            "drop_end": F.max("idx").over(stretch),
            "drop_points": F.count("*").over(stretch),
            "_first": F.min(F.struct("idx", "_prev", "value", "mean")).over(stretch),
        }
    )
    first = F.col("_first")
    hit = (
        (F.col("_low") == 1) & (first["_prev"] >= DROP_FROM) & (first["mean"] >= DROP_BASELINE)
        & (F.col("drop_points") >= DROP_RUN)
    )
    severity = F.when(F.try_divide(first["value"], first["_prev"]) < 0.01, "critical").otherwise("high")
    return marked.withColumns(
        {"sudden_drop": F.coalesce(hit, F.lit(False)), "drop_severity": severity}
    ).drop("_prev", "_low", "_run", "_first")


def sudden_drop(points: DataFrame) -> DataFrame:
    """Stretches near zero right after normal traffic; each point carries its stretch."""
    return _with_drops(points).where("sudden_drop").select(
        *KEY, "idx", "ts", "value", "drop_start", "drop_end", F.col("drop_points").alias("points"),
        F.col("drop_severity").alias("severity"),
    )


def combined(points: DataFrame, forest: DataFrame | None = None, threshold: float = 3.0) -> DataFrame:
    """Statistical, near-zero and sudden-drop points together, in runs of four.

    The three tests are columns of one pass over the series. ``forest`` (outlier points)
    only raises the confidence of statistical hits.
    """
    z = F.round(F.abs(F.col("value") - F.col("mean")) / F.col("eff"), 9)
    rows = _effective(_with_drops(points)).withColumn("z", z)
    if forest is None:
        rows = rows.withColumn("ml_score", F.lit(None).cast("double"))
    else:
        rows = rows.join(forest.select(*KEY, "idx", "ml_score"), [*KEY, "idx"], "left")
    stat, ml = F.col("z") > threshold, F.col("ml_score").isNotNull()
    low = (F.col("mean") >= OUTAGE_BASELINE) & (F.col("value") <= NEAR_ZERO)
    labelled = rows.where(stat | low | F.col("sudden_drop")).select(
        *KEY, "idx", "ts", "value", "mean", "std",
        F.when(stat, "combined").when(low, "sustained_outage").otherwise("sudden_drop_to_zero").alias("method"),
        F.when(stat & ~ml, "medium").otherwise("high").alias("confidence"),
        F.when(stat & ml, "high").when(stat, S.z_severity(F.col("z"))).when(low, "high")
        .otherwise(F.col("drop_severity")).alias("severity"),
        "z", low.alias("sustained_outage"), "sudden_drop", "ml_score",
    )
    return Q.keep_runs(labelled, KEY, shortest=RUN)


def moving_average(points: DataFrame, keys: list[str], threshold: float = 2.5, width: int = 12) -> DataFrame:
    """Points far from the mean of the ``width`` points before them."""
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(-width, -1)
    near = points.withColumns(
        {"baseline": F.avg("value").over(w), "sd": F.stddev_pop("value").over(w), "seen": F.count("value").over(w)}
    ).where(F.col("seen") == width)
    eff = F.greatest(F.col("sd"), 0.05 * F.abs("baseline"), F.lit(0.02))
    z = F.round((F.col("value") - F.col("baseline")) / eff, 9)
    return near.withColumn("z", z).where(F.abs("z") > threshold).drop("sd", "seen").withColumn(
        "severity", F.when(F.abs("z") > 3.0, "high").otherwise("medium")
    )


def smooth(points: DataFrame, keys: list[str], alpha: float = 0.1, block: int = 256) -> DataFrame:
    """Adds ``smoothed``, the exponentially weighted average started at the first value.

    The recurrence is linear, so it is folded inside blocks of ``block`` points as if it
    started from zero, one row per block is folded into the value each block starts
    from, and that start is added with its decay. No row holds more than a block, or one
    entry per block of a series.
    """
    keep = 1.0 - alpha
    cut = points.withColumn("_b", F.expr(f"idx div {block}"))
    listed = F.array_sort(F.collect_list(F.struct("idx", "value")))
    folded = cut.groupBy(*keys, "_b").agg(listed.alias("pts")).withColumn(
        "loc",
        F.aggregate(
            "pts",
            F.array().cast("array<double>"),
            lambda acc, p: F.array_append(
                acc, alpha * p["value"] + keep * F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0))
            ),
        ),
    )
    summary = folded.select(
        *keys, "_b", F.element_at("loc", -1).alias("end"), F.pow(F.lit(keep), F.size("loc")).alias("fade"),
        F.when(F.col("_b") == 0, F.get("pts", F.lit(0))["value"]).alias("x0"),
    )
    order = F.array_sort(F.collect_list(F.struct("_b", "end", "fade")))
    whole = summary.groupBy(*keys).agg(order.alias("blocks"), F.max("x0").alias("x0"))
    starts = F.aggregate(
        "blocks",
        F.array("x0"),
        lambda acc, s: F.array_append(acc, s["end"] + s["fade"] * F.element_at(acc, -1)),
    )
    carried = whole.select(*keys, F.explode(F.arrays_zip(F.transform("blocks", lambda s: s["_b"]).alias("_b"), starts.alias("c"))).alias("z"))
    carried = carried.select(*keys, F.col("z._b").alias("_b"), F.col("z.c").alias("c")).where("_b IS NOT NULL")
    rows = folded.select(*keys, "_b", F.posexplode(F.arrays_zip("pts", "loc")).alias("k", "z"))
    return rows.join(carried, [*keys, "_b"]).select(
        *keys, F.col("z.pts.idx").alias("idx"), F.col("z.pts.value").alias("value"),
        (F.col("z.loc") + F.pow(F.lit(keep), F.col("k") + 1) * F.col("c")).alias("smoothed"),
    )


def ewma(points: DataFrame, keys: list[str], alpha: float = 0.1, multiplier: float = 2.5) -> DataFrame:
    """Points whose distance to the smoothed value leaves the band of the last 20 distances."""
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(-19, 0)
    rows = smooth(points, keys, alpha).where("idx > 0").withColumn(
        "residual", F.abs(F.col("value") - F.col("smoothed"))
    )
    seen = Window.partitionBy(*keys).orderBy("idx")
    band = rows.withColumns(
        {"m": F.avg("residual").over(w), "sd": F.stddev_pop("residual").over(w), "n": F.row_number().over(seen)}
    )
    over = F.round(F.col("residual") - F.col("m") - multiplier * F.col("sd"), 9) > 0
    return band.where((F.col("n") >= 10) & over).select(
        *keys, "idx", "value", F.col("smoothed").alias("baseline"), "residual",
        F.when(F.col("residual") > F.col("m") + 3 * F.col("sd"), "high").otherwise("medium").alias("severity"),
    )


def non_periodic(points: DataFrame, keys: list[str], threshold: float = 2.5) -> DataFrame:
    """Points both detectors without history agree on, in runs of four."""
    a = moving_average(points, keys, threshold).select(*keys, "idx", "value", "baseline", "z")
    b = ewma(points, keys, multiplier=threshold).select(*keys, "idx", "residual")
    both = a.join(b, [*keys, "idx"]).withColumns(
        {"confidence": F.lit("high"), "severity": F.when(F.col("z") > 3.0, "high").otherwise("medium")}
    )
    return Q.keep_runs(both, keys, shortest=RUN)


def role_rules(points: DataFrame) -> DataFrame:
    """Adds direction, change_limit and z_limit from event_type and as_role."""
    kind, role = F.col("event_type"), F.col("as_role")

    def pick(i: int) -> Column:
        out = None
        for event, who, *rest in ROLE_RULES:
            cond = (kind == event) & (role == who)
            out = F.when(cond, rest[i]) if out is None else out.when(cond, rest[i])
        return out.when(kind == "outage", OUTAGE_RULE[i]).otherwise(OTHER_RULE[i])

    return points.withColumns({"direction": pick(0), "change_limit": pick(1), "z_limit": pick(2)})


def role_anomalies(points: DataFrame) -> DataFrame:
    """Points that move the way the AS's part in the event predicts, in runs of four.

    ``points`` need event_type and as_role.
    """
    d, limit = F.col("direction"), F.col("change_limit")
    change = F.round((F.col("value") - F.col("mean")) / (F.col("mean") + 1e-10), 9)
    z = F.round(F.abs((F.col("value") - F.col("mean")) / (F.col("eff") + 1e-10)), 9)
    moved = (
        F.when(d.isin("decrease", "drop_to_zero"), F.col("change") < limit)
        .when(d == "increase", F.col("change") > limit)
        .otherwise(F.abs("change") > limit)
    )
    scored = role_rules(_effective(points)).withColumns({"change": change, "z": z})
    hit = scored.where((F.col("z") > F.col("z_limit")) | moved).withColumn(
        "severity", F.when((F.col("z") > 3) | (F.abs("change") > 0.5), "high").otherwise("medium")
    )
    return Q.keep_runs(hit.drop("eff"), KEY, shortest=RUN)


def expand_boundaries(anomalies: DataFrame, points: DataFrame, margin: int = 8, widths: float = 2.0) -> DataFrame:
    """(series, event_name, start, end): ``margin`` points around the anomalies, then on
    while points stay ``widths`` deviations off."""
    ends = points.groupBy(*KEY).agg(F.max("idx").alias("last"))
    span = anomalies.groupBy(*KEY).agg(F.min("idx").alias("a"), F.max("idx").alias("b")).join(ends, KEY).select(
        *KEY, "last", F.greatest(F.lit(0), F.col("a") - margin).alias("a"),
        F.least(F.col("last"), F.col("b") + margin).alias("b"),
    )
    calm = F.abs(F.col("value") - F.col("mean")) <= widths * F.col("std")
    j = points.join(span, KEY)
    grown = j.groupBy(*KEY).agg(
        F.coalesce(F.max(F.when(calm & (F.col("idx") <= F.col("a")), F.col("idx"))), F.lit(0)).alias("first_idx"),
        F.coalesce(F.min(F.when(calm & (F.col("idx") >= F.col("b")), F.col("idx"))), F.max("last")).alias("last_idx"),
    )
    at = points.join(grown, KEY).where((F.col("idx") == F.col("first_idx")) | (F.col("idx") == F.col("last_idx")))
    return at.groupBy(*KEY).agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.min("ts").alias("start"), F.max("ts").alias("end")
    )


def statistics(points: DataFrame) -> DataFrame:
    """Mean now, mean of the historical means, change in percent, number of points."""
    g = points.groupBy(*KEY).agg(
        F.avg("value").alias("current_avg"), F.avg("mean").alias("historical_avg"), F.count("*").alias("data_points")
    )
    change = F.try_divide(F.col("current_avg") - F.col("historical_avg"), F.col("historical_avg")) * 100
    return g.withColumn("percent_change", F.when(F.col("historical_avg") > 0, change).otherwise(0.0))


def quick_screening(traffic: DataFrame, windows: DataFrame, step: int = 900) -> DataFrame:
    """Whether a window deserves the full analysis, from a look one (else two) weeks back.

    ``step`` is the spacing of points; fewer than half the expected ones count as sparse.
    """
    week = 7 * 86400

    def level(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"), F.count("value").alias("n")
        )

    now = level(current_points(traffic, windows), KEY)
    old = level(history(traffic, windows, week, 2), [*KEY, "period"]).where("n >= 5")
    ref = old.groupBy(*KEY).agg(F.min_by(F.struct("m", "sd"), "period").alias("p"))
    expected = windows.select(
        "event_name", (F.floor((T.seconds(F.col("end")) - T.seconds(F.col("start"))) / step) + 1).alias("expected")
    )
    j = now.join(expected, "event_name").join(ref, KEY, "left")
    change = F.when(F.col("m") > 0, F.try_divide(F.abs(F.col("m") - F.col("p.m")), F.col("p.m")) * 100)
    wild = F.coalesce(F.try_divide(F.col("sd"), F.col("p.m")) > 2, F.lit(False))
    sparse = F.col("n") < F.col("expected") * 0.5
    usable = F.col("n") >= 5
    points = (
        F.when(change > 50, 0.4).when(change > 30, 0.25).when(change > 15, 0.1).otherwise(0.0)
        + F.when(wild, 0.2).otherwise(0.0) + F.when(sparse, 0.15).otherwise(0.0)
    )
    signals = F.array_compact(
        F.array(
            F.when(change > 50, F.lit("large_change")).when(change > 30, "medium_change").when(change > 15, "small_change"),
            F.when(wild, F.lit("volatile")), F.when(sparse, F.lit("sparse")),
        )
    )
    none = F.array().cast("array<string>")
    return j.select(
        *KEY, usable.alias("data_available"),
        F.when(usable, F.least(F.lit(1.0), points)).otherwise(0.0).alias("quick_score"),
        F.when(usable, signals).otherwise(none).alias("signals"),
    ).withColumn(
        "need_full_analysis",
        (F.round("quick_score", 9) >= 0.5) | ((F.round("quick_score", 9) >= 0.2) & (F.size("signals") > 0)),
    )

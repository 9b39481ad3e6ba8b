"""Whether a traffic series repeats by day or by week.

Three kinds of evidence are made as rows and the strongest row decides: peaks of the
autocorrelation near whole days and weeks, the strongest frequency, and the share of the
variance that a seasonal mean explains. Series are cut in blocks of ``SIZE`` points, so lagged
products and frequencies are sums over blocks, spread over tasks also within one series. The
products cost a series' length times the lags looked at, the frequencies half its length squared.

Null and NaN values are left out; equal times of one series are ordered by value. A series
without a value at all has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE = 512

# Names, least scores and widths of the search, in points a week and a day.
LEAST_POINTS = 24
WEEKS, WEEK_PEAK, WEEK_MEAN, WEEK_SLACK = 3, 0.08, 0.10, (50, 672)
DAYS, DAY_PEAK, DAY_MEAN, DAY_SLACK = 27, 0.12, 0.15, (25, 96)
SPECTRUM_LEAST, SPECTRUM_NEAR = 0.03, 0.4
SEASON_POINTS, SEASON_LEAST = 24 * 7, 0.12
BEST_EFFORT = 0.25
NO_PERIOD, TOO_SHORT, UNCLEAR = "none", "insufficient_data", "no_clear_period"


def slack(points: int, fixed: tuple[int, int]) -> int:
    """How far from a whole cycle a peak may lie."""
    return max(1, points * fixed[0] // fixed[1])


def numbered(traffic: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, p, n, value, d, r): points by place, with the distance from mean (d) and from the line (r)."""
    known = traffic.where("value IS NOT NULL AND NOT isnan(value)").select(*keys, "ts", F.col("value").cast("double").alias("value"))
    placed = known.withColumn("p", F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "value")).cast("long") - 1)
    lines = placed.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("value").alias("_m"),
        F.coalesce(F.regr_slope("value", F.col("p").cast("double")), F.lit(0.0)).alias("_s"), F.avg("p").alias("_q"),
    )
    d = F.col("value") - F.col("_m")
    return placed.join(lines, keys).select(*keys, "p", "n", "value", d.alias("d"), (d - F.col("_s") * (F.col("p") - F.col("_q"))).alias("r"))


def blocks(points: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys…, n, b, xs): the values of ``column`` in order, ``SIZE`` a row."""
    rows = points.groupBy(*keys, "n", F.floor(F.col("p") / SIZE).alias("b")).agg(F.sort_array(F.collect_list(F.struct("p", column))).alias("xs"))
    return rows.withColumn("xs", F.transform("xs", lambda x: x[column]))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def autocorrelation(points: DataFrame, keys: list[str], lags: DataFrame) -> DataFrame:
    """(keys…, lag, acf) at every lag of ``lags`` (keys…, lag) below the series' length."""
    cut = blocks(points, keys, "d")
    asked = lags.where("lag >= 0").select(*keys, "lag").distinct()
    # blocks a lag's partners lie in: the one it falls on, and the next
    apart = asked.withColumn("q", F.explode(F.array(F.floor(F.col("lag") / SIZE), F.floor(F.col("lag") / SIZE) + 1)))
    apart = apart.groupBy(*keys, "q").agg(F.collect_list("lag").alias("lags"))
    left = cut.join(apart, keys).withColumn("b2", F.col("b") + F.col("q"))
    right = cut.select(*keys, F.col("b").alias("b2"), F.col("xs").alias("ys"))
    met = left.join(right, [*keys, "b2"]).select(*keys, "q", "xs", "ys", F.explode("lags").alias("lag"))
    shift = (F.col("lag") - F.col("q") * SIZE).cast("int")  # from a place here to its partner's place there
    start = F.greatest(F.lit(0), -shift)
    length = F.least(F.size("xs"), F.size("ys") - shift) - start
    met = met.withColumn("start", start).withColumn("length", length).withColumn("shift", shift).where("length > 0")
    part = _dot(F.slice("xs", F.col("start") + 1, F.col("length")), F.slice("ys", F.col("start") + F.col("shift") + 1, F.col("length")))
    sums = met.select(*keys, "lag", part.alias("s")).groupBy(*keys, "lag").agg(F.sum("s").alias("s"))
    whole = points.groupBy(*keys).agg(F.sum(F.col("d") * F.col("d")).alias("v"))
    return sums.join(whole, keys).select(*keys, "lag", F.when(F.col("v") > 0, F.col("s") / F.col("v")).otherwise(0.0).alias("acf"))


def _cycles(series: DataFrame, keys: list[str], name: str, points: int, most: int, wide: int, reach: int) -> DataFrame:
    """(keys…, name, cycle, lag) of every lag near a whole number of cycles."""
    last = F.least(F.col("n") - 1, F.lit(reach))  # the largest lag looked at
    cycle = F.explode(F.sequence(F.lit(1), F.lit(most))).alias("cycle")
    rows = series.select(*keys, last.cast("long").alias("last"), cycle)
    if name == "daily":
        rows = rows.where(f"cycle < (last + 1) div {points}")
    low, high = F.greatest(F.lit(0), F.col("cycle") * points - wide), F.least(F.col("last"), F.col("cycle") * points + wide - 1)
    rows = rows.withColumn("low", low.cast("long")).withColumn("high", high.cast("long")).where("low <= high")
    return rows.select(*keys, F.lit(name).alias("name"), "cycle", F.explode(F.sequence("low", "high")).alias("lag"))


def peaks(points: DataFrame, series: DataFrame, keys: list[str], daily: int, weekly: int) -> DataFrame:
    """Evidence of the autocorrelation: the mean of its peaks near whole cycles."""
    wide = slack(weekly, WEEK_SLACK)
    reach = WEEKS * weekly + 2 * wide
    near = _cycles(series, keys, "weekly", weekly, WEEKS, wide, reach).unionAll(
        _cycles(series, keys, "daily", daily, DAYS, slack(daily, DAY_SLACK), reach))
    tops = near.join(autocorrelation(points, keys, near), [*keys, "lag"]).groupBy(*keys, "name", "cycle").agg(F.round(F.max("acf"), 9).alias("top"))
    least = F.when(F.col("name") == "weekly", WEEK_PEAK).otherwise(DAY_PEAK)
    found = tops.where(F.col("top") > least).groupBy(*keys, "name").agg(F.round(F.avg("top"), 9).alias("score"), F.count("*").alias("c"))
    enough = F.when(F.col("name") == "weekly", WEEK_MEAN).otherwise(DAY_MEAN)
    method = F.format_string("acf_%s_%dpeaks", "name", "c")
    return found.where(F.col("score") > enough).select(*keys, "name", "score", method.alias("method"), F.when(F.col("name") == "weekly", 1).otherwise(2).alias("place"))


def spectrum(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, n, k, power) of the frequencies 1..n/2 of the series without its line."""
    rows = blocks(points, keys, "r").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("n") / 2))))
    turn = 2 * F.pi() / F.col("n")
    # whole turns are taken off before the angle is formed, so long series lose no digits
    angle = lambda i: F.pmod(F.col("k") * (F.col("b") * SIZE + i), F.col("n")) * turn
    part = lambda f: F.aggregate(F.transform("xs", lambda x, i: x * f(angle(i))), F.lit(0.0), lambda t, x: t + x)
    sums = rows.select(*keys, "n", "k", part(F.cos).alias("re"), part(F.sin).alias("im")).groupBy(*keys, "n", "k").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return sums.select(*keys, "n", "k", F.round(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")), 9).alias("power"))


def strongest(points: DataFrame, keys: list[str], daily: int, weekly: int) -> DataFrame:
    """Evidence of the spectrum: the strongest frequency below the highest one, if it is near a day or a week."""
    inner = F.col("k") < F.floor(F.col("n") / 2)
    best = F.max(F.when(inner, F.struct("power", -F.col("k"))))
    tops = spectrum(points, keys).groupBy(*keys, "n").agg(best.alias("best"), F.max("power").alias("most")).where("best IS NOT NULL AND most > 0")
    length = F.bround(F.col("n") / -F.col("best")["col2"])
    near = lambda size: F.abs(length - size) < size * SPECTRUM_NEAR
    name = F.when(near(daily), "daily").when(near(weekly), "weekly")
    rows = tops.select(*keys, name.alias("name"), F.round(F.col("best")["power"] / F.col("most"), 9).alias("score"))
    return rows.where(F.col("name").isNotNull() & (F.col("score") > SPECTRUM_LEAST)).select(*keys, "name", "score", F.concat(F.lit("fft_"), "name").alias("method"), F.lit(3).alias("place"))


def seasonal(points: DataFrame, keys: list[str], daily: int) -> DataFrame:
    """Evidence of the seasons: the share of the variance around a moving mean that the phase of a quarter day explains."""
    size = max(2, daily // 4)
    half = size // 2
    w = Window.partitionBy(*keys).orderBy("p")
    near = w.rowsBetween(-half, half)
    ends = (F.lag("value", half).over(w) + F.lead("value", half).over(w)) / 2 if size % 2 == 0 else F.lit(0.0)
    rest = points.where(F.col("n") >= SEASON_POINTS).withColumn("x", F.col("value") - (F.sum("value").over(near) - ends) / size)
    rest = rest.where((F.col("p") >= half) & (F.col("p") < F.col("n") - half))
    phases = rest.groupBy(*keys, (F.col("p") % size).alias("phase")).agg(F.count("*").alias("c"), F.avg("x").alias("m"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    total = F.sum("c")
    square = F.pow(F.sum(F.col("c") * F.col("m")) / total, 2)
    between = F.sum(F.col("c") * F.col("m") * F.col("m")) / total - square
    every = F.sum("xx") / total - square
    shares = phases.groupBy(*keys).agg(between.alias("between"), every.alias("every")).where("every > 0")
    rows = shares.select(*keys, F.lit("daily").alias("name"), F.round(F.col("between") / F.col("every"), 9).alias("score"), F.lit("stl_daily").alias("method"), F.lit(4).alias("place"))
    return rows.where(F.col("score") > SEASON_LEAST)


def detect_periods(traffic: DataFrame, keys: list[str], daily: int = 96, weekly: int = 672) -> DataFrame:
    """(keys…, period_name, confidence, method, best_effort) of every series."""
    points = numbered(traffic, keys)
    series = points.select(*keys, "n").distinct()
    long_enough = F.col("n") >= LEAST_POINTS
    looked_at = points.where(long_enough)
    evidence = peaks(looked_at, series.where(long_enough), keys, daily, weekly)
    evidence = evidence.unionAll(strongest(looked_at, keys, daily, weekly)).unionAll(seasonal(looked_at, keys, daily))
    named = evidence.groupBy(*keys, "name").agg(F.avg("score").alias("confidence"), F.max(F.struct("score", -F.col("place"), "method")).alias("top"))
    chosen = named.groupBy(*keys).agg(F.max(F.struct("top", "name", "confidence")).alias("c"))
    rows = series.join(chosen, keys, "left").select(*keys, "n", "c.name", "c.confidence", "c.top.method")
    confidence = F.coalesce("confidence", F.lit(0.0))
    return rows.select(
        *keys, F.coalesce("name", F.lit(NO_PERIOD)).alias("period_name"), confidence.alias("confidence"),
        F.coalesce("method", F.when(long_enough, UNCLEAR).otherwise(TOO_SHORT)).alias("method"),
        (F.col("name").isNotNull() & (confidence < BEST_EFFORT)).alias("best_effort"),
    )

import numpy as np
from pyspark.sql import functions as F

from routescope.functions import times as T
from routescope.operators import learned, periods
from routescope.operators import traffic as TR

T_START = 1_700_000_000 - 1_700_000_000 % 86400


def points(spark, values, means=None, std=0.1):
    means = means or [0.5] * len(values)
    rows = [("s", "e", i, float(v), float(m), std) for i, (v, m) in enumerate(zip(values, means))]
    df = spark.createDataFrame(rows, "series string, event_name string, idx int, value double, mean double, std double")
    return df.withColumn("ts", T.from_seconds(F.col("idx").cast("bigint") * 900))


def test_sudden_drop(spark, rows):
    got = TR.sudden_drop(points(spark, [0.5, 0.5, 0, 0, 0, 0, 0.5]))
    assert rows(got, "idx", "points", "severity") == [(i, 4, "critical") for i in (2, 3, 4, 5)]
    kept = TR.combined(points(spark, [0.5, 0.5, 0, 0, 0, 0, 0.5]))
    assert rows(kept, "idx") == [(2,), (3,), (4,), (5,)]


def test_three_zeros_drop_but_are_no_run(spark):
    p = points(spark, [0.5, 0.5, 0, 0, 0, 0.5])
    assert TR.sudden_drop(p).count() == 3
    assert TR.combined(p).count() == 0


def test_no_drop_from_low_traffic_or_at_the_start(spark):
    assert TR.sudden_drop(points(spark, [0.05, 0, 0, 0, 0])).count() == 0
    assert TR.sudden_drop(points(spark, [0, 0, 0, 0])).count() == 0


def test_smoothing_in_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.random(300)
    s = [x[0]]
    for v in x[1:]:
        s.append(0.1 * v + 0.9 * s[-1])
    df = points(spark, x).select("series", "idx", "value")
    for block in (7, 256, 1000):
        got = {r["idx"]: r["smoothed"] for r in TR.smooth(df, ["series"], block=block).collect()}
        assert np.allclose([got[i] for i in range(300)], s), block


def test_moving_average_needs_a_full_window(spark, rows):
    got = TR.moving_average(points(spark, [0.5] * 12 + [0.9] + [0.5] * 3), ["series"])
    assert rows(got, "idx", "severity")[0] == (12, "high")


def test_roles(spark, rows):
    p = points(spark, [0.5] * 4 + [0.3] * 4).withColumns({"event_type": F.lit("hijack"), "as_role": F.lit("victim")})
    assert rows(TR.role_anomalies(p), "idx", "direction") == [(i, "decrease") for i in (4, 5, 6, 7)]
    q = p.withColumn("as_role", F.lit("hijacker"))
    assert TR.role_anomalies(q).count() == 0


def test_boundaries_grow_while_off(spark):
    p = points(spark, [0.5] * 20 + [0.0] * 4 + [0.5] * 20)
    odd = p.where("value = 0").select("series", "event_name", "idx")
    r = TR.expand_boundaries(odd, p, margin=2).first()
    assert (r["first_idx"], r["last_idx"]) == (18, 25)


def hourly(spark, **series):
    rows = [(name, T_START + 3600 * i, float(v)) for name, values in series.items() for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "series string, t bigint, value double")
    return frame.select("series", T.from_seconds(F.col("t")).alias("ts"), "value")


def test_periods(spark):
    t = np.arange(1500)
    noise = np.random.default_rng(1).random(1500)
    traffic = hourly(spark, day=np.sin(2 * np.pi * t / 24) + noise, week=np.sin(2 * np.pi * t / 168) + noise,
                     noise=noise, flat=np.ones(300), short=noise[:10], quarter=np.tile(np.arange(6), 60), holes=[np.nan] * 30)
    got = {r["series"]: r for r in periods.detect_periods(traffic, ["series"], 24, 168).collect()}
    assert set(got) == {"day", "week", "noise", "flat", "short", "quarter"}
    assert (got["day"]["period_name"], got["day"]["method"]) == ("daily", "fft_daily") and got["day"]["confidence"] > 0.5
    assert (got["week"]["period_name"], got["week"]["method"]) == ("weekly", "fft_weekly")
    assert got["quarter"]["method"] == "stl_daily"
    assert [got[s]["method"] for s in ("noise", "flat", "short")] == ["no_clear_period", "no_clear_period", "insufficient_data"]
    assert [got[s]["confidence"] for s in ("noise", "flat", "short")] == [0.0] * 3
    assert periods.detect_periods(traffic.where("false"), ["series"], 24, 168).count() == 0


def test_autocorrelation_and_spectrum_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(periods, "SIZE", 7)
    x = np.random.default_rng(2).random(60)
    d = x - x.mean()
    points = periods.numbered(hourly(spark, s=x), ["series"])
    lags = spark.range(70).select(F.lit("s").alias("series"), F.col("id").alias("lag"))
    got = {r["lag"]: r["acf"] for r in periods.autocorrelation(points, ["series"], lags).collect()}
    assert sorted(got) == list(range(60))
    assert np.allclose([got[k] for k in range(60)], [(d[k:] * d[: len(d) - k]).sum() / (d * d).sum() for k in range(60)])
    t = np.arange(60)
    want = np.abs(np.fft.fft(x - np.polyval(np.polyfit(t, x, 1), t)))
    power = {r["k"]: r["power"] for r in periods.spectrum(points, ["series"]).collect()}
    assert np.allclose([power[k] for k in range(1, 31)], want[1:31])


def test_isolation_scores_are_seeded_and_find_the_odd_one():
    train = np.random.default_rng(4).normal(0.5, 0.05, 400)
    a, b = (learned.isolation_scores(learned.grown(train), 256, np.array([0.5, 3.0])) for _ in range(2))
    assert np.array_equal(a, b)
    assert a[1] > a[0]
    assert a[1] > np.quantile(learned.isolation_scores(learned.grown(train), 256, train), 0.9)


def test_forest_takes_its_limit_from_all_history(spark, monkeypatch):
    monkeypatch.setattr(learned, "CELL", 50)
    monkeypatch.setattr(learned, "SAMPLE", 4)  # trees see 400 of the 600 past values
    values = np.random.default_rng(4).normal(0.5, 0.05, 600)
    past = spark.createDataFrame([("s", "e", 1, i, float(v)) for i, v in enumerate(values)], "series string, event_name string, period int, idx int, value double")
    few = past.where("idx < 9").withColumn("series", F.lit("few"))
    now = spark.createDataFrame([(s, "e", i, v) for s in ("s", "few") for i, v in enumerate([0.5, 3.0, -2.0])], "series string, event_name string, idx int, value double")
    got = learned.isolation_forest(now, past.unionAll(few)).collect()
    assert sorted((r["series"], r["idx"]) for r in got) == [("s", 1), ("s", 2)]
    trees = learned.forests(past).collect()
    own = learned.unpacked([t["cuts"] for t in trees], [t["depths"] for t in trees])
    limit = np.quantile(learned.isolation_scores(own, trees[0]["size"], values), 0.9)
    want = learned.isolation_scores(own, trees[0]["size"], np.array([3.0, -2.0])) - limit
    assert np.allclose([r["ml_score"] for r in sorted(got)], want)


def test_screening_counts_points_by_their_step(spark):
    rows = [(name, T_START + 3600 * i, 10.0) for name, hours in (("dense", range(24)), ("sparse", range(0, 24, 3)), ("short", range(3))) for i in hours]
    rows += [(name, T_START - 7 * 86400 + 3600 * i, 8.0) for name in ("dense", "sparse", "short") for i in range(24)]
    traffic = spark.createDataFrame(rows, "series string, t bigint, value double").select("series", T.from_seconds(F.col("t")).alias("ts"), "value")
    window = spark.createDataFrame([("e", T_START, T_START + 23 * 3600)], "event_name string, a bigint, b bigint")
    window = window.select("event_name", T.from_seconds(F.col("a")).alias("start"), T.from_seconds(F.col("b")).alias("end"))
    got = {r["series"]: r for r in TR.quick_screening(traffic, window, step=3600).collect()}
    assert got["dense"]["signals"] == ["small_change"]  # a quarter more than a week before
    assert got["dense"]["quick_score"] == 0.1 and not got["dense"]["need_full_analysis"]
    assert got["sparse"]["signals"] == ["small_change", "sparse"] and round(got["sparse"]["quick_score"], 9) == 0.25
    assert not got["short"]["data_available"] and got["short"]["quick_score"] == 0.0

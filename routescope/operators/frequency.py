"""How often a link is seen, and whether that is rare enough to doubt it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routescope.functions import paths as P
from routescope.functions import scores as S
from routescope.functions import times as T
from routescope.operators.links import fake_links, fake_paths, with_path_facts
from routescope.session import cut_lineage

WEEK = 7 * 86400


def link_sightings(updates: DataFrame, keep: list[str]) -> DataFrame:
    """(keep…, as1, as2): each link of an update once."""
    pairs = F.explode(F.array_distinct(P.adjacent_pairs(F.col("hops")))).alias("p")
    return updates.select(*keep, pairs).select(*keep, "p.as1", "p.as2")


def pair_counts(updates: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds n, total and ratio to each wanted pair; 0 for pairs never seen."""
    total = updates.agg(F.count("*")).scalar()
    seen = link_sightings(updates, []).groupBy("as1", "as2").agg(F.count("*").alias("n"))
    return pairs.select("as1", "as2").distinct().join(seen, ["as1", "as2"], "left").select(
        "as1", "as2", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), total.alias("total")
    ).withColumn("ratio", F.coalesce(F.try_divide("n", "total"), F.lit(0.0)))


def updates_until(updates: DataFrame, points: DataFrame) -> DataFrame:
    """(t, until): number of updates up to and including second ``t``, for each point.

    Updates are first counted per second; wanted points enter as seconds with count 0,
    so a running sum answers them all. The sum runs within a day, and whole earlier days
    are added from one row per day: no task sees more than a day of seconds.
    """
    per_second = updates.groupBy(T.seconds(F.col("ts")).alias("t")).agg(F.count("*").alias("n"))
    return counts_until(per_second, points.select("t"), [])


def counts_until(per_second: DataFrame, points: DataFrame, by: list[str]) -> DataFrame:
    """(by…, t, until): the counts (by…, t, n) added up to and including each wanted point (by…, t)."""
    ask = points.distinct().withColumn("n", F.lit(0).cast("bigint"))
    day = F.floor(F.col("t") / 86400)
    line = per_second.select(*by, "t", "n").unionByName(ask).groupBy(*by, "t").agg(F.sum("n").alias("n")).withColumn("day", day)
    in_day = Window.partitionBy(*by, "day").orderBy("t")
    before = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = line.groupBy(*by, "day").agg(F.sum("n").alias("n")).select(
        *by, "day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carried")
    )
    running = line.select(*by, "t", "day", F.sum("n").over(in_day).alias("run"))
    return running.join(days, [*by, "day"]).select(*by, "t", (F.col("run") + F.col("carried")).alias("until")).join(
        ask.select(*by, "t"), [*by, "t"], "left_semi"
    )


def rarity_as_of(updates: DataFrame, asked: DataFrame, window: int = WEEK) -> DataFrame:
    """Verdicts on links as of asked times: ``asked`` has as1, as2, day (a date) and t_end (seconds, or null).

    A link's sightings are counted among the updates of the week up to ``t_end``; without an end, or if that
    week has no updates, among those of ``day`` alone. The threshold comes from the first AS's share of the
    day's updates. A row without updates to count among has no data and is suspicious. Counts are running sums per
    day, looked up at both ends of a window, so a question costs two look-ups however long its window.
    """
    asked = cut_lineage(asked.select("as1", "as2", F.col("day").cast("date").alias("day"), F.col("t_end").cast("bigint").alias("t_end")).distinct())
    d0 = F.unix_date("day").cast("bigint") * 86400
    spans = asked.select(
        "as1", "as2", "day", "t_end", F.explode(F.array(
            F.struct(F.lit("7d_window").alias("coverage"), (F.col("t_end") - window - 1).alias("lo"), F.col("t_end").alias("hi")),
            F.struct(F.lit("single_day").alias("coverage"), (d0 - 1).alias("lo"), (d0 + 86399).alias("hi")))).alias("w")
    ).select("as1", "as2", "day", "t_end", "w.*").where("hi IS NOT NULL")
    ends = F.explode(F.array("lo", "hi")).alias("t")
    sightings = link_sightings(updates, ["ts"]).join(asked.select("as1", "as2").distinct(), ["as1", "as2"], "left_semi")
    per_pair = sightings.groupBy("as1", "as2", T.seconds(F.col("ts")).alias("t")).agg(F.count("*").alias("n"))
    all_until = cut_lineage(updates_until(updates, spans.select(ends)))
    pair_until = cut_lineage(counts_until(per_pair, spans.select("as1", "as2", ends), ["as1", "as2"]))

    def at(table: DataFrame, end: str, name: str, by: list[str]) -> DataFrame:
        return table.select(*by, F.col("t").alias(end), F.col("until").alias(name))

    two = ["as1", "as2"]
    counted = spans.join(at(all_until, "lo", "a0", []), "lo").join(at(all_until, "hi", "a1", []), "hi")
    counted = counted.join(at(pair_until, "lo", "p0", two), [*two, "lo"]).join(at(pair_until, "hi", "p1", two), [*two, "hi"])
    used = counted.select(*two, "day", "t_end", "coverage", (F.col("a1") - F.col("a0")).alias("total"), (F.col("p1") - F.col("p0")).alias("n")).where("total > 0")
    # '7d_window' comes before 'single_day'
    best = used.groupBy(*two, "day", "t_end").agg(F.min(F.struct("coverage", "total", "n")).alias("b"))
    date = F.to_date("ts").alias("day")
    per_day = updates.groupBy(date).agg(F.count("*").alias("day_total"))
    active = updates.select(date, F.explode(F.array_distinct("hops")).alias("as1")).groupBy("day", "as1").agg(F.count("*").alias("active"))
    named = best.toDF("x1", "x2", "x_day", "x_end", "b")
    same = (F.col("as1") == F.col("x1")) & (F.col("as2") == F.col("x2")) & (F.col("day") == F.col("x_day")) & F.col("t_end").eqNullSafe(F.col("x_end"))
    judged = asked.join(named, same, "left").select(
        *two, "day", "t_end", F.coalesce("b.coverage", F.lit("insufficient")).alias("coverage"),
        F.coalesce("b.n", F.lit(0).cast("bigint")).alias("n"), F.coalesce("b.total", F.lit(0).cast("bigint")).alias("total"))
    share = F.coalesce(F.try_divide("active", "day_total"), F.lit(0.0))
    rows = judged.join(per_day, "day", "left").join(active, ["day", "as1"], "left").withColumns(
        {"ratio": F.coalesce(F.try_divide("n", "total"), F.lit(0.0)), "threshold": F.when(F.col("total") > 0, S.forge_threshold(share))})
    return rows.select(*two, "day", "t_end", "coverage", "n", "total", "ratio", "threshold", F.coalesce(F.col("ratio") <= F.col("threshold"), F.lit(True)).alias("suspicious"))


def rarity_verdicts(updates: DataFrame, pairs: DataFrame, window: int = WEEK) -> DataFrame:
    """Per wanted pair: sightings and all updates in the week up to its last sighting,
    their ratio, the threshold its first AS earns, and whether the link is suspicious.

    A pair never seen has no data and is suspicious.
    """
    wanted = pairs.select("as1", "as2").distinct()
    seen = link_sightings(updates, ["ts"]).join(wanted, ["as1", "as2"], "left_semi").groupBy(
        "as1", "as2", T.seconds(F.col("ts")).alias("t")
    ).agg(F.count("*").alias("n"))
    seen = cut_lineage(seen)  # read three times below; far smaller than the updates
    last = seen.groupBy("as1", "as2").agg(F.max("t").alias("t_end"))
    recent = seen.join(last, ["as1", "as2"]).where(F.col("t") >= F.col("t_end") - window).groupBy(
        "as1", "as2", "t_end"
    ).agg(F.sum("n").alias("n"))
    ask = last.select(F.explode(F.array(F.col("t_end"), F.col("t_end") - window - 1)).alias("t"))
    until = updates_until(updates, ask)
    at_end = until.select(F.col("t").alias("t_end"), F.col("until").alias("hi"))
    at_start = until.select((F.col("t") + window + 1).alias("t_end"), F.col("until").alias("lo"))
    counted = recent.join(at_end, "t_end").join(at_start, "t_end").withColumns(
        {"total": F.col("hi") - F.col("lo"), "day": F.floor(F.col("t_end") / 86400)}
    )
    day = F.floor(T.seconds(F.col("ts")) / 86400).alias("day")
    per_day = updates.groupBy(day).agg(F.count("*").alias("day_total"))
    active = updates.select(day, F.explode(F.array_distinct("hops")).alias("as1")).groupBy("day", "as1").agg(
        F.count("*").alias("active")
    )
    judged = counted.join(per_day, "day").join(active, ["day", "as1"], "left").withColumn(
        "threshold", S.forge_threshold(F.coalesce("active", F.lit(0)) / F.col("day_total"))
    )
    ratio = F.col("n") / F.col("total")
    return wanted.join(
        judged.select("as1", "as2", "n", "total", ratio.alias("ratio"), "threshold"), ["as1", "as2"], "left"
    ).select(
        "as1", "as2",
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
        F.coalesce("total", F.lit(0).cast("bigint")).alias("total"),
        F.coalesce("ratio", F.lit(0.0)).alias("ratio"),
        "threshold",
        F.coalesce(F.col("ratio") <= F.col("threshold"), F.lit(True)).alias("suspicious"),
    )


def mark_paths(updates: DataFrame, edges: DataFrame) -> DataFrame:
    """(path_id, fakes, suspicious): the paths of ``updates`` with unexplained links.

    Each distinct path is looked up once, each distinct fake link judged once; the paths are stored, being read twice.
    """
    paths = cut_lineage(fake_paths(updates, edges))
    listed = paths.select("path_id", F.explode("fakes").alias("f")).select("path_id", "f.as1", "f.as2")
    verdicts = rarity_verdicts(updates, listed).select("as1", "as2", "suspicious")
    judged = listed.join(verdicts, ["as1", "as2"]).groupBy("path_id").agg(F.max("suspicious").alias("suspicious"))
    return paths.join(judged, "path_id")


def mark_updates(updates: DataFrame, edges: DataFrame) -> DataFrame:
    """``updates`` with unexplained links, with these as ``fakes``, ``has_fake`` and whether any is ``suspicious``."""
    return with_path_facts(updates, mark_paths(updates, edges)).withColumn("has_fake", F.lit(True))


def fake_link_groups(alert_links: DataFrame) -> DataFrame:
    """Per (target, prefix, link): first and last seen, sightings and distinct paths.

    Paths are made distinct by grouping first, so no list of paths is held.
    """
    key = ["target_as", "prefix", "as1", "as2"]
    per_path = alert_links.groupBy(*key, "as_path").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n")
    )
    return per_path.groupBy(*key).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("n").alias("n"), F.count("*").alias("n_paths"),
    )


def fake_link_groups_across(groups: DataFrame) -> DataFrame:
    """The same link on the same prefix, once for all targets."""
    return groups.groupBy("prefix", "as1", "as2").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.max("n").alias("n"), F.max("n_paths").alias("n_paths"),
        F.count("*").alias("n_targets"),
    )


def weekly_interception(updates: DataFrame, edges: DataFrame, start: str, end: str, legit_from: int = 5) -> DataFrame:
    """Fake links seen under ``legit_from`` times since a week before ``start`` and again after it.

    An alert has fewer than ``legit_from`` sightings, so its path and prefix lists are short.
    """
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    scope = updates.where((F.col("ts") >= lo - F.expr("INTERVAL 7 DAYS")) & (F.col("ts") <= hi))
    fakes = fake_links(scope, edges, ["seq", "ts", "prefix", "as_path"])
    counts = fakes.groupBy("as1", "as2").agg(
        F.count("*").alias("week"), F.count_if(F.col("ts") >= lo).alias("recent")
    ).where((F.col("week") < legit_from) & (F.col("recent") > 0))
    recent = fakes.where(F.col("ts") >= lo).join(counts, ["as1", "as2"])
    ordered = F.array_sort(F.collect_list(F.struct("ts", "seq", "pos", "as_path")))
    return recent.groupBy("as1", "as2", "week", "recent").agg(
        F.min("ts").alias("first_seen"),
        F.array_sort(F.collect_set("prefix")).alias("prefixes"),
        F.slice(F.transform(ordered, lambda s: s["as_path"]), 1, 5).alias("paths"),
    ).withColumn("confidence", F.when(F.col("recent") > 3, "high").otherwise("medium"))

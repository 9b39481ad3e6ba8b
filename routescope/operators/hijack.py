"""Origin hijacks, forged paths, interception patterns, and alert roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routescope.functions import paths as P
from routescope.functions import scores as S
from routescope.functions import times as T
from routescope.operators import frequency, links, prefix_join


def origin_hijacks(announcements: DataFrame, prefix2as: DataFrame, target_asns: DataFrame) -> DataFrame:
    """Alerts for announcements by an AS that does not own the prefix or its closest parent.

    A target that owns the prefix was hijacked; a target that announced it is hijacking.
    Only owners and the origin can be concerned, so those few are listed and matched to
    the targets, instead of testing every target on every announcement.
    """
    owners = prefix_join.resolve_owners(announcements, prefix2as)
    origin = F.col("origin_as")
    wrong = announcements.where(origin.isNotNull()).join(owners, "prefix").where(
        ~F.array_contains("origins", origin)
    )
    # the origin is no owner here, so no AS is listed twice
    listed = wrong.withColumn("target_as", F.explode(F.concat(F.col("origins"), F.array(origin))))
    mine = listed.join(target_asns.select(F.col("asn").alias("target_as")).distinct(), "target_as", "left_semi")
    hijacking = F.col("target_as") == origin
    others = F.filter(F.col("origins"), lambda a: a != F.col("target_as"))
    return mine.select(
        F.when(hijacking, "origin_hijacking").otherwise("origin_hijacked").alias("type"),
        "seq", "ts", "prefix", "checked_prefix", "origin_as", "as_path", "target_as",
        F.col("origins").alias("legitimate_origins"),
        F.col("origin_as").alias("hijacker_as"),
        F.when(hijacking, F.get("origins", F.lit(0))).otherwise(F.col("target_as")).alias("victim_as"),
        F.when(hijacking, F.col("origins")).otherwise(F.concat(F.array("target_as"), others)).alias("victim_ases"),
        F.lit("low").alias("confidence"),
    )


def alert_actors(marked: DataFrame, prefix2as: DataFrame) -> DataFrame:
    """Adds victims, attackers and the first fake link to suspicious updates.

    Attackers are the ends of the fake links plus the origin.
    """
    owners = prefix_join.prefix_origins(prefix2as)
    ends = F.array_sort(F.array_distinct(F.flatten(F.transform("fakes", lambda f: F.array(f["as1"], f["as2"])))))
    joined = marked.join(owners, "prefix", "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "*",
        F.coalesce("origins", none).alias("victim_ases"),
        ends.alias("attacker_ases"),
        F.array_union(ends, F.array_compact(F.array("origin_as"))).alias("hijacker_as_list"),
        F.concat_ws("|", F.get("fakes", F.lit(0))["as1"], F.get("fakes", F.lit(0))["as2"]).alias("fake_connection"),
    ).drop("origins")


def forged_paths(announcements: DataFrame, edges: DataFrame, prefix2as: DataFrame, target_asns: DataFrame) -> DataFrame:
    """Alerts for updates that cross a target over a rare, unexplained link."""
    marked = frequency.mark_updates(announcements, edges).where("suspicious")
    acted = alert_actors(marked, prefix2as).withColumn("target_as", F.explode(F.array_distinct("hops")))
    mine = acted.join(target_asns.select(F.col("asn").alias("target_as")).distinct(), "target_as", "left_semi")
    return mine.select(
        F.lit("forge_hijacked").alias("type"),
        "seq", "ts", "prefix", "origin_as", "as_path", "target_as", "victim_ases", "attacker_ases",
        F.coalesce(F.get("victim_ases", F.lit(0)), F.col("target_as")).alias("victim_as"),
        F.get("hijacker_as_list", F.lit(0)).alias("hijacker_as"),
        "hijacker_as_list", "fake_connection", "fakes",
        F.lit("medium").alias("confidence"),
    )


def dominant_paths(announcements: DataFrame) -> DataFrame:
    """(prefix, expected, expected_n, path, n): each less common path seen twice or more
    beside the prefix's most common one; equal counts go to the lowest path."""
    counts = announcements.groupBy("prefix", F.col("hops").alias("path")).agg(F.count("*").alias("n"))
    best = counts.groupBy("prefix").agg(F.min(F.struct((-F.col("n")).alias("neg"), "path")).alias("best"))
    return (
        counts.where("n >= 2").join(best, "prefix")
        .where(F.col("path") != F.col("best.path"))
        .select("prefix", F.col("best.path").alias("expected"), (-F.col("best.neg")).alias("expected_n"), "path", "n")
    )


def interception_patterns(
    announcements: DataFrame, edges: DataFrame, target_asns: DataFrame
) -> DataFrame:
    """Paths that bypass a target, or cross it with unexplained company.

    Candidate targets are the hops of the two paths compared.
    """
    alt = dominant_paths(announcements)
    paths = alt.select(F.col("path").alias("hops")).distinct()
    bad = links.fake_links(paths, edges, ["hops"]).groupBy("hops").agg(F.count("*").alias("bad_pairs"))
    ok = links.related_to_path(paths, edges).groupBy("hops").agg(F.collect_set("asn").alias("related"))
    facts = paths.join(bad, "hops", "left").join(ok, "hops", "left").select(
        F.col("hops").alias("path"),
        F.coalesce("bad_pairs", F.lit(0)).alias("bad_pairs"),
        F.coalesce("related", F.array().cast("array<string>")).alias("related"),
    )
    names = target_asns.select(F.col("asn").alias("target_as")).distinct()
    cases = alt.withColumn("target_as", F.explode(F.array_union("path", "expected"))).join(
        names, "target_as", "left_semi"
    )
    cases = cases.join(facts, "path")
    here = F.array_contains("path", F.col("target_as"))
    strange = F.filter("path", lambda h: ~F.array_contains("expected", h))
    first = F.array_position("path", F.col("target_as"))
    unexplained = F.size(
        F.filter(
            F.col("path"),
            lambda h, i: (i + 1 != first)
            & ~F.array_contains("expected", h)
            & ~F.array_contains("related", h),
        )
    )
    insertions = F.when(here, unexplained).otherwise(F.size(strange))
    length = S.path_length_score(F.size("path"), F.size("expected"))
    repeats = F.when(P.occurrences(F.col("path"), F.col("target_as")) > 1, 1).otherwise(0)
    odd = F.col("bad_pairs") + P.returns_to_hop(F.col("path")) + repeats
    pattern = F.when(here, S.pattern_score(odd)).otherwise(F.lit(0.8))
    scored = cases.select(
        "prefix", "target_as", "expected", "expected_n", "path", "n",
        F.when(here, "attacker").otherwise("victim").alias("scenario"),
        insertions.alias("insertions"), length.alias("length_score"), pattern.alias("pattern_score"),
    ).withColumn("risk", S.interception_risk(F.col("insertions"), F.col("length_score"), F.col("pattern_score")))
    limit = F.when(F.col("scenario") == "victim", 0.2).otherwise(0.3)
    return scored.where(F.col("risk") > limit).withColumn("confidence", S.risk_confidence(F.col("risk")))


def aggregate_alerts(alerts: DataFrame, width: int = 300) -> DataFrame:
    """Alerts of one type on one prefix within ``width`` seconds as one group.

    Largest groups first. Members stay rows of the input, found again by (type, prefix,
    window_start).
    """
    window = T.bucket_seconds(F.col("ts"), width).alias("window_start")
    g = alerts.groupBy("type", "prefix", window).agg(
        F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.min_by("confidence", F.struct("ts", "seq")).alias("lone"),
    )
    rated = g.withColumn("confidence", S.count_confidence(F.col("n"), F.col("lone"))).drop("lone")
    return rated.orderBy(F.desc("n"), "window_start", "type", "prefix")


def severity_of_alerts(alerts: DataFrame, by: list[str]) -> DataFrame:
    """Severity per group of alerts, from their number and how many are certain."""
    g = alerts.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(F.col("confidence") == "high").alias("high")
    )
    return g.withColumn("severity", S.alert_severity(F.col("total"), F.col("high")))


def alert_report(alerts: DataFrame) -> DataFrame:
    """Counts by type and by confidence and over all, with distinct prefixes."""
    per_prefix = alerts.groupBy("type", "confidence", "prefix").agg(F.count("*").alias("n"))
    return per_prefix.cube("type", "confidence").agg(
        F.sum("n").alias("n"), F.count_distinct("prefix").alias("prefixes")
    ).fillna("all", ["type", "confidence"])


def validate_alerts(alerts: DataFrame, updates: DataFrame) -> DataFrame:
    """Per alert type: alerts, those matching an update by time and prefix, passed or not."""
    seen = updates.select("ts", "prefix").distinct().withColumn("hit", F.lit(1))
    return alerts.join(seen, ["ts", "prefix"], "left").groupBy("type").agg(
        F.count("*").alias("total"), F.count("hit").alias("valid")
    ).withColumn("passed", F.col("total") == F.col("valid"))

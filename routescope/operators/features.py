"""Feature series of target AS sets from update messages.

Input rows come from ``relevant_updates`` with columns FEATURE_INPUT plus ``target``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routescope.functions import paths as P
from routescope.functions import times as T
from routescope.operators.reports import first_rows
from routescope.session import cut_lineage

FEATURE_INPUT = ["seq", "ts", "aw", "peer_as", "prefix", "as_path", "hops"]

# Features compared with a baseline (fixed names, in report order).
SERIES_FEATURES = (
    "announcement_count", "withdrawal_count", "flapping_prefix_count", "unique_prefix_count",
    "ori_change_rate", "num_ori_change", "origin_change_count", "path_change_rate", "dup_A_rate",
    "avg_arrival_interval", "editDis_entropy", "unique_as_count", "unique_peer_as_count",
    "avg_path_length", "max_path_length", "min_path_length",
)
# Features summed when buckets are added up, in the totals of a window.
SUMMED = (
    "announcement_count", "withdrawal_count", "total_messages", "announced_prefix_count",
    "withdrawn_prefix_count", "unique_prefix_count", "flapping_prefix_count",
)


def _c(name: str) -> Column:
    return F.col(name)


def state_of(rows: DataFrame) -> DataFrame:
    """Adds the numeric hops, whether the row changes route state, and what it leaves behind."""
    has_path = (_c("aw") == "A") & (_c("as_path") != "")
    left = F.struct("aw", "as_path", "asns")
    numeric = F.filter("hops", lambda h: h.rlike(r"^\d+$"))
    return rows.withColumns(
        {
            "has_path": has_path,
            "asns": F.array_distinct(numeric),
            "origin": F.when(has_path, P.origin(numeric)),
        }
    ).withColumn("left_state", F.when(has_path | (_c("aw") == "W"), left))


def _before(rows: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """Adds, per value column, its last non-null within ``keys`` strictly before the row."""
    w = Window.partitionBy(*keys).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({new: F.last(old, ignorenulls=True).over(w) for new, old in values.items()})


def busy_keys(rows: DataFrame, keys: list[str], more_than: int = 1_000_000) -> DataFrame:
    """Keys of more than ``more_than`` rows; counts combine before the shuffle. The few
    found are saved, so that asking whether there are any costs nothing twice."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > more_than)
    return cut_lineage(counts.select(*keys))


def bucket_tasks(updates: DataFrame, bucket: int, per_task: int = 50_000, most: int = 200_000) -> int | None:
    """How many tasks to deal whole buckets of updates to; none if a bucket holds more than ``most``, too many for one."""
    counts = updates.groupBy(T.bucket_seconds(_c("ts"), bucket).alias("bucket")).agg(F.count("*").alias("n"))
    total, widest = counts.agg(F.sum("n"), F.max("n")).first()  # two numbers
    if total is None:
        return 1
    return -(-total // per_task) if widest <= most else None


def cut_busy(rows: DataFrame, busy: DataFrame, piece: int) -> DataFrame:
    """Adds ``_piece``: the piece of time a row of a busy key lies in, -1 for quiet keys."""
    some = busy.columns
    same = [rows[k].eqNullSafe(F.col(f"_{k}")) for k in some]
    named = busy.select(*[_c(k).alias(f"_{k}") for k in some], F.lit(True).alias("_busy"))
    return rows.join(named, same, "left").withColumn(
        "_piece", F.when(_c("_busy"), F.floor(T.seconds(_c("ts")) / piece)).otherwise(F.lit(-1).cast("bigint"))
    ).drop("_busy", *[f"_{k}" for k in some])


def before_across(
    rows: DataFrame, keys: list[str], values: dict[str, str], piece: int = 3600, busy: DataFrame | None = None
) -> DataFrame:
    """As ``_before`` over a whole history, without giving one task a busy key.

    Busy keys have their history cut into pieces of ``piece`` seconds. Inside a piece the
    window does the work; the last value of each piece, one row per busy key and piece, is
    carried to the later ones. A prefix with a third of all messages is so worked on by
    as many tasks as it has pieces, and quiet keys cost nothing extra.

    ``busy`` lists busy values of some of the key columns; without it they are counted.
    Counting on the source of ``rows`` is cheaper than on ``rows``. Rows may come cut
    already (``_piece``).
    """
    cut = rows
    if "_piece" not in rows.columns:
        busy = busy_keys(rows, keys) if busy is None else busy
        if busy.isEmpty():
            return _before(rows, keys, values)
        cut = cut_busy(rows, busy, piece)
    inside = _before(cut, [*keys, "_piece"], values)
    order = F.struct("ts", "seq")
    tails = cut.where("_piece >= 0").groupBy(*keys, "_piece").agg(
        *[F.max_by(old, F.when(_c(old).isNotNull(), order)).alias(f"_{new}") for new, old in values.items()]
    )
    w = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(
        *keys, "_piece", *[F.last(f"_{new}", ignorenulls=True).over(w).alias(f"_{new}") for new in values]
    )
    joined = inside.join(carried, [*keys, "_piece"], "left")
    filled = joined.withColumns({new: F.coalesce(new, f"_{new}") for new in values})
    return filled.drop("_piece", *[f"_{new}" for new in values])


def route_changes(
    rows: DataFrame, scope: str = "file", bucket: int = 300, piece: int = 3600, busy: DataFrame | None = None
) -> DataFrame:
    """Per message, how it changes the route of its (target, prefix).

    ``scope='file'`` forgets the state at each bucket, ``'global'`` keeps it; ``busy`` and
    ``piece`` say how the global history of busy prefixes is cut. A withdrawal clears the
    path but not the origin.
    """
    s = state_of(rows)
    if "bucket" not in rows.columns:
        s = s.withColumn("bucket", T.bucket_seconds(_c("ts"), bucket))
    values = {"prev": "left_state", "prev_origin": "origin"}
    if scope == "file":
        known = before_across if "_piece" in s.columns else _before
        s = known(s, ["target", "prefix", "bucket"], values)
    elif scope == "global":
        s = before_across(s, ["target", "prefix"], values, piece, busy)
    else:
        raise ValueError(f"scope is 'file' or 'global', not {scope!r}")
    return change_flags(s).drop("prev", "prev_origin", "left_state")


def change_flags(s: DataFrame) -> DataFrame:
    """How each message of ``state_of`` changes the route ``prev`` (aw, as_path, asns) and its origin ``prev_origin``."""
    live = _c("has_path") & (_c("prev.aw") == "A")
    new_len, old_len = F.size("asns"), F.size("prev.asns")

    def flag(cond: Column) -> Column:
        return F.when(cond, 1).otherwise(0)

    return s.withColumns(
        {
            "path_length": F.when(_c("has_path"), new_len),
            "dup_a": flag(live & (_c("prev.as_path") == _c("as_path"))),
            "ori_change": flag(
                _c("has_path") & _c("prev_origin").isNotNull() & (_c("origin") != _c("prev_origin"))
            ),
            "longer": flag(live & (new_len > old_len)),
            "shorter": flag(live & (new_len < old_len)),
            "edit": F.when(live, P.edit_distance(_c("prev.asns"), _c("asns"))),
            "new_after_w": flag(_c("has_path") & (_c("prev.aw") == "W")),
            "dup_w": flag((_c("aw") == "W") & (_c("prev.aw") == "W")),
        }
    )


def _rate(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def feature_series(
    rows: DataFrame, bucket: int = 300, scope: str = "file", busy: DataFrame | None = None
) -> DataFrame:
    """One row per (target, bucket) with all features; ``bucket`` is in epoch seconds."""
    return series_of(bucket_states(rows, bucket, scope, busy))


def bucket_states(
    rows: DataFrame, bucket: int = 300, scope: str = "file", busy: DataFrame | None = None
) -> DataFrame:
    """What each (target, bucket) holds, one row per value counted distinct: sums, bounds and counts that add up.

    Each message is listed under its prefix and under every value counted distinct (hops,
    peer, edit distance); only rows of a prefix have more than their number ``n``. Rows of the same value in other buckets merge into wider ones (``merge_states``),
    and ``series_of`` yields counts, distinct counts and entropy together; every grouping
    combines before its shuffle.
    """
    s = route_changes(rows, scope, bucket, busy=busy)

    def entry(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))

    hops = F.transform(F.when(_c("has_path"), _c("asns")), lambda a: entry("as", a))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    single = F.array_compact(
        F.array(
            entry("prefix", _c("prefix")),
            F.when(_c("has_path") & _c("peer_as").isNotNull(), entry("peer", _c("peer_as"))),
            F.when(_c("edit").isNotNull(), entry("edit", _c("edit"))),
        )
    )
    flags = ["dup_a", "ori_change", "longer", "shorter", "new_after_w", "dup_w"]
    listed = s.select(
        "target", "bucket", "ts", "aw", "path_length", *flags,
        F.explode(F.concat(single, F.coalesce(hops, none))).alias("e"),
    ).select("*", "e.kind", "e.value").drop("e")
    # what a message adds is kept under its prefix alone; most rows are hops, which need their number only
    own = {n: F.when(_c("kind") == "prefix", _c(n)) for n in ("ts", "aw", "path_length", *flags)}
    listed = listed.withColumns(own)
    return listed.groupBy("target", "bucket", "kind", "value").agg(
        F.count("*").alias("n"),
        F.count_if(_c("aw") == "A").alias("a"),
        F.count_if(_c("aw") == "W").alias("w"),
        F.min(T.seconds(_c("ts"))).alias("t0"),
        F.max(T.seconds(_c("ts"))).alias("t1"),
        F.sum("path_length").alias("len_sum"),
        F.count("path_length").alias("len_n"),
        F.max("path_length").alias("len_max"),
        F.min("path_length").alias("len_min"),
        *[F.sum(f).alias(f) for f in flags],
    )


def merge_states(states: DataFrame, width: int, slide: int | None = None) -> DataFrame:
    """States of windows of ``width`` seconds, one every ``slide`` (by default side by side), by the clock.

    ``slide`` divides ``width`` and is a multiple of the states' own width; a window is named by its start.
    New buckets only add rows, so windows may be merged from states written file by file."""
    slide = slide or width
    if width % slide:
        raise ValueError("the slide must divide the width")
    last = _c("bucket") - F.pmod(_c("bucket"), F.lit(slide))
    starts = F.transform(F.sequence(F.lit(0), F.lit(width // slide - 1)), lambda k: last - k * slide)
    placed = states.withColumn("bucket", F.explode(starts)) if width > slide else states.withColumn("bucket", last)
    by = ["target", "bucket", "kind", "value"]
    least, most = ("t0", "len_min"), ("t1", "len_max")
    added = [n for n in states.columns if n not in (*by, *least, *most)]
    return placed.groupBy(*by).agg(
        *[F.sum(n).alias(n) for n in added], *[F.min(n).alias(n) for n in least], *[F.max(n).alias(n) for n in most]
    )


def series_of(per_value: DataFrame) -> DataFrame:
    """One row per (target, bucket) with all features, from ``bucket_states``."""

    def of(kind: str, value: Column) -> Column:
        return F.when(_c("kind") == kind, value)

    def pfx(name: str) -> Column:
        return of("prefix", _c(name))

    def total(name: str) -> Column:
        return F.coalesce(F.sum(pfx(name)), F.lit(0))

    edits = F.sum(of("edit", _c("n")))
    # log2(total) - sum(n log2 n) / total
    entropy = F.log2(edits) - F.sum(of("edit", _c("n") * F.log2(_c("n")))) / edits
    g = per_value.groupBy("target", "bucket").agg(
        total("a").alias("announcement_count"),
        total("w").alias("withdrawal_count"),
        total("n").alias("total_messages"),
        F.count_if((_c("kind") == "prefix") & (_c("a") > 0)).alias("announced_prefix_count"),
        F.count_if((_c("kind") == "prefix") & (_c("w") > 0)).alias("withdrawn_prefix_count"),
        F.count(of("prefix", F.lit(1))).alias("unique_prefix_count"),
        F.count_if((_c("kind") == "prefix") & (_c("a") > 0) & (_c("w") > 0)).alias("flapping_prefix_count"),
        F.coalesce(F.max(pfx("a")), F.lit(0)).alias("max_announce_per_prefix"),
        F.coalesce(F.max(pfx("w")), F.lit(0)).alias("max_withdraw_per_prefix"),
        total("ori_change").alias("num_ori_change"),
        total("longer").alias("num_longer"),
        total("shorter").alias("num_shorter"),
        total("new_after_w").alias("num_new_A_afterW"),
        total("dup_a").alias("num_dup_A"),
        total("dup_w").alias("num_dup_W"),
        (F.max(pfx("t1")) - F.min(pfx("t0"))).alias("span"),
        F.count(of("as", F.lit(1))).alias("unique_as_count"),
        F.count(of("peer", F.lit(1))).alias("unique_peer_as_count"),
        F.coalesce(F.greatest(entropy, F.lit(0.0)), F.lit(0.0)).alias("editDis_entropy"),
        total("len_n").alias("path_samples"),
        total("len_sum").alias("len_sum"),
        F.coalesce(F.max(pfx("len_max")), F.lit(0)).alias("max_path_length"),
        F.coalesce(F.min(pfx("len_min")), F.lit(0)).alias("min_path_length"),
    )
    a = _c("announcement_count")
    return g.withColumns(
        {
            "ori_change_rate": _rate(_c("num_ori_change"), a),
            "path_change_rate": _rate(_c("num_longer") + _c("num_shorter"), a),
            "dup_A_rate": _rate(_c("num_dup_A"), a),
            "avg_arrival_interval": _rate(_c("span"), _c("total_messages") - 1),
            "avg_path_length": _rate(_c("len_sum"), _c("path_samples")),
            "origin_change_count": _c("num_ori_change"),
            "max_path_length": _c("max_path_length").cast("bigint"),
            "min_path_length": _c("min_path_length").cast("bigint"),
        }
    ).drop("span", "len_sum")


def merge_buckets(series: DataFrame, width: int) -> DataFrame:
    """Coarser buckets from finer ones: sums, mean weighted by samples, max, least non-zero."""
    summed = [*SUMMED, "num_ori_change", "num_longer", "num_shorter", "num_dup_A", "num_dup_W",
              "num_new_A_afterW", "path_samples"]
    g = series.groupBy("target", F.expr(f"bucket - pmod(bucket, {width})").alias("bucket")).agg(
        *[F.sum(n).alias(n) for n in summed],
        F.sum(_c("avg_path_length") * _c("path_samples")).alias("weighted"),
        F.max("max_path_length").alias("max_path_length"),
        F.coalesce(F.min(F.when(_c("min_path_length") > 0, _c("min_path_length"))), F.lit(0)).alias("min_path_length"),
    )
    return g.withColumn("avg_path_length", _rate(_c("weighted"), _c("path_samples"))).drop("weighted")


def totals(series: DataFrame, by: list[str]) -> DataFrame:
    """Totals of a window: sums, mean of the non-zero bucket means, max, least non-zero."""
    positive = F.when(_c("avg_path_length") > 0, _c("avg_path_length"))
    return series.groupBy(*by).agg(
        *[F.sum(n).alias(n) for n in SUMMED],
        F.coalesce(F.avg(positive), F.lit(0.0)).alias("avg_path_length"),
        F.max("max_path_length").alias("max_path_length"),
        F.coalesce(F.min(F.when(_c("min_path_length") > 0, _c("min_path_length"))), F.lit(0)).alias("min_path_length"),
        F.count("*").alias("buckets"),
    )


def window_totals(rows: DataFrame) -> DataFrame:
    """Per target over all its rows: counts, distinct prefixes and peers, flapping, path
    lengths, announcements and withdrawals per prefix."""
    s = state_of(rows)
    length = F.when(_c("as_path") != "", F.size("asns"))
    entries = F.array_compact(
        F.array(
            F.struct(F.lit("prefix").alias("kind"), _c("prefix").alias("value")),
            F.when(_c("peer_as").isNotNull(), F.struct(F.lit("peer").alias("kind"), _c("peer_as").cast("string").alias("value"))),
        )
    )
    listed = s.select("target", "aw", length.alias("len"), F.explode(entries).alias("e"))
    per_value = listed.groupBy("target", "e.kind", "e.value").agg(
        F.count("*").alias("n"), F.count_if(_c("aw") == "A").alias("a"), F.count_if(_c("aw") == "W").alias("w"),
        F.sum("len").alias("ls"), F.count("len").alias("ln"), F.max("len").alias("lx"), F.min("len").alias("li"),
    )
    is_prefix = _c("kind") == "prefix"

    def pfx(name: str) -> Column:
        return F.when(is_prefix, _c(name))

    g = per_value.groupBy("target").agg(
        F.sum(pfx("a")).alias("announcement_count"),
        F.sum(pfx("w")).alias("withdrawal_count"),
        F.sum(pfx("n")).alias("total_messages"),
        F.count_if(is_prefix & (_c("a") > 0)).alias("announced_prefix_count"),
        F.count_if(is_prefix & (_c("w") > 0)).alias("withdrawn_prefix_count"),
        F.count_if(is_prefix).alias("unique_prefix_count"),
        F.count_if(~is_prefix).alias("unique_peer_as_count"),
        F.count_if(is_prefix & (_c("a") > 0) & (_c("w") > 0)).alias("flapping_prefix_count"),
        F.max(pfx("a")).alias("max_announce_per_prefix"),
        F.max(pfx("w")).alias("max_withdraw_per_prefix"),
        F.sum(pfx("ls")).alias("ls"), F.sum(pfx("ln")).alias("ln"),
        F.coalesce(F.max(pfx("lx")), F.lit(0)).cast("bigint").alias("max_path_length"),
        F.coalesce(F.min(pfx("li")), F.lit(0)).cast("bigint").alias("min_path_length"),
    )
    return g.withColumns(
        {
            "avg_path_length": _rate(_c("ls"), _c("ln")),
            "avg_announce_per_prefix": _rate(_c("announcement_count"), _c("announced_prefix_count")),
            "avg_withdraw_per_prefix": _rate(_c("withdrawal_count"), _c("withdrawn_prefix_count")),
        }
    ).drop("ls", "ln")


def origin_diversity(rows: DataFrame) -> DataFrame:
    """(target, prefix, origins): number of different origins announcing each prefix."""
    pairs = state_of(rows).where("origin IS NOT NULL").select("target", "prefix", "origin").distinct()
    return pairs.groupBy("target", "prefix").agg(F.count("*").alias("origins"))


def top_peers(rows: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` busiest peers of each target."""
    counts = rows.where("peer_as IS NOT NULL").groupBy("target", "peer_as").agg(F.count("*").alias("n"))
    return first_rows(counts.withColumn("neg", -_c("n")), ["target"], ["neg", "peer_as"], k).select(
        "target", "peer_as", "n", _c("_rank").cast("bigint").alias("rank")
    )


def flapping_prefixes(rows: DataFrame, by: list[str]) -> DataFrame:
    """Prefixes both announced and withdrawn."""
    return rows.groupBy(*by, "prefix").agg(
        F.count_if(_c("aw") == "A").alias("announced"), F.count_if(_c("aw") == "W").alias("withdrawn")
    ).where("announced > 0 AND withdrawn > 0")


def entropy(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Shannon entropy in bits of the values of each group."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    n = F.sum("n")
    bits = F.log2(n) - F.sum(_c("n") * F.log2("n")) / n
    return counts.groupBy(*by).agg(n.alias("n"), F.greatest(bits, F.lit(0.0)).alias("entropy"))

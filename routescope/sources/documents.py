"""The table of indexed updates: one document per distinct message, by date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routescope.functions import paths as P
from routescope.functions import times as T


OPTIONAL = ("next_hop", "local_pref", "med", "communities")


def _messages(updates: DataFrame) -> DataFrame:
    """Messages with the digest that becomes their id, before paths are taken apart."""
    blank = F.lit("")
    peer = F.coalesce(F.col("peer_as").cast("string"), blank)
    prefix = F.coalesce("prefix", blank)
    path = F.coalesce("as_path", blank)
    return updates.select(
        F.unhex(F.md5(F.concat_ws("|", T.text(F.col("ts")), peer, prefix, path))).alias("_id"),
        "ts", "aw", "peer_ip", peer.alias("peer_as"), prefix.alias("prefix"), path.alias("as_path"), "origin_as",
        *[n for n in OPTIONAL if n in updates.columns],
    )


def _documents(messages: DataFrame, file_source: str | None) -> DataFrame:
    hops = P.parse_path(F.col("as_path"))
    pairs = F.transform(P.adjacent_pairs(hops), lambda p: F.concat_ws("-", p["as1"], p["as2"]))
    return messages.select(
        F.lower(F.hex("_id")).alias("_id"),
        F.col("ts").alias("timestamp"), F.col("aw").alias("type"), "peer_ip", "peer_as", "prefix", "as_path",
        hops.alias("as_path_array"), pairs.alias("as_pairs"),
        F.coalesce("origin_as", F.lit("")).alias("origin"), *[n for n in OPTIONAL if n in messages.columns],
        F.lit(file_source).alias("file_source"), F.col("ts").cast("date").alias("date"),
    )


def build(updates: DataFrame, file_source: str | None = None) -> DataFrame:
    """Documents with path and pair arrays; messages of equal id become one.

    The id is the MD5 of ``timestamp|peer_as|prefix|as_path``. Paths are taken apart after the shuffle.
    """
    return _documents(_messages(updates).dropDuplicates(["_id"]), file_source)


def build_by_time(updates: DataFrame, file_source: str | None = None) -> DataFrame:
    """``build`` with the documents ranged by time. Messages of equal id are of one second, so the
    ranges bring them together and nothing is shuffled again to make them one."""
    second = T.seconds(F.col("ts"))
    ranged = _messages(updates).withColumn("_second", second).repartitionByRange("_second", "_id")
    return _documents(ranged.dropDuplicates(["_second", "_id"]), file_source)


def write(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Documents by date; rows are ranged by time first, so a busy date gets several files."""
    docs.repartitionByRange("timestamp", "_id").write.mode(mode).partitionBy("date").parquet(path)


def postings(docs: DataFrame) -> DataFrame:
    """(date, kind, key, _id): every pair, AS and prefix of a document once, to be kept by date beside the documents."""
    def entry(kind: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    entries = F.concat(entry("pair", F.array_distinct("as_pairs")), entry("as", F.array_distinct("as_path_array")), entry("prefix", F.array("prefix")))
    return docs.select("date", "_id", F.explode(entries).alias("e")).select("date", "e.kind", "e.key", "_id")


DOCS = 250_000  # documents whose postings one task sorts


def sorted_postings(docs: DataFrame) -> DataFrame:
    """``postings`` in ranges of a day's prefixes, sorted by date and key within each. The documents
    are shuffled, not the many postings of each."""
    short = docs.select("date", "_id", "prefix", "as_path_array", "as_pairs")
    parts = docs.count() // DOCS + docs.sparkSession.sparkContext.defaultParallelism
    return postings(short.repartitionByRange(parts, "date", "prefix", "_id")).sortWithinPartitions("date", "kind", "key")


def write_postings(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Postings by date; sorted by key, so that a key's rows lie together in a file and other row groups are skipped."""
    sorted_postings(docs).write.mode(mode).partitionBy("date").parquet(path)


def _days(start: str, end: str) -> Column:
    return F.col("date").between(F.lit(start[:10]).cast("date"), F.lit(end[:10]).cast("date"))


def _holding(index: DataFrame, kind: str, keys: Sequence[str] | DataFrame) -> DataFrame:
    of_kind = index.where(F.col("kind") == kind)
    if isinstance(keys, DataFrame):
        return of_kind.join(keys.toDF("key").distinct(), "key", "left_semi").select("date", "_id")
    return of_kind.where(F.col("key").isin(*keys)).select("date", "_id")


def search_indexed(
    docs: DataFrame, index: DataFrame, start: str, end: str, as_pairs: Sequence[str] = (), peer_as: str | None = None,
    prefix: str | None = None, path_contains: Sequence[str] = (), announced: bool = False,
) -> DataFrame:
    """``search`` over stored documents: which of them hold a pair or an AS is read from the postings of the days asked for."""
    index = index.where(_days(start, end))
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    found = docs.where(_days(start, end) & F.col("timestamp").between(lo, hi))
    if announced:
        found = found.where(F.col("type") == "A")
    if peer_as is not None:
        found = found.where(F.col("peer_as") == str(peer_as))
    wanted = ([("pair", as_pairs)] if as_pairs else []) + [("as", [str(a)]) for a in path_contains] + ([("prefix", [prefix])] if prefix is not None else [])
    for kind, keys in wanted:
        found = found.join(_holding(index, kind, keys), ["date", "_id"], "left_semi")
    return found


def candidates_indexed(docs: DataFrame, index: DataFrame, target: str, owned: DataFrame, start: str, end: str) -> DataFrame:
    """Announcements whose path holds ``target`` or whose prefix is one of ``owned``, by the postings."""
    index = index.where(_days(start, end))
    hits = _holding(index, "as", [str(target)]).unionByName(_holding(index, "prefix", owned.select("prefix")))
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    rows = docs.where(_days(start, end) & F.col("timestamp").between(lo, hi) & (F.col("type") == "A"))
    return rows.join(hits, ["date", "_id"], "left_semi")


def search(
    docs: DataFrame, start: str, end: str, as_pairs: Sequence[str] = (), peer_as: str | None = None,
    prefix: str | None = None, path_contains: Sequence[str] = (),
) -> DataFrame:
    """Documents in a time range with any of the pairs, the peer, the prefix, and all of
    the path's ASes, as far as given."""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    cond: Column = F.col("timestamp").between(lo, hi) & F.col("date").between(lo.cast("date"), hi.cast("date"))
    if as_pairs:
        cond = cond & F.arrays_overlap("as_pairs", F.array(*[F.lit(p) for p in as_pairs]))
    if peer_as is not None:
        cond = cond & (F.col("peer_as") == str(peer_as))
    if prefix is not None:
        cond = cond & (F.col("prefix") == prefix)
    for asn in path_contains:
        cond = cond & F.array_contains("as_path_array", str(asn))
    return docs.where(cond)


def leak_candidates(docs: DataFrame, asn: str, start: str, end: str) -> DataFrame:
    """Announcements in the range whose path has the AS, in time order."""
    return search(docs, start, end, path_contains=[asn]).where("type = 'A'").orderBy("timestamp", "_id")


def hijack_candidates(docs: DataFrame, asn: str, owned: DataFrame, start: str, end: str) -> DataFrame:
    """Announcements in the range crossing the AS or for a prefix it owns, in time order.

    Every owned prefix counts; they are joined, not listed in a filter.
    """
    rows = search(docs, start, end).where("type = 'A'")
    mine = owned.select("prefix").distinct().withColumn("_owned", F.lit(True))
    hit = F.array_contains("as_path_array", str(asn)) | F.coalesce("_owned", F.lit(False))
    return rows.join(mine, "prefix", "left").where(hit).drop("_owned").orderBy("timestamp", "_id")


def as_updates(docs: DataFrame) -> DataFrame:
    """Documents under the column names of updates."""
    hops = P.collapse_prepends(F.col("as_path_array"))
    return docs.select(
        F.col("_id").alias("seq"), F.col("timestamp").alias("ts"), F.col("type").alias("aw"), "peer_ip",
        F.col("peer_as").try_cast("bigint").alias("peer_as"), "prefix", "as_path", hops.alias("hops"),
        F.when(F.col("origin") != "", F.col("origin")).alias("origin_as"), "date",
    )


def without(docs: DataFrame, condition: Column) -> DataFrame:
    """What is left after deleting by query; write it over the partitions concerned."""
    return docs.where(~F.coalesce(condition, F.lit(False)))


def delete(spark, path: str, condition: Column, scratch: str) -> int:
    """Delete by query in a written document table; returns the number deleted.

    Only dates with a hit are rewritten, from a copy in ``scratch``, and swapped in by
    dynamic partition overwrite; a date losing all its documents is written empty.
    """
    docs = spark.read.parquet(path)
    hits = docs.where(condition)
    n = hits.count()
    if n == 0:
        return 0
    dates = hits.select("date").distinct()
    touched = docs.join(dates, "date", "left_semi")
    without(touched, condition).write.mode("overwrite").partitionBy("date").parquet(scratch)
    kept = spark.read.schema(docs.schema).parquet(scratch)
    # at most one entry per calendar day; asked before the files behind it are replaced
    emptied = [r["date"] for r in dates.join(kept.select("date").distinct(), "date", "left_anti").collect()]
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    nothing = spark.createDataFrame([], docs.drop("date").schema)
    for day in emptied:
        nothing.write.mode("overwrite").parquet(f"{path}/date={day}")
    return n

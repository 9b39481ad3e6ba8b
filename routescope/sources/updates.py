"""Update dumps: text lines to typed rows, file listings, coverage and validity."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routescope.functions import paths as P
from routescope.functions import times as T

# Fixed order of the dump's fields.
COLUMNS = (
    "record_type", "timestamp", "aw", "peer_ip", "peer_as", "prefix", "as_path", "origin", "next_hop",
    "local_pref", "med", "communities", "atomic_aggregate", "aggregator", "unknown",
)
FEWEST_FIELDS = 6
STEP = 300


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, seq) of plain or gzipped dumps.

    ``seq`` names a line by file, offset of the block it was read in, and place in that
    block, so it is unique and sorts as the file does however the file was split.
    """
    lines = spark.read.text(path)
    return lines.select(
        "value",
        F.col("_metadata.file_name").alias("file"),
        F.format_string(
            "%s:%015d:%011d",
            F.col("_metadata.file_name"),
            F.col("_metadata.file_block_start"),
            F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1),
        ).alias("seq"),
    )


def split_fields(lines: DataFrame, announcements_only: bool = False) -> DataFrame:
    """The fifteen fields as text; short lines are filled with '', long ones cut, and
    lines of fewer than six fields dropped."""
    if announcements_only:
        lines = lines.where(F.contains("value", F.lit("|A|")))
    parts = lines.withColumn("_p", F.split(F.trim("value"), r"\|")).where(F.size("_p") >= FEWEST_FIELDS)
    fields = [F.coalesce(F.get("_p", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(COLUMNS)]
    kept = [n for n in lines.columns if n != "value"]
    return parts.select(*kept, *fields)


def _blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def typed(fields: DataFrame) -> DataFrame:
    """Typed updates as the operators take them; unreadable lines are dropped."""
    hops = P.collapse_prepends(P.parse_path(F.col("as_path")))
    rows = fields.where("record_type = 'BGP4MP'").withColumns(
        {
            "ts": T.parse_time(F.col("timestamp")),
            "_peer": _blank_to_null(F.col("peer_as")),
            "prefix": _blank_to_null(F.col("prefix")),
            "hops": hops,
            "local_pref": F.col("local_pref").try_cast("int"),
            "med": F.col("med").try_cast("int"),
        }
    ).withColumn("peer_as", F.col("_peer").try_cast("bigint"))
    good = rows.where(F.col("ts").isNotNull() & (F.col("_peer").isNull() | F.col("peer_as").isNotNull()))
    return good.withColumns(
        {"origin_as": P.origin(F.col("hops")), "date": F.col("ts").cast("date")}
    ).drop("_peer", "timestamp", "unknown")


def read_updates(spark: SparkSession, path: str, announcements_only: bool = False) -> DataFrame:
    return typed(split_fields(read_lines(spark, path), announcements_only))


def ingest(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Dumps to a table by date, ranged by time so that a busy date is spread over files.

    Run it before operators that read the updates more than once: a line's ``seq`` depends
    on how a scan packed the files, and is fixed once written.
    """
    rows = read_updates(spark, path)
    rows.repartitionByRange("ts", "seq").sortWithinPartitions("ts", "seq").write.mode("append").partitionBy("date").parquet(out)
    return spark.read.parquet(out)


def scan(updates: DataFrame, start: str, end: str) -> DataFrame:
    """Updates from the five-minute mark before ``start`` to ``end`` (ISO texts).

    The dates are asked for beside the times, so that whole partitions are skipped.
    """
    lo, hi = datetime.fromisoformat(start), datetime.fromisoformat(end)
    lo = lo.replace(minute=lo.minute - lo.minute % (STEP // 60), second=0, microsecond=0)
    return updates.where(
        F.col("date").between(F.lit(lo.date()), F.lit(hi.date()))
        & (F.col("ts") >= F.lit(str(lo)).cast("timestamp_ntz"))
        & (F.col("ts") <= F.lit(str(hi)).cast("timestamp_ntz"))
    )


def file_time(name: Column) -> Column:
    """Start of the five minutes a dump file covers, from its name."""
    stamp = F.regexp_extract(name, r"(\d{8})\.(\d{4})", 0)
    return F.try_to_timestamp(stamp, F.lit("yyyyMMdd.HHmm")).cast("timestamp_ntz")


def archive_range(files: DataFrame, start: str, end: str) -> DataFrame:
    """Files of the window and the one before its start, across months."""
    listed = files.withColumn("file_time", file_time(F.col("name"))).where("file_time IS NOT NULL")
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    before = listed.where(F.col("file_time") < lo).agg(F.max("file_time")).scalar()
    return listed.where((F.col("file_time") >= F.coalesce(before, lo)) & (F.col("file_time") <= hi))


def coverage(windows: DataFrame, files: DataFrame, pre_days: int = 7, post_days: int = 0, step: int = STEP) -> DataFrame:
    """(event_name, file_time, present): every file an event needs and whether it is there."""
    lo = T.bucket_seconds(F.col("start") - F.expr(f"INTERVAL {int(pre_days)} DAYS"), step)
    hi = T.seconds(F.col("end") + F.expr(f"INTERVAL {int(post_days)} DAYS"))
    wanted = windows.select("event_name", F.explode(F.sequence(lo, hi, F.lit(step).cast("bigint"))).alias("t"))
    have = files.select(T.seconds(file_time(F.col("name"))).alias("t"), F.lit(True).alias("hit")).distinct()
    return wanted.join(have, "t", "left").select(
        "event_name", T.from_seconds(F.col("t")).alias("file_time"), F.coalesce("hit", F.lit(False)).alias("present")
    )


def undecoded(raw: DataFrame, decoded: DataFrame) -> DataFrame:
    """Raw files without a decoded twin of the same stem."""

    def stem(name: Column) -> Column:
        return F.regexp_replace(name, r"\.(gz|txt|bz2)$", "")

    done = decoded.select(stem(F.col("name")).alias("stem")).distinct()
    return raw.withColumn("stem", stem(F.col("name"))).join(done, "stem", "left_anti").select("name")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content, length) of the files of a folder.

    A scan leaves empty files out, so the folder's listing, one name per file, goes beside it.
    """
    files = spark.read.format("binaryFile").load(path)
    names = spark.createDataFrame([(p.rsplit("/", 1)[-1],) for p in files.inputFiles()], "name string")
    read = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content", "length")
    nothing = F.to_binary(F.lit(""), F.lit("utf-8"))
    return names.join(read, "name", "left").select(
        "name", F.coalesce("content", nothing).alias("content"), F.coalesce("length", F.lit(0).cast("bigint")).alias("length")
    )


def audit(files: DataFrame, smallest: int = 1) -> DataFrame:
    """(name, length, status): empty, too_small, not_gzip or valid. Nothing is deleted."""
    magic = F.hex(F.substring("content", F.lit(1), F.lit(2)))
    status = (
        F.when(F.col("length") == 0, "empty")
        .when(F.col("length") < smallest, "too_small")
        .when(magic != "1F8B", "not_gzip")
        .otherwise("valid")
    )
    return files.select("name", "length", status.alias("status"))


def audit_totals(audited: DataFrame) -> DataFrame:
    return audited.groupBy("status").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))

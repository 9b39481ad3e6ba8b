"""Dump files of five minutes each, written and read by tasks, as a data source.

A folder of dumps holds a folder for each day, ``20240107``, and in it files such as
``updates.20240107.1335.p00003.txt.gz``; a busy five minutes may have several parts. The source ``route_dumps``
gives their lines with the file's start, ``file_time``. Comparisons of ``file_time`` are pushed into
it: days and hours outside are never listed, and files outside never opened. The driver sees the names
of day folders only; a task lists the files of one hour.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)

from routescope.functions import times as T
from routescope.session import qualified, ship_package
from routescope.sources import updates as U

STEP = timedelta(seconds=U.STEP)
SCHEMA = "value string, file string, line bigint, file_time timestamp_ntz"
_BLOCK = 1 << 22


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a qualified path."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def stamp_of(name: str) -> datetime | None:
    """Start of the five minutes of a dump file, from its name."""
    parts = name.split(".")
    try:
        return datetime.strptime(f"{parts[1]}.{parts[2]}", "%Y%m%d.%H%M")
    except (IndexError, ValueError):
        return None


def lines_of(updates: DataFrame) -> DataFrame:
    """(stamp, seq, value): updates as dump lines with the name of their five minutes."""
    have = set(updates.columns)
    given = {"record_type": F.lit("BGP4MP"), "timestamp": T.text(F.col("ts")), "aw": F.col("aw"), "peer_ip": F.col("peer_ip")}
    fields = [given.get(n, F.col(n) if n in have else F.lit("")) for n in U.COLUMNS[:-1]]
    value = F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])
    return updates.select(F.date_format(T.bucket_start(F.col("ts")), "yyyyMMdd.HHmm").alias("stamp"), "seq", value.alias("value"))


def write(updates: DataFrame, folder: str, compressed: bool = True) -> DataFrame:
    """Writes the updates under ``folder``; (file, lines) of what was written.

    Tasks take ranges of time, so a busy five minutes is spread over several and has as many parts.
    A file appears under its name when it is whole; a task run again replaces its own files."""
    spark = updates.sparkSession
    root = qualified(spark, folder)
    ordered = lines_of(updates).repartitionByRange("stamp", "seq").sortWithinPartitions("stamp", "seq")
    numbered = ordered.select("stamp", "value", F.spark_partition_id().alias("part"))

    def run(batches):
        where, base = place(root)
        out, stamp, count, final, mine = None, None, 0, "", ""

        def ended():
            out.close()
            where.move(f"{base}/{mine}", f"{base}/{final}")
            return pa.RecordBatch.from_arrays([pa.array([final]), pa.array([count], pa.int64())], ["file", "lines"])

        for batch in batches:
            if not batch.num_rows:
                continue
            stamps, values = batch.column("stamp").to_pylist(), batch.column("value").to_pylist()
            part, lo = batch.column("part")[0].as_py(), 0
            while lo < len(stamps):
                if stamps[lo] != stamp:
                    if out is not None:
                        yield ended()
                    stamp, count = stamps[lo], 0
                    final = f"{stamp[:8]}/updates.{stamp}.p{part:05d}.txt" + ".gz" * compressed
                    mine = f"{stamp[:8]}/_writing-{uuid.uuid4().hex}"
                    where.create_dir(f"{base}/{stamp[:8]}", recursive=True)
                    out = where.open_output_stream(f"{base}/{mine}", compression="gzip" if compressed else None)
                hi = lo
                while hi < len(stamps) and stamps[hi] == stamp:
                    hi += 1
                out.write(("\n".join(values[lo:hi]) + "\n").encode())
                count, lo = count + hi - lo, hi
        if out is not None:
            yield ended()

    ship_package(spark)
    manifest = f"{folder.rstrip('/')}/_files"
    numbered.mapInArrow(run, "file string, lines bigint").write.mode("overwrite").parquet(manifest)
    return spark.read.parquet(manifest)


@dataclass
class Hour(InputPartition):
    """The files of one hour, or none; of those the ones that start from ``first`` to ``last``."""

    hour: datetime | None
    first: datetime
    last: datetime


class _Reader(DataSourceReader):
    def __init__(self, path: str, first: datetime, last: datetime) -> None:
        self.path, self.first, self.last = path, first, last

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        tick = timedelta(microseconds=1)
        for f in filters:
            value = getattr(f, "value", None)
            if f == IsNotNull(("file_time",)):
                continue  # it never is
            if getattr(f, "attribute", None) != ("file_time",) or not isinstance(value, datetime):
                yield f
                continue
            if isinstance(f, (GreaterThanOrEqual, GreaterThan, EqualTo)):
                self.first = max(self.first, value + tick * isinstance(f, GreaterThan))
            if isinstance(f, (LessThanOrEqual, LessThan, EqualTo)):
                self.last = min(self.last, value - tick * isinstance(f, LessThan))
            if not isinstance(f, (GreaterThanOrEqual, GreaterThan, EqualTo, LessThanOrEqual, LessThan)):
                yield f

    def partitions(self) -> list[Hour]:
        where, base = place(self.path)
        names = [i.base_name for i in where.get_file_info(fs.FileSelector(base, allow_not_found=True)) if i.type == fs.FileType.Directory]
        days = sorted(datetime.strptime(n, "%Y%m%d") for n in names if n.isdigit() and len(n) == 8)
        hours = [day + timedelta(hours=h) for day in days if self.first.date() <= day.date() <= self.last.date() for h in range(24)]
        hour = timedelta(hours=1)
        return [Hour(h, self.first, self.last) for h in hours if h + hour > self.first and h <= self.last] or [Hour(None, self.first, self.last)]

    def read(self, partition: Hour) -> Iterator[pa.RecordBatch]:
        if partition.hour is None:
            return
        where, base = place(self.path)
        day, hour = f"{partition.hour:%Y%m%d}", f"{partition.hour:%Y%m%d.%H}"
        for info in sorted(where.get_file_info(fs.FileSelector(f"{base}/{day}")), key=lambda i: i.base_name):
            stamp = stamp_of(info.base_name)
            if stamp is None or not info.base_name.startswith(f"updates.{hour}") or not partition.first <= stamp <= partition.last or not info.size:
                continue
            kind = "gzip" if info.base_name.endswith(".gz") else None
            with where.open_input_stream(info.path, compression=kind) as stream:
                yield from _lines(stream, info.base_name, stamp)


def _lines(stream, name: str, stamp: datetime) -> Iterator[pa.RecordBatch]:
    rest, count, more = b"", 0, True
    while more:
        block = stream.read(_BLOCK)
        more = bool(block)
        whole, _, rest = (rest + block).rpartition(b"\n") if more else (rest, b"", b"")
        if not whole:
            continue
        values = whole.decode("utf-8", "replace").split("\n")
        n = len(values)
        yield pa.RecordBatch.from_arrays(
            [pa.array(values, pa.string()), pa.array([name] * n, pa.string()), pa.array(range(count, count + n), pa.int64()),
             pa.array([stamp] * n, pa.timestamp("us"))], ["value", "file", "line", "file_time"])
        count += n


class Dumps(DataSource):
    """``spark.read.format("route_dumps").load(folder)``; the options ``first`` and ``last`` (ISO) bound the files' starts."""

    @classmethod
    def name(cls) -> str:
        return "route_dumps"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        first, last = self.options.get("first"), self.options.get("last")
        return _Reader(self.options["path"], datetime.fromisoformat(first) if first else datetime(1900, 1, 1), datetime.fromisoformat(last) if last else datetime(9999, 1, 1))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(value, file, line, file_time) of all dumps of a folder; conditions on ``file_time`` are pushed into the scan."""
    ship_package(spark)
    spark.dataSource.register(Dumps)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("route_dumps").load(qualified(spark, folder))


def read_updates(spark: SparkSession, folder: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Typed updates of the dumps that cover ``start`` to ``end``: from the file that holds ``start`` on.

    A line's ``seq`` is its file and place in it; it sorts as the files do."""
    lines = read(spark, folder)
    if start is not None:
        at = datetime.fromisoformat(start)
        lines = lines.where(F.col("file_time") >= F.lit(at - (at - datetime.min) % STEP).cast("timestamp_ntz"))
    if end is not None:
        lines = lines.where(F.col("file_time") <= F.lit(datetime.fromisoformat(end)).cast("timestamp_ntz"))
    named = lines.select("value", F.format_string("%s:%011d", "file", "line").alias("seq"))
    rows = U.typed(U.split_fields(named))
    if end is not None:
        rows = rows.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return rows


def audit(spark: SparkSession, folder: str, smallest: int = 1) -> DataFrame:
    """(name, length, status) of every file, by ``updates.audit``; tasks list one day each and read two bytes a file."""
    root = qualified(spark, folder)
    where, base = place(root)
    days = [i.base_name for i in where.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.Directory and i.base_name.isdigit()]

    def run(batches):
        where, base = place(root)
        for batch in batches:
            for day in batch.column("day").to_pylist():
                infos = [i for i in where.get_file_info(fs.FileSelector(f"{base}/{day}")) if stamp_of(i.base_name) is not None]
                marks = []
                for i in infos:
                    with where.open_input_file(i.path) as f:
                        marks.append(f.read(2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i.base_name for i in infos], pa.string()), pa.array(marks, pa.binary()), pa.array([i.size for i in infos], pa.int64())],
                    ["name", "content", "length"])

    ship_package(spark)
    listed = spark.createDataFrame([(d,) for d in sorted(days)], "day string")
    return U.audit(listed.repartition(max(1, len(days)), "day").mapInArrow(run, "name string, content binary, length bigint"), smallest)

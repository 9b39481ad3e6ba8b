"""Rows that streams dropped behind their watermark, stored as each batch ends.

A query reports its progress to a listener of its session; what a batch dropped becomes a small
file named after the batch, so the count covers all batches, those before a restart
included, and a batch run again after a failure counts once. Queries are told apart by name.
"""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


@dataclass
class _Watched:
    folder: str
    ended: threading.Event = field(default_factory=threading.Event)
    failure: Exception | None = None


class _Listener(StreamingQueryListener):
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.by_name: dict[str, _Watched] = {}
        self.by_run: dict[str, _Watched] = {}

    def onQueryStarted(self, event) -> None:
        if event.name in self.by_name:
            self.by_run[str(event.runId)] = self.by_name[event.name]

    def onQueryProgress(self, event) -> None:
        run = self.by_run.get(str(event.progress.runId))
        if run is None:
            return
        try:
            dropped = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
            if dropped:
                _put(self.spark, f"{run.folder}/{event.progress.batchId:012d}", str(dropped))
        except Exception as ex:  # raised where the count is asked for
            run.failure = ex

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = self.by_run.get(str(event.runId))
        if run is not None:
            run.ended.set()


_listeners: dict[str, _Listener] = {}


def _put(spark: SparkSession, path: str, text: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def _there(spark: SparkSession, folder: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def watched(spark: SparkSession, folder: str) -> str:
    """The name under which a query's late rows go to ``folder``."""
    app = spark.sparkContext.applicationId
    if app not in _listeners:
        _listeners[app] = _Listener(spark)
        spark.streams.addListener(_listeners[app])
    name = f"late-{uuid.uuid4().hex}"
    _listeners[app].by_name[name] = _Watched(folder)
    return name


def late_rows(query: StreamingQuery, patience: float = 60.0) -> int:
    """Rows dropped so far by a query of ``run_to_table``; of an ended one, when its last report is in.

    A windowed count combines rows before it drops them, and counts what is left of them."""
    listener = next(x for x in _listeners.values() if query.name in x.by_name)
    run = listener.by_name[query.name]
    if not query.isActive and not run.ended.wait(patience):
        raise RuntimeError("the query's end was not reported")
    if run.failure is not None:
        raise run.failure
    if not _there(listener.spark, run.folder):
        return 0
    return listener.spark.read.text(run.folder).agg(F.coalesce(F.sum(F.col("value").cast("bigint")), F.lit(0))).first()[0]

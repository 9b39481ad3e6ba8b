"""Route state of each (target, prefix), kept across micro-batches by keyed state.

A prefix remembers its last message that changed the route, and the origin of its last path. Prefixes of a
target are kept in ``groups`` by a digest, a group being one value of the state store: a call to the store
costs far more than a message, so it is made once for a group, not for a prefix. Only groups with new messages
are read and written. The processor puts what was there before beside each message; how the
message changes it is said by the batch operator's own expressions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from routescope.functions import paths as P
from routescope.operators import features
from routescope.session import ship_package

CHANGES = ("dup_a", "ori_change", "longer", "shorter", "new_after_w", "dup_w")
GROUPS = 128  # of a target's prefixes
_MEMORY = "held string"  # by prefix: aw, as_path, asns, origin, when to forget it
_INPUT = "target string, part int, prefix string, seq {seq}, ts timestamp, aw string, as_path string, asns array<string>, has_path boolean, origin string"
_BEFORE = ", p_aw string, p_path string, p_asns array<string>, prev_origin string"
_NAMES = [n.strip().split(" ")[0] for n in (_INPUT + _BEFORE).split(",")]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Remember(StatefulProcessor):
    """Messages of a group in the order of their time, each with its prefix's state before it.

    A group's messages of one batch are held together to be sorted; a batch is bounded by its files.
    With ``ttl`` (milliseconds of event time) a prefix silent for so long is forgotten by a timer, one
    for the group's next prefix to forget."""

    def __init__(self, ttl: int | None = None) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", _MEMORY)

    def _held(self) -> dict[str, list]:
        held = self.memory.get()
        return json.loads(held[0]) if held is not None else {}

    def _wake(self, known: dict[str, list]) -> None:
        due = min((v[4] for v in known.values() if v[4] is not None), default=None)
        if due is not None and due not in set(self.handle.listTimers()):
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, changed, last = self._held(), False, {}
        named = Row(*_NAMES)
        for r in sorted(rows, key=lambda r: (r.ts, r.seq)):
            name = json.dumps(r.prefix)  # a null prefix is a key of its own
            seen = last.get(name)
            last[name] = (r.seq, r.ts)
            if seen is not None and seen[0] == r.seq:  # a message that touches several ASes of the target
                continue
            aw, path, asns, origin, due = known.get(name, (None, None, None, None, None))
            yield named(*r, aw, path, asns, origin)
            if r.has_path or r.aw == "W":
                origin = r.origin if r.has_path and r.origin is not None else origin
                known[name], changed = [r.aw, r.as_path, r.asns, origin, due], True
        if self.ttl is not None:
            for name, (_, ts) in last.items():
                if name in known:
                    known[name][4], changed = int(ts.timestamp() * 1000) + self.ttl, True
        if changed:
            self.memory.update((json.dumps(known),))
        if self.ttl is not None:
            self._wake(known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        known = {k: v for k, v in self._held().items() if v[4] is None or v[4] > now}
        if known:
            self.memory.update((json.dumps(known),))
            self._wake(known)
        else:
            self.memory.clear()
        return iter(())

    def close(self) -> None:
        pass


def touching(updates: DataFrame, targets: DataFrame, columns: list[str] = features.FEATURE_INPUT) -> DataFrame:
    """Updates of a stream with each target they concern; once for each AS of the target they touch."""
    touched = updates.select(*columns, F.explode(P.touched_asns(F.col("peer_as"), F.col("hops"))).alias("asn"))
    return touched.join(targets.select("target", "asn").distinct(), "asn").select("target", *columns)


def route_changes(rows: DataFrame, ttl_days: int | None = None, delay: str = "10 minutes", groups: int = GROUPS) -> DataFrame:
    """(target, prefix, seq, edit, flags) of each message of a stream of (target, FEATURE_INPUT).

    Messages are taken batch by batch, in the order of (ts, seq) within a batch. Prefixes silent for
    ``ttl_days`` are forgotten, none by default, as in the batch operator; then late rows are dropped.
    A stream keeps the ``groups`` it was started with."""
    seq = rows.schema["seq"].dataType.simpleString()
    known = features.state_of(rows.withColumn("ts", F.col("ts").cast("timestamp")))
    part = F.pmod(F.xxhash64("prefix"), F.lit(groups)).cast("int")
    given = known.withColumn("part", part).select(*[n.strip().split(" ")[0] for n in _INPUT.split(",")])
    ttl, mode = None, "None"
    if ttl_days is not None:
        given, ttl, mode = given.withWatermark("ts", delay), int(ttl_days) * 86_400_000, "EventTime"
    ship_package(rows.sparkSession)
    before = given.groupBy("target", "part").transformWithState(
        Remember(ttl), (_INPUT + _BEFORE).format(seq=seq), "Append", mode)
    prev = F.when(F.col("p_aw").isNotNull(), F.struct(F.col("p_aw").alias("aw"), F.col("p_path").alias("as_path"), F.col("p_asns").alias("asns")))
    return features.change_flags(before.withColumn("prev", prev)).select("target", "prefix", "seq", "edit", *CHANGES)


def route_state(rows: DataFrame, folder: str, ttl_days: int | None = None) -> StreamingQuery:
    """``route_changes`` appended to ``folder``/table, all that is there now."""
    spark = rows.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)  # keyed state lives in this store only; a query keeps the value it starts with
    try:
        return route_changes(rows, ttl_days).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/table").option(
            "checkpointLocation", f"{folder}/checkpoint"
        ).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)

"""Which updates concern which target set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routescope.functions import paths as P
from routescope.functions import times as T
from routescope.operators.features import cut_busy


def relevant_updates(
    updates: DataFrame, targets: DataFrame, columns: list[str], bucket: int | None = None,
    in_order: bool = False, busy: DataFrame | None = None, piece: int = 300, spread: int | None = None,
) -> DataFrame:
    """``columns`` of every update with each target it concerns, once.

    An update concerns a target when its peer or a hop is one of the target's ASes. Only
    AS numbers and the wanted columns travel.

    With ``bucket`` (seconds, added as a column) or ``in_order`` the rows come spread and
    sorted the way route state needs them, by target and prefix (and bucket); repeats are
    neighbours there, so removing them takes no shuffle and no sort of its own. Prefixes
    listed in ``busy`` are spread by pieces of time as well, so that a prefix with a third
    of all rows fills no task however long its history.

    With ``bucket`` and ``spread`` the updates themselves are dealt by bucket to so many tasks, before they are listed
    under targets; what follows needs no other shuffle, up to one row per target and bucket. A bucket is then
    the work of one task, so ask ``bucket_tasks`` first.
    """
    if bucket is not None and spread is not None:
        updates = updates.withColumn("bucket", T.bucket_seconds(F.col("ts"), bucket)).repartition(spread, "bucket")
        columns = [*columns, "bucket"]
    touched = updates.select(
        *columns, F.explode(P.touched_asns(F.col("peer_as"), F.col("hops"))).alias("asn")
    )
    rows = touched.join(targets.select("target", "asn").distinct(), "asn").select("target", *columns)
    if bucket is None and not in_order:
        return rows.dropDuplicates(["target", "seq"])
    place = ["target", "prefix"]
    if bucket is not None:
        if spread is None:
            rows = rows.withColumn("bucket", T.bucket_seconds(F.col("ts"), bucket))
        place = [*place, "bucket"]
    if busy is not None and not busy.isEmpty():
        rows = cut_busy(rows, busy, piece)
        place = [*place, "_piece"]
    before = F.lag("seq").over(Window.partitionBy(*place).orderBy("ts", "seq"))
    return rows.withColumn("_same", before.eqNullSafe(F.col("seq"))).where(~F.col("_same")).drop("_same")

"""Where results go: JSON, CSV and text folders, written in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_features(table: DataFrame, path: str) -> None:
    """The per-event feature table as CSV with a header."""
    table.write.mode("overwrite").csv(path, header=True)


def path_count_lines(counts: DataFrame) -> DataFrame:
    """``a|b|c n`` lines; a count of one is left out."""
    return counts.select(
        F.when(F.col("n") > 1, F.concat_ws(" ", "path", F.col("n").cast("string"))).otherwise(F.col("path")).alias("value")
    )


def probability_lines(probs: DataFrame) -> DataFrame:
    """``a|b|p2c|p2p|c2p`` lines."""
    return probs.select(F.concat_ws("|", "as1", "as2", *[F.col(n).cast("string") for n in ("p2c", "p2p", "c2p")]).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def alert_documents(alerts: DataFrame) -> DataFrame:
    """One JSON text per alert, lists and nested links included."""
    return alerts.select(F.to_json(F.struct("*")).alias("value"))

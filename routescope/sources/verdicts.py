"""Tables of earlier verdicts: upsert, expiry, newest rows, statistics, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keys of the two verdict tables.
FREQUENCY_KEY = ("fake_connection", "date_str")
PAIR_KEY = ("as1", "as2", "date_str", "asrel_hash")


def upsert(existing: DataFrame, new: DataFrame, key: tuple[str, ...], updated: str = "updated_at") -> DataFrame:
    """One row per key: the latest by ``updated``, the new one on a tie.

    Kept by aggregation, which combines before the shuffle, not by ranking a key's rows.
    """
    rows = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [n for n in existing.columns if n not in key]
    latest = F.max_by(F.struct(*rest), F.struct(F.col(updated), F.col("_new")))
    return rows.groupBy(*key).agg(latest.alias("v")).select(*key, "v.*")


def upsert_table(spark: SparkSession, path: str, new: DataFrame, key: tuple[str, ...], scratch: str, updated: str = "updated_at") -> None:
    """Upsert into a table written by ``date_str``; only the dates of ``new`` are rewritten.

    The merged dates are written to ``scratch`` first, because they are read from the files
    they replace.
    """
    touched = spark.read.parquet(path).withColumn("date_str", F.col("date_str").cast("string")).join(
        new.select("date_str").distinct(), "date_str", "left_semi"
    )
    merged = upsert(touched.select(*new.columns), new, key, updated)
    merged.write.mode("overwrite").parquet(scratch)
    store(spark.read.parquet(scratch), path, "overwrite")


def store(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write verdicts by date; overwriting replaces only the dates present."""
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("date_str").parquet(path)


def expire(rows: DataFrame, now: Column, days: int = 30, updated: str = "updated_at") -> DataFrame:
    """Rows updated within the last ``days`` days."""
    return rows.where(F.col(updated) >= now - F.expr(f"INTERVAL {int(days)} DAYS"))


def newest(rows: DataFrame, n: int, updated: str = "updated_at", tie: tuple[str, ...] = ()) -> DataFrame:
    return rows.orderBy(F.desc(updated), *tie).limit(n)


def pair_statistics(pairs: DataFrame) -> DataFrame:
    """Total, fake, legitimate, and how many dates and relationship versions."""
    return pairs.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("is_fake")).alias("fake"),
        F.count_if(~F.col("is_fake")).alias("legitimate"),
        F.count_distinct("date_str").alias("dates"),
        F.count_distinct("asrel_hash").alias("versions"),
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of several tables."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)

"""Reference files: relationships, organisations, prefix owners, probabilities, path counts.

``parse_*`` take lines in ``value``; the readers add the file scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routescope.functions import text as W


def _data(lines: DataFrame) -> DataFrame:
    return lines.where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))


def _field(i: int) -> Column:
    return F.get("p", F.lit(i))


def parse_asrel(lines: DataFrame) -> DataFrame:
    """``a|b|rel``: -1 means a provides b, 0 that they are peers."""
    p = _data(lines).select(F.split(F.trim("value"), r"\|").alias("p")).where(F.size("p") >= 3)
    return p.select(
        W.normalise_asn(_field(0)).alias("as1"), W.normalise_asn(_field(1)).alias("as2"), _field(2).try_cast("int").alias("rel")
    ).where("rel IN (-1, 0)")


def parse_asorg(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aut, org) from the two layouts of the file: six fields name an AS, five an organisation."""
    p = _data(lines).select(F.split("value", r"\|").alias("p"))
    aut = p.where(F.size("p") >= 6).select(
        W.normalise_asn(_field(0)).alias("asn"), _field(2).alias("aut_name"), _field(3).alias("org_id")
    )
    org = p.where(F.size("p") == 5).select(
        _field(0).alias("org_id"), _field(1).alias("changed"), _field(2).alias("name"), _field(3).alias("country"), _field(4).alias("source")
    )
    return aut, org


def parse_prefix2as(lines: DataFrame) -> DataFrame:
    """``ip length as1_as2``: the first AS counts; repeats of a prefix keep their order.

    Lines carry ``seq``, which orders the owners of a prefix.
    """
    p = _data(lines).select("seq", F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= 3)
    return p.select(
        F.concat(_field(0), F.lit("/"), _field(1)).alias("prefix"),
        F.col("seq").alias("ord"),
        F.split(_field(2), "[_,]")[0].alias("origin"),
    )


def parse_asprob(lines: DataFrame) -> DataFrame:
    """``a|b|p2c|p2p|c2p`` keyed by string order of the ends; the last line of a link holds.

    Lines carry ``seq``.
    """
    p = _data(lines).select("seq", F.split(F.trim("value"), r"\|").alias("p")).where(F.size("p") >= 5)
    rows = p.select(
        "seq", _field(0).alias("as1"), _field(1).alias("as2"),
        *[_field(i).try_cast("double").alias(n) for i, n in ((2, "p2c"), (3, "p2p"), (4, "c2p"))],
    ).where("p2c IS NOT NULL AND p2p IS NOT NULL AND c2p IS NOT NULL")
    # flip each line first: a link may be listed from either end
    flip = F.col("as1") > F.col("as2")
    keyed = rows.select(
        "seq", F.least("as1", "as2").alias("as1"), F.greatest("as1", "as2").alias("as2"),
        F.when(flip, F.col("c2p")).otherwise(F.col("p2c")).alias("p2c"), "p2p",
        F.when(flip, F.col("p2c")).otherwise(F.col("c2p")).alias("c2p"),
    )
    last = keyed.groupBy("as1", "as2").agg(F.max_by(F.struct("p2c", "p2p", "c2p"), "seq").alias("v"))
    return last.select("as1", "as2", "v.*")


def parse_path_counts(lines: DataFrame) -> DataFrame:
    """``a|b|c [n]``, n being 1 when left out; repeats of a path add up."""
    p = _data(lines).select(F.split(F.trim("value"), r"\s+").alias("p"))
    rows = p.select(F.split(_field(0), r"\|").alias("path"), F.coalesce(_field(1).try_cast("bigint"), F.lit(1)).alias("n"))
    return rows.groupBy("path").agg(F.sum("n").alias("n"))


def read_asrel(spark: SparkSession, path: str) -> DataFrame:
    return parse_asrel(spark.read.text(path))


def read_asorg(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_asorg(spark.read.text(path))


def read_prefix2as(spark: SparkSession, path: str) -> DataFrame:
    from routescope.sources.updates import read_lines

    return parse_prefix2as(read_lines(spark, path))


def read_asprob(spark: SparkSession, path: str) -> DataFrame:
    from routescope.sources.updates import read_lines

    return parse_asprob(read_lines(spark, path))


def read_path_counts(spark: SparkSession, path: str) -> DataFrame:
    return parse_path_counts(spark.read.text(path))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Event catalogue from CSV with a header; incomplete rows are dropped."""
    from routescope.functions.times import parse_time

    raw = spark.read.csv(path, header=True)
    rows = raw.select(
        "event_type", "event_name", "outage_as",
        parse_time(F.col("start_time")).alias("start"), parse_time(F.col("end_time")).alias("end"),
    )
    blank = F.coalesce(F.trim("event_type"), F.lit("")) == ""
    return rows.where(~blank & (F.trim("event_name") != "") & F.col("start").isNotNull() & F.col("end").isNotNull())


def relationship_version(edges: DataFrame) -> DataFrame:
    """One digest of the edge set, the same whatever the order of its rows.

    Edges are hashed one by one and the hashes added, so nothing is gathered.
    """
    text = F.concat_ws("|", "as1", "as2", F.col("rel").cast("string"))
    word = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(38,0)")
    return edges.distinct().agg(F.count("*").alias("n"), F.sum(word).cast("string").alias("s")).select(
        "n", F.md5(F.concat_ws("|", F.col("n").cast("string"), "s")).alias("version")
    )



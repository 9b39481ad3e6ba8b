import gzip
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from routescope.functions import times as T
from routescope.session import qualified
from routescope.sources import documents as D
from routescope.sources import dumps as DU

COLUMNS = "seq bigint, s bigint, aw string, peer_ip string, peer_as bigint, prefix string, as_path string"
START = 1704067200  # 2024-01-01


def updates(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    return df.withColumn("ts", T.from_seconds(F.col("s") + START)).drop("s")


ROWS = [
    (1, 0, "A", "192.0.2.1", 1, "10.0.0.0/24", "1 2 3"), (2, 299, "W", "192.0.2.1", 1, "10.0.0.0/24", ""), (3, 300, "A", "2001:db8::1", 7, "2001:db8::/32", "7 7 8"),
    (4, 3599, "A", "192.0.2.1", 1, "10.0.0.0/24", "1 {4,5}"), (5, 86400 + 7200, "A", "192.0.2.1", 1, "é/24", "1 2"), (6, 10 * 86400, "A", "192.0.2.9", 4200000000, "10.0.1.0/24", "1"),
]


@pytest.mark.parametrize("compressed", [True, False])
def test_files_round_trip(spark, tmp_path, compressed):
    folder = str(tmp_path / "dumps")
    written = DU.write(updates(spark, ROWS), folder, compressed)
    assert sorted((r["file"].split("/")[1].split(".p")[0], r["lines"]) for r in written.collect()) == [
        ("updates.20240101.0000", 2), ("updates.20240101.0005", 1), ("updates.20240101.0055", 1), ("updates.20240102.0200", 1), ("updates.20240111.0000", 1)]
    got = DU.read_updates(spark, folder)
    columns = ["ts", "aw", "peer_ip", "peer_as", "prefix", "as_path"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, updates(spark, ROWS).select(*columns).collect()))
    assert got.select("seq").distinct().count() == len(ROWS)
    hops = {r["prefix"]: r["hops"] for r in got.collect()}
    assert hops["2001:db8::/32"] == ["7", "8"]
    assert not [p for p in (tmp_path / "dumps").rglob("_writing*")]


def test_conditions_on_file_times_prune_files(spark, tmp_path):
    folder = str(tmp_path / "dumps")
    DU.write(updates(spark, ROWS), folder).count()
    # a file that must not be opened
    (tmp_path / "dumps" / "20240103").mkdir()
    (tmp_path / "dumps" / "20240103" / "updates.20240103.0000.txt.gz").write_bytes(b"no gzip")
    (tmp_path / "dumps" / "20240101" / "notes.txt").write_text("no dump")
    (tmp_path / "dumps" / "20240101" / "updates.20240101.0100.txt.gz").write_bytes(b"")
    some = DU.read(spark, folder).where("file_time >= timestamp_ntz'2024-01-01 00:05:00' AND file_time < timestamp_ntz'2024-01-02 02:00:00'")
    assert sorted(r["file_time"] for r in some.collect()) == [datetime(2024, 1, 1, 0, 5), datetime(2024, 1, 1, 0, 55)]
    assert some.rdd.getNumPartitions() == 26  # the hours of two days asked for, of four days there
    assert ") Filter " not in some._jdf.queryExecution().executedPlan().toString()  # all of it was pushed down
    with pytest.raises(Exception):
        DU.read(spark, folder).count()
    got = DU.read_updates(spark, folder, "2024-01-01 00:03:00", "2024-01-01 00:59:00")
    assert sorted(r["seq"].split(".p")[0] for r in got.collect()) == ["updates.20240101.0000"] * 2 + ["updates.20240101.0005"]
    assert DU.read(spark, folder).where("file_time > timestamp_ntz'2030-01-01 00:00:00'").count() == 0
    assert DU.read(spark, folder).where("file_time = timestamp_ntz'2024-01-11 00:00:00' AND value LIKE '%4200000000%'").count() == 1


def test_a_busy_five_minutes_has_several_parts(spark, tmp_path):
    rows = [(i, i % 7, "A", "192.0.2.1", 1, "10.0.0.0/24", "1 2") for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        written = DU.write(updates(spark, rows), str(tmp_path / "dumps"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert written.count() > 1 and written.agg(F.sum("lines")).first()[0] == 3000
    assert DU.read_updates(spark, str(tmp_path / "dumps")).count() == 3000


def test_audit_of_files(spark, tmp_path):
    day = tmp_path / "dumps" / "20240101"
    day.mkdir(parents=True)
    (day / "updates.20240101.0000.txt.gz").write_bytes(gzip.compress(b"x" * 1000))
    (day / "updates.20240101.0005.txt.gz").write_bytes(b"plain text")
    (day / "updates.20240101.0010.txt.gz").write_bytes(b"")
    (day / "updates.20240101.0015.txt.gz").write_bytes(b"ab")
    (day / "other").write_bytes(b"ab")
    got = {r["name"][17:21]: (r["length"], r["status"]) for r in DU.audit(spark, str(tmp_path / "dumps"), 5).collect()}
    assert {k: s for k, (_, s) in got.items()} == {"0000": "valid", "0005": "not_gzip", "0010": "empty", "0015": "too_small"}
    assert got["0005"][0] == 10


def test_no_dumps(spark, tmp_path):
    (tmp_path / "dumps").mkdir()
    assert DU.read_updates(spark, str(tmp_path / "dumps")).count() == 0
    assert DU.write(updates(spark, []), str(tmp_path / "none")).count() == 0
    assert qualified(spark, "/x/y") == "file:/x/y"


def test_searches_by_postings_agree_and_prune(spark, tmp_path):
    rows = [(i, i * 1800, "AW"[i % 9 == 0], "192.0.2.1", i % 4, f"10.0.{i % 6}.0/24", " ".join(str((i * k) % 11) for k in (1, 3, 5))) for i in range(400)]
    docs = D.build(updates(spark, rows).withColumns({"origin_as": F.lit("1")}))
    D.write(docs, str(tmp_path / "docs"))
    D.write_postings(docs, str(tmp_path / "index"))
    stored, index = spark.read.parquet(str(tmp_path / "docs")), spark.read.parquet(str(tmp_path / "index"))
    when = ("2024-01-02 05:00:00", "2024-01-05 07:00:00")
    ids = lambda df: sorted(r["_id"] for r in df.collect())
    for given in ({"as_pairs": ["1-3", "2-6"]}, {"path_contains": ["4", "1"]}, {"prefix": "10.0.3.0/24"}, {"peer_as": "2", "path_contains": ["9"]}, {}):
        assert ids(D.search_indexed(stored, index, *when, **given)) == ids(D.search(stored, *when, **given)), given
    assert ids(D.search_indexed(stored, index, *when, path_contains=["7"], announced=True)) == ids(D.leak_candidates(stored, "7", *when))
    owned = spark.createDataFrame([("10.0.1.0/24",), ("10.0.1.0/24",)], "prefix string")
    assert ids(D.candidates_indexed(stored, index, "5", owned, *when)) == ids(D.hijack_candidates(stored, "5", owned, *when))
    plan = D.search_indexed(stored, index, *when, as_pairs=["1-3"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(date") >= 2 and "In(key" in plan.replace("EqualTo(key", "In(key")

import gzip

from pyspark.sql import functions as F

from routescope.functions import times as T
from routescope.operators import correlate as C
from routescope.sources import documents as D
from routescope.sources import reference as R
from routescope.sources import sinks as S
from routescope.sources import updates as U
from routescope.sources import verdicts as V


def lines(spark, *values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "value string, seq int")


def test_gzipped_dump_keeps_its_order(spark, tmp_path):
    text = "".join(f"BGP4MP|2024-01-01 00:00:{i:02d}|A|192.0.2.1|100|10.0.{i}.0/24|100 200|IGP\n" for i in range(40)) + "short|line\n"
    with gzip.open(tmp_path / "updates.20240101.0000.gz", "wt") as f:
        f.write(text)
    u = U.read_updates(spark, str(tmp_path))
    assert [r["prefix"] for r in u.orderBy("seq").collect()] == [f"10.0.{i}.0/24" for i in range(40)]
    assert u.select("seq").distinct().count() == 40
    kept = U.ingest(spark, str(tmp_path), str(tmp_path / "table"))
    assert U.scan(kept, "2024-01-01 00:00:30", "2024-01-01 00:00:35").count() == 36


def test_audit(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"x" * 100))
    (tmp_path / "b.gz").write_bytes(b"plain text, long enough")
    (tmp_path / "c.gz").write_bytes(b"")
    got = {r["name"]: r["status"] for r in U.audit(U.list_files(spark, str(tmp_path)), 10).collect()}
    assert got == {"a.gz": "valid", "b.gz": "not_gzip", "c.gz": "empty"}


def test_archive_range_takes_the_file_before(spark, rows):
    names = ["updates.20240131.2355.gz", "updates.20240201.0000.gz", "updates.20240201.0005.gz", "notes.txt"]
    files = spark.createDataFrame([(n,) for n in names], "name string")
    assert rows(U.archive_range(files, "2024-02-01 00:02:00", "2024-02-01 00:05:00"), "name") == [(n,) for n in names[1:3]]


def test_reference_files(spark, rows):
    assert rows(R.parse_asrel(lines(spark, "# note", "100|200|-1", "AS0200|300|0", "bad"))) == [("100", "200", -1), ("200", "300", 0)]
    aut, org = R.parse_asorg(lines(
        spark, "# format:aut|changed|aut_name|org_id|opaque_id|source", "AS0200|20240101|NET-TWO|ORG-2|x|RIR",
        "# format:org_id|changed|org_name|country|source", "ORG-2|20240101|Two Networks|NL|RIR"))
    assert rows(aut) == [("200", "NET-TWO", "ORG-2")]
    assert rows(org, "org_id", "country") == [("ORG-2", "NL")]
    p = R.parse_prefix2as(lines(spark, "10.0.0.0\t16\t300", "10.0.0.0  24  300_301"))
    assert rows(p, "prefix", "origin") == [("10.0.0.0/16", "300"), ("10.0.0.0/24", "300")]
    q = R.parse_asprob(lines(spark, "100|200|0.1|0.1|0.8", "300|200|0.2|0.1|0.7", "100|200|0.3|0.3|0.4"))
    assert rows(q) == [("100", "200", 0.3, 0.3, 0.4), ("200", "300", 0.7, 0.1, 0.2)]
    n = R.parse_path_counts(lines(spark, "100|200|300 5", "100|400", "100|400 2"))
    assert rows(n.select(F.array_join("path", " "), "n")) == [("100 200 300", 5), ("100 400", 3)]


def test_relationship_version_ignores_order(spark):
    e = [("1", "2", -1), ("2", "3", 0)]
    schema = "as1 string, as2 string, rel int"
    a = R.relationship_version(spark.createDataFrame(e, schema)).first()
    b = R.relationship_version(spark.createDataFrame(e[::-1] + e, schema)).first()
    c = R.relationship_version(spark.createDataFrame(e[:1], schema)).first()
    assert a == b and a != c


def _updates(spark, n=30):
    df = spark.range(n).withColumn("ts", T.from_seconds(F.col("id") * 7200))
    return df.select(
        F.col("id").alias("seq"), "ts", F.lit("A").alias("aw"), F.lit("192.0.2.1").alias("peer_ip"), (F.col("id") % 3).alias("peer_as"),
        F.lit("10.0.0.0/24").alias("prefix"), F.lit("1 2 3").alias("as_path"), F.lit("3").alias("origin_as"),
    )


def test_documents_written_and_deleted(spark, tmp_path):
    docs = D.build(_updates(spark).unionByName(_updates(spark)), "file.txt")
    assert docs.count() == 30
    path = str(tmp_path / "docs")
    D.write(docs, path)
    day = F.col("date") == F.lit("1970-01-02").cast("date")
    n = D.delete(spark, path, day | (F.col("peer_as") == "1"), str(tmp_path / "scratch"))
    left = spark.read.parquet(path)
    assert n + left.count() == 30
    assert left.where(day | (F.col("peer_as") == "1")).count() == 0
    assert D.search(left, "1970-01-01 00:00:00", "1970-01-03 12:00:00", as_pairs=["2-3"], path_contains=["1"]).count() > 0


def test_sinks(spark, tmp_path, rows):
    counts = spark.createDataFrame([("1|2", 1), ("1|3", 4)], "path string, n bigint")
    S.write_lines(S.path_count_lines(counts), str(tmp_path / "p"))
    back = R.read_path_counts(spark, str(tmp_path / "p"))
    assert rows(back.select(F.array_join("path", "|"), "n")) == [("1|2", 1), ("1|3", 4)]
    S.write_json(counts, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    V.export_csv(counts, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["path", "n"]


def test_catalogue_from_csv(spark, tmp_path):
    (tmp_path / "e.csv").write_text('event_type,event_name,start_time,end_time,outage_as\nhijack,demo,2024/01/01 00:00,2024-01-01 01:00:00,"AS100、200, as300"\noutage,,x,y,\n')
    got = R.read_catalogue(spark, str(tmp_path / "e.csv")).collect()
    assert len(got) == 1 and str(got[0]["end"]) == "2024-01-01 01:00:00"


def test_upsert_and_expiry(spark, rows):
    def t(values):
        return spark.createDataFrame(values, "k string, v int, s bigint").select("k", "v", T.from_seconds(F.col("s")).alias("updated_at"))

    both = V.upsert(t([("a", 1, 10), ("b", 2, 10)]), t([("a", 3, 10), ("c", 4, 5), ("b", 9, 1)]), ("k",))
    assert rows(both, "k", "v") == [("a", 3), ("b", 2), ("c", 4)]
    assert [r["v"] for r in V.newest(both, 2, tie=("k",)).collect()] == [3, 2]
    now = T.from_seconds(F.lit(86400 * 30 + 7))
    assert rows(V.expire(both, now, 30), "k") == [("a",), ("b",)]


def test_set_metrics(spark, rows):
    def m(*pairs):
        return spark.createDataFrame(pairs, "event_id string, member string")

    cases = spark.createDataFrame([("e",), ("none",), ("missed",)], "event_id string")
    got = C.set_metrics(m(("e", "a"), ("e", "b")), m(("e", "b"), ("e", "c"), ("missed", "x")), cases)
    assert rows(got, "event_id", "precision", "recall", "f1") == [("e", 0.5, 0.5, 0.5), ("missed", 0.0, 0.0, 0.0), ("none", 1.0, 1.0, 1.0)]


def test_upsert_into_a_written_table(spark, tmp_path, rows):
    def t(values):
        return spark.createDataFrame(values, "k string, date_str string, v int, s bigint").select(
            "k", "date_str", "v", T.from_seconds(F.col("s")).alias("updated_at"))

    path = str(tmp_path / "verdicts")
    V.store(t([("a", "2024-01-01", 1, 10), ("b", "2024-01-02", 2, 10)]), path)
    V.upsert_table(spark, path, t([("a", "2024-01-01", 7, 20), ("c", "2024-01-01", 3, 5)]), ("k", "date_str"), str(tmp_path / "scratch"))
    back = spark.read.parquet(path)
    assert rows(back, "k", "v") == [("a", 7), ("b", 2), ("c", 3)]


def test_sql_surface(spark):
    from routescope.plans import catalog, views  # noqa: F401

    folder = "/root/testdata/sf0.001"
    views.register_tables(spark, folder)
    views.register_query(spark, folder, "B5_origin_as")
    n = spark.sql("SELECT count(*) AS n FROM updates u JOIN B5_origin_as o ON o.seq = u.seq AND o.origin = u.origin_as").first()["n"]
    assert n == spark.sql("SELECT count(*) AS n FROM updates WHERE aw = 'A'").first()["n"] > 0


def test_documents_by_time_shuffle_short_rows_once(spark):
    twice = _updates(spark).unionByName(_updates(spark)).withColumn("peer_as", F.when(F.col("seq") % 5 > 0, F.col("peer_as")))
    ranged = D.build_by_time(twice, "file.txt")
    assert sorted(map(str, ranged.collect())) == sorted(map(str, D.build(twice, "file.txt").collect()))
    plan = ranged._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1
    below = plan[plan.index("Exchange"):]
    assert "transform(" not in below and "split(" not in below  # paths are taken apart after it
    index = D.sorted_postings(ranged)
    assert sorted(index.collect()) == sorted(D.postings(ranged).collect())
    shuffled = index._jdf.queryExecution().optimizedPlan().toString()
    assert shuffled.index("Generate explode") < shuffled.index("Repartition")  # the postings are made above the shuffle

import time

from pyspark.sql import functions as F

from routescope.functions import times as T
from routescope.operators import features as FE
from routescope.streaming import jobs as J
from routescope.streaming import state as K
from routescope.streaming.late import late_rows

COLUMNS = ["seq", "ts", "aw", "peer_as", "prefix", "as_path", "hops"]


def batch(spark, rows):
    df = spark.createDataFrame(rows, "seq int, s bigint, aw string, prefix string, as_path string")
    hops = F.filter(F.split("as_path", " "), lambda h: h != "")
    return df.select("seq", T.from_seconds(F.col("s") + 864000).alias("ts"), "aw", F.lit(1).cast("bigint").alias("peer_as"), "prefix", "as_path", hops.alias("hops"))


PARTS = [
    [(1, 0, "A", "p", "1 2"), (2, 10, "A", "p", "1 2"), (3, 20, "W", "q", "")],
    [(4, 400, "W", "p", ""), (5, 410, "A", "p", "1 3"), (6, 420, "A", "q", "1 4")],
    [(7, 5000, "A", "p", "1 3 4"), (8, 5, "A", "q", "1 4"), (9, 5010, "W", "q", "")],
]


def feed(spark, tmp_path, parts=PARTS):
    folder = str(tmp_path / "in")
    for part in parts:
        batch(spark, part).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken in order of their times
    return folder


def test_counts_drop_late_rows(spark, tmp_path):
    folder = feed(spark, tmp_path, [*PARTS, [(10, 5100, "A", "q", "1 4")], [(11, 6, "A", "q", "1 4")]])
    s = J.update_stream(spark, folder, batch(spark, PARTS[0]).schema, max_files=1)
    q = J.run_to_table(J.bucket_counts(s, []), str(tmp_path / "out"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/table"))
    counts = {r["bucket"].minute: (r["announcement_count"], r["withdrawal_count"]) for r in got.collect()}
    # row 8 comes in the batch that moves the watermark past it and still counts; row 11 is late
    assert counts[0] == (3, 1) and late_rows(q) == 1


def test_late_rows_of_batches_no_longer_remembered(spark, tmp_path):
    later = [[(k, 5100 + k, "A", "q", "1 4")] for k in range(12, 16)]
    folder = feed(spark, tmp_path, [*PARTS, [(10, 5100, "A", "q", "1 4")], [(11, 6, "A", "q", "1 4")], *later])
    name = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(name)
    spark.conf.set(name, 3)
    try:
        s = J.update_stream(spark, folder, batch(spark, PARTS[0]).schema, max_files=1)
        q = J.run_to_table(J.bucket_counts(s, []), str(tmp_path / "out"))
        q.awaitTermination()
        remembered = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
        assert len(q.recentProgress) == 2 and remembered == 0  # of nine batches and more
        assert late_rows(q) == 1
        # a second run over what came since goes on counting
        batch(spark, [(20, 7, "A", "q", "1 4")]).coalesce(1).write.mode("append").parquet(folder)
        q = J.run_to_table(J.bucket_counts(s, []), str(tmp_path / "out"))
        q.awaitTermination()
        assert late_rows(q) == 2
    finally:
        spark.conf.set(name, before)


def test_route_state_across_batches(spark, tmp_path):
    ordered = [PARTS[0], PARTS[1], [r for r in PARTS[2] if r[0] != 8]]
    folder = feed(spark, tmp_path, ordered)
    schema = batch(spark, PARTS[0]).schema

    def targets(rows):
        return rows.withColumn("target", F.lit("t"))

    q = K.route_state(targets(J.update_stream(spark, folder, schema, max_files=1)), str(tmp_path / "state"))
    q.awaitTermination()
    done = [p for p in q.recentProgress if p["numInputRows"]]
    assert len(done) == 3 and [p["stateOperators"][0]["numRowsUpdated"] for p in done] == [2, 2, 2]  # keys with new messages
    got = spark.read.parquet(str(tmp_path / "state/table"))
    whole = FE.route_changes(targets(spark.read.schema(schema).parquet(folder)), "global")
    want = {r["seq"]: (r["edit"], *(r[c] for c in K.CHANGES)) for r in whole.collect()}
    assert {r["seq"]: (r["edit"], *(r[c] for c in K.CHANGES)) for r in got.collect()} == want
    assert want[5][5] == 1 and want[5][2] == 1  # announced again after a withdrawal, by another origin


def test_silent_prefixes_are_forgotten(spark, tmp_path):
    day = 86_400
    parts = [[(1, 0, "A", "p", "1 2")], [(2, 3 * day, "A", "q", "1 2")], [(3, 3 * day + 9000, "A", "r", "1 2")], [(4, 3 * day + 9100, "A", "p", "1 2"), (5, 3 * day + 9100, "A", "q", "1 2")]]
    folder = feed(spark, tmp_path, parts)
    rows = J.update_stream(spark, folder, batch(spark, PARTS[0]).schema, max_files=1).withColumn("target", F.lit("t"))
    K.route_state(rows, str(tmp_path / "state"), ttl_days=2).awaitTermination()
    got = {r["seq"]: r["dup_a"] for r in spark.read.parquet(str(tmp_path / "state/table")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}  # p was silent for three days, q for hours


def test_a_message_of_several_target_ases_counts_once(spark, tmp_path):
    folder = feed(spark, tmp_path, [PARTS[0]])
    s = J.update_stream(spark, folder, batch(spark, PARTS[0]).schema)
    targets = spark.createDataFrame([("t", "1"), ("t", "2"), ("u", "2"), ("t", "2")], "target string, asn string")
    K.route_state(K.touching(s, targets), str(tmp_path / "state")).awaitTermination()
    got = sorted((r["target"], r["seq"], r["dup_a"]) for r in spark.read.parquet(str(tmp_path / "state/table")).collect())
    assert got == [("t", 1, 0), ("t", 2, 1), ("t", 3, 0), ("u", 1, 0), ("u", 2, 1)]


def test_prefixes_of_a_group_share_a_value_of_state(spark, tmp_path):
    parts = [[(100 * b + k, 1000 * b + k, "W" if (b + k) % 5 == 0 else "A", f"p{k % 20}", "" if (b + k) % 5 == 0 else f"1 {k % 3 + b}") for k in range(40)] for b in range(3)]
    folder = feed(spark, tmp_path, parts)
    schema = batch(spark, parts[0]).schema
    rows = J.update_stream(spark, folder, schema, max_files=1).withColumn("target", F.lit("t"))
    out = K.route_changes(rows, groups=2)
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, K.ROCKS)
    try:
        q = J.run_to_table(out, str(tmp_path / "out"))
        q.awaitTermination()
    finally:
        spark.conf.set(conf, before)
    done = [p for p in q.recentProgress if p["numInputRows"]]
    assert [p["stateOperators"][0]["numRowsUpdated"] for p in done] == [2, 2, 2]  # 20 prefixes, two calls a batch
    whole = FE.route_changes(spark.read.schema(schema).parquet(folder).withColumn("target", F.lit("t")), "global")
    shown = ["seq", "prefix", "edit", *K.CHANGES]
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out/table")).select(*shown).collect())) == sorted(map(str, whole.select(*shown).collect()))


def test_prefixes_of_a_group_are_forgotten_one_by_one(spark, tmp_path):
    day = 86_400
    parts = [[(1, 0, "A", "p", "1 2"), (2, day, "A", "q", "1 2")], [(3, 5 * day // 2, "A", "r", "1 2")], [(4, 5 * day // 2 + 9000, "A", "r", "1 2")],
             [(5, 5 * day // 2 + 9100, "A", "p", "1 2"), (6, 5 * day // 2 + 9100, "A", "q", "1 2")], [(7, 6 * day, "A", "s", "1 2")],
             [(8, 6 * day + 9000, "A", "s", "1 2")], [(9, 6 * day + 9100, "A", "q", "1 2"), (10, 6 * day + 9100, "A", "s", "1 2")]]
    folder = feed(spark, tmp_path, parts)
    rows = J.update_stream(spark, folder, batch(spark, parts[0]).schema, max_files=1).withColumn("target", F.lit("t"))
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, K.ROCKS)
    try:
        J.run_to_table(K.route_changes(rows, ttl_days=2, groups=1), str(tmp_path / "out")).awaitTermination()
    finally:
        spark.conf.set(conf, before)
    got = {r["seq"]: r["dup_a"] for r in spark.read.parquet(str(tmp_path / "out/table")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1, 5: 0, 6: 1, 7: 0, 8: 1, 9: 0, 10: 1}


def test_duplicates_within_watermark(spark, tmp_path):
    folder = feed(spark, tmp_path, [PARTS[0], PARTS[0]])
    s = J.update_stream(spark, folder, batch(spark, PARTS[0]).schema, max_files=1)
    out = J.drain(J.distinct_messages(s.withColumn("_id", F.col("seq")).select("_id", "ts")), str(tmp_path / "d"))
    assert sorted(r["_id"] for r in out.collect()) == [1, 2, 3]

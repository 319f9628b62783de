"""Encodings chosen file by file, keyed quota state, mergeable snapshots, a dense spot in a radius join."""

import pytest
from pyspark.sql import functions as F

from placerank.operators.joins import radius_join
from placerank.sources import readers as R
from placerank.streaming.intake import merge_snapshots, merged_mean, quota_stream, snapshot_mean


def test_every_file_has_its_own_encoding(spark, tmp_path):
    d = tmp_path / "mixed"
    d.mkdir()
    (d / "a.csv").write_bytes("name,n\n서초구,1\n\"줄\n바꿈, 쉼표\",\n".encode("cp949"))       # legacy text under an ASCII header
    (d / "b.csv").write_bytes("n,name,extra\n2,강남구,x\n".encode("utf-8"))
    (d / "c.csv").write_bytes("﻿name,n\n성동구,3\n".encode("utf-8"))
    (d / "empty.csv").write_bytes(b"")
    before = spark.conf.get("spark.sql.legacy.javaCharsets", None)
    got = R.read_csv_encoded(spark, str(d), required=["name"])
    assert dict(got.dtypes) == {"name": "string", "n": "bigint", "extra": "string"}
    assert sorted(map(tuple, got.select("name", "n", "extra").collect()), key=repr) == \
        sorted([("서초구", 1, None), ("줄\n바꿈, 쉼표", None, None), ("강남구", 2, "x"), ("성동구", 3, None)], key=repr)
    told = {r["path"].rsplit("/", 1)[1]: r["encoding"] for r in R.file_encodings(spark, str(d)).collect()}
    assert told == {"a.csv": "cp949", "b.csv": "utf-8-sig", "c.csv": "utf-8-sig"}
    assert [tuple(r) for r in R.read_csv_encoded(spark, str(d / "b.csv"), schema="name string, n double, gone int").collect()] == [("강남구", 2.0, None)]
    (d / "bad.csv").write_bytes(b"name,n\n\xff\xff\x80\x80,1\n")
    assert {r["encoding"] for r in R.file_encodings(spark, str(d / "bad.csv")).collect()} == {None}
    with pytest.raises(ValueError):
        R.read_csv_encoded(spark, str(d / "bad.csv"))
    with pytest.raises(Exception, match="no encoding fits .*bad.csv"):
        R.read_csv_encoded(spark, str(d)).collect()
    assert spark.conf.get("spark.sql.legacy.javaCharsets", None) == before


SCHEMA = "id int, ts timestamp, k string, body string"


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, "id int, ts string, k string, body string").withColumn("ts", F.to_timestamp("ts")) \
        .coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, folder, target, state, quota=2):
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)
    q = quota_stream(stream, "id", "ts", "k", quota, body="body").writeStream.format("parquet") \
        .option("path", target).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_quota_of_late_repeated_and_replayed_batches(spark, tmp_path):
    src, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    t = "2024-01-01 00:00:0"
    put(spark, src, "b1", [(1, t + "5", "u", "x"), (1, t + "5", "u", "x"), (9, t + "1", "u", " "), (5, t + "1", "v", "x"), (6, t + "1", None, "x")])
    run(spark, src, target, state)
    put(spark, src, "b2", [(1, t + "5", "u", "again"), (2, t + "2", "u", "late"), (3, t + "1", "u", "late too")])
    run(spark, src, target, state)
    accepted = {r["id"]: r["body"] for r in spark.read.parquet(target).collect()}
    assert accepted == {1: "x", 5: "x", 3: "late too"}            # of the late rows the earliest fills the room
    put(spark, src, "b3", [(7, t + "0", "u", "no room"), (5, t + "1", "v", "again"), (8, t + "9", "v", "x")])
    run(spark, src, target, state)
    run(spark, src, target, state)                                 # nothing new
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [1, 3, 5, 8]
    # replay: the commit of the last batch is lost, so it is run again from the state before it
    import glob
    import os
    last = max(glob.glob(f"{state}/commits/[0-9]*"), key=lambda p: int(p.rsplit("/", 1)[1]))
    for p in (last, os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")):
        if os.path.exists(p):
            os.remove(p)
    run(spark, src, target, state)
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [1, 3, 5, 8]


def test_merged_snapshots_equal_the_batch_mean(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = [("2024-11-03", "p", 500, 10.0), ("2024-11-03", "q", 500, None), ("2024-11-06", "p", 500, 20.0), ("2024-11-06", "p", 1000, 3.0),
            ("2025-08-10", "q", 500, 7.5), ("2025-08-10", "p", 500, 1.0)]
    df = spark.createDataFrame(rows, "d string, place string, r int, m double")
    for day in ("2025-08-10", "2024-11-03", "2024-11-06", "2024-11-03"):   # out of order, one of them twice
        merge_snapshots(df.where(F.col("d") == day), path, "d", ["place", "r"], "m")
    got = sorted(map(tuple, merged_mean(spark, path, ["place", "r"], "m").collect()), key=repr)
    assert got == sorted(map(tuple, snapshot_mean(df, ["place", "r"], "m").collect()), key=repr)
    fixed = df.where("d = '2024-11-03'").withColumn("m", F.lit(0.0))
    merge_snapshots(fixed, path, "d", ["place", "r"], "m")                 # a corrected file replaces its own part
    assert {tuple(r)[:3] for r in merged_mean(spark, path, ["place", "r"], "m").collect()} == {("p", 500, 7.0), ("p", 1000, 3.0), ("q", 500, 3.75)}


def test_snapshots_from_a_stream(spark, tmp_path):
    src, path = str(tmp_path / "days"), str(tmp_path / "sums")
    for day, m in (("a", 1.0), ("b", 3.0)):
        spark.createDataFrame([(day, "p", m)], "d string, place string, m double").coalesce(1).write.parquet(f"{src}/{day}")
    stream = spark.readStream.schema("d string, place string, m double").option("recursiveFileLookup", "true").parquet(src)
    for state in ("s1", "s2"):                                             # the second query sees all files again
        stream.writeStream.foreachBatch(lambda b, _: merge_snapshots(b, path, "d", "place", "m")) \
            .option("checkpointLocation", str(tmp_path / state)).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in merged_mean(spark, path, "place", "m").collect()] == [("p", 2.0, 2)]


def test_many_points_at_one_spot_are_dealt_over_tasks(spark):
    points = spark.range(300_000).select("id", F.lit(37.5).alias("p_lat"), F.lit(127.0).alias("p_lng")) \
        .unionByName(spark.range(2000).select((F.col("id") + 1_000_000).alias("id"), (37.0 + F.col("id") / 2000).alias("p_lat"), F.lit(127.0).alias("p_lng")))
    places = spark.createDataFrame([(1, 37.5, 127.0), (2, 37.501, 127.0), (3, 37.9, 127.0)], "place int, lat double, lng double")
    got = radius_join(places, points.repartition(8), 500.0, right_lat="p_lat", right_lng="p_lng", broadcast_left=False)
    sizes = got.groupBy("place").count().collect()
    brute = points.crossJoin(places).where("6371000.0 * 2 * asin(sqrt(pow(sin(radians(lat - p_lat) / 2), 2))) <= 500.0").groupBy("place").count()
    assert {tuple(r) for r in sizes} == {tuple(r) for r in brute.collect()}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        per_task = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(per_task) == 4 and max(per_task) < 2 * sum(per_task) / len(per_task)

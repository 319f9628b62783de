import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from placerank.operators.clean import assign_cyclic, dedupe_columns, resolve_columns, time_code_filter
from placerank.sources import readers as R
from placerank.sources import writers as W
from placerank.streaming.intake import intake, intake_stream, quota_sink, snapshot_mean


def test_csv_json_readers(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("﻿자치구,합계 발생\n강남구,10\n", encoding="utf-8")
    df = R.read_table(spark, str(p))
    assert df.columns == ["자치구", "합계 발생"] and df.first()[1] == 10
    q = tmp_path / "b.csv"
    q.write_bytes("자치구,값\n서초구,1\n".encode("cp949"))
    enc = R.read_csv_encoded(spark, str(q), ["utf-8", "x-windows-949"], required=["자치구"])
    assert enc.first()["자치구"] == "서초구"
    pos = tmp_path / "c.csv"
    pos.write_text('스마트쉼터 현황,,\n,,\n시도,시군구,시설명\n서울,강남구,"a\nb"\n', encoding="utf-8")
    pr = R.read_positional(spark, str(pos), ["sido", "gu", "name"], skip_until="시도").collect()
    assert [(r["gu"], r["name"]) for r in pr] == [("강남구", "a\nb")]
    env = tmp_path / "d.json"
    env.write_text(json.dumps({"meta": 1, "records": [{"p_park": "x", "geo": {"lat": 1.5}}]}), encoding="utf-8")
    jr = R.read_json_records(spark, str(env)).first()
    assert jr["p_park"] == "x" and jr["geo.lat"] == 1.5
    lst = tmp_path / "e.json"
    lst.write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert sorted(r["a"] for r in R.read_json_records(spark, str(lst)).collect()) == [1, 2]
    keyed = tmp_path / "f.json"
    keyed.write_text(json.dumps({"서울숲": {"구": "성동구", "최종대표시간": 7.5}, "보라매": {"구": None, "최종대표시간": None}}))
    kj = {r["park"]: r["최종대표시간"] for r in R.read_keyed_json(spark, str(keyed), "struct<`구`:string,`최종대표시간`:double>", "park").collect()}
    assert kj == {"서울숲": 7.5, "보라매": None}


def test_unpivot_union_dir_writers(spark, tmp_path):
    wide = spark.createDataFrame([("p1", 2, 0, None), (None, 1, 1, 1)], "park_nm string, cnt01 int, cnt02 int, cnt03 int")
    out = R.unpivot_coded(wide, "park_nm", "cnt", {"CNT01": "농구장", "cnt02": "배드민턴장"}, keep=["농구장", "배드민턴장"])
    assert [(r["park_nm"], r["label"]) for r in out.collect()] == [("p1", "농구장")]
    d = str(tmp_path)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    W.write_csv(df.filter("id = 1"), f"{d}/u1")
    W.write_csv(df.filter("id = 2"), f"{d}/u2")
    assert R.read_union(spark, [f"{d}/u1", f"{d}/u2"], ["id", "v"]).count() == 2
    with pytest.raises(ValueError):
        R.read_union(spark, [f"{d}/u1"], ["missing"])
    df.write.partitionBy("v").csv(f"{d}/dir", header=True)
    dk = R.read_dir_with_key(spark, f"{d}/dir/*/*.csv", ".csv", "ent", path_pattern="v=([^/]+)/")
    assert dk.columns[0] == "ent" and sorted(r["ent"] for r in dk.collect()) == ["a", "b"]
    W.write_json(spark.createDataFrame([("강남구",)], "g string"), f"{d}/j")
    txt = "".join(open(os.path.join(f"{d}/j", f), encoding="utf-8").read()
                  for f in os.listdir(f"{d}/j") if f.endswith(".json"))
    assert "강남구" in txt


def test_columns_and_codes(spark):
    df = spark.createDataFrame([(1, 2.0)], "`Dong Lat` int, LNG double")
    r = resolve_columns(df, {"lat": ["dong_lat", "lat"], "lng": ["lng"]}, required=["lat"])
    assert r.columns == ["lat", "lng"]
    with pytest.raises(ValueError):
        resolve_columns(df, {"x": ["nope"]}, required=["x"])
    dup = spark.createDataFrame([(1, 2)], "a int, b int").toDF("a", "a")
    assert dedupe_columns(dup).columns == ["a"]
    ev = spark.createDataFrame([("20241103", 7, "1111012345"), ("20241103", 23, "1111012345"), ("20241104", 9, "x")],
                               "d string, h int, c string")
    t = time_code_filter(ev, "d", "h", "c", dates=["20241103"], hours=(7, 22)).collect()
    assert [(r["h"], r["c"]) for r in t] == [("07", "11110123")]
    lab = assign_cyclic(spark.createDataFrame([(i,) for i in range(5)], "i int"), "i", ["x", "y"])
    assert [r["label"] for r in lab.orderBy("i").collect()] == ["x", "y", "x", "y", "x"]


def test_intake_batch_and_stream(spark, tmp_path):
    rows = [(1, 1, "u", "a"), (1, 2, "u", "a"), (2, 1, "u", " "), (3, 3, "u", "b"), (4, 4, "u", "c"), (5, 1, "v", "d")]
    df = spark.createDataFrame(rows, "id int, ts int, k string, body string")
    got = sorted((r["id"], r["ts"]) for r in intake(df, "id", "ts", "k", body="body", quota=2).collect())
    assert got == [(1, 1), (3, 3), (5, 1)]
    src = str(tmp_path / "in")
    os.makedirs(src)
    sdf = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:00:01", "a"),
                                 (2, "2024-01-01 00:00:02", "")], "id int, ts string, body string")
    sdf.withColumn("ts", F.to_timestamp("ts")).write.mode("overwrite").parquet(src + "/b1")
    stream = spark.readStream.schema("id int, ts timestamp, body string").parquet(src + "/b1")
    q = (intake_stream(stream, "id", "ts", body="body").writeStream.format("memory").queryName("intake_t")
         .outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    assert [r["id"] for r in spark.sql("SELECT id FROM intake_t").collect()] == [1]


def test_snapshot_stream_and_quota_sink(spark, tmp_path):
    src = str(tmp_path / "snap")
    spark.createDataFrame([("p", 500, 10.0), ("p", 500, 20.0), ("q", 500, 5.0)], "place string, r int, m double") \
        .write.parquet(src + "/d1")
    stream = spark.readStream.schema("place string, r int, m double").parquet(src + "/d1")
    q = (snapshot_mean(stream, ["place", "r"], "m").writeStream.format("memory").queryName("snap_t")
         .outputMode("complete").start())
    q.processAllAvailable()
    q.stop()
    got = {r["place"]: r["m_mean"] for r in spark.sql("SELECT * FROM snap_t").collect()}
    assert got == {"p": 15.0, "q": 5.0}
    target = str(tmp_path / "accepted")
    sink = quota_sink(target, "k", "id", "ts", 2)
    sink(spark.createDataFrame([(1, 1, "u"), (2, 2, "u")], "id int, ts int, k string"), 0)
    sink(spark.createDataFrame([(3, 3, "u"), (4, 1, "v")], "id int, ts int, k string"), 1)
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [1, 2, 4]


def test_read_positional_skips_the_preamble_of_each_file(spark, tmp_path):
    d = tmp_path / "pos"
    d.mkdir()
    (d / "a.csv").write_text("title,,\nkey,x,y\na1,1,2\n")
    (d / "b.csv").write_text("title,,\nnote,,\nkey,x,y\nb1,3,4\nb2,5,6\n")
    got = R.read_positional(spark, str(d), ["k", "x", "y"], skip_until="key").collect()
    assert sorted(r["k"] for r in got) == ["a1", "b1", "b2"]
    got = R.read_positional(spark, str(d), ["k", "x", "y"], skip_rows=2).collect()
    assert sorted(r["k"] for r in got) == ["a1", "b1", "b2", "key"]
    with pytest.raises(Exception, match="no marker row"):
        R.read_positional(spark, str(d), ["k", "x", "y"], skip_until="absent").collect()

"""Readers, generators and streams."""

import json
import time

import numpy as np
import pytest

from geotiles import catalog
from geotiles.operators import windows
from geotiles.sources import binary, generators, text
from geotiles.streaming import ingest


def test_binary_files(spark, tmp_path):
    binary.register(spark)
    rows = np.zeros(7, binary.record("dat"))
    rows["lat"], rows["lon"], rows["time"], rows["app"] = np.arange(7), -np.arange(7), 1000 + np.arange(7), 3
    (tmp_path / "x.dat").write_bytes(b"\0" * 764 + rows.tobytes() + b"\1\2")
    got = spark.read.format("geotiles_dat").option("path", str(tmp_path / "x.dat")).load()
    assert [tuple(r) for r in got.orderBy("time").collect()][6] == (6.0, -6.0, 1006, 0, 0, 3) and got.count() == 7
    assert spark.read.format("geotiles_dat").option("path", str(tmp_path / "x.dat")).option("limit", 3).load().count() == 3
    for endian, order in (("little", "lat_lon"), ("big", "lon_lat")):
        rows = np.zeros(2, binary.record("dmp", endian, order))
        rows["lat"], rows["lon"], rows["time"], rows["text"] = [1.5, 2.5], [3.5, 4.5], [7, 8], [b"hello", "ü".encode()]
        (tmp_path / "y.dmp").write_bytes(rows.tobytes())
        got = spark.read.format("geotiles_dmp").option("path", str(tmp_path / "y.dmp")).option("endian", endian).option("coord_order", order).load()
        assert [tuple(r) for r in got.orderBy("time").collect()] == [(1.5, 3.5, 7, "hello"), (2.5, 4.5, 8, "ü")]


def test_messages(spark, tmp_path):
    lines = [
        {"coordinates": {"coordinates": [10.5, 20.5]}, "created_at": "Wed Aug 27 13:08:45 +0000 2008", "id": 5, "text": "hi", "lang": "en", "entities": {"hashtags": [{"text": "a"}]}},
        {"id": 6},
    ]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, lines)) + "\nnoise\n")
    rows = text.read_messages(spark, str(tmp_path / "m.json"))
    got = {r["id"]: r for r in rows.collect()}
    assert set(got) == {"5", "6"} and got["6"]["lang"] == "none" and got["5"]["hashtags"] == ["a"] and got["6"]["hashtags"] == []
    assert [tuple(r) for r in text.to_points(rows).collect()] == [(1219842525, 20.5, 10.5, "hi")]


def test_workload_file(spark, tmp_path):
    (tmp_path / "w.csv").write_text("85,-179,-85,179\n1,2,0,3\n")
    assert [(k, r.lat0, r.lon1) for k, r in text.read_workload(spark, str(tmp_path / "w.csv"))] == [(0, 85.0, 179.0), (1, 1.0, 3.0)]
    assert len(text.read_workload(spark, str(tmp_path / "w.csv"), 1)) == 1
    log = spark.createDataFrame([("a", 1, 2.0)], "algo string, t long, ms double")
    text.write_benchmark_log(log, str(tmp_path / "log"))
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "log")).columns == ["algo", "t", "ms"]


def test_random_points(spark):
    a, b = (generators.random_points(spark, 1000, payload=4).orderBy("id").collect() for _ in range(2))
    assert a == b and all(-85 <= r["lat"] <= 85 and -180 <= r["lon"] <= 180 for r in a) and a[999]["time"] == 0


@pytest.fixture()
def batches(spark, data, tmp_path):
    rows = catalog.points(spark, data).select("event_id", "time", "lat", "lon", "event_type")
    for k in range(3):
        rows.where(f"event_id % 3 = {k}").coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        time.sleep(0.01)
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        next((tmp_path / f"in{k}").glob("*.parquet")).rename(folder / f"{k}.parquet")
    return rows, str(folder)


def test_streams_equal_batches(spark, batches, tmp_path):
    rows, folder = batches
    stream = ingest.read_points(spark, folder, rows.schema.simpleString()[7:-1].replace(":", " "))
    notices = []
    ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "c1"), notices.append).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.count() == rows.count() and notices == ['{"renew": true}'] * 3
    box = catalog.MAIN
    assert stored.where(box.box.contains()).count() == catalog.layout.with_keys(rows).where(box.box.contains()).count()
    found = []
    ingest.hot_cells(stream, str(tmp_path / "c2"), lambda df, k: found.extend((k, *r) for r in df.drop("batch").collect()), 20).awaitTermination()
    want = [windows.hot_cells(spark.read.parquet(f"{folder}/{k}.parquet").withColumn("batch", catalog.F.lit(0)), "batch", 20).count() for k in range(3)]
    assert len(found) == sum(want)
    newest = rows.agg({"time": "max"}).collect()[0][0]
    ingest.windowed_store(stream, str(tmp_path / "w"), str(tmp_path / "c3"), 3).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "w"))
    oldest = newest - 2
    assert windows.live(kept, oldest).count() == windows.live(rows, oldest).count() <= kept.count()
    keyword = ingest.with_keyword(rows, ["CLICK"], "event_type")
    assert keyword.count() == rows.where("event_type = 'click'").count()


def test_push_tells_of_data_time_and_hot_cells(spark, batches, tmp_path):
    rows, folder = batches
    stream = ingest.read_points(spark, folder, rows.schema.simpleString()[7:-1].replace(":", " "))
    sent = []
    ingest.push(stream, str(tmp_path / "c"), sent.append, 20).awaitTermination()
    told = [json.loads(x) for x in sent]
    assert [x for x in told if x["renew"]] == [{"renew": True}] * 3
    newest = [spark.read.parquet(f"{folder}/{k}.parquet").agg({"time": "max"}).collect()[0][0] for k in range(3)]
    assert [x["info"] for x in told if "info" in x] == [[n] for n in newest]
    cells = [len(x["triggers"]) for x in told if "triggers" in x]
    assert sum(cells) == sum(windows.hot_cells(spark.read.parquet(f"{folder}/{k}.parquet").withColumn("batch", catalog.F.lit(0)), "batch", 20).count() for k in range(3))


def test_a_repeated_batch_is_stored_once(spark, batches, tmp_path):
    rows, folder = batches
    stream = ingest.read_points(spark, folder, rows.schema.simpleString()[7:-1].replace(":", " "))
    for k in range(2):  # a lost checkpoint makes every batch come again
        ingest.windowed_store(stream, str(tmp_path / "w"), str(tmp_path / f"c{k}"), 10**6).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "w")).count() == rows.count()


def test_event_time_windows(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    stream = generators.points_of_events(ingest.read_points(spark, data + "/events.parque[t]", events.schema.simpleString()[7:-1].replace(":", " ")).withColumn("at", catalog.F.col("ts").cast("timestamp")))
    counts = ingest.cell_counts(stream, "at", "1 day", "1 hour")
    counts.writeStream.outputMode("complete").format("memory").queryName("cells").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("SELECT sum(n) FROM cells").collect()[0][0] == events.count()
    assert json.loads(ingest.informed(5)) == {"renew": False, "info": [5]} and json.loads(ingest.triggered([(1, 2, 3, 4)]))["triggers"] == [[1, 2, 3, 4]]

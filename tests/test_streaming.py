from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codeloom.streaming import events as stream

T0 = datetime(2025, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(p, k, t, T0 + timedelta(seconds=s)) for p, k, t, s in rows], stream.EVENT)


ROWS = [("a.py", "modified", None, 0.0), ("b.py", "moved", "c.py", 1.5), ("dir/", "created", None, 1.6), ("a.py", "modified", None, 3.0), ("z.py", "created", None, 10.0), ("late.py", "created", None, 500.0)]


def test_bursts(spark):
    got = stream.debounced(stream.touched(events(spark, ROWS))).orderBy("start").collect()
    assert [(r.paths, r.events) for r in got] == [(["a.py", "b.py", "c.py"], 4), (["z.py"], 1), (["late.py"], 1)]
    assert (got[0].end - got[0].start).total_seconds() == 5


def test_stream_of_bursts_refreshes_in_batches(spark, tmp_path):
    for k in range(0, len(ROWS), 2):
        events(spark, ROWS[k : k + 2]).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    seen = []
    q = stream.refreshing(stream.debounced(stream.touched(stream.source(spark, str(tmp_path / "log")))), lambda df, n: seen.extend(r.paths for r in df.collect()), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    assert sorted(map(tuple, seen)) == [("a.py", "b.py", "c.py"), ("z.py",)]  # the last burst is still open


def test_stream_windows_equal_batch_below_the_watermark(spark, tmp_path):
    e = spark.createDataFrame([(k, "x" if k % 2 else "y", T0 + timedelta(minutes=7 * k)) for k in range(200)], "id int, kind string, at timestamp")
    for k in range(0, 200, 50):  # files in the order of time
        e.where(f"id >= {k} and id < {k + 50}").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    q = stream.tumbling(stream.once(s, "id", "at"), "at", "1 hour", None, "kind").writeStream.outputMode("append").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("w").collect()}
    want = {tuple(r) for r in stream.tumbling(e, "at", "1 hour", "1 hour", "kind").collect()}
    assert got and got <= want
    slid = stream.sliding(e, "at", "2 hours", "1 hour").agg(F.sum("events")).first()[0]
    assert slid == 400


def test_rates(spark):
    e = spark.createDataFrame([("u", k, T0 + timedelta(seconds=s)) for k, s in enumerate([0, 2, 4, 10])], "u string, id int, at timestamp")
    r = stream.rolling_rate(e, ["u"], "at", "id", 2).orderBy("id").collect()
    assert [x.mean_gap for x in r] == [None, 2.0, 2.0, 4.0] and r[3].per_minute == 15
    assert spark.range(1).select(stream.phase_rate(F.lit(10), F.lit(30.0))).first()[0] == 20


def test_state(spark, tmp_path):
    e = spark.createDataFrame([("u", T0 + timedelta(seconds=s)) for s in (0, 2, 6)] + [("v", T0)], "u string, at timestamp")
    e.write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = stream.counted(s, "u", "at").writeStream.outputMode("update").format("memory").queryName("n").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.key: (r.events, r.mean_gap) for r in spark.table("n").collect()}
    assert got["u"] == (3, pytest.approx(3.0)) and got["v"][0] == 1

"""Streams over files give what the batch forms give."""

import datetime as dt

from pyspark.sql import functions as F

from memloom.operators import memory as M
from memloom.sources import testdata as D
from memloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def drain(df, name, mode, checkpoint):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_current_entries(spark, tmp_path):
    w = D.kv_writes(spark, SF)
    w.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(w.schema).parquet(str(tmp_path / "in"))
    got = drain(jobs.current_entries(stream), "entries", "complete", str(tmp_path / "c"))
    want = M.store(w).select(*M.KEY, "value", "seq")
    assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).isEmpty()


def test_cascade_state(spark, tmp_path):
    a = D.access_log(spark, SF).filter("note_id < 5").select("note_id", "accessed_at")
    a.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(a.schema).parquet(str(tmp_path / "in"))
    got = drain(jobs.cascade_state(stream), "levels", "update", str(tmp_path / "c"))
    want = {r["note_id"]: r["n"] for r in a.groupBy("note_id").agg(F.count("*").alias("n")).collect()}
    last = {r["note_id"]: r["n"] for r in got.groupBy("note_id").agg(F.max("accesses").alias("n")).collect()}
    assert last == want


def test_entries_expire_and_leave_the_state(spark, tmp_path):
    """Timers fire once the watermark has passed an entry's end; a newer write puts the end off; entries without one stay."""
    schema = "seq long, agent_id long, namespace string, key string, value double, written_at timestamp, ttl_seconds int"
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    batches = [
        [(1, 1, "n", "short", 1.0, at(0), 3600), (2, 1, "n", "renewed", 2.0, at(0), 3600), (3, 1, "n", "kept", 3.0, at(0), None)],
        [(4, 1, "n", "renewed", 4.0, at(0.5), 36_000), (5, 1, "n", "kept", 5.0, at(0.5), None), (0, 1, "n", "kept", 9.0, at(0.5), 1)],
        [(6, 2, "n", "late", None, at(5), 360_000)],
        [(7, 2, "n", "late", 7.0, at(6), 360_000)],
        [(8, 2, "n", "late", 8.0, at(7), 360_000)],
    ]
    out, mark = str(tmp_path / "out"), str(tmp_path / "c")
    last = None
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = jobs.live_entries(stream, "1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        last = q.lastProgress or last
    got = sorted((r["key"], r["seq"], r["op"]) for r in spark.read.parquet(out).collect())
    assert got == sorted([("short", 1, "set"), ("renewed", 2, "set"), ("kept", 3, "set"), ("renewed", 4, "set"), ("kept", 5, "set"), ("late", 6, "set"), ("late", 7, "set"), ("late", 8, "set"), ("short", 1, "expired")])
    assert last["stateOperators"][0]["numRowsTotal"] == 3

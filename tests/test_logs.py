"""Literal cases of logs, answers and streams that no query runs, and the nearest vectors by brute force."""

import hashlib
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from memloom.functions import text as X
from memloom.operators import memory as M
from memloom.operators import schemas as P
from memloom.operators import search as S
from memloom.streaming import jobs

AT = datetime(2024, 1, 1)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_conflicts(spark):
    log = spark.createDataFrame([(1, "a", "n", "k", 1.0), (2, "a", "n", "k", 2.0), (3, "a", "n", "j", 3.0)], "seq long, agent_id string, namespace string, key string, value double")
    assert [r["seq"] for r in M.conflicts(log).collect()] == [2]


def test_answers(spark):
    got = one(spark, 'Sure! {"title": "T", "content": "C", "action": "patch", "sibling_schema_id": "s1"} Bye', X.abstraction)
    assert (got["title"], got["content"], got["rationale"], got["action"], got["sibling"]) == ("T", "C", "llm rationale omitted", "patch", "s1")
    assert one(spark, "no json", X.abstraction) is None and one(spark, '{"title": "T"}', X.abstraction) is None and one(spark, "} {", X.json_object) is None
    assert [r["tag"] for r in one(spark, 'tags: [{"tag": "a", "confidence": 0.9}, {"tag": "b"}].', X.tag_suggestions)] == ["a", "b"]
    assert one(spark, "none", X.tag_suggestions) is None
    got = one(spark, "p", lambda x: X.request_hash(x, F.lit("s"), F.lit(1.0), F.lit(5)))
    assert got == hashlib.sha256(b"prompt:p\nsys:s\nt:1\nm:5\n").hexdigest()
    assert one(spark, "p", lambda x: X.request_hash(x, F.lit(None), F.lit(None), F.lit(None))) == hashlib.sha256(b"prompt:p\n").hexdigest()


def test_proposals(spark):
    p = spark.createDataFrame([(1, "t1", "c", [1, 2], 0.9, "create", None), (5, "t5", "c", [5, 6], 0.8, "patch", 77), (9, "t9", "c", [9], 0.7, "patch", 78)], "proposal_id long, title string, content string, sources array<long>, mean_similarity double, action string, schema_id long")
    flagged = P.flag(p, F.lit(AT))
    done = P.commit(p.filter("proposal_id <> 1"), spark.createDataFrame([(77,)], "id long"), F.col("proposal_id") + 1000, "immediate", F.lit(AT))
    assert {r["id"] for r in done["schemas"].collect()} == {77, 1009}
    assert {(r["id"], r["parent_schema_id"]) for r in done["parents"].collect()} == {(5, 77), (6, 77), (9, 1009)}
    events = flagged.unionByName(done["events"])
    assert [r["proposal_id"] for r in P.pending(p, events).collect()] == [1]
    assert P.pending(p, events.unionByName(P.reject(p.filter("proposal_id = 1"), "me", "no", F.lit(AT)))).count() == 0
    wanted = spark.createDataFrame([(1,), (2,), (6,)], "wanted long")
    assert {r["wanted"]: r["proposal_id"] for r in P.resolve_pending(P.pending(p, events), wanted).collect()} == {1: 1, 2: 1, 6: None}


def test_contradiction_log(spark):
    found = spark.createDataFrame([(1, 2, 0.9), (3, 4, 0.8), (5, 6, 0.7)], "a long, b long, combined double")
    log = P.record_contradictions(found, spark.createDataFrame([(4, 3)], "a long, b long"), F.lit(AT))
    done = spark.createDataFrame([(1, 2, "first", AT), (1, 2, "last", AT + timedelta(1))], "a long, b long, resolution string, at timestamp")
    after = P.resolve_contradictions(log, done)
    assert [(r["a"], r["b"]) for r in P.open_contradictions(after).collect()] == [(5, 6)]
    assert after.filter("a = 1").first()["resolution"] == "last"


def test_nearest_between(spark, monkeypatch):
    monkeypatch.setattr(S, "MEETING_BLOCK", 16)
    r = np.random.default_rng(1)
    a, b = r.normal(size=(40, 5)), r.normal(size=(50, 5))
    b[7] = b[9]
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)] + [(99, None), (98, [1.0])], "query_id long, vector array<double>")
    v = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b)] + [(99, None)], "id long, embedding array<float>")
    got = {}
    for x in S.nearest_between(q, v, 3).collect():
        got.setdefault(x["query_id"], {})[x["rank"]] = x["id"]
    b = b.astype(np.float32).astype(float)
    for i, x in enumerate(a):
        sims = (b @ x / np.linalg.norm(b, axis=1) / np.linalg.norm(x)).clip(-1, 1).round(6)
        assert [got[i][k] for k in (1, 2, 3)] == sorted(range(50), key=lambda j: (-sims[j], j))[:3]
    assert set(got) == set(range(40))


def drain(df, name, mode, checkpoint):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    w = spark.createDataFrame([(1, "a", "n", "k", 1.0, AT), (2, "a", "n", "k", 2.0, AT + timedelta(hours=1)), (3, "a", "n", "j", 3.0, AT)], "seq long, agent_id string, namespace string, key string, value double, written_at timestamp")
    w.coalesce(1).write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema(w.schema).parquet(str(tmp_path / "w"))
    assert drain(jobs.first_writes(stream), "first", "append", str(tmp_path / "c1")).count() == 2
    e = spark.createDataFrame([(1, AT, "x", 1.0), (1, AT + timedelta(minutes=5), "x", 2.0), (1, AT + timedelta(hours=2), "x", 4.0)], "user_id long, ts timestamp, event_type string, value double")
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    assert [(r["n"], r["total"]) for r in drain(jobs.daily_counts(stream), "days", "complete", str(tmp_path / "c2")).collect()] == [(3, 7.0)]
    assert sorted(r["n"] for r in drain(jobs.sessions(stream), "sessions", "complete", str(tmp_path / "c3")).collect()) == [1, 2]
    q = jobs.embedding_queue(stream, lambda d: d.select("user_id"), str(tmp_path / "out"), str(tmp_path / "c4"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_tables_are_released(spark, monkeypatch):
    """What a program wrote goes at once; another program's tables stay."""
    import os

    from memloom import session

    other = session.materialize(spark.range(3))
    monkeypatch.setattr(session, "RUN", "another")
    df = session.materialize(spark.range(5))
    assert df.count() == 5 and os.path.isdir(session.run_dir(spark))
    session.release(spark)
    assert not os.path.isdir(session.run_dir(spark)) and other.count() == 3

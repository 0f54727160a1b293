"""Stores by batches, claims by byte offsets, long chains and replaced links, on small tables with odd rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from memloom.functions import text as X
from memloom.operators import integrity as I
from memloom.operators.stores import AccessStore, VectorStore, search_accesses

AT = dt.datetime(2024, 1, 1)


def vectors(spark, rows):
    return spark.createDataFrame([(n, v, m, AT + dt.timedelta(hours=h)) for n, v, m, h in rows], "note_id long, embedding array<float>, model string, created_at timestamp")


def held(store, ids=None):
    return {r["note_id"]: (list(r["embedding"]), r["model"]) for r in store.current(ids).collect()}


def test_vectors_are_replaced_and_checked(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/v", 4)
    assert held(store) == {} and store.width() is None
    store.put(vectors(spark, [(1, [1.0, 0.0], "a", 0), (2, [0.0, 1.0], "a", 0), (2, [0.5, 0.5], "b", 1)]), 0)
    assert held(store) == {1: ([1.0, 0.0], "a"), 2: ([0.5, 0.5], "b")} and store.width() == 2
    for _ in range(2):  # the second run of a batch changes nothing
        store.put(vectors(spark, [(2, [9.0, 9.0], "c", 0), (3, [3.0, 3.0], None, 0)]), 1)
    want = {1: ([1.0, 0.0], "a"), 2: ([9.0, 9.0], "c"), 3: ([3.0, 3.0], None)}
    assert held(store) == want and held(store, spark.createDataFrame([(2,), (7,)], "note_id long")) == {2: want[2]}
    for bad in ([(4, [1.0], "a", 0)], [(4, None, "a", 0)], [(None, [1.0, 1.0], "a", 0)], [(4, [1.0, 1.0], "a", 0), (5, [1.0, 1.0, 1.0], "a", 0)]):
        with pytest.raises(ValueError, match="2 numbers"):
            store.put(vectors(spark, bad), 2)
    with pytest.raises(ValueError, match="not there"):
        store.put(vectors(spark, [(4, [1.0, 1.0], "a", 0)]), 2, spark.createDataFrame([(1,)], "id long"))
    store.compact()
    assert held(store) == want and store.generation == 1
    store.put(vectors(spark, [(1, [7.0, 7.0], "d", 0)]), 2)
    assert held(store)[1] == ([7.0, 7.0], "d") and len(held(store)) == 3
    store.put(vectors(spark, []), 3)
    assert len(held(store)) == 3


def test_accesses_are_counted_once(spark, tmp_path):
    store = AccessStore(spark, f"{tmp_path}/a")
    assert store.counters().collect() == [] == store.log().collect()
    rows = lambda xs: spark.createDataFrame([(n, AT + dt.timedelta(hours=h), "read", q, "me") for n, h, q in xs], "note_id long, accessed_at timestamp, access_kind string, query_context string, agent_id string")
    store.record(rows([(1, 0, None), (1, 5, "q"), (2, 1, ""), (None, 9, "x")]), 0)
    for _ in range(3):
        store.record(rows([(1, 2, "q"), (3, 3, None)]), 1)
    got = {r["note_id"]: (r["access_count"], (r["last_accessed_at"] - AT).seconds // 3600) for r in store.counters().collect()}
    assert got == {1: (3, 5), 2: (1, 1), 3: (1, 3)} and store.log().count() == 5
    levels = {r["note_id"]: r["accesses"] for r in store.salience(F.lit(AT + dt.timedelta(days=1))).collect()}
    assert levels == {1: 3, 2: 1, 3: 1}


def test_accesses_of_a_stream_survive_a_restart(spark, tmp_path):
    """The same files through a stream whose last batch is run again: nothing counts twice."""
    schema = "note_id long, accessed_at timestamp, access_kind string, query_context string, agent_id string"
    for i in range(3):
        spark.createDataFrame([(n, AT, "read", None, None) for n in range(i + 1)], schema).write.parquet(f"{tmp_path}/in/part{i}")
    store = AccessStore(spark, f"{tmp_path}/a")
    run = lambda mark: spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in").writeStream.foreachBatch(store.record).option("checkpointLocation", f"{tmp_path}/{mark}").trigger(availableNow=True).start().awaitTermination()
    run("one")
    run("one")
    run("two")  # without its checkpoint, the stream begins anew at batch 0
    assert {r["note_id"]: r["access_count"] for r in store.counters().collect()} == {0: 3, 1: 2, 2: 1}


def test_search_accesses(spark):
    context = spark.createDataFrame([(1, 5), (1, 6), (1, 5), (2, 5), (9, 1)], "query_id long, id long")
    queries = spark.createDataFrame([(1, "a"), (2, None)], "query_id long, query string")
    got = search_accesses(context, queries, F.lit(AT)).collect()
    assert sorted((r["note_id"], r["query_context"] or "") for r in got) == [(1, ""), (5, ""), (5, "a"), (6, "a")]
    assert all(r["access_kind"] == "search_hit" and r["accessed_at"] == AT for r in got)


def test_claims_by_offsets(spark):
    note = "Äpfel sind rot. The sky is blue today."
    notes = spark.createDataFrame([(1, note), (2, None)], "id long, content string")
    sources = spark.createDataFrame([(7, "They say: the sky is blue today. Grass is green.", "u7", "t"), (8, None, "u8", None)], "id long, excerpt string, uri string, title string")
    raw = note.encode()
    a, b = raw.index(b"The sky"), len(raw)
    rows = [
        (1, 1, a, b, 7, None, None), (2, 1, a, b + 1, 7, None, None), (3, 1, b, b, 7, None, None), (4, 1, 1, 6, 7, None, None), (5, 1, a, b, 8, None, None),
        (6, 9, 0, 1, 7, None, None), (7, 1, a, b, 9, None, None), (8, 2, 0, 1, 7, None, None), (9, 1, a, b, 7, 33, 47), (10, 1, a, b, 7, 5, 4000), (11, None, 0, 1, None, None, None), (12, 1, None, 4, 7, None, None), (13, 1, a - 4, a + 15, 7, 0, 32),
    ]
    claims = spark.createDataFrame(rows, "id long, note_id long, claim_start long, claim_end long, source_id long, source_span_start long, source_span_end long")
    spans = I.claim_spans(claims, notes, sources)
    got = {r["id"]: r for r in spans.collect()}
    assert {k: r["status"] for k, r in got.items() if k not in (13,)} == {1: "accepted", 2: "bounds", 3: "bounds", 4: "overlap", 5: "overlap", 6: "note", 7: "source", 8: "bounds", 9: "overlap", 10: "accepted", 11: "note", 12: "bounds"}
    assert got[4]["claim"] == "pfel" and got[1]["claim"] == "The sky is blue today."  # an offset within a character moves on
    listed = [(r["position"], r["id"], r["uri"]) for r in I.spans_of_notes(spans, sources).orderBy("note_id", "position").collect()]
    accepted = sorted((r["claim_start"], r["id"]) for r in got.values() if r["status"] == "accepted")
    assert listed == [(i + 1, k, "u7") for i, (_, k) in enumerate(accepted)]


def test_long_chain(spark):
    """Cut at any place, edited, relinked or shortened; one event and none; more tasks than events."""
    ev = spark.createDataFrame([(i, 0, "e", f"p{i}" if i % 5 else None, AT + dt.timedelta(seconds=i // 3)) for i in range(100)], "id long, stream long, event_type string, payload string, event_time timestamp")
    whole = spark.createDataFrame(I.chain(ev).collect(), I.chain(ev).schema)
    check = lambda df, parts: tuple(I.check_long_chain(df, parts).first())
    last = whole.orderBy(F.desc("event_time"), F.desc("id")).first()["event_hash"]
    for parts in (1, 7, 300):
        assert check(whole, parts) == (100, 0, 0, last)
        assert check(whole.filter("id <> 50"), parts)[:3] == (99, 1, 0)
        assert check(whole.filter("id > 0"), parts)[:3] == (99, 1, 0)
        assert check(whole.withColumn("payload", F.when(F.col("id") == 33, "x").otherwise(F.col("payload"))), parts)[:3] == (100, 0, 1)
        assert check(whole.withColumn("event_hash", F.when(F.col("id") == 33, None).otherwise(F.col("event_hash"))), parts)[1:3] == (1, 1)
    assert check(whole.limit(0), 3) == (0, 0, 0, None) and check(whole.filter("id = 0"), 3)[:3] == (1, 0, 0)
    old = whole.filter("id < 60")
    head = I.check_long_chain(old).select(F.lit(0).cast("long").alias("stream"), F.col("head").alias("event_hash"))
    assert check(old.unionByName(I.chain(ev.filter("id >= 60"), heads=head)), 5) == (100, 0, 0, last)


def test_any_replacement_of_links(spark):
    df = spark.createDataFrame([("see [[A|x]], [[rel:causal|B]] and [[A|x]] [[C#s]]",), ("",), (None,), ("none",)], "c string")
    got = [r[0] for r in df.select(X.replace_wikilinks(F.col("c"), lambda link: F.concat(F.lit("<"), F.upper(link["target"]), F.lit(":"), link["relation"], F.lit(">")))).collect()]
    assert got == ["see <A:wikilink>, <B:causal> and <A:wikilink> <C:wikilink>", "", None, "none"]

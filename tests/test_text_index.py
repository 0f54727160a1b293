"""The stored text index against a scan of the current notes, after inserts, changes and deletions."""

import re

from pyspark.sql import functions as F

from memloom.operators import search as S
from memloom.operators.text_index import TextIndex

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "id", "score", "rank").collect())


def test_index_equals_scan(spark, tmp_path):
    notes = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), F.concat(F.lit("Doc "), "doc_id").alias("title"), F.col("text").alias("content"))
    odd = spark.createDataFrame([(900, None, None), (901, "Running", "the runner ran and runs"), (902, "", "")], "id long, title string, content string")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").limit(12)
    phrases = item.select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.slice(F.split("text", r"[^\p{L}\p{N}]+"), 1, 2)).alias("phrase")).unionAll(spark.createDataFrame([(800, "the runner"), (801, "running"), (802, ""), (803, "doc 7")], "query_id long, phrase string"))
    questions = item.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))

    def same(index, now):
        assert rows(index.phrase_search(phrases, 30)) == rows(S.phrase_search(now, phrases, 30))
        assert rows(index.phrase_search(phrases, 30, stem=False)) == rows(S.phrase_search(now, phrases, 30, stem=False))
        assert rows(index.any_term_search(questions, 15)) == rows(S.any_term_search(now, questions, 15))

    index = TextIndex.build(notes.filter("id < 150"), f"{tmp_path}/index", buckets=8)
    same(index, notes.filter("id < 150"))
    change = lambda df: df.withColumn("content", F.concat("content", F.lit(" the runner")))
    batch = notes.filter("id >= 150").unionByName(odd).withColumn("deleted", F.lit(False)).unionByName(change(notes.filter("id < 40")).withColumn("deleted", F.expr("id % 3 = 0")))
    now = notes.filter("id >= 40").unionByName(odd).unionByName(change(notes.filter("id < 40 and id % 3 <> 0")))
    index.apply(batch, 1)
    index.apply(batch, 1)  # again, as after a failure
    same(index, now)
    back = notes.filter("id = 3").withColumn("deleted", F.lit(False))
    index.apply(back, 2)
    now = now.unionByName(notes.filter("id = 3"))
    same(index, now)
    same(index.compact(), now)


def test_searches_read_only_their_buckets(spark, tmp_path):
    notes = spark.createDataFrame([(i, f"t{i}", f"word{i} next{i} tail") for i in range(400)], "id long, title string, content string")
    index = TextIndex.build(notes, f"{tmp_path}/index", buckets=16)
    p = index.postings(spark.createDataFrame([("word7",), ("next9",)], "term string"))
    plan = p._jdf.queryExecution().executedPlan().toString()
    asked = re.search(r"PartitionFilters: \[(.*?)\]", plan)[1]
    assert re.search(r"bucket#\d+ (IN|=)", asked)
    assert 0 < p.select("bucket").distinct().count() <= 2
    got = index.phrase_search(spark.createDataFrame([(1, "word7 next7")], "query_id long, phrase string"), stem=False).collect()
    assert [r["id"] for r in got] == [7]


def test_best_of_each_task_are_the_best_of_all(spark, monkeypatch):
    """Any number of terms: tasks that keep their best give what joining all occurrences gives, with ties, copies, empty queries and notes; what is shuffled are the best only."""
    import numpy as np

    monkeypatch.setattr(S, "SCORES", 40)
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{x}" for x in rng.zipf(1.3, n) if x < 400) + " xx é中文"
    made = [(i, f"Title w{i % 7}", text(rng.integers(0, 30))) for i in range(300)] + [(300 + i, "w1", "www w12 w12") for i in range(20)] + [(400, None, None), (401, "", "")]
    notes = spark.createDataFrame(made, "id long, title string, content string").repartition(5)
    asked = spark.createDataFrame([(i, text(6)) for i in range(15)] + [(20, ""), (21, "w1"), (22, None), (23, "www w12 WWW")], "query_id long, question string")
    got = S.any_term_search(notes, asked, 4, least_bytes=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(S, "WANTED", 3)
    assert rows(got) == rows(S.any_term_search(notes, asked, 4, least_bytes=2)) and len(rows(got)) > 40
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan

"""Consolidation: scores, actions, schema clusters and proposals, the proxy gate, and the daily digest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truncate_bytes
from ..session import materialize
from .graph import degrees
from .pairs import components, grouped
from .search import nearest_between, phrase_search
from .vectors import pairs_within, widths


def context_diversity(accesses: DataFrame, full: int = 8) -> DataFrame:
    """(note_id, diversity): distinct non-blank query contexts over ``full``, at most 1."""
    seen = accesses.filter(F.trim(F.coalesce("query_context", F.lit(""))) != "")
    return seen.groupBy("note_id").agg(F.least(F.countDistinct("query_context") / F.lit(float(full)), F.lit(1.0)).alias("diversity"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def score(salience: Column, degree: Column, diversity: Column) -> Column:
    """Consolidation score: the logistic of .45 salience + .25 ln(1 + degree) + .30 diversity."""
    return sigmoid(0.45 * salience + 0.25 * F.log1p(degree) + 0.30 * F.least(F.greatest(diversity, F.lit(0.0)), F.lit(1.0)))


def consolidation_scores(notes: DataFrame, links: DataFrame, accesses: DataFrame, salience: DataFrame) -> DataFrame:
    """(id, salience, degree, diversity, accesses, score) of every note; what a note lacks counts as 0."""
    n = accesses.groupBy("note_id").agg(F.count(F.lit(1)).alias("accesses"))
    out = notes.select("id").join(salience.select(F.col("note_id").alias("id"), "salience"), "id", "left").join(degrees(links), "id", "left")
    out = out.join(context_diversity(accesses).withColumnRenamed("note_id", "id"), "id", "left").join(n.withColumnRenamed("note_id", "id"), "id", "left").na.fill(0)
    return out.withColumn("score", F.round(score(F.col("salience"), F.col("degree"), F.col("diversity")), 6))


def consolidation_pass(scores: DataFrame, last_access: DataFrame, rejections: DataFrame, now: Column, flag_below: float = 0.15, eligible_above: float = 0.80, idle_days: int = 30, aggressive: bool = True, before: float = 0.5) -> DataFrame:
    """(id, score, action, changed): what one pass does with each note that is not suppressed by a rejection.

    Actions: eligible (over eligible_above), archive (aggressive only: below the flag and
    idle, or never accessed), flag (below the flag), keep.
    """
    open_ = scores.join(rejections.filter(F.col("suppress_until") > now).select("id").distinct(), "id", "left_anti")
    out = open_.join(last_access.select(F.col("note_id").alias("id"), "last_accessed_at"), "id", "left")
    idle = F.col("last_accessed_at").isNull() | (F.col("last_accessed_at") < now - F.make_dt_interval(F.lit(idle_days)))
    low = F.col("score") < flag_below
    action = F.when(F.col("score") > eligible_above, "eligible").when(low & idle & F.lit(aggressive), "archive").when(low, "flag").otherwise("keep")
    return out.select("id", "score", action.alias("action"), (F.abs(F.col("score") - before) > 0.01).alias("changed"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles within -1 and 1; 0 for empty, unequal or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (n == 0), 0.0).otherwise(F.least(F.greatest(dot(a, b) / n, F.lit(-1.0)), F.lit(1.0)))


def similar_pairs(vectors: DataFrame, least: float, cell: int = 1024) -> DataFrame:
    """(a, b, similarity) with a < b for vectors (id, embedding) with a cosine of ``least`` (over 0) or more.

    Exact: vectors in cells of about ``cell`` meet only the cells that such a cosine lets them reach
    (``vectors.pairs_within``). Vectors of different widths are similar to none.
    """
    found = [pairs_within(vectors, least, cell, w) for w in widths(vectors)]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], "a long, b long, similarity double")


def clusters(pairs: DataFrame, min_size: int = 3) -> DataFrame:
    """(id, cluster): single-linkage clusters of at least ``min_size`` nodes, named by their least id."""
    return _large(components(pairs), min_size)


def _large(c: DataFrame, min_size: int) -> DataFrame:
    big = c.groupBy("label").count().filter(F.col("count") >= min_size).select("label")
    return c.join(big, "label", "left_semi").select("id", F.col("label").alias("cluster"))


def clusters_with_similarity(pairs: DataFrame, min_size: int = 3) -> tuple[DataFrame, DataFrame]:
    """``clusters`` of the pairs and their ``mean_similarity`` over the same pairs, which are made once and neither kept nor shuffled: a pair lies in one cluster."""
    c, sums = grouped(pairs)
    members = materialize(_large(c, min_size))
    m = members.join(sums, "id").groupBy("cluster").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return members, _means(members, m)


def _means(members: DataFrame, m: DataFrame) -> DataFrame:
    return members.select("cluster").distinct().join(m, "cluster", "left").select("cluster", F.expr("coalesce(((2 * s + n) div (2 * n)) / 1e6D, 1D)").alias("mean_similarity"))


def centroids(members: DataFrame, vectors: DataFrame, key: str = "cluster") -> DataFrame:
    """(cluster, members, centroid): element-wise means."""
    e = members.join(vectors.select("id", "embedding"), "id").select(key, F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    c = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: F.round(s["m"], 6))
    return m.groupBy(key).agg(F.max("n").alias("members"), c.alias("centroid"))


def mean_similarity(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cluster, mean_similarity) over the given pairs within each cluster; 1 where there are none.

    The mean is made of whole millionths, halves up, so that it does not depend on the order of the pairs.
    """
    a = members.select(F.col("id").alias("a"), F.col("cluster"))
    b = members.select(F.col("id").alias("b"), F.col("cluster").alias("other"))
    m = pairs.join(a, "a").join(b, "b").filter("cluster = other").groupBy("cluster").agg(F.sum(F.round(F.col("similarity") * 1e6).cast("long")).alias("s"), F.count(F.lit(1)).alias("n"))
    return _means(members, m)


def nearest_schema(centres: DataFrame, schemas: DataFrame, least: float = 0.82) -> DataFrame:
    """(cluster, schema_id, similarity, decision): the most similar schema (schema_id, vector) of each cluster (cluster, centroid); patch it if similar enough, else create one."""
    near = nearest_between(centres.select(F.col("cluster").alias("query_id"), F.col("centroid").alias("vector")), schemas.select(F.col("schema_id").alias("id"), F.col("vector").alias("embedding")))
    best = near.select(F.col("query_id").alias("cluster"), F.col("id").alias("schema_id"), F.col("score").alias("similarity"))
    return best.withColumn("decision", F.when(F.col("similarity") >= least, "patch").otherwise("create"))


def groundedness(query: Column, context: Column) -> Column:
    """The share of a query's tokens of 3 bytes or more that the context holds; 0 without tokens."""
    t = F.filter(F.split(F.lower(query), r"[^\p{L}\p{N}]+"), lambda x: F.octet_length(x) >= 3)
    return F.when(F.size(t) == 0, 0.0).otherwise(F.size(F.filter(t, lambda x: F.contains(F.lower(context), x))) / F.size(t))


def proxy_score(query: Column, context: Column, retrieved: Column, sources: Column) -> Column:
    """Half the groundedness and half the share of the sources that are among the retrieved ids; without sources that share is 0."""
    share = F.when(F.size(sources) == 0, 0.0).otherwise(F.size(F.filter(sources, lambda x: F.array_contains(retrieved, x))) / F.size(sources))
    return 0.5 * groundedness(query, context) + 0.5 * share


def extractive_proposals(members: DataFrame, notes: DataFrame, similarity: DataFrame) -> DataFrame:
    """(cluster, title, content): the text of a schema over each cluster's notes (id, title, content), in order of ids; 240 bytes of each."""
    e = members.join(notes.select("id", "title", "content"), "id").select("cluster", F.struct("id", "title", truncate_bytes(F.col("content"), 240).alias("excerpt")).alias("e"))
    g = e.groupBy("cluster").agg(F.array_sort(F.collect_list("e")).alias("e")).join(similarity.select("cluster", "mean_similarity"), "cluster")
    more = F.when(F.size("e") > 1, F.concat(F.lit(" (+"), F.size("e") - 1, F.lit(" more)"))).otherwise("")
    lines = F.array_join(F.transform("e", lambda x: F.concat(F.lit("- "), x["title"], F.lit(": "), x["excerpt"])), "\n")
    content = F.concat(F.format_string("Extractive schema over %d episodes (mean cosine %.2f).\n\n", F.size("e"), F.col("mean_similarity")), lines)
    return g.select("cluster", F.concat(F.lit("Schema: "), F.col("e")[0]["title"], more).alias("title"), content.alias("content"))


def proxy_gate(proposals: DataFrame, members: DataFrame, accesses: DataFrame, notes: DataFrame, sample: int = 8, top_k: int = 3, least: float = 0.05, stem: bool = True) -> DataFrame:
    """(cluster, queries, mean_delta, decision): whether a schema (cluster, title, content) would help the queries of its sources.

    ``members``: id, cluster. Held out are the ``sample`` last used query contexts of each
    cluster's notes, ties by name. Each is scored half by groundedness and half by the share of sources
    found, with the ``top_k`` notes of the phrase search and with the schema before them, which covers all
    sources. A mean gain over ``least`` is accepted, another one rejected; without queries the gate is unavailable.
    """
    log = accesses.filter(F.trim(F.coalesce("query_context", F.lit(""))) != "").select(F.col("note_id").alias("id"), "query_context", "accessed_at")
    used = log.join(members.select("id", "cluster"), "id").groupBy("cluster", F.col("query_context").alias("query_id")).agg(F.max("accessed_at").alias("at"))
    w = Window.partitionBy("cluster").orderBy(F.desc("at"), "query_id")
    held = materialize(used.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= sample).select("cluster", "query_id"))
    hits = materialize(phrase_search(notes, held.select("query_id", F.col("query_id").alias("phrase")).distinct(), top_k, stem=stem).select("query_id", "id", "rank"))
    text = F.struct("rank", F.concat("title", F.lit("\n"), "content", F.lit("\n")).alias("text"))
    found = hits.join(notes.select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content")), "id")
    context = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(text)), lambda x: x["text"]), "").alias("context"))
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("sources"))
    covered = held.join(hits, "query_id").join(members.select("id", "cluster"), ["id", "cluster"]).groupBy("cluster", "query_id").agg(F.count(F.lit(1)).alias("covered"))
    q = held.join(context, "query_id", "left").join(covered, ["cluster", "query_id"], "left").join(size, "cluster").join(proposals.select("cluster", "title", "content"), "cluster")
    without = F.coalesce("context", F.lit(""))
    gain = groundedness(F.col("query_id"), F.concat("title", F.lit("\n"), "content", F.lit("\n"), without)) - groundedness(F.col("query_id"), without)
    delta = 0.5 * gain + 0.5 * (1 - F.coalesce("covered", F.lit(0)) / F.col("sources"))
    means = q.select("cluster", delta.alias("delta")).groupBy("cluster").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("delta"), 6).alias("mean_delta"))
    decision = F.when(F.col("mean_delta").isNull(), "unavailable").when(F.col("mean_delta") > least, "accept").otherwise("reject")
    return proposals.select("cluster").join(means, "cluster", "left").select("cluster", F.coalesce("queries", F.lit(0)).alias("queries"), "mean_delta", decision.alias("decision"))


def trending_tags(tags_at: DataFrame, now: Column, days: int = 7, limit: int = 10, rising: int = 3) -> DataFrame:
    """(tag, uses, trend) of the last days from (tag, at): rising over ``rising`` uses, else stable."""
    recent = tags_at.filter((F.col("at") > now - F.make_dt_interval(F.lit(days))) & (F.col("at") <= now))
    t = recent.groupBy("tag").agg(F.count(F.lit(1)).alias("uses")).orderBy(F.desc("uses"), "tag").limit(limit)
    return t.withColumn("trend", F.when(F.col("uses") > rising, "rising").otherwise("stable"))


def on_this_day(notes: DataFrame, now: Column) -> DataFrame:
    """Notes made on the same day of the month (and, over a year, of the year) before now."""
    return notes.filter((F.date_format("created_at", "dd") == F.date_format(now, "dd")) & (F.to_date("created_at") < F.to_date(now))).select("id", "title", F.to_date("created_at").alias("day"))


def recall(answers: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """(queries, recall, mrr) of hits (query_id, id, rank) against answers (query_id, id)."""
    j = answers.distinct().join(hits.filter(F.col("rank") <= k), ["query_id", "id"], "left")
    q = j.groupBy("query_id").agg((F.count("rank") / F.count(F.lit(1))).alias("r"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr"))
    return q.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("r"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"))

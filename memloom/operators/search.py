"""Full-text phrase search with BM25, vector search, fusion, and context assembly, for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.porter import stemmed
from ..session import Scratch, materialize
from .graph import bfs
from .vectors import nearest_neighbours, widths

K1, B = 1.2, 0.75
#: Query vectors that go to every task at once.
QUERY_BLOCK = 4096
#: Terms of queries that go to every task at most, and scores (notes by queries) that it makes at once.
WANTED, SCORES = 200_000, 1_000_000
#: Vectors of each of the two blocks that meet in a task when all are compared with all.
MEETING_BLOCK = 2048


def postings(notes: DataFrame) -> DataFrame:
    """(id, dl, field, pos, a, b): each term of title and content with the one after it in the field, and the note's number of terms."""
    words = notes.select("id", F.array(*(X.ordered_tokens(F.coalesce(F.col(f), F.lit(""))) for f in ("title", "content"))).alias("w"))
    words = words.select("id", (F.size(F.col("w")[0]) + F.size(F.col("w")[1])).alias("dl"), F.posexplode("w").alias("field", "t"))
    return words.select("id", "dl", "field", "t", F.posexplode("t").alias("pos", "a")).select("id", "dl", "field", "pos", "a", F.get("t", F.col("pos") + 1).alias("b"))


def variants(notes: DataFrame, stems: DataFrame) -> DataFrame:
    """(term, stem): the terms of the notes whose stem is one of (stem). Each distinct term is stemmed once."""
    every = notes.select(F.explode(F.concat(*(X.ordered_tokens(F.coalesce(F.col(f), F.lit(""))) for f in ("title", "content")))).alias("term")).distinct()
    return every.withColumn("stem", stemmed(F.array("term"))[0]).join(stems, "stem", "left_semi").select("term", "stem")


def phrase_search(notes: DataFrame, queries: DataFrame, k: int = 20, offset: int = 0, stem: bool = True) -> DataFrame:
    """(query_id, id, score, rank) for queries (query_id, phrase): adjacent terms within a field, by BM25.

    A phrase is its pairs of neighbours, which meet the pairs of the texts: pairs are
    far rarer than terms, so a frequent word makes no rows of its own. An occurrence is
    a start at which all pairs of a phrase meet; a phrase of one term meets single terms.
    Texts are not scanned once for each query. Queries without terms match nothing.
    """
    q = phrase_terms(queries, stem)
    known = materialize(variants(notes, q.select(F.explode("terms").alias("stem")).distinct())) if stem else None
    return phrase_hits(postings(notes), lengths(notes), wanted_pairs(q, known), k, offset)


def phrase_terms(queries: DataFrame, stem: bool) -> DataFrame:
    """(query_id, terms) of the phrases that have any."""
    terms = X.ordered_tokens(F.col("phrase"))
    return queries.select("query_id", (stemmed(terms) if stem else terms).alias("terms")).filter(F.size("terms") > 0)


def wanted_pairs(q: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(query_id, m, k, a, b): the m pairs of neighbours of each phrase, b null for a phrase of one term; ``known`` (term, stem) puts terms in the places of stems."""
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("terms") - 2, F.lit(0))), lambda i: F.struct(F.get("terms", i).alias("a"), F.get("terms", i + 1).alias("b")))
    want = q.select("query_id", F.greatest(F.size("terms") - 1, F.lit(1)).alias("m"), F.posexplode(pairs).alias("k", "p")).select("query_id", "m", "k", "p.a", "p.b")
    if known is not None:
        second = known.select(F.col("term").alias("to"), F.col("stem").alias("b"))
        want = want.join(known.withColumnRenamed("stem", "a"), "a").drop("a").withColumnRenamed("term", "a").join(second, "b", "left").filter("b is null or to is not null").drop("b").withColumnRenamed("to", "b")
    return want


def lengths(notes: DataFrame) -> DataFrame:
    """(id, dl): the number of terms of each note."""
    return notes.select("id", (F.size(X.ordered_tokens(F.coalesce("title", F.lit("")))) + F.size(X.ordered_tokens(F.coalesce("content", F.lit(""))))).alias("dl"))


def _whole(size: DataFrame):
    return size.agg(F.struct(F.count(F.lit(1)).cast("double").alias("total"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("mean")).alias("s")).scalar()


def _bm25(tf: DataFrame, size: DataFrame, by: list[str]) -> DataFrame:
    """tf (query_id, id, dl, tf) with its weight; the number of notes with it is counted for each of ``by``."""
    df = tf.groupBy(*by).agg(F.count(F.lit(1)).alias("df"))
    hits = tf.join(df, by).withColumn("s", _whole(size))
    idf = F.greatest(F.log((F.col("s.total") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    return hits.withColumn("weight", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("s.mean"))))


def phrase_hits(p: DataFrame, size: DataFrame, want: DataFrame, k: int, offset: int = 0) -> DataFrame:
    """(query_id, id, score, rank) from postings, lengths of the notes and wanted pairs."""
    two, one = want.filter("b is not null"), want.filter("b is null").drop("b")
    met = p.join(two, ["a", "b"]).select("query_id", "m", "k", "id", "dl", "field", "pos").unionAll(p.join(one, "a").select("query_id", "m", "k", "id", "dl", "field", "pos"))
    starts = met.groupBy("query_id", "m", "id", "dl", "field", (F.col("pos") - F.col("k")).alias("start")).agg(F.count(F.lit(1)).alias("c")).filter("c = m")
    tf = starts.groupBy("query_id", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    return top(_bm25(tf, size, ["query_id"]).select("query_id", "id", F.round("weight", 6).alias("score")), k, offset)


def question_terms(queries: DataFrame, least_bytes: int = 3) -> DataFrame:
    """(query_id, a): the distinct terms of each question of ``least_bytes`` or more."""
    terms = F.array_distinct(F.filter(X.ordered_tokens(F.col("question")), lambda t: F.octet_length(t) >= least_bytes))
    return queries.select("query_id", F.explode(terms).alias("a"))


def any_term_hits(p: DataFrame, size: DataFrame, want: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) from postings, lengths of the notes and wanted terms."""
    tf = p.join(want, "a").groupBy("query_id", "a", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    return top(_bm25(tf, size, ["query_id", "a"]).groupBy("query_id", "id").agg(F.round(F.sum("weight"), 6).alias("score")), k)


def any_term_search(notes: DataFrame, queries: DataFrame, k: int = 20, least_bytes: int = 3) -> DataFrame:
    """(query_id, id, score, rank) for queries (query_id, question): notes with any of the terms of ``least_bytes`` or more, by the sum of their BM25 weights.

    Up to WANTED terms of queries go to every task, which counts them in its notes; then each task keeps its best ``k`` for each query, so
    what is shuffled does not depend on the number of notes. With more, occurrences are counted and joined on Spark. A query without terms matches
    nothing, a note without an id is never found.
    """
    want = question_terms(queries, least_bytes)
    got = want.limit(WANTED + 1).toArrow()
    if len(got) > WANTED:
        return any_term_hits(postings(notes), lengths(notes), want, k)
    spark, scratch = notes.sparkSession, Scratch(notes.sparkSession)
    names = got.column(0).combine_chunks().dictionary_encode("encode")
    terms = got.column(1).combine_chunks().dictionary_encode()
    sent = spark.sparkContext.broadcast(terms.dictionary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = pc.index_in(b.column(1).flatten(), value_set=sent.value)
            some = at.is_valid().to_numpy(zero_copy_only=False)
            row = pc.list_parent_indices(b.column(1)).to_numpy()[some]
            key, tf = np.unique(row.astype(np.int64) << 32 | at.drop_null().to_numpy(), return_counts=True)
            ends = pa.array(np.append(0, np.cumsum(np.bincount(key >> 32, minlength=len(b)))).astype(np.int32))
            lists = (pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (key & (2**32 - 1), tf))
            yield pa.RecordBatch.from_arrays([b.column(0), pc.list_value_length(b.column(1)).cast(pa.int32()), *lists], names=["id", "dl", "t", "tf"])

    words = F.concat(*(X.ordered_tokens(F.coalesce(F.col(f), F.lit(""))) for f in ("title", "content")))
    counted = scratch.write(notes.select(F.col("id").cast("long").alias("id"), words.alias("w")).mapInArrow(count, "id long, dl int, t array<int>, tf array<int>"), "counted")
    total, mean = counted.agg(F.count(F.lit(1)), F.coalesce(F.avg("dl"), F.lit(1.0))).first()
    df = np.zeros(len(terms.dictionary))
    for r in counted.select(F.explode("t").alias("t")).groupBy("t").count().collect():  # WANTED at most
        df[r["t"]] = r["count"]
    of = terms.indices.to_numpy()
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(len(df) + 1))
    shared = spark.sparkContext.broadcast((np.maximum(np.log((total - df + 0.5) / (df + 0.5)), 1e-6), bounds, names.indices.to_numpy()[order], names.dictionary))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, bounds, asks, names = shared.value
        many, kept, waiting = len(names), [], 0

        def pack() -> None:
            q, i, s = (np.concatenate(c) for c in zip(*kept, strict=True))
            by = np.lexsort((i, -s, q))
            q, i, s = q[by], i[by], s[by]
            first = np.flatnonzero(np.diff(q, prepend=-1))
            some = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k
            kept[:] = [(q[some], i[some], s[some])]

        for b in batches:
            step = max(1, SCORES // max(many, 1))
            for at in range(0, len(b), step):
                part = b.slice(at, step)
                n = pc.list_value_length(part.column(2)).to_numpy()
                row, t, tf = np.repeat(np.arange(len(part)), n), part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
                weight = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * part.column(1).to_numpy()[row] / mean))
                n = bounds[t + 1] - bounds[t]
                stop = np.cumsum(n)
                q = asks[np.arange(n.sum()) + np.repeat(bounds[t] - stop + n, n)]
                sums = np.bincount(np.repeat(row, n) * many + q, np.repeat(weight, n), len(part) * many)
                hit = np.flatnonzero(sums)
                kept.append((hit % many, part.column(0).to_numpy()[hit // many], np.floor(sums[hit] * 1e6 + 0.5).astype(np.int64)))
                waiting += len(hit)
                if waiting > SCORES:
                    pack()
                    waiting = 0
        if kept:
            pack()
            q, i, s = kept[0]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), pa.array(i), pa.array(s / 1e6)], names=["query_id", "id", "score"])

    hits = counted.filter("id is not null and size(t) > 0").mapInArrow(best, f"query_id {queries.schema['query_id'].dataType.simpleString()}, id long, score double")
    return top(hits, k)


def replay_rerank(hits: DataFrame, scores: DataFrame, k: int = 10, alpha: float = 0.6) -> DataFrame:
    """(query_id, id, score, rank): the first ``3 * k`` hits by alpha over their rank plus the rest of the consolidation score (id, consolidation_score)."""
    h = hits.filter(F.col("rank") <= 3 * k).join(scores.select("id", "consolidation_score"), "id", "left")
    score = F.round(alpha / F.col("rank") + (1 - alpha) * F.coalesce("consolidation_score", F.lit(0.0)), 6)
    return top(h.select("query_id", "id", score.alias("score")), k)


def top(hits: DataFrame, k: int, offset: int = 0, by: str = "query_id", ascending: bool = False) -> DataFrame:
    order = F.col("score").asc() if ascending else F.col("score").desc()
    w = Window.partitionBy(by).orderBy(order, "id")
    return hits.withColumn("rank", F.row_number().over(w) - offset).filter((F.col("rank") > 0) & (F.col("rank") <= k))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", exclude_self: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` nearest of (id, embedding) to each of (query_id, vector), exactly.

    Up to QUERY_BLOCK queries go to every task, which keeps its best ``k`` (all that tie
    with the last one) for each, so what is shuffled does not depend on the number
    of vectors. More queries meet the vectors on Spark, in cells (L2) or in blocks (cosine).
    Vectors of another width, and null ones, are never near. Distances are L2; metric cosine
    gives similarities, best first, 0 where a norm is 0.
    """
    rows = queries.filter("vector is not null").select("query_id", "vector")
    near, more = metric == "l2", k + int(exclude_self)
    got = rows.limit(QUERY_BLOCK + 1).collect()
    if len(got) > QUERY_BLOCK:
        hits = nearest_neighbours(vectors, rows, more) if near else nearest_between(rows, vectors, more)
        hits = hits.drop("rank")
    elif not got:
        return vectors.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    else:
        hits = _scan(vectors, [r["query_id"] for r in got], [list(r["vector"]) for r in got], more, near)
    return top(hits.filter("query_id <> id") if exclude_self else hits, k, ascending=near)


def _scan(vectors: DataFrame, names: list[int], points: list[list[float]], k: int, near: bool) -> DataFrame:
    """(query_id, id, score): each task's best ``k`` for each of a bounded number of points."""
    sent = vectors.sparkSession.sparkContext.broadcast((names, points))

    def run(batches):
        names, vs = sent.value
        q = np.array(vs, float)
        norm = np.linalg.norm(q, axis=1)
        for b in batches:
            ids, x = b.column(0).to_pylist(), b.column(1).to_pylist()
            ok = [i for i, v in enumerate(x) if v is not None and len(v) == q.shape[1]]
            if not ok:
                continue
            m = np.array([x[i] for i in ok], float)
            dot = q @ m.T
            if near:
                s = np.sqrt(np.maximum((q**2).sum(1)[:, None] + (m**2).sum(1) - 2 * dot, 0))
            else:
                n = norm[:, None] * np.linalg.norm(m, axis=1)
                s = np.clip(np.divide(dot, n, out=np.zeros_like(dot), where=n > 0), -1, 1)
            s = s.round(6)
            key = s if near else -s
            last = np.partition(key, k - 1, axis=1)[:, k - 1] if key.shape[1] > k else np.full(len(q), np.inf)
            a, c = np.nonzero(key <= last[:, None])
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in a], pa.int64()), pa.array([ids[ok[j]] for j in c], pa.int64()), pa.array(s[a, c])], names=["query_id", "id", "score"])

    return vectors.select(F.col("id").cast("long"), "embedding").mapInArrow(run, "query_id long, id long, score double")


def nearest_each(vectors: DataFrame, k: int = 10, cell: int = 1024) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` nearest others by L2 distance of each of (id, embedding), exactly.

    In cells of about ``cell`` vectors (``vectors.nearest_neighbours``); nothing passes through the driver.
    Only vectors of the same width are near, null ones never.
    """
    found = [nearest_neighbours(vectors, None, k, cell, w) for w in widths(vectors)]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")


def nearest_between(queries: DataFrame, vectors: DataFrame, k: int = 1) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` of (id, embedding) with the highest cosine to each of (query_id, vector), exactly.

    Both tables may be large: each block of queries meets each block of vectors in one task, and only the best ``k`` of
    each block, with all that tie, are shuffled. Vectors of another width, and null ones, are never near; the cosine with a zero vector is 0.
    """
    q = queries.filter("vector is not null").select(F.lit(0).alias("side"), F.col("query_id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("v"))
    x = vectors.filter("embedding is not null").select(F.lit(1).alias("side"), F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    m, n = (max(1, -(-d.count() // MEETING_BLOCK)) for d in (q, x))
    q = q.select(F.pmod(F.xxhash64("id"), F.lit(m)).alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("q"), "side", "id", "v")
    x = x.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias("p"), F.pmod(F.xxhash64("id"), F.lit(n)).alias("q"), "side", "id", "v")

    def compare(rows: list[tuple]):
        sides: list[dict[int, list]] = [{}, {}]
        for _, _, side, name, v in rows:
            sides[side].setdefault(len(v), []).append((name, v))
        for width, left in sides[0].items():
            right = sides[1].get(width)
            if not right or not width:
                continue
            a, b = np.array([r[1] for r in left], float), np.array([r[1] for r in right], float)
            size = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)
            sim = np.clip(np.divide(a @ b.T, size, out=np.zeros((len(a), len(b))), where=size > 0), -1, 1).round(6)
            last = np.partition(-sim, k - 1, axis=1)[:, k - 1] if sim.shape[1] > k else np.full(len(sim), np.inf)
            i, j = np.nonzero(-sim <= last[:, None])
            yield pa.RecordBatch.from_arrays([pa.array([left[t][0] for t in i], pa.int64()), pa.array([right[t][0] for t in j], pa.int64()), pa.array(sim[i, j], pa.float64())], names=["query_id", "id", "score"])

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:2] != now:
                    yield from compare(rows)
                    now, rows = r[:2], []
                rows.append(r)
        yield from compare(rows)

    met = q.unionByName(x).repartition("p", "q").sortWithinPartitions("p", "q")
    return top(met.mapInArrow(run, "query_id long, id long, score double"), k)


def reciprocal_rank_fusion(fts: DataFrame, semantic: DataFrame, limit: int = 10, fts_weight: float = 0.5, k: int = 60) -> DataFrame:
    """(query_id, id, score, match_source, rank) from two ranked lists, each cut at twice the limit."""
    a = fts.filter(F.col("rank") <= 2 * limit).select("query_id", "id", (fts_weight / (k + F.col("rank"))).alias("s"), F.lit(1).alias("src"))
    b = semantic.filter(F.col("rank") <= 2 * limit).select("query_id", "id", ((1 - fts_weight) / (k + F.col("rank"))).alias("s"), F.lit(2).alias("src"))
    both = a.unionAll(b).groupBy("query_id", "id").agg(F.round(F.sum("s"), 9).alias("score"), F.sum("src").alias("src"))
    source = F.when(F.col("src") == 1, "fts").when(F.col("src") == 2, "semantic").otherwise("both")
    return top(both.select("query_id", "id", "score", source.alias("match_source")), limit)


def salience_boost(hits: DataFrame, scores: DataFrame, weight: float = 0.2) -> DataFrame:
    """Hits with score * (1 + weight * consolidation score within 0 and 1), ranked anew; notes without a score are not boosted."""
    cs = F.least(F.greatest(F.coalesce("consolidation_score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    out = hits.drop("rank").join(scores.select("id", "consolidation_score"), "id", "left")
    out = out.withColumn("score", F.round(F.col("score") * (1 + weight * cs), 9)).drop("consolidation_score")
    return top(out, 2**31 - 1)


def expand_context(seeds: DataFrame, notes: DataFrame, links: DataFrame, top_k: int = 10, depth: int = 1) -> DataFrame:
    """(query_id, id, score, match_type): search hits, their neighbours in the graph, and the schemas of both.

    ``notes``: id, parent_schema_id. Of the notes within ``depth`` open links of a query's
    hits the first max(top_k / 2, 1) by depth and id join it (graph, score 0), then each
    parent schema that is not there yet (schema, score 1). Ids without a note join nothing.
    """
    known = notes.select("id", "parent_schema_id")
    hits = materialize(seeds.select("query_id", "id", "score", "match_type").join(known.select("id"), "id", "left_semi").select("query_id", "id", "score", "match_type"))
    near = bfs(links.filter("valid_until is null"), hits.select("id"), depth).join(hits.select("query_id", F.col("id").alias("seed")), "seed")
    near = near.groupBy("query_id", "id").agg(F.min("depth").alias("depth")).join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("depth", "id")
    near = near.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max(top_k // 2, 1)).join(known.select("id"), "id", "left_semi")
    both = materialize(hits.unionByName(near.select("query_id", "id", F.lit(0.0).alias("score"), F.lit("graph").alias("match_type"))))
    up = both.join(known.filter("parent_schema_id is not null"), "id").select("query_id", F.col("parent_schema_id").alias("id")).distinct()
    up = up.join(both.select("query_id", "id"), ["query_id", "id"], "left_anti").join(known.select("id"), "id", "left_semi")
    return both.unionByName(up.select("query_id", "id", F.lit(1.0).alias("score"), F.lit("schema").alias("match_type")))


def retrieve_context(seeds: DataFrame, notes: DataFrame, max_tokens: int = 4096) -> DataFrame:
    """(query_id, position, id, match_type, composite, block_chars, chars_before, used) from candidates (query_id, id, score, match_type).

    ``notes``: id, title, content, consolidation_score. Candidates are ranked by .5 score + .3
    consolidation + .2 for schemas, then by id, each note once at its best; blocks are
    taken as long as four characters a token allow. The first block that does not fit
    is cut if more than 200 are left, and it is listed as a source (unlike in the
    reference, which leaves it out). Lengths are characters, so no character is cut in two.
    """
    c = seeds.join(notes.select("id", "title", "content", "consolidation_score"), "id")
    comp = F.round(0.5 * F.col("score") + 0.3 * F.coalesce("consolidation_score", F.lit(0.0)) + F.when(F.col("match_type") == "schema", 0.2).otherwise(0.0), 6)
    c = c.withColumn("composite", comp)
    once = Window.partitionBy("query_id", "id").orderBy(F.desc("composite"), "match_type")
    c = c.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    w = Window.partitionBy("query_id").orderBy(F.desc("composite"), "id")
    c = c.withColumn("position", F.row_number().over(w))
    size = F.length(F.col("position").cast("string")) + F.length("title") + F.length("content") + 9
    c = c.withColumn("block_chars", size).withColumn("chars_before", F.coalesce(F.sum("block_chars").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    left = F.lit(4 * max_tokens) - F.col("chars_before")
    used = F.when(F.col("block_chars") <= left, F.col("block_chars")).when(left > 200, left)
    return c.withColumn("used", used).filter("used is not null").select("query_id", "position", "id", "match_type", "composite", "block_chars", "chars_before", "used")


def rag_context(hits: DataFrame, notes: DataFrame, links: DataFrame, top_k: int = 10, depth: int = 1, max_tokens: int = 2048) -> DataFrame:
    """(query_id, position, id, match_type, score, preview, used): sources of an answer, hits (query_id, id, score, rank, match_source) first, then their neighbours.

    Of the notes within ``depth`` open links the first max(top_k, 5) by depth and id join a query's hits, with score
    0. All are sources; their blocks go into the context in this order as far as four characters a token allow. The first that
    does not fit is cut if more than 100 are left, and nothing follows it; ``used`` is null for sources that are not in it.
    """
    known = notes.select("id", "title", "content")
    seeds = materialize(hits.filter(F.col("rank") <= top_k).join(notes.select("id"), "id", "left_semi").select("query_id", "id", "score", "rank", F.col("match_source").alias("match_type")))
    near = bfs(links.filter("valid_until is null"), seeds.select("id"), depth).join(seeds.select("query_id", F.col("id").alias("seed")), "seed")
    near = near.groupBy("query_id", "id").agg(F.min("depth").alias("depth")).join(seeds.select("query_id", "id"), ["query_id", "id"], "left_anti")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("depth", "id"))).filter(F.col("n") <= max(top_k, 5))
    every = seeds.unionByName(near.select("query_id", "id", F.lit(0.0).alias("score"), (F.col("n") + top_k).alias("rank"), F.lit("graph").alias("match_type"))).join(known, "id")
    w = Window.partitionBy("query_id").orderBy("rank", "id")
    c = every.withColumn("position", F.row_number().over(w))
    c = c.withColumn("size", F.length(F.col("position").cast("string")) + F.length("title") + F.length("content") + 14)
    before = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("room", F.lit(4 * max_tokens) - before)
    used = F.when(F.col("size") <= F.col("room"), F.col("size")).when(F.col("room") > 100, F.col("room"))
    return c.select("query_id", "position", "id", "match_type", "score", X.preview(F.col("content")).alias("preview"), used.alias("used"))

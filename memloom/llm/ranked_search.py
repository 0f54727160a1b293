"""Ranked lexical search by buckets of impact vectors of similar length.

A document's impact vector has one whole number for each of its terms that a query holds.
Vectors are dealt in descending order of their length (norm) and cut into buckets. A query
passes a bucket by if its own norm times the bucket's greatest cannot reach the score that
its k-th document has (Cauchy-Schwarz). Within a bucket the query's heaviest coordinates are
summed, and what the rest can add is bounded by the norms of the remaining coordinates; only
documents whose bound reaches the threshold are scored, exactly and in whole numbers.

The longest vectors are searched first and give every query its first threshold; then all buckets
follow in parallel, and each task raises its own thresholds as it goes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .arrow import ROWS, pieces

#: Terms of the queries that are searched together at most (about; queries are dealt to blocks by hash).
QUERY_TERMS = 500_000
#: Documents of a bucket, and query coordinates that are summed before the rest is bounded.
BUCKET, FOCUS = 2048, 8
#: Characters of a text that are cut into terms at once.
LONG = 1 << 22

#: Stands for a null doc_id, which comes last among equal scores.
NO_ID = 2**63 - 1

#: ASCII letters and digits, and all bytes of other characters, are parts of terms; A-Z count as a-z, the rest as spaces.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded length."""
    raw, at = text.encode().translate(_TERMS), 0
    while at < len(raw):
        end = raw.find(b" ", at + LONG)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


@dataclass
class Query:
    """A query's terms by their numbers, ascending, with what each adds per unit of impact."""

    item: int
    terms: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        heavy = np.argsort(-self.weights, kind="stable")[:FOCUS]
        rest = np.delete(self.weights, heavy).astype(float)
        self.heavy, self.rest = heavy, float(np.sqrt((rest * rest).sum()))
        self.norm = float(np.sqrt((self.weights.astype(float) ** 2).sum()))


def frequencies(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term, tf): the number of terms of each text, and its terms among ``number`` with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches):
        get = shared.value.get
        for b in batches:
            for first in range(0, len(b), ROWS):
                ids, texts = b.column(0).slice(first, ROWS), [t or "" for t in b.column(1).slice(first, ROWS).to_pylist()]
                at = 0
                for part in pieces(texts):
                    n, found = [], []
                    for t in part:
                        count, has = 0, Counter()
                        for some in terms(t):
                            count += len(some)
                            has.update(map(get, some))
                        has.pop(None, None)
                        n.append(count)
                        found.append(has)
                    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                    term = pa.array([i for h in found for i in h], pa.int32())
                    tf = pa.array([k for h in found for k in h.values()], pa.int32())
                    lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (term, tf)]
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "term", "tf"])
                    at += len(part)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Ends (from 0) and values of a column of lists without nulls."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return ends - ends[0], column.values.to_numpy()[ends[0] : ends[-1]]


def impacts(counted: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(doc_id, norm, term, impact) of the documents that hold a term; terms ascending."""

    def run(batches):
        for b in batches:
            ends, term = _lists(b.column(2))
            _, tf = _lists(b.column(3))
            m = 75 + 25 * b.column(1).to_numpy() * n_docs // n_terms
            row = np.repeat(np.arange(len(b)), np.diff(ends))
            order = np.lexsort((term, row))
            tf = tf.astype(np.int64)[order]
            impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[row])
            norm = np.sqrt(np.bincount(row, impact.astype(float) ** 2, len(b)))
            lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x, pa.int32())) for x in (term[order], impact.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(norm), *lists], names=["doc_id", "norm", "term", "impact"])

    return counted.filter(F.size("term") > 0).mapInArrow(run, "doc_id long, norm double, term array<int>, impact array<int>")


class Best:
    """The k best documents of one query so far: score descending, then doc_id ascending (no id last)."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, least
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.least
        s, d = np.concatenate([self.scores, scores[keep]]), np.concatenate([self.ids, ids[keep]])
        first = np.lexsort((d, -s))[: self.k]
        self.scores, self.ids = s[first], d[first]
        if len(first) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


def search_bucket(norm: np.ndarray, ends: np.ndarray, term: np.ndarray, impact: np.ndarray, ids: np.ndarray, queries: list[Query], best: list[Best]) -> int:
    """Raise ``best`` by the documents of one bucket; returns how many documents were scored exactly."""
    row = np.repeat(np.arange(len(norm)), np.diff(ends))
    order = np.argsort(term, kind="stable")
    by_term, docs, value = term[order], row[order], impact[order].astype(float)
    top, square, scored = float(norm.max()), norm * norm, 0
    for q, b in zip(queries, best, strict=True):
        if not len(q.terms) or q.norm * top * (1 + 1e-9) < b.least:
            continue
        heavy = q.terms[q.heavy]
        lo, hi = np.searchsorted(by_term, heavy), np.searchsorted(by_term, heavy, "right")
        got, used = np.zeros(len(norm)), np.zeros(len(norm))
        for w, i, j in zip(q.weights[q.heavy].tolist(), lo.tolist(), hi.tolist(), strict=True):
            v, d = value[i:j], docs[i:j]
            got[d] += w * v
            used[d] += v * v
        bound = (got + q.rest * np.sqrt(np.maximum(square - used, 0) + 1)) * (1 + 1e-9)
        alive = np.flatnonzero(bound >= b.least)
        if not len(alive):
            continue
        scored += len(alive)
        size = ends[alive + 1] - ends[alive]
        start = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(ends[alive] - start, size)
        place = np.minimum(np.searchsorted(q.terms, term[at]), len(q.terms) - 1)
        part = np.where(q.terms[place] == term[at], q.weights[place] * impact[at].astype(np.int64), 0)
        b.add(np.add.reduceat(part, start), ids[alive])
    return scored


def search(vectors: DataFrame, queries: list[Query], least: list[int], k: int) -> DataFrame:
    """(query, doc_id, score): each partition's k best documents of each query, of those that reach ``least``."""
    shared = vectors.sparkSession.sparkContext.broadcast((queries, least))

    def run(batches):
        qs, floor = shared.value
        best = [Best(k, x) for x in floor]
        for b in batches:
            for first in range(0, len(b), BUCKET):
                part = b.slice(first, BUCKET)
                ends, term = _lists(part.column(2))
                _, impact = _lists(part.column(3))
                ids = part.column(0).fill_null(NO_ID).to_numpy()
                search_bucket(part.column(1).to_numpy(), ends, term, impact, ids, qs, best)
        out = [(i, None if d == NO_ID else d, s) for i, b in enumerate(best) for d, s in zip(b.ids.tolist(), b.scores.tolist(), strict=True)]
        cols = list(zip(*out, strict=True)) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["query", "doc_id", "score"])

    return vectors.mapInArrow(run, "query int, doc_id long, score long")


def _block(docs: DataFrame, items: list[tuple[int, Counter]], k: int) -> DataFrame:
    """The result for one block of queries."""
    spark = docs.sparkSession
    number = {t: i for i, t in enumerate(sorted(set().union(*(c for _, c in items))))}
    scratch = Scratch(spark)
    counted = scratch.write(frequencies(docs, number), "counted")
    n_docs, n_terms = counted.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r[0]: r[1] for r in counted.select(F.explode("term").alias("t")).groupBy("t").agg(F.count(F.lit(1))).collect()}  # a row for each query term at most
    queries = []
    for item, has in items:
        # a term that no document holds adds to no score
        known = sorted((number[t], c) for t, c in has.items() if number[t] in df)
        weights = [c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t, c in known]
        queries.append(Query(item, np.array([t for t, _ in known], np.int32), np.array(weights, np.int64)))
    vectors = scratch.write(impacts(counted, n_docs, max(1, n_terms)), "vectors")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    longest = vectors.select("norm").orderBy(F.desc("norm")).limit(BUCKET // 4).agg(F.min("norm")).first()[0]
    first = search(vectors.filter(F.col("norm") >= longest), queries, [1] * len(queries), k).withColumn("rank", place)
    least = {r["query"]: r["score"] for r in first.filter(F.col("rank") == k).collect()}
    # equal norms, as copies have, are dealt by the hash of the id
    dealt = vectors.repartitionByRange(F.desc("norm"), F.xxhash64("doc_id")).sortWithinPartitions(F.desc("norm"))
    found = search(dealt, queries, [least.get(i, 1) for i in range(len(queries))], k)
    ranked = found.withColumn("rank", place).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, q.item) for i, q in enumerate(queries)], "query int, item_id long")
    return ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of ``docs`` (doc_id, text) that score highest for each row of ``queries`` (item_id, text).

    Scores are above 0 and exact; equal ones go by ascending doc_id, a null doc_id last. Terms are runs of ASCII
    letters and digits and of characters beyond ASCII, A-Z in lower case; null and empty texts have none. Each
    repeated row of either table counts for itself; other columns are not carried. Without queries or terms
    there are no rows. Queries are searched in blocks of about QUERY_TERMS terms, one scan of ``docs`` a block;
    a block's terms, its queries and their thresholds are what is broadcast.
    """
    spark = docs.sparkSession
    asked = queries.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = 1 + chars // (4 * QUERY_TERMS)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for i in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).orderBy("item_id", "text").collect()
        items = [(r["item_id"], Counter(t for some in terms(r["text"]) for t in some)) for r in mine]
        items = [x for x in items if x[1]]
        if items:
            out = out.unionByName(_block(docs, items, k))
    return out

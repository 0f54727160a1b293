"""Ranked search against SQL and against brute force, its bounds, and odd tables."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from compare import database, difference

from memloom.llm import entries, ranked_search
from memloom.llm.ranked_search import Best, Query

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a", "A a", "b-b c", "É é", "日本 a", "a\x00b", "a " * 900, "q" * 5000, None, "b c a", "b c a", "_a^b`c{d"]


def cut(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, queries, k):
    """(item, rank, doc, score) by scoring every document for every query."""
    words = [(d, cut(t)) for d, t in docs]
    n_docs, total = sum(1 for _, w in words if w), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in queries:
        scored = []
        for d, w in words:
            tf, m = Counter(w), 75 + 25 * len(w) * n_docs // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in cut(text) if t in tf)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_sql(spark):
    assert difference(entries.QUERIES["op13_norm_buckets"](spark, SF), database(SF), entries.ORACLES["op13_norm_buckets"]) is None


@pytest.mark.parametrize("blocks", [False, True])
def test_odd_tables_by_brute_force(spark, monkeypatch, blocks):
    """Nulls, repeats, ties, clashing columns; queries in several blocks, a bucket of two documents, terms cut in parts."""
    if blocks:
        monkeypatch.setattr(ranked_search, "QUERY_TERMS", 400)
    docs = [*enumerate(ODD), (None, "b c a"), (3, "A a")]
    queries = [(1, "a b c"), (2, "É q " + "q" * 5000), (3, None), (4, ""), (5, "nowhere"), (6, "a a a b"), (6, "c"), (7, "日本")]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, norm string").repartition(3)
    q = spark.createDataFrame([(i, t, 9) for i, t in queries], "item_id long, text string, rank int")
    assert found(ranked_search.ranked_search(d, q, k=4)) == brute(docs, queries, 4)


def test_nothing(spark):
    none, one = (spark.createDataFrame(x, "doc_id long, text string") for x in ([], [(1, "a")]))
    asked = one.withColumnRenamed("doc_id", "item_id")
    assert found(ranked_search.ranked_search(none, asked)) == [] == found(ranked_search.ranked_search(one, asked.limit(0)))
    assert found(ranked_search.ranked_search(one, asked)) == brute([(1, "a")], [(1, "a")], 20)


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(ranked_search, "LONG", 7)
    text = "Ab cd-ef,gh " * 20 + "x" * 50
    assert [t.decode() for part in ranked_search.terms(text) for t in part] == cut(text)


def test_bucket_is_exact_and_prunes():
    """Random vectors in descending order of norm: the k best are those of brute force, and most vectors are never scored."""
    r = np.random.default_rng(3)
    n, v, k = 6000, 400, 5
    rows = [np.sort(r.choice(v, r.integers(1, 30), replace=False)) for _ in range(n)]
    values = [r.integers(1, 1 + int(10 ** r.uniform(2, 6)), len(x)) for x in rows]
    norm = np.array([math.sqrt(float((x.astype(float) ** 2).sum())) for x in values])
    order = np.argsort(-norm)
    queries = []
    for i in range(20):
        t = np.sort(r.choice(v, 12, replace=False)).astype(np.int32)
        queries.append(Query(i, t, r.integers(1, 9000, 12)))
    best, scored = [Best(k, 1) for _ in queries], 0
    for first in range(0, n, 500):
        some = order[first : first + 500]
        ends = np.cumsum([0, *(len(rows[i]) for i in some)])
        scored += ranked_search.search_bucket(norm[some], ends, np.concatenate([rows[i] for i in some]), np.concatenate([values[i] for i in some]), some, queries, best)
    for q, b in zip(queries, best, strict=True):
        w = dict(zip(q.terms.tolist(), q.weights.tolist(), strict=True))
        every = sorted(((-sum(w.get(t, 0) * x for t, x in zip(rows[i].tolist(), values[i].tolist(), strict=True)), i) for i in range(n)))
        assert [(-s, i) for s, i in zip(b.scores.tolist(), b.ids.tolist(), strict=True)] == [x for x in every[:k] if x[0] < 0]
    assert scored < n * len(queries) / 4

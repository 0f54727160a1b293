"""Literal cases of the functions and operators that SQL does not express."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memloom.functions import text as X
from memloom.functions.porter import stem
from memloom.operators import consolidate as C
from memloom.operators import graph as G
from memloom.operators import memory as M
from memloom.operators import pairs as P
from memloom.operators import search as S
from memloom.operators import transactions as T
from memloom.operators.cascade import Cascade, salience
from memloom.sources import files


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_links(spark):
    got = one(spark, "see [[A b#s|c]] and [[rel:Causal|T x|d]] and [[Z]]", X.wikilinks)
    assert [(r["target"], r["alias"], r["section"], r["relation"]) for r in got] == [("T x", "d", None, "causal"), ("A b", "c", "s", "wikilink"), ("Z", None, None, "wikilink")]
    assert one(spark, "a [[N t]] b", X.wikilinks_to_markdown) == "a [N t](/notes/n-t) b"


def test_tags_and_front_matter(spark):
    assert one(spark, "#a x#b #c/d-e #1 #_f", X.tags) == ["a", "c/d-e", "_f"]
    doc = '---\ntags: [rust, "ai"]\ndate: 2024\n---\n\nBody here'
    assert one(spark, doc, lambda c: X.yaml_list(X.front_field(c, "tags"))) == ["rust", "ai"]
    assert one(spark, doc, X.body) == "Body here"
    assert one(spark, doc, X.word_count) == 2
    assert [tuple(h) for h in one(spark, "# A\ntext\n### B c\n####### no", X.headings)] == [(1, "A"), (3, "B c")]


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="aé中👍 ", max_size=40), st.integers(0, 30))
def test_truncate(spark, s, n):
    want = s.encode()[:n].decode(errors="ignore")
    assert one(spark, s, lambda c: X.truncate_bytes(c, n)) == want


def test_overlap(spark):
    df = spark.createDataFrame([("the cat sat", "Yes: the cat sat."), ("alpha beta", "gamma delta"), ("x", "")], "c string, s string")
    got = [r["v"] for r in df.select(X.verify_overlap(F.col("c"), F.col("s")).alias("v")).collect()]
    assert (got[0]["score"], got[0]["method"], got[0]["passed"]) == (1.0, "literal", True)
    assert not got[1]["passed"] and not got[2]["passed"]


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("happy", "happi"), ("generalization", "gener"), ("controlling", "control"), ("sky", "sky"), ("agreed", "agre"), ("motoring", "motor"), ("adjustable", "adjust"), ("rate", "rate")])
def test_porter(word, want):
    assert stem(word) == want


def test_chunks():
    assert files.chunk_text("") == []
    assert files.chunk_text("small") == ["small"]
    out = files.chunk_text("\n\n".join(f"Paragraph number {i} with words." for i in range(100)), 500, 50)
    assert len(out) > 5 and all(len(c.encode()) <= 500 for c in out)
    out = files.chunk_text("中" * 80, 50, 10)
    assert all(set(c) == {"中"} for c in out) and len(out) > 4


def test_bfs_and_paths(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "src long, dst long").withColumns({"link_type": F.lit("wikilink"), "valid_from": F.lit(None).cast("timestamp"), "valid_until": F.lit(None).cast("timestamp")})
    seeds = spark.createDataFrame([(1,)], "id long")
    assert sorted(map(tuple, G.bfs(edges, seeds, 3).collect())) == [(1, 2, 1), (1, 3, 1), (1, 4, 2)]
    pairs = spark.createDataFrame([(1, 4), (4, 1), (1, 1)], "source long, target long")
    assert {(r[0], r[1]): r[2] for r in G.shortest_paths(edges, pairs).collect()} == {(1, 4): [1, 2, 3, 4], (4, 1): [], (1, 1): [1]}
    assert {r["id"]: r["degree"] for r in G.degrees(edges).collect()}[5] == 2


def test_paths_of_any_length(spark):
    """Against a plain search: longer than any fixed depth, least among equals, none where there is none."""
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(30)] + [(int(a), int(b)) for a, b in rng.integers(40, 70, (45, 2))] + [(30, 40)]
    out = {}
    for a, b in links:
        out.setdefault(a, set()).add(b)

    def least(s, t):
        level, known = [[s]], {s}
        while level:
            if hit := [p for p in level if p[-1] == t]:
                return min(hit)
            new = {}
            for p in sorted(level):
                for b in out.get(p[-1], ()):
                    if b not in known:
                        new.setdefault(b, [*p, b])
            known |= set(new)
            level = list(new.values())
        return []

    pairs = [(0, 30), (0, 9), (30, 0), (12, 12), *((int(a), int(b)) for a, b in rng.integers(0, 70, (30, 2)))]
    edges = spark.createDataFrame(links, "src long, dst long").withColumn("link_type", F.lit("wikilink"))
    got = {(r[0], r[1]): r[2] for r in G.shortest_paths(edges, spark.createDataFrame(pairs, "source long, target long")).collect()}
    assert got == {p: least(*p) for p in pairs} and len(got[0, 30]) == 31
    short = {(r[0], r[1]): r[2] for r in G.shortest_paths(edges, spark.createDataFrame(pairs, "source long, target long"), max_depth=9).collect()}
    assert short == {p: v if len(v) <= 10 else [] for p, v in got.items()}


def test_memory(spark):
    t = datetime(2024, 1, 1)
    log = spark.createDataFrame([(1, "a", "n", "k", 1.0, t, 10), (2, "a", "n", "k", 2.0, t + timedelta(1), None), (3, "a", "n", "k", 3.0, t + timedelta(2), 5)], "seq long, agent_id string, namespace string, key string, value double, written_at timestamp, ttl_seconds int")
    assert M.store(log).first()["value"] == 3.0 and M.store(log, "reject").first()["value"] == 1.0
    assert [(r["seq"], r["superseded_by"]) for r in M.history(log).orderBy("seq").collect()] == [(1, 2), (2, 3)]
    assert M.live(M.store(log), F.lit(t + timedelta(3))).count() == 0


def test_cascade(spark):
    c = Cascade()

    def euler(u, dt):
        n = max(1, math.ceil(dt / 450))
        for _ in range(n):
            u = u + c.generator() @ u * (dt / n)
        return u

    u = np.array([1.0, 0.2, 0, 0, 0, 0])
    assert np.allclose(c.advance(u, 10_000), euler(u, 10_000))
    assert not c.advance(u, 1e12).any()
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t), (1, t + timedelta(hours=1)), (2, t), (None, t)], "note_id long, accessed_at timestamp")
    got = {r["note_id"]: r for r in salience(df, F.lit(t + timedelta(hours=2))).collect()}
    assert got[1]["accesses"] == 2 and math.isclose(got[1]["salience"], c.replay([0, 3600], 7200).mean(), abs_tol=1e-6)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sets(st.integers(0, 9), max_size=6), min_size=1, max_size=12), st.sampled_from([0.15, 0.35, 0.5, 0.8]))
def test_pairs(spark, sets, threshold):
    df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in enumerate(sets)], "id long, tokens array<string>")
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold}
    assert {(r["a"], r["b"]) for r in P.jaccard_pairs(df, threshold).collect()} == want


def test_context_expansion(spark):
    parent = {1: 50, 2: 50, 4: 51, 6: 2, 7: 99}
    notes = spark.createDataFrame([(i, f"N{i}", "x" * 30, 0.5, parent.get(i)) for i in [*range(1, 13), 50, 51]], "id long, title string, content string, consolidation_score double, parent_schema_id long")
    ended = datetime(2024, 1, 1)
    links = spark.createDataFrame([(1, 2, None), (4, 1, None), (1, 5, ended), (2, 6, None), (4, 7, None), (1, 90, None), (8, 9, None), (8, 10, None), (8, 11, None)], "src long, dst long, valid_until timestamp")
    seeds = spark.createDataFrame([(1, 1, 0.6, "fts"), (1, 2, 0.4, "both"), (2, 8, 0.6, "fts")], "query_id long, id long, score double, match_type string")
    got = S.expand_context(seeds, notes, links, top_k=5)
    want = {(1, 1, 0.6, "fts"), (1, 2, 0.4, "both"), (1, 4, 0.0, "graph"), (1, 6, 0.0, "graph"), (1, 50, 1.0, "schema"), (1, 51, 1.0, "schema"), (2, 8, 0.6, "fts"), (2, 9, 0.0, "graph"), (2, 10, 0.0, "graph")}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    context = S.retrieve_context(got, notes).filter("query_id = 1").orderBy("position").collect()
    assert [(r["id"], r["match_type"]) for r in context] == [(50, "schema"), (51, "schema"), (1, "fts"), (2, "both"), (4, "graph"), (6, "graph")]
    deeper = {r["id"] for r in S.expand_context(seeds, notes, links, top_k=10, depth=2).filter("query_id = 1").collect()}
    assert deeper == {1, 2, 4, 6, 7, 50, 51}


def test_context_in_query(spark):
    from memloom.plans.registry import QUERIES

    kinds = {r[0] for r in QUERIES["context_budget"](spark, "/root/testdata/sf0.001").select("match_type").distinct().collect()}
    assert {"graph", "schema"} <= kinds


def test_knn_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, [1.0])], "id long, embedding array<double>")
    q = df.filter("id < 12").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    monkeypatch.setattr(S, "QUERY_BLOCK", 5)
    got = {(r["query_id"], r["rank"]): r["id"] for r in S.nearest(df, q, 3).collect()}
    for i in range(12):
        want = sorted(range(40), key=lambda j: (round(float(np.linalg.norm(v[i] - v[j])), 6), j))[:3]
        assert [got[i, k] for k in (1, 2, 3)] == want


def test_nearest_each(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = np.vstack([rng.normal(size=(50, 6)), np.ones((20, 6))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(98, [1.0]), (99, None)], "id long, embedding array<double>")
    monkeypatch.setattr(S, "MEETING_BLOCK", 15)
    got = {(r["query_id"], r["rank"]): r["id"] for r in S.nearest_each(df, 4).collect()}
    assert len(got) == 70 * 4
    for i in range(70):
        want = sorted((j for j in range(70) if j != i), key=lambda j: (round(float(np.linalg.norm(v[i] - v[j])), 6), j))[:4]
        assert [got[i, r] for r in (1, 2, 3, 4)] == want


def test_link_suggestions_pass_no_vectors_through_the_driver(spark, monkeypatch):
    from memloom.plans.registry import QUERIES

    monkeypatch.setattr(S, "nearest", lambda *a, **b: pytest.fail("collects the queries"))
    assert QUERIES["link_suggestions"](spark, "/root/testdata/sf0.001").count() > 0


def test_scores(spark):
    row = spark.range(1).select(C.score(F.lit(0.0), F.lit(0), F.lit(0.0)).alias("zero"), C.cosine(F.array(F.lit(1.0)), F.array(F.lit(0.0))).alias("none")).first()
    assert row["zero"] == 0.5 and row["none"] == 0.0


def test_proxy_gate(spark):
    notes = spark.createDataFrame([(1, "A", "aspirin dose one"), (2, "B", "red fox"), (3, "C", "blue fox"), (4, "D", "grey owl"), (5, "E", "grey owl"), (6, "F", "grey owl"), (7, "G", "x"), (8, "H", "y"), (9, "I", "z")], "id long, title string, content string")
    members = spark.createDataFrame([(i, (i - 1) // 3) for i in range(1, 10)], "id long, cluster long")
    t = datetime(2024, 1, 1)
    log = [(1, "fox", t), (2, "fox", t + timedelta(1)), (3, "aspirin dose", t), (1, " ", t), (2, None, t), (4, "grey owl", t)]
    accesses = spark.createDataFrame(log, "note_id long, query_context string, accessed_at timestamp")
    similarity = members.select("cluster", F.lit(0.9).alias("mean_similarity")).distinct()
    proposals = C.extractive_proposals(members, notes, similarity)
    first = {r["cluster"]: r for r in proposals.collect()}[0]
    assert (first["title"], first["content"]) == ("Schema: A (+2 more)", "Extractive schema over 3 episodes (mean cosine 0.90).\n\n- A: aspirin dose one\n- B: red fox\n- C: blue fox")
    got = {r["cluster"]: tuple(r)[1:] for r in C.proxy_gate(proposals, members, accesses, notes).collect()}
    # fox finds two of three sources, aspirin dose one; grey owl finds all three, so that nothing is gained.
    assert got == {0: (2, 0.25, "accept"), 1: (1, 0.0, "reject"), 2: (0, None, "unavailable")}
    newest = {r["cluster"]: tuple(r)[1:] for r in C.proxy_gate(proposals, members, accesses, notes, sample=1).collect()}
    assert newest[0] == (1, round(0.5 / 3, 6), "accept")


def test_publish(spark, tmp_path):
    df = spark.range(3)
    assert T.publish({"t": df}, str(tmp_path)) == 1 and T.publish({"t": spark.range(5)}, str(tmp_path)) == 2
    assert T.read_version(spark, str(tmp_path), "t").count() == 5 and T.read_version(spark, str(tmp_path), "t", 1).count() == 3


def test_markdown_folder(spark, tmp_path):
    notes = spark.createDataFrame([(1, "A/b", "text #x", ["t"])], "id long, title string, content string, tags array<string>")
    files.export_markdown(notes, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() > 0
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "My note.md").write_text("---\ntags: [p]\n---\nHello #q")
    r = files.import_markdown(spark, str(tmp_path / "in")).first()
    assert (r["title"], r["tags"]) == ("My note", ["p", "q"])


@pytest.mark.parametrize(("threshold", "strict"), [(0.15, True), (0.35, False), (0.7, False)])
def test_pairs_in_blocks(spark, monkeypatch, threshold, strict):
    """In blocks of a few sets, with copies of one size dealt in parts and few common tokens, every pair is found once; a null id, a null token and copied tokens count for nothing."""
    for name, value in (("COMMON", 5), ("BLOCK_TOKENS", 60), ("BLOCK_SETS", 9)):
        monkeypatch.setattr(P, name, value)
    rng = np.random.default_rng(4)
    sets = [{f"t{x}" for x in rng.zipf(1.5, rng.integers(0, 25)) if x < 200} for _ in range(150)] + [{"t1", "a", "b", "c" * 99}] * 30
    rows = [(int(i), [*s, *sorted(s)[:1], None]) for i, s in zip(rng.permutation(len(sets)) * 10, sets, strict=True)] + [(None, ["a", "t1"])]
    want = {}
    for k, (a, _) in enumerate(rows[:-1]):
        for m in range(k):
            x, y = sets[k], sets[m]
            j = len(x & y) / len(x | y) if x | y else 0
            if x and y and (j > threshold if strict else j >= threshold):
                want[min(a, rows[m][0]), max(a, rows[m][0])] = j
    got = P.jaccard_pairs(spark.createDataFrame(rows, "id long, tokens array<string>").repartition(3), threshold, strict).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): r["jaccard"] for r in got} == want


def test_sure_pairs_are_the_surest_of_all(spark):
    """Asking for sure links gives what a filter over all of them gives, also where the least confidence is only reached by rounding."""
    text = lambda *parts: " ".join(f"word{x}" for part in parts for x in part)
    rows = [(0, text(range(10))), (1, text(range(7))), (2, text(range(10), [99])), (3, text(range(5), range(20, 25))), (4, text(range(9))), (5, "no")]
    notes = spark.createDataFrame(rows, "id long, content string")
    links = spark.createDataFrame([(4, 0)], "src long, dst long")
    for sure in (0.0, 0.7, 0.85, 0.636364, 0.9):
        every = P.keyword_pairs(notes, links).filter(F.col("confidence") >= sure).collect()
        assert sorted(map(tuple, P.keyword_pairs(notes, links, sure=sure).collect())) == sorted(map(tuple, every)) and bool(every) == (sure < 0.9)
    assert {(r["src"], r["dst"]) for r in P.auto_links(P.keyword_pairs(notes, links, sure=0.7)).collect()} == {(0, 1), (0, 2), (2, 4), (1, 4)}


def test_mentions_in_blocks(spark, monkeypatch):
    """Titles in blocks, contents in short parts: against a plain search, with titles within titles, other cases and scripts, links, copies of titles, and rows without a title or content."""
    for name, value in (("BLOCK_TITLES", 7), ("CONTENT", 60), ("MEETINGS", 5)):
        monkeypatch.setattr(P, name, value)
    rng = np.random.default_rng(2)
    titles = ["Doc 1", "Doc 12", "doc 12", "aaaa", "aaaaa", "Été 5", "abc", "中文", "中", "Doc 123", "ab ab ab", None, "Doc 12", "x" * 70]
    words = ["DOC 12", "doc 123", "[[Doc 12]]", "[[doc 123]]", "aaaaaa", "ÉTÉ 5", "abc", "中文中", "ab ab ab ab", "zz", "", "[[aaaa]]", "x" * 75]
    rows = [(i, titles[i % len(titles)], " ".join(rng.choice(words, rng.integers(0, 12)))) for i in range(60)] + [(60, "lone", None), (None, "Doc 1", "doc 12")]
    links = {(int(a), int(b)) for a, b in rng.integers(0, 60, (300, 2))}
    want = sorted((a, b) for a, _, c in rows for b, t, _ in rows if None not in (a, b, c, t) and a != b and len(t.encode()) > 3 and t.lower() in c.lower() and f"[[{t}]]" not in c and (a, b) not in links)
    notes = spark.createDataFrame(rows, "id long, title string, content string").repartition(2)
    got = P.title_mentions(notes, spark.createDataFrame(sorted(links), "src long, dst long")).collect()
    assert sorted((r["source"], r["target"]) for r in got) == want and len(want) > 300

"""Neighbours, pairs and the stored index of vectors against brute force, on vectors with and without groups, and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.operators import vectors as V

SF = "/root/testdata/sf0.01"


def made(spark, n, groups, spread, seed=1, width=8):
    """``n`` vectors around ``groups`` centres, with copies, nulls, zero and shorter ones."""
    r = np.random.default_rng(seed)
    x = r.standard_normal((groups, width))[r.integers(0, groups, n)] + spread * r.standard_normal((n, width))
    x[n // 2 : n // 2 + 40] = x[0]
    x[5] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(n, None), (n + 1, [1.0] * (width - 1)), (None, [1.0] * width)]
    return spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3), x


def brute(x, queries, k, others=False):
    out = []
    for i, q in queries:
        d = np.sqrt(((x - q) ** 2).sum(1)).round(6)
        best = sorted((d[j], j) for j in range(len(x)) if not (others and j == i))[:k]
        out += [(i, j, s) for s, j in best]
    return out


def same(df, want):
    got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())
    assert [(g[0], g[2]) for g in got] == [(w[0], w[1]) for w in want] and np.allclose([g[3] for g in got], [w[2] for w in want], atol=2e-6)


@pytest.mark.parametrize(("groups", "spread"), [(12, 0.05), (1, 1.0)])
def test_neighbours_are_exact(spark, monkeypatch, groups, spread):
    monkeypatch.setattr(V, "PART", 50)
    df, x = made(spark, 700, groups, spread)
    asked = [(i, x[i]) for i in range(0, 700, 50)] + [(10_000, np.full(8, 9.0))]
    q = spark.createDataFrame([(i, v.tolist()) for i, v in asked] + [(10_001, None), (10_002, [1.0])], "query_id long, vector array<double>")
    same(V.nearest_neighbours(df, q, 5, size=40), brute(x, asked, 5))
    same(V.nearest_neighbours(df, None, 3, size=40), brute(x, list(enumerate(x)), 3, others=True))


@pytest.mark.parametrize("least", [0.3, 0.82, 0.999])
def test_pairs_are_exact(spark, monkeypatch, least):
    monkeypatch.setattr(V, "PART", 50)
    df, x = made(spark, 500, 12, 0.05)
    n = np.linalg.norm(x, axis=1)
    s = np.divide(x @ x.T, n[:, None] * n, out=np.zeros((500, 500)), where=n[:, None] * n > 0).clip(-1, 1).round(6)
    want = {(i, j): s[i, j] for i in range(500) for j in range(i + 1, 500) if s[i, j] >= least}
    got = {(r["a"], r["b"]): r["similarity"] for r in V.pairs_within(df, least, size=30).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_vectors_in_groups_meet_few_cells(spark):
    """In groups, far fewer points are sent to cells than points times cells; nothing is lost (see above)."""
    df, _ = made(spark, 2000, 40, 0.05)
    v, width = V.whole(df)
    unit = v.filter("id <> 5").select("id", F.expr("transform(v, x -> x / sqrt(aggregate(v, 0D, (s, y) -> s + y * y)))").alias("v"))
    pivots = V.choose_pivots(unit, width, 40)
    sizes = V.cell_sizes(V.assign(unit, pivots))
    asks = V.send(unit.withColumn("limit", F.lit(float(np.sqrt(2 - 2 * 0.82)))), pivots, sizes, own_and_later=True).count()
    assert len(sizes) >= 30 and asks < 2000 * len(sizes) / 8


def test_index(spark, tmp_path):
    """Stored once, searched exactly and with few probes; added vectors are found; another width is refused."""
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    x = np.array([r["embedding"] for r in vectors.orderBy("id").collect()], float)
    asked = [(i, x[i]) for i in range(0, len(x), 10)]
    q = spark.createDataFrame([(i, v.tolist()) for i, v in asked], "query_id long, vector array<double>")
    V.VectorIndex.build(vectors.filter("id % 5 <> 0"), f"{tmp_path}/index", size=25)
    index = V.VectorIndex(spark, f"{tmp_path}/index")
    index.add(vectors.filter("id % 5 = 0"))
    assert index.stored.count() == len(x)
    same(index.search(q, 10), brute(x, asked, 10))
    want = {(i, j) for i, j, _ in brute(x, asked, 10)}
    cells = len(V.cell_sizes(index.stored))
    probed = {(r["query_id"], r["id"]) for r in index.search(q, 10, probes=cells * 3 // 4).collect()}
    assert cells >= 15 and len(want & probed) >= 0.9 * len(want)
    with pytest.raises(Exception, match="64 numbers"):
        index.add(spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>"))


def test_grouped_vectors_need_few_probes(spark, tmp_path):
    """In groups, a tenth of the cells holds nine in ten of the true neighbours."""
    df, x = made(spark, 3000, 60, 0.2)
    index = V.VectorIndex.build(df.filter("size(embedding) = 8"), f"{tmp_path}/index", size=50)
    asked = [(i, x[i]) for i in range(0, 3000, 30)]
    q = spark.createDataFrame([(i, v.tolist()) for i, v in asked], "query_id long, vector array<double>")
    want = {(i, j) for i, j, _ in brute(x, asked, 10)}
    got = {(r["query_id"], r["id"]) for r in index.search(q, 10, probes=6).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "id long, embedding array<float>")
    assert V.nearest_neighbours(none, None).collect() == [] == V.pairs_within(none, 0.5).collect()


@pytest.mark.parametrize("kind", ["array<double>", "array<float>"])
def test_pairs_in_blocks(spark, monkeypatch, kind):
    """Blocks of a few cells, a cell of copies dealt in parts: every pair once, and nothing is shuffled to make them."""
    monkeypatch.setattr(V, "CELL", 20)
    monkeypatch.setattr(V, "BLOCK_NUMBERS", 400)
    df, x = made(spark, 400, 9, 0.3)
    df = df.select("id", F.col("embedding").cast(kind).alias("embedding"))
    if kind == "array<float>":
        x = x.astype(np.float32).astype(float)
    n = np.linalg.norm(x, axis=1)
    s = np.divide(x @ x.T, n[:, None] * n, out=np.zeros((400, 400)), where=n[:, None] * n > 0).clip(-1, 1).round(6)
    want = {(i, j): s[i, j] for i in range(400) for j in range(i + 1, 400) if s[i, j] >= 0.35}
    pairs = V.pairs_within(df, 0.35, size=20)
    rows = pairs.collect()
    assert len(rows) == len(want) and all(abs(r["similarity"] - want[r["a"], r["b"]]) < 2e-6 for r in rows)
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    twice = V.pairs_within(df.union(df.filter("id < 9")), 0.35, size=20).collect()
    assert sorted(map(tuple, twice)) == sorted(map(tuple, rows))


@pytest.mark.parametrize("tree", [4_000_000, 60, 8])
def test_components_and_their_similarity(spark, monkeypatch, tree):
    """By forests of tasks that hold all pairs, few, or too few for one task to end with; sums by node give the same means as joining the pairs."""
    from memloom.operators import consolidate as C
    from memloom.operators import pairs as P

    monkeypatch.setattr(P, "TREE", tree)
    rng = np.random.default_rng(7)
    ends = rng.permutation(500)[rng.integers(0, 500, (230, 2))].tolist() + [[600 + i, 601 + i] for i in range(40)]
    rows = [(min(e), max(e), float(round(x, 6))) for e, x in zip(ends, rng.uniform(0.35, 1, len(ends)), strict=True) if e[0] != e[1]]
    label = {i: i for r in rows for i in r[:2]}
    for _ in rows:
        for a, b, _s in rows:
            label[a] = label[b] = min(label[a], label[b])
    pairs = spark.createDataFrame(rows, "a long, b long, similarity double").repartition(12)
    assert sorted(map(tuple, P.components(pairs).collect())) == sorted(label.items())
    members, similarity = C.clusters_with_similarity(pairs)
    assert sorted(map(tuple, members.collect())) == sorted(map(tuple, C.clusters(pairs).collect()))
    assert sorted(map(tuple, similarity.collect())) == sorted(map(tuple, C.mean_similarity(members, pairs).collect()))
    forest = pairs.coalesce(1).mapInArrow(P._forest, P.FOREST).filter("b is not null").count()
    assert tree < 100 or forest == len(label) - len(set(label.values()))

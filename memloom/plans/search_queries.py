"""Search, fusion, similarity and suggestion queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import consolidate as C
from ..operators import pairs as P
from ..operators import search as S
from ..operators.text_index import TextIndex
from ..operators.vectors import VectorIndex
from ..session import run_dir
from ..sources import testdata as D
from ..sources.testdata import SQL, with_views

Q, O = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


def _plain(spark, sf):
    return D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("Doc "), "doc_id").alias("title"), F.col("text").alias("content"))


def _phrases(spark, sf):
    """The first two words of each benchmark item as a phrase."""
    w = X.ordered_tokens(F.col("text"))
    return D.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(w, 1, 2), " ").alias("phrase"))


_TOK = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_FTS = f"""d AS (SELECT doc_id AS id, {_TOK.format("'Doc ' || doc_id")} AS tt, {_TOK.format('text')} AS tc FROM documents),
q AS (SELECT item_id AS query_id, list_slice({_TOK.format('text')}, 1, 2) AS w FROM benchmark), st AS (SELECT avg(len(tt) + len(tc)) AS avgdl, count(*) AS n FROM d),
p AS (SELECT id, 't' AS f, unnest(tt) AS term, unnest(range(len(tt))) AS pos FROM d UNION ALL SELECT id, 'c', unnest(tc), unnest(range(len(tc))) FROM d),
tf AS (SELECT query_id, a.id, count(*) AS tf FROM q JOIN p a ON a.term = w[1] JOIN p b ON b.id = a.id AND b.f = a.f AND b.pos = a.pos + 1 AND b.term = w[2] WHERE len(w) = 2 GROUP BY ALL),
df AS (SELECT query_id, count(*) AS df FROM tf GROUP BY ALL),
hits AS (SELECT query_id, tf.id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (len(tt) + len(tc)) / avgdl)), 6) AS score FROM tf JOIN df USING (query_id) JOIN d ON d.id = tf.id, st),
fts AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hits)"""
_KNN = """v AS (SELECT vec_id AS id, embedding AS e FROM embeddings), knn_all AS (SELECT a.id AS query_id, b.id, round(sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))), 6) AS score FROM v a, v b WHERE {0}),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM knn_all)"""


@query(f"WITH {_FTS} SELECT DISTINCT query_id, id FROM fts")
def fts_phrase(spark, sf):
    return S.phrase_search(_plain(spark, sf), _phrases(spark, sf), k=2**31 - 1, stem=False).select("query_id", "id")


@query(f"WITH {_FTS} SELECT query_id, id, score, rank FROM fts WHERE rank <= 20")
def fts_bm25(spark, sf):
    return S.phrase_search(_plain(spark, sf), _phrases(spark, sf), k=20, stem=False)


def _text_index(spark, sf):
    """An index of the documents, whose texts then change: of ids that five divides they are put before themselves again, those that seven divides go."""
    notes = _plain(spark, sf)
    index = TextIndex.build(notes, f"{run_dir(spark)}/{uuid.uuid4().hex}/text_index", buckets=16)
    changed = notes.filter("id % 5 = 0 or id % 7 = 0").withColumns({"content": F.concat("content", F.lit(" "), "content"), "deleted": F.expr("id % 7 = 0")})
    index.apply(changed, 1)
    return index


_CHANGED = "documents AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' ' || text ELSE text END AS text FROM main.documents WHERE doc_id % 7 <> 0)"


@query(f"WITH {_CHANGED}, {_FTS} SELECT query_id, id, score, rank FROM fts WHERE rank <= 20")
def fts_index(spark, sf):
    """Phrases by a stored index after a batch of changes."""
    return _text_index(spark, sf).phrase_search(_phrases(spark, sf), k=20, stem=False)


@query()
def fts_stemmed(spark, sf):
    return S.phrase_search(_plain(spark, sf), _phrases(spark, sf), k=20)


def _query_vectors(spark, sf):
    return D.vectors(spark, sf).filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


@query(f"WITH {_KNN.format('a.id % 100 = 0')} SELECT query_id, id, score, rank FROM knn WHERE rank <= 10")
def knn_l2(spark, sf):
    return S.nearest(D.vectors(spark, sf), _query_vectors(spark, sf), 10)


@query(f"WITH {_KNN.format('a.id % 100 = 0')} SELECT query_id, id, score, rank FROM knn WHERE rank <= 10")
def knn_index(spark, sf):
    """The same by a stored index, which is built of all vectors first and then read by the cells that the queries reach."""
    index = VectorIndex.build(D.vectors(spark, sf), f"{run_dir(spark)}/{uuid.uuid4().hex}/vector_index", size=256)
    return index.search(_query_vectors(spark, sf), 10)


@query("""WITH v AS (SELECT vec_id AS id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE ** 2))) AS n FROM embeddings),
s AS (SELECT a.id AS query_id, b.id, round(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (a.n * b.n), 6) AS score FROM v a, v b WHERE a.id % 100 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def knn_cosine(spark, sf):
    return S.nearest(D.vectors(spark, sf), _query_vectors(spark, sf), 10, metric="cosine")


@query(f"""{with_views('links')}, {_KNN.format('a.id <> b.id')}, top AS (SELECT * FROM knn WHERE rank <= 10)
SELECT query_id AS src, id AS dst, round(1 - score / 2, 6) AS similarity FROM top t WHERE 1 - score / 2 >= 0.4 AND NOT EXISTS (SELECT 1 FROM links l WHERE l.src = t.query_id AND l.dst = t.id)""")
def link_suggestions(spark, sf):
    """Each vector's ten nearest as links, unless there is one, by the similarity 1 - distance / 2."""
    near = S.nearest_each(D.vectors(spark, sf), 10)
    near = near.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.round(1 - F.col("score") / 2, 6).alias("similarity")).filter("similarity >= 0.4")
    return near.join(D.links(spark, sf).select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def _hybrid(spark, sf, limit=10):
    fts = S.phrase_search(_plain(spark, sf), _phrases(spark, sf), k=2 * limit, stem=False)
    q = D.vectors(spark, sf).join(D.table(spark, sf, "benchmark").select(F.col("item_id").alias("id")), "id").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    return S.reciprocal_rank_fusion(fts, S.nearest(D.vectors(spark, sf), q, 2 * limit), limit)


_HYBRID = f"""WITH {_FTS}, {_KNN.format('a.id IN (SELECT item_id FROM benchmark)')},
u AS (SELECT query_id, id, 0.5 / (60 + rank) AS s, 1 AS src FROM fts WHERE rank <= 20 UNION ALL SELECT query_id, id, 0.5 / (60 + rank), 2 FROM knn WHERE rank <= 20),
f AS (SELECT query_id, id, round(sum(s), 9) AS score, CASE sum(src) WHEN 1 THEN 'fts' WHEN 2 THEN 'semantic' ELSE 'both' END AS match_source FROM u GROUP BY ALL),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10)"""


@query(f"{_HYBRID} SELECT * FROM h")
def hybrid_rrf(spark, sf):
    return _hybrid(spark, sf)


@query(f"{_HYBRID}, b AS (SELECT query_id, h.id, match_source, round(h.score * (1 + 0.2 * (length(text) % 100) / 100.0), 9) AS score FROM h LEFT JOIN documents ON doc_id = h.id) SELECT query_id, id, match_source, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, match_source, coalesce(score, (SELECT round(x.score, 9) FROM h x WHERE x.query_id = b.query_id AND x.id = b.id)) AS score FROM b)")
def salience_boost(spark, sf):
    scores = D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.length("text") % 100 / 100).alias("consolidation_score"))
    return S.salience_boost(_hybrid(spark, sf), scores, 0.2)


@query(f"""{_HYBRID}, {SQL['links']}, hit AS (SELECT query_id, h.id, score, match_source AS match_type FROM h JOIN documents ON doc_id = h.id),
und AS (SELECT src AS a, dst AS b FROM links WHERE valid_until IS NULL UNION ALL SELECT dst, src FROM links WHERE valid_until IS NULL),
nb AS (SELECT DISTINCT hit.query_id, und.b AS id FROM hit JOIN und ON und.a = hit.id WHERE NOT EXISTS (SELECT 1 FROM hit x WHERE x.query_id = hit.query_id AND x.id = und.b)),
near AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS n FROM nb) WHERE n <= 5),
both_ AS (SELECT * FROM hit UNION ALL SELECT query_id, id, 0.0, 'graph' FROM near JOIN documents ON doc_id = id),
up AS (SELECT DISTINCT query_id, id - id % 20 AS id FROM both_ b WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM both_ x WHERE x.query_id = b.query_id AND x.id = b.id - b.id % 20)),
every AS (SELECT * FROM both_ UNION ALL SELECT query_id, id, 1.0, 'schema' FROM up),
c AS (SELECT query_id, id, match_type, round(0.5 * score + 0.3 * (length(text) % 100) / 100.0 + CASE WHEN match_type = 'schema' THEN 0.2 ELSE 0 END, 6) AS composite, text, 'Doc ' || doc_id AS title FROM every JOIN documents ON doc_id = id),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY composite DESC, id) AS position FROM c),
l AS (SELECT *, length(CAST(position AS VARCHAR)) + length(title) + length(text) + 9 AS block_chars FROM o),
s AS (SELECT *, CAST(coalesce(sum(block_chars) OVER (PARTITION BY query_id ORDER BY composite DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chars_before FROM l),
e AS (SELECT *, CASE WHEN block_chars <= 16384 - chars_before THEN block_chars WHEN 16384 - chars_before > 200 THEN 16384 - chars_before END AS used FROM s)
SELECT query_id, position, id, match_type, composite, block_chars, chars_before, used FROM e WHERE used IS NOT NULL""")
def context_budget(spark, sf):
    """Hybrid hits, graph neighbours and schemas within a budget; each twentieth note stands for the schema of the odd ones after it."""
    notes = _plain(spark, sf).withColumns({"consolidation_score": F.length("content") % 100 / 100, "parent_schema_id": F.expr("case when id % 2 = 1 then id - id % 20 end")})
    seeds = _hybrid(spark, sf).select("query_id", "id", "score", F.col("match_source").alias("match_type"))
    return S.retrieve_context(S.expand_context(seeds, notes, D.links(spark, sf)), notes, 4096)


@query(f"""WITH {_FTS}, a AS (SELECT DISTINCT query_id, id FROM fts WHERE rank <= 40 AND id % 3 = 0), j AS (SELECT a.query_id, a.id, f.rank FROM a LEFT JOIN fts f ON f.query_id = a.query_id AND f.id = a.id AND f.rank <= 10),
g AS (SELECT query_id, count(rank) / count(*) AS r, coalesce(1.0 / min(rank), 0) AS rr FROM j GROUP BY 1) SELECT count(*) AS queries, round(avg(r), 6) AS recall, round(avg(rr), 6) AS mrr FROM g""")
def recall_mrr(spark, sf):
    """Recall and mean reciprocal rank at 10 of the phrase search against answers found further down."""
    hits = S.phrase_search(_plain(spark, sf), _phrases(spark, sf), k=40, stem=False)
    return C.recall(hits.filter("id % 3 = 0").select("query_id", "id"), hits, 10)


_PAIRS = """s AS (SELECT doc_id AS id, list_distinct({tok}) AS t FROM documents), n AS (SELECT id, len(t) AS n FROM s), x AS (SELECT id, unnest(t) AS w FROM s),
i AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM x a JOIN x b ON a.w = b.w AND a.id < b.id GROUP BY ALL),
j AS (SELECT a, b, c / (na.n + nb.n - c) AS jaccard FROM i JOIN n na ON na.id = a JOIN n nb ON nb.id = b)"""


@query(f"WITH {_PAIRS.format(tok=_TOK.format('text'))} SELECT a, b, round(jaccard, 6) AS jaccard FROM j WHERE jaccard >= 0.35")
def token_jaccard(spark, sf):
    t = _plain(spark, sf).select("id", X.tokens(F.col("content")).alias("tokens"))
    return P.jaccard_pairs(t, 0.35).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_STOP = "['" + "','".join(X.STOPWORDS) + "']"
_STEM = "CASE " + " ".join(f"WHEN strlen(x) > {len(s) + 2} AND suffix(x, '{s}') THEN left(x, length(x) - {len(s)})" for s in X.SUFFIXES) + " ELSE x END"
_EVID = f"list_distinct(list_transform(list_filter(string_split({{0}}, ' '), lambda x: x <> '' AND NOT list_contains({_STOP}, x)), lambda x: {_STEM}))"
_TRI = "CASE WHEN length({0}) < 3 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, length({0}) - 1), lambda k: substr({0}, k, 3))) END"
_JAC = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) END"
_CLAIMS = f"""{with_views('claims')}, n AS (SELECT id, note_id, source_id, {_NORM.format('claim')} AS c, {_NORM.format('source_text')} AS s FROM claims),
t AS (SELECT *, {_EVID.format('c')} AS ec, {_EVID.format('s')} AS es, {_TRI.format('c')} AS gc, {_TRI.format('s')} AS gs FROM n),
m AS (SELECT id, note_id, source_id, CASE WHEN contains(s, c) THEN 1.0 WHEN contains(c, s) AND s <> '' THEN 0.75 ELSE 0.0 END AS lit, {_JAC.format('ec', 'es')} AS tok, {_JAC.format('gc', 'gs')} AS gram FROM t),
ov AS (SELECT id, note_id, source_id, round(greatest(lit, tok * 0.85, gram * 0.7), 6) AS score, CASE WHEN lit >= tok * 0.85 AND lit >= gram * 0.7 THEN 'literal' WHEN tok * 0.85 >= gram * 0.7 THEN 'token' ELSE 'trigram' END AS method,
greatest(lit, tok * 0.85, gram * 0.7) >= 0.55 AS passed FROM m)"""


@query(f"{_CLAIMS} SELECT * FROM ov")
def overlap_verify(spark, sf):
    from ..operators.integrity import attach_claims

    return attach_claims(D.claims(spark, sf)).select("id", "note_id", "source_id", "score", "method", "passed")


@query(f"{_CLAIMS} SELECT id, round(gram, 6) AS trigram FROM m")
def trigram_jaccard(spark, sf):
    c = D.claims(spark, sf).select("id", X.normalize(F.coalesce("claim", F.lit(""))).alias("c"), X.normalize(F.coalesce("source_text", F.lit(""))).alias("s"))
    both = F.struct(X.trigrams(F.col("c")).alias("a"), X.trigrams(F.col("s")).alias("b"))
    return c.select("id", F.round(X.let(both, lambda t: X.jaccard(t["a"], t["b"])), 6).alias("trigram"))


@query(f"{_CLAIMS} SELECT note_id, round(avg(score), 6) AS authority, count(DISTINCT source_id) AS sources FROM ov WHERE passed GROUP BY note_id")
def claim_avg(spark, sf):
    from ..operators.integrity import attach_claims, authority

    return authority(attach_claims(D.claims(spark, sf)).filter("passed")).select("note_id", F.round("authority", 6).alias("authority"), F.size("sources").alias("sources"))


def _dated(spark, sf):
    return _plain(spark, sf).withColumn("created_at", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id as int), 0, 0)"))


@query(f"""{_CLAIMS}, {_PAIRS.format(tok=_TOK.format('text')).replace('s AS', 'ss AS', 1).replace('FROM s)', 'FROM ss)').replace('n AS (SELECT id, len', 'nn AS (SELECT id, len').replace('JOIN n na', 'JOIN nn na').replace('JOIN n nb', 'JOIN nn nb')},
au AS (SELECT note_id, avg(score) AS au, list_sort(list(DISTINCT source_id)) AS src FROM ov WHERE passed GROUP BY note_id),
g AS (SELECT doc_id AS id, regexp_matches(lower(text), '{'|'.join(X.NEGATIONS).replace("'", "''")}') AS neg, au, src FROM documents LEFT JOIN au ON note_id = doc_id),
k AS (SELECT a, b, jaccard, exp(-abs(a - b) * 3600 / 86400.0 / 14) AS rec, CASE WHEN ga.au IS NOT NULL AND gb.au IS NOT NULL THEN (ga.au + gb.au) / 2 ELSE coalesce(ga.au, gb.au, 0) * 0.5 END AS auth
FROM j JOIN g ga ON ga.id = a JOIN g gb ON gb.id = b WHERE jaccard >= 0.35 AND (ga.neg <> gb.neg OR coalesce(ga.src <> gb.src, false)))
SELECT a, b, round(jaccard, 6) AS semantic, round(rec, 6) AS recency, round(auth, 6) AS authority, round(0.5 * jaccard + 0.2 * rec + 0.3 * auth, 6) AS combined FROM k WHERE round(0.5 * jaccard + 0.2 * rec + 0.3 * auth, 6) >= 0.6""")
def contradictions(spark, sf):
    from ..operators.integrity import attach_claims, contradictions as find

    return find(_dated(spark, sf), attach_claims(D.claims(spark, sf)).filter("passed"))


_WORDS = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: strlen(x) > 3)"


@query(f"{with_views('links')}, {_PAIRS.format(tok=_WORDS)} SELECT a AS source, b AS target, round(least(jaccard, 0.85), 6) AS confidence FROM j WHERE jaccard > 0.15 AND NOT EXISTS (SELECT 1 FROM links l WHERE (l.src = a AND l.dst = b) OR (l.src = b AND l.dst = a))")
def smart_links(spark, sf):
    return P.keyword_pairs(_plain(spark, sf), D.links(spark, sf))


@query(f"{with_views('notes', 'links')}, l AS (SELECT src, dst FROM links WHERE link_type = 'wikilink') SELECT a.id AS source, b.id AS target FROM notes a JOIN notes b ON a.id <> b.id AND contains(lower(a.content), lower(b.title)) AND NOT contains(a.content, '[[' || b.title || ']]') WHERE NOT EXISTS (SELECT 1 FROM l WHERE src = a.id AND dst = b.id)")
def title_mentions(spark, sf):
    n = D.notes(spark, sf)
    return P.title_mentions(n, D.links(spark, sf).filter("link_type = 'wikilink'"))

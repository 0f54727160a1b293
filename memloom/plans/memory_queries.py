"""Memory, integrity, consolidation, digest, transaction and event-time queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import cascade, consolidate as C, integrity as I, memory as M, transactions as T
from ..operators.stores import AccessStore, VectorStore, search_accesses
from ..session import materialize, run_dir
from ..sources import testdata as D
from ..sources.testdata import SQL, with_views
from .search_queries import _CLAIMS, _EVID, _JAC, _NORM, _TRI, context_budget
from .search_queries import O as SEARCH_SQL

Q, O = {}, {}
NOW = "timestamp '2024-01-31 00:00:00'"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


_KV = "agent_id, namespace, key"


@query(f"{with_views('kv')} SELECT {_KV}, arg_max(value, seq) AS value, max(seq) AS seq, count(*) AS writes FROM kv GROUP BY ALL")
def kv_latest(spark, sf):
    return M.store(D.kv_writes(spark, sf)).select(*M.KEY, "value", "seq", "writes")


@query(f"{with_views('kv')} SELECT {_KV}, arg_min(value, seq) AS value, min(seq) AS seq, count(*) - 1 AS refused FROM kv GROUP BY ALL")
def kv_first_wins(spark, sf):
    return M.store(D.kv_writes(spark, sf), "reject").select(*M.KEY, "value", "seq", (F.col("writes") - 1).alias("refused"))


@query(f"{with_views('kv')}, h AS (SELECT seq, {_KV}, value, lead(seq) OVER w AS superseded_by, epoch_us(lead(written_at) OVER w) AS superseded_us FROM kv WINDOW w AS (PARTITION BY {_KV} ORDER BY seq)) SELECT * FROM h WHERE superseded_by IS NOT NULL")
def kv_history(spark, sf):
    return M.history(D.kv_writes(spark, sf)).select("seq", *M.KEY, "value", "superseded_by", F.unix_micros("superseded_at").alias("superseded_us"))


@query(f"{with_views('kv')}, l AS (SELECT {_KV}, arg_max(value, seq) AS value, max(seq) AS seq FROM kv GROUP BY ALL) SELECT l.* FROM l JOIN kv USING (seq) WHERE kv.ttl_seconds IS NULL OR NOT floor(epoch({NOW})) > floor(epoch(written_at)) + ttl_seconds")
def kv_ttl(spark, sf):
    return M.live(M.store(D.kv_writes(spark, sf)), F.expr(NOW)).select(*M.KEY, "value", "seq")


@query(f"{with_views('kv')} SELECT {_KV}, arg_max(value, seq) AS value FROM kv WHERE key ILIKE 'S%' GROUP BY ALL")
def kv_prefix(spark, sf):
    return M.with_prefix(M.store(D.kv_writes(spark, sf)), "S").select(*M.KEY, "value")


@query(f"{with_views('tool_logs')} SELECT id, agent_id, tool_name, status, duration_ms FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY created_at DESC, id DESC) AS n FROM tool_logs) WHERE n <= 50")
def tool_logs_recent(spark, sf):
    return M.recent_tool_logs(D.tool_logs(spark, sf)).select("id", "agent_id", "tool_name", "status", "duration_ms")


@query(f"{with_views('tool_logs')} SELECT tool_name, status, count(*) AS calls, round(avg(duration_ms), 4) AS mean_ms, max(duration_ms) AS max_ms FROM tool_logs GROUP BY ALL")
def tool_status_rollup(spark, sf):
    return M.tool_rollup(D.tool_logs(spark, sf))


@query(f"""{with_views('notes', 'links', 'claims')}, k AS (SELECT src, dst + 37 AS dst FROM links), ids AS (SELECT id FROM notes)
SELECT 'link_dst' AS kind, src AS id, dst AS missing FROM k WHERE dst NOT IN (SELECT id FROM ids) UNION SELECT 'claim_source', id, source_id + 1 FROM claims WHERE source_id + 1 NOT IN (SELECT id FROM ids)""")
def dangling_refs(spark, sf):
    n = D.notes(spark, sf)
    return I.dangling(n, D.links(spark, sf).withColumn("dst", F.col("dst") + 37), D.claims(spark, sf).withColumn("source_id", F.col("source_id") + 1))


def _events(spark, sf):
    return D.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("stream"), "event_type", F.col("props").alias("payload"), F.col("ts").cast("timestamp").alias("event_time"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, coalesce(props, '') AS payload, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
c AS (SELECT user_id, n, '' AS prev, sha256(event_id || event_type || payload || t) AS h FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, c.h, sha256(event_id || event_type || payload || t || c.h) FROM c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1),
x AS (SELECT c.user_id, prev, h, coalesce(lag(h) OVER (PARTITION BY c.user_id ORDER BY c.n), '') AS before, sha256(event_id || event_type || payload || CASE WHEN event_id % 100 = 7 THEN ' ' ELSE '' END || t || prev) AS again FROM c JOIN e ON e.user_id = c.user_id AND e.n = c.n)
SELECT user_id AS stream, count(*) AS events, count_if(prev <> before) AS broken_links, count_if(again <> h) AS wrong_hashes FROM x GROUP BY user_id""")
def hash_chain_check(spark, sf):
    """Chains are made for each agent, every hundredth payload is edited afterwards, and the check finds exactly those."""
    edited = F.when(F.col("id") % 100 == 7, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))
    return I.check_chain(I.chain(_events(spark, sf)).withColumn("payload", edited))


@query(f"""{with_views('notes', 'links')}, {_CLAIMS.removeprefix('WITH ')} SELECT (SELECT count(*) FROM notes) AS notes, (SELECT count(*) FROM links) AS links, (SELECT count(*) FROM claims) AS claims, (SELECT count(DISTINCT note_id) FROM ov WHERE passed) AS grounded,
(SELECT count(*) FROM (SELECT 'dst', src, dst FROM links WHERE dst NOT IN (SELECT id FROM notes) UNION SELECT 'src', dst, src FROM links WHERE src NOT IN (SELECT id FROM notes) UNION SELECT 'claim', id, source_id FROM claims WHERE source_id NOT IN (SELECT id FROM notes))) AS dangling, (SELECT count(*) FROM ov WHERE NOT passed) AS failed_claims, (SELECT count(*) FROM notes WHERE id NOT IN (SELECT src FROM links UNION SELECT dst FROM links)) AS orphans, (SELECT count(*) FROM ov WHERE NOT passed) = 0 AS ok""")
def verify_report(spark, sf):
    return I.verify_report(D.notes(spark, sf), D.links(spark, sf), D.claims(spark, sf))


@query(f"{with_views('access_log')} SELECT note_id, round(least(count(DISTINCT query_context) / 8.0, 1.0), 6) AS diversity FROM access_log WHERE trim(coalesce(query_context, '')) <> '' GROUP BY note_id")
def context_diversity(spark, sf):
    return C.context_diversity(D.access_log(spark, sf)).select("note_id", F.round("diversity", 6).alias("diversity"))


_ORDERED = "o AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS n FROM events), k AS (SELECT *, lag(n) OVER (ORDER BY n) AS b FROM o WHERE event_id % 250 <> 9)"


@query(f"WITH {_ORDERED} SELECT count(*) AS events, count_if(coalesce(b, 0) <> n - 1) AS broken_links, count_if(event_id % 100 = 7) AS wrong_hashes FROM k")
def long_chain_check(spark, sf):
    """All events as one chain, which goes on from a stored head halfway; some are edited and some taken out, and the check by ranges finds them."""
    events = _events(spark, sf).withColumn("stream", F.lit(0).cast("long"))
    half = F.expr("timestamp '2024-01-15 00:00:00'")
    first = materialize(I.chain(events.filter(F.col("event_time") < half)))
    head = I.check_long_chain(first).select(F.lit(0).cast("long").alias("stream"), F.col("head").alias("event_hash"))
    whole = first.unionByName(I.chain(events.filter(F.col("event_time") >= half), heads=head))
    edited = F.when(F.col("id") % 100 == 7, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))
    return I.check_long_chain(whole.withColumn("payload", edited).filter("id % 250 <> 9")).drop("head")


def _salience(spark, sf):
    return cascade.salience(D.access_log(spark, sf), F.expr(NOW))


@query()
def cascade_salience(spark, sf):
    return _salience(spark, sf).select("note_id", "accesses", "salience")


@query()
def consolidation_score(spark, sf):
    return C.consolidation_scores(D.notes(spark, sf), D.links(spark, sf), D.access_log(spark, sf), _salience(spark, sf))


@query(f"""{with_views('notes', 'links', 'access_log')}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM links UNION ALL SELECT dst FROM links) GROUP BY id),
v AS (SELECT note_id AS id, least(count(DISTINCT query_context) / 8.0, 1.0) AS diversity FROM access_log WHERE trim(coalesce(query_context, '')) <> '' GROUP BY note_id), a AS (SELECT note_id AS id, count(*) AS accesses FROM access_log GROUP BY note_id)
SELECT id, CAST(0 AS DOUBLE) AS salience, coalesce(degree, 0) AS degree, coalesce(diversity, 0)::DOUBLE AS diversity, coalesce(accesses, 0) AS accesses, round(1 / (1 + exp(-(0.25 * ln(1 + coalesce(degree, 0)) + 0.3 * coalesce(diversity, 0)))), 6) AS score
FROM notes LEFT JOIN d USING (id) LEFT JOIN v USING (id) LEFT JOIN a USING (id)""")
def consolidation_score_rested(spark, sf):
    """Scores of a store at rest, of which all salience has leaked away."""
    rested = D.access_log(spark, sf).select("note_id").distinct().withColumn("salience", F.lit(0.0))
    return C.consolidation_scores(D.notes(spark, sf), D.links(spark, sf), D.access_log(spark, sf), rested)


@query()
def consolidation_pass(spark, sf):
    scores = C.consolidation_scores(D.notes(spark, sf), D.links(spark, sf), D.access_log(spark, sf), _salience(spark, sf))
    rejected = D.notes(spark, sf).filter("id % 50 = 0").select("id", F.expr(f"{NOW} + interval 1 day").alias("suppress_until"))
    return C.consolidation_pass(scores, _salience(spark, sf), rejected, F.expr(NOW), flag_below=0.6)


def _new_store(spark, kind, *more):
    return kind(spark, f"{run_dir(spark)}/{uuid.uuid4().hex}/{kind.__name__}", *more)


@query("SELECT vec_id AS note_id, CASE WHEN vec_id % 3 = 0 THEN 'second' ELSE 'first' END AS model, CAST(len(embedding) AS INTEGER) AS dimensions, CASE WHEN vec_id % 3 = 0 THEN -embedding[1] ELSE embedding[1] END::DOUBLE AS first_number FROM embeddings")
def embedding_upsert(spark, sf):
    """Vectors by note after a batch that replaces a third of them and is run twice, read from a compacted store."""
    store = _new_store(spark, VectorStore, 16)
    rows = D.vectors(spark, sf).select(F.col("id").alias("note_id"), "embedding", F.lit("first").alias("model"), F.expr(NOW).alias("created_at"))
    store.put(rows, 0)
    again = rows.filter("note_id % 3 = 0").withColumns({"embedding": F.transform("embedding", lambda x: -x), "model": F.lit("second")})
    store.put(again, 1)
    store.put(again, 1)
    store.compact()
    return store.current().select("note_id", "model", "dimensions", F.col("embedding")[0].cast("double").alias("first_number"))


@query(f"{with_views('access_log')} SELECT note_id, count(*) AS access_count, epoch_us(max(accessed_at)) AS last_accessed_us FROM access_log GROUP BY note_id")
def access_counters(spark, sf):
    """Counters kept by three batches of accesses, one of which is run twice."""
    store, log = _new_store(spark, AccessStore), D.access_log(spark, sf)
    for batch in (0, 1, 1, 2):
        store.record(log.filter(F.col("id") % 3 == batch), batch)
    return store.counters().select("note_id", "access_count", F.unix_micros("last_accessed_at").alias("last_accessed_us"))


_CONTEXT = SEARCH_SQL["context_budget"]


@query(f"WITH ctx AS ({_CONTEXT}) SELECT ctx.id AS note_id, ctx.query_id, 'search_hit' AS access_kind, text AS query_context FROM ctx JOIN benchmark ON item_id = ctx.query_id")
def context_accesses(spark, sf):
    """The log rows that retrieving each benchmark item's context leaves, as they are read from the store."""
    store = _new_store(spark, AccessStore)
    item = D.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    store.record(search_accesses(context_budget(spark, sf), item, F.expr(NOW)), 0)
    return store.log().join(item.select("query_id", F.col("query").alias("query_context")), "query_context").select("note_id", "query_id", "access_kind", "query_context")


_LINES = """claims AS (SELECT id, note_id, source_id, claim_start, claim_start + strlen(claim) AS claim_end, claim, source_text FROM (
SELECT a.doc_id * 4 AS id, a.doc_id AS note_id, a.doc_id AS source_id, 0 AS claim_start, split_part(a.text, chr(10), 1) AS claim, a.text AS source_text FROM documents a
UNION ALL SELECT a.doc_id * 4 + 1, a.doc_id, a.doc_id, strlen(split_part(a.text, chr(10), 1)) + 1, split_part(a.text, chr(10), 2), split_part(a.text, chr(10), 2) FROM documents a WHERE contains(a.text, chr(10))
UNION ALL SELECT a.doc_id * 4 + 2, a.doc_id, b.doc_id, 0, split_part(a.text, chr(10), 1), b.text FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) WHERE claim <> '')"""


@query(f"WITH {_LINES}{_CLAIMS.split(SQL['claims'])[1]} SELECT note_id, row_number() OVER (PARTITION BY note_id ORDER BY claim_start, id) AS position, id, claim_start, claim_end, source_id, score, method, 'doc/' || source_id AS uri FROM ov JOIN claims USING (id, note_id, source_id) WHERE passed")
def claim_spans(spark, sf):
    """First and second lines of the documents as claims by byte offsets, in order; claims out of bounds and on missing notes or sources are refused."""
    d = D.table(spark, sf, "documents").select("doc_id", "text", F.split("text", "\n").alias("l"))
    size = lambda x: F.octet_length(x).cast("long")
    none, no = F.lit(None).cast("long"), F.lit(0).cast("long")
    two = size(F.col("l")[0]) + 1
    first = d.select((F.col("doc_id") * 4).alias("id"), F.col("doc_id").alias("note_id"), no.alias("claim_start"), size(F.col("l")[0]).alias("claim_end"), F.col("doc_id").alias("source_id"), none.alias("source_span_start"), none.alias("source_span_end"))
    second = d.filter(F.size("l") > 1).select((F.col("doc_id") * 4 + 1).alias("id"), F.col("doc_id").alias("note_id"), two.alias("claim_start"), (two + size(F.get("l", F.lit(1)))).alias("claim_end"), F.col("doc_id").alias("source_id"), two.alias("source_span_start"), (two + size(F.get("l", F.lit(1)))).alias("source_span_end"))
    other = first.withColumns({"id": F.col("id") + 2, "source_id": F.col("source_id") + 1})
    bad = first.withColumns({"id": F.col("id") + 3, "claim_end": F.lit(2**40)}).unionByName(first.withColumns({"id": -F.col("id") - 1, "note_id": -F.col("note_id") - 1}))
    sources = d.select(F.col("doc_id").alias("id"), F.col("text").alias("excerpt"), F.concat(F.lit("doc/"), "doc_id").alias("uri"), F.concat(F.lit("Doc "), "doc_id").alias("title"))
    spans = I.claim_spans(first.unionByName(second).unionByName(other).unionByName(bad), d.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), sources)
    return I.spans_of_notes(spans, sources).select("note_id", "position", "id", "claim_start", "claim_end", "source_id", "score", "method", "uri")


LEAST = 0.35
_SIM = f"""v AS (SELECT vec_id AS id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE ** 2))) AS n FROM embeddings),
p AS (SELECT a.id AS a, b.id AS b, round(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (a.n * b.n), 6) AS similarity FROM v a JOIN v b ON a.id < b.id), s AS (SELECT * FROM p WHERE similarity >= {LEAST})"""


@query(f"WITH {_SIM} SELECT * FROM s")
def similar_pairs(spark, sf):
    return C.similar_pairs(D.vectors(spark, sf), LEAST)


_CLUSTERS = f"""WITH RECURSIVE {_SIM}, u AS (SELECT a, b FROM s UNION SELECT b, a FROM s), r AS (SELECT a AS id, a AS label FROM u UNION SELECT u.b, r.label FROM r JOIN u ON u.a = r.id),
l AS (SELECT id, min(label) AS cluster FROM r GROUP BY id), c AS (SELECT * FROM l WHERE cluster IN (SELECT cluster FROM l GROUP BY cluster HAVING count(*) >= 3))"""


@query(f"{_CLUSTERS} SELECT * FROM c")
def clusters(spark, sf):
    return C.clusters(C.similar_pairs(D.vectors(spark, sf), LEAST))


@query(f"{_CLUSTERS}, x AS (SELECT cluster, unnest(e) AS x, unnest(range(len(e))) AS i, c.id FROM c JOIN v USING (id)), m AS (SELECT cluster, i, round(avg(x::DOUBLE), 6) AS m, count(*) AS n FROM x GROUP BY ALL) SELECT cluster, n AS members, CAST(i AS INTEGER) AS i, m FROM m")
def cluster_centroid(spark, sf):
    v = D.vectors(spark, sf)
    c = C.centroids(C.clusters(C.similar_pairs(v, LEAST)), v)
    return c.select("cluster", "members", F.posexplode("centroid").alias("i", "m"))


@query(f"{_CLUSTERS}, a AS (SELECT id AS a, cluster FROM c), b AS (SELECT id AS b, cluster AS other FROM c) SELECT cluster, (2 * CAST(sum(CAST(round(similarity * 1e6) AS BIGINT)) AS BIGINT) + count(*)) // (2 * count(*)) / 1e6 AS mean_similarity FROM s JOIN a USING (a) JOIN b USING (b) WHERE cluster = other GROUP BY cluster")
def cluster_similarity(spark, sf):
    return C.clusters_with_similarity(C.similar_pairs(D.vectors(spark, sf), LEAST))[1]


@query(f"""{_CLUSTERS}, e AS (SELECT cluster, i, round(avg(x::DOUBLE), 6) AS m FROM (SELECT c.cluster, unnest(e) AS x, unnest(range(len(e))) AS i FROM c JOIN v USING (id)) GROUP BY ALL),
k AS (SELECT label AS schema_id, i, round(avg(x::DOUBLE), 6) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL),
ne AS (SELECT cluster, sqrt(sum(m * m)) AS n FROM e GROUP BY 1), nk AS (SELECT schema_id, sqrt(sum(m * m)) AS n FROM k GROUP BY 1),
near AS (SELECT cluster, schema_id, round(sum(e.m * k.m) / any_value(ne.n * nk.n), 6) AS similarity FROM e JOIN k USING (i) JOIN ne USING (cluster) JOIN nk USING (schema_id) GROUP BY 1, 2)
SELECT cluster, schema_id, similarity, CASE WHEN similarity >= {LEAST} THEN 'patch' ELSE 'create' END AS decision FROM near QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY similarity DESC, schema_id) = 1""")
def nearest_schema(spark, sf):
    """Clusters against one schema for each label: the mean of its vectors."""
    v = D.vectors(spark, sf)
    schemas = C.centroids(v.select("id", F.col("label").alias("cluster")), v).select(F.col("cluster").alias("schema_id"), F.col("centroid").alias("vector"))
    return C.nearest_schema(C.centroids(C.clusters(C.similar_pairs(v, LEAST)), v), schemas, least=LEAST)


@query("""WITH q AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) >= 3) AS t FROM benchmark)
SELECT item_id AS query_id, doc_id AS id, round(CASE WHEN len(t) = 0 THEN 0 ELSE len(list_filter(t, lambda x: contains(lower(text), x))) / len(t) END, 6) AS grounded FROM documents JOIN q ON item_id = doc_id % (SELECT count(*) FROM benchmark)""")
def proxy_gate(spark, sf):
    """How far each document bears out one benchmark item as a query: the gate's measure alone; the gate is ``schema_proxy_gate``."""
    b = D.table(spark, sf, "benchmark")
    d = D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % b.count()).alias("query_id"))
    j = d.join(b.select(F.col("item_id").alias("query_id"), F.col("text").alias("q")), "query_id")
    return j.select("query_id", "id", F.round(C.groundedness(F.col("q"), F.col("text")), 6).alias("grounded"))


@query()
def schema_proxy_gate(spark, sf):
    """The gate over extractive schemas of the vectors' clusters, by the query contexts of their notes."""
    v, n = D.vectors(spark, sf), D.notes(spark, sf)
    every, similarity = C.clusters_with_similarity(C.similar_pairs(v, LEAST))
    members = every
    if not v.join(n.select("id"), "id", "left_anti").isEmpty():  # vectors without a note connect others, but their pairs do not count
        members = materialize(every.join(n.select("id"), "id", "left_semi"))
        similarity = C.mean_similarity(members, C.similar_pairs(v.join(n.select("id"), "id", "left_semi"), LEAST))
    return C.proxy_gate(C.extractive_proposals(members, n, similarity), members, D.access_log(spark, sf), n)


@query(f"""{with_views('notes', 'note_tags')}, n AS (SELECT max(created_at) AS now FROM notes)
SELECT tag, count(*) AS uses, CASE WHEN count(*) > 3 THEN 'rising' ELSE 'stable' END AS trend FROM note_tags JOIN notes USING (id), n WHERE created_at > now - INTERVAL 7 DAY AND created_at <= now GROUP BY tag ORDER BY uses DESC, tag LIMIT 10""")
def trending_tags(spark, sf):
    n = D.notes(spark, sf)
    now = n.agg(F.max("created_at")).first()[0]
    at = D.note_tags(n).join(n.select("id", F.col("created_at").alias("at")), "id")
    return C.trending_tags(at, F.lit(now))


@query(f"{with_views('notes')}, n AS (SELECT max(created_at) AS now FROM notes) SELECT id, title, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day FROM notes, n WHERE day(created_at) = day(now) AND CAST(created_at AS DATE) < CAST(now AS DATE)")
def on_this_day(spark, sf):
    n = D.notes(spark, sf)
    now = n.agg(F.max("created_at")).first()[0]
    return C.on_this_day(n, F.lit(now)).withColumn("day", F.col("day").cast("string"))


@query(f"{with_views('notes', 'access_log')}, n AS (SELECT max(created_at) AS now FROM notes) SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS notes, count(DISTINCT lang) AS langs, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM notes GROUP BY 1")
def digest(spark, sf):
    """What was added on each day."""
    n = D.notes(spark, sf)
    return n.groupBy(F.to_date("created_at").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("notes"), F.countDistinct("lang").alias("langs"), F.sum(F.octet_length("content")).alias("bytes"))


@query(f"""WITH n AS (SELECT doc_id, lang, strlen(text) AS bytes, {_NORM.format('text')} AS c, {_NORM.format("CASE WHEN lang = 'en' THEN text ELSE '0' END")} AS s FROM documents),
t AS (SELECT *, {_EVID.format('c')} AS ec, {_EVID.format('s')} AS es, {_TRI.format('c')} AS gc, {_TRI.format('s')} AS gs FROM n),
m AS (SELECT *, greatest(CASE WHEN contains(s, c) THEN 1.0 WHEN contains(c, s) AND s <> '' THEN 0.75 ELSE 0.0 END, {_JAC.format('ec', 'es')} * 0.85, {_JAC.format('gc', 'gs')} * 0.7) >= 0.55 AS passed FROM t),
e AS (SELECT doc_id, list_filter([CASE WHEN bytes <= 0 THEN '0: claim out of bounds' WHEN NOT passed THEN '0: claim not borne out' END, CASE WHEN doc_id % 5 = 0 THEN '1: create_link: no note dst' END], lambda x: x IS NOT NULL) AS errors FROM m)
SELECT doc_id AS tx_id, 2 AS operations, CASE WHEN len(errors) = 0 THEN 'committed' ELSE 'failed' END AS status, array_to_string(errors, '; ') AS errors FROM e""")
def tx_validate(spark, sf):
    """A transaction for each document that notes its text with the whole as a claim; other languages cite another text, each fifth links to no note."""
    d = D.table(spark, sf, "documents")
    claim = F.array(F.struct(F.lit(0).alias("claim_start"), F.octet_length("text").alias("claim_end"), F.col("doc_id").alias("source_id"), F.when(F.col("lang") == "en", F.col("text")).otherwise("0").alias("source_content")))
    create = F.to_json(F.struct(F.lit("create_note").alias("op"), (F.col("doc_id") + 10**9).alias("id"), F.lit("t").alias("title"), F.col("text").alias("content"), claim.alias("claims")))
    link = F.to_json(F.struct(F.lit("create_link").alias("op"), F.col("doc_id").alias("src"), F.when(F.col("doc_id") % 5 == 0, F.lit(-1)).otherwise(F.col("doc_id")).alias("dst"), F.lit("wikilink").alias("link_type")))
    tx = d.select(F.col("doc_id").alias("tx_id"), F.concat(F.lit("["), create, F.lit(","), link, F.lit("]")).alias("operations"))
    return T.validate(tx, D.notes(spark, sf)).select("tx_id", F.col("operations").cast("int").alias("operations"), "status", F.array_join("errors", "; ").alias("errors"))


@query("SELECT user_id, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS day_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def daily_windows(spark, sf):
    e = D.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.unix_micros("w.start").alias("day_us"), "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf):
    e = D.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


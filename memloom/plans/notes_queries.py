"""Queries over notes: listings, lookups, parsing, previews, chunks, synchronisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import notes as N
from ..sources import files
from ..sources import testdata as D
from ..sources.testdata import with_views

Q, O = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


def _notes(spark, sf):
    return D.notes(spark, sf).withColumn("updated_at", F.col("created_at"))


#: The longest beginning of a text of at most n bytes: the longest in characters that fits.
_CUT = "left(content, list_max(list_filter(range(0, 201), lambda k: strlen(left(content, k)) <= 200)))"
_PREVIEW = f"CASE WHEN strlen(content) <= 200 THEN content ELSE {_CUT} || '...' END"


@query(f"{with_views('notes', 'note_tags')} SELECT n.id, title, {_PREVIEW} AS preview, (SELECT count(*) FROM note_tags t WHERE t.id = n.id) AS tag_count FROM notes n ORDER BY created_at DESC, n.id LIMIT 20")
def notes_list(spark, sf):
    n = _notes(spark, sf)
    return N.listing(n, D.note_tags(n))


@query(f"{with_views('notes', 'note_tags')} SELECT n.id, title, {_PREVIEW} AS preview, (SELECT count(*) FROM note_tags t WHERE t.id = n.id) AS tag_count FROM notes n WHERE id IN (SELECT id FROM note_tags WHERE tag = 'de') ORDER BY title, id LIMIT 20 OFFSET 20")
def notes_by_tag(spark, sf):
    n = _notes(spark, sf)
    return N.listing(n, D.note_tags(n), sort="title_asc", limit=20, offset=20, tag="de")


@query(f"{with_views('notes', 'note_tags', 'links')} SELECT n.id, title, (SELECT string_agg(tag, ',' ORDER BY tag) FROM note_tags t WHERE t.id = n.id) AS tags, (SELECT count(*) FROM links WHERE dst = n.id) AS in_links, (SELECT count(*) FROM links WHERE src = n.id) AS out_links FROM notes n")
def note_details(spark, sf):
    n = _notes(spark, sf)
    return N.details(n, D.note_tags(n), D.links(spark, sf)).select("id", "title", F.array_join("tags", ",").alias("tags"), "in_links", "out_links")


@query(f"""{with_views('notes')}, refs AS (SELECT title AS ref FROM notes UNION SELECT CAST(id AS VARCHAR) FROM notes UNION SELECT 'Doc ' || (id + 100000000) FROM notes)
SELECT ref, coalesce((SELECT id FROM notes WHERE CAST(id AS VARCHAR) = ref), (SELECT min(id) FROM notes WHERE title = ref)) AS id FROM refs""")
def resolve_refs(spark, sf):
    n = _notes(spark, sf)
    refs = n.select(F.col("title").alias("ref")).union(n.select(F.col("id").cast("string"))).union(n.select(F.concat(F.lit("Doc "), F.col("id") + 100000000)))
    return N.resolve(n, refs)


@query(f"""{with_views('notes')}, w AS (SELECT user_id AS request, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) - 1 AS pos FROM events)
SELECT request, pos, w.id, title FROM w JOIN notes USING (id)""")
def multi_get(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    e = D.table(spark, sf, "events").select("user_id", "event_id", (F.row_number().over(w) - 1).alias("p"))
    wanted = e.groupBy(F.col("user_id").alias("request")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "event_id"))), lambda s: s["event_id"]).alias("ids"))
    return N.by_ids(_notes(spark, sf), wanted)


@query(f"{with_views('links')} SELECT src, dst, link_type, CAST(epoch(valid_from) AS BIGINT) AS valid_from, CAST(epoch(valid_until) AS BIGINT) AS valid_until FROM links")
def all_links(spark, sf):
    return D.links(spark, sf).select("src", "dst", "link_type", F.unix_timestamp("valid_from").alias("valid_from"), F.unix_timestamp("valid_until").alias("valid_until"))


@query(f"{with_views('notes')} SELECT id, title FROM notes WHERE id NOT IN (SELECT vec_id FROM embeddings)")
def missing_embeddings(spark, sf):
    return N.missing_embeddings(_notes(spark, sf), D.vectors(spark, sf))


@query(f"{with_views('notes')} SELECT id, unnest(regexp_extract_all(content, '(?:^|\\s)#([a-zA-Z_][\\w/-]*)', 1)) AS tag FROM notes")
def extract_tags(spark, sf):
    return _notes(spark, sf).select("id", F.explode(X.tags(F.col("content"))).alias("tag"))


@query(f"{with_views('notes')}, r AS (SELECT id, unnest(regexp_extract_all(content, '\\[\\[rel:[a-zA-Z_]\\w*\\|[^\\]|]+(?:\\|[^\\]]+)?\\]\\]')) AS raw FROM notes) SELECT id, lower(regexp_extract(raw, '\\[\\[rel:([a-zA-Z_]\\w*)\\|([^\\]|]+)', 1)) AS relation, trim(regexp_extract(raw, '\\[\\[rel:([a-zA-Z_]\\w*)\\|([^\\]|]+)', 2)) AS target FROM r")
def extract_typed_links(spark, sf):
    return _notes(spark, sf).select("id", F.inline(X.typed_links(F.col("content")))).select("id", "relation", "target")


@query(f"{with_views('notes')}, r AS (SELECT id, unnest(regexp_extract_all(content, '\\[\\[[^\\]|#]+(?:#[^\\]|]+)?(?:\\|[^\\]]+)?\\]\\]')) AS raw FROM notes) SELECT id, trim(regexp_extract(raw, '\\[\\[([^\\]|#]+)', 1)) AS target FROM r WHERE NOT regexp_matches(raw, '^\\[\\[rel:[a-zA-Z_]\\w*\\|[^\\]|]+')")
def extract_plain_links(spark, sf):
    return _notes(spark, sf).select("id", F.inline(X.plain_links(F.col("content")))).select("id", "target")


@query(f"{with_views('notes')} SELECT id, '[Doc ' || regexp_extract(content, '\\[\\[Doc ([0-9]+)\\]\\]', 1) || '](/notes/doc-' || regexp_extract(content, '\\[\\[Doc ([0-9]+)\\]\\]', 1) || ') [Doc ' || regexp_extract(content, '\\[\\[rel:causal\\|Doc ([0-9]+)\\]\\]', 1) || '](/notes/doc-' || regexp_extract(content, '\\[\\[rel:causal\\|Doc ([0-9]+)\\]\\]', 1) || ') #' || lang || ' #' || source AS tail FROM notes")
def markdown_links(spark, sf):
    md = X.wikilinks_to_markdown(F.col("content"))
    return _notes(spark, sf).select("id", F.regexp_extract(md, r"(\[Doc [0-9]+\]\(/notes/doc-[0-9]+\) \[Doc [0-9]+\]\(/notes/doc-[0-9]+\) #\w+ #\w+)$", 1).alias("tail"))


@query(f"{with_views('notes')} SELECT id, unnest([lang, source]) AS tag FROM notes")
def frontmatter_tags(spark, sf):
    return _notes(spark, sf).select("id", F.explode(X.yaml_list(X.front_field(F.col("content"), "tags"))).alias("tag"))


@query(f"{with_views('notes')} SELECT id, len(list_filter(regexp_split_to_array(regexp_replace(content, '^---\\ntags: [^\\n]*\\n---\\n', ''), '\\s+'), lambda x: x <> '')) AS words FROM notes")
def word_count(spark, sf):
    return _notes(spark, sf).select("id", X.word_count(F.col("content")).alias("words"))


@query(f"{with_views('notes')} SELECT id, {_PREVIEW} AS preview FROM notes")
def preview_bytes(spark, sf):
    return _notes(spark, sf).select("id", X.preview(F.col("content")).alias("preview"))


@query("SELECT page_id AS id, CAST(unnest(regexp_extract_all(html, '<h([1-6])>[^<]*</h', 1)) AS INTEGER) AS level FROM pages")
def page_headings(spark, sf):
    """Headings of pages written as markdown lines, read back by the outline function."""
    h = F.transform(F.regexp_extract_all("html", F.lit(r"<h([1-6])>[^<]*</h"), 1), lambda x: F.concat(F.repeat(F.lit("#"), x.cast("int")), F.lit(" heading")))
    return D.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.explode(X.headings(F.array_join(h, "\n")))).select("id", F.col("col.level").alias("level"))


@query("SELECT doc_id AS id, regexp_replace('a/b: ' || source || ' ' || lang || '?', '[/\\\\:*?\"<>| ]', '_', 'g') AS file FROM documents")
def sanitized_names(spark, sf):
    return D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), X.sanitize_filename(F.concat(F.lit("a/b: "), "source", F.lit(" "), "lang", F.lit("?"))).alias("file"))


@query()
def chunk_documents(spark, sf):
    return files.chunk_documents(D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


@query()
def ingest_documents(spark, sf):
    d = D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("Doc "), "doc_id").alias("title"), F.col("text").alias("content"))
    notes, links = files.ingest(d)
    n = links.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("chunks"))
    return notes.join(n, "id").select("id", "title", F.octet_length("content").alias("preview_bytes"), "chunks")


@query(f"{with_views('notes')} SELECT id, to_base64(unhex(sha256(title || '|' || content))) AS hash FROM notes")
def content_hash(spark, sf):
    return files.manifest(_notes(spark, sf))


@query(f"""{with_views('notes')}, l AS (SELECT id, sha256(title || '|' || content) AS h FROM notes WHERE id % 7 <> 0), r AS (SELECT id, sha256(title || '|' || CASE WHEN id % 5 = 0 THEN upper(content) ELSE content END) AS h FROM notes WHERE id % 11 <> 0)
SELECT id, CASE WHEN r.h IS NULL THEN 'push' WHEN l.h IS NULL THEN 'pull' WHEN l.h <> r.h THEN 'update' ELSE 'same' END AS action FROM l FULL JOIN r USING (id)""")
def sync_diff(spark, sf):
    """Two sides derived from all notes: each lacks some, and one has changed some."""
    n = _notes(spark, sf)
    here = files.manifest(n.filter("id % 7 <> 0"))
    there = files.manifest(n.filter("id % 11 <> 0").withColumn("content", F.when(F.col("id") % 5 == 0, F.upper("content")).otherwise(F.col("content"))))
    return files.sync_actions(here, there)


@query("""WITH log AS (SELECT event_id AS seq, user_id AS id, event_type, value FROM events), e AS (SELECT id, max(seq) AS ended FROM log WHERE event_type = 'error' GROUP BY id),
a AS (SELECT log.* FROM log LEFT JOIN e USING (id) WHERE event_type <> 'error' AND (ended IS NULL OR seq > ended))
SELECT id, arg_max(CASE WHEN event_type <> 'view' THEN 't' || seq END, CASE WHEN event_type <> 'view' THEN seq END) AS title, arg_max('c' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), seq) AS content FROM a GROUP BY id HAVING bool_or(event_type = 'signup')""")
def note_log_projection(spark, sf):
    """Notes from a change log: sign-ups create, errors delete, views change the content, others title and content."""
    log = D.table(spark, sf, "events").selectExpr(
        "event_id as seq", "user_id as id", "case event_type when 'signup' then 'create' when 'error' then 'delete' else 'update' end as op",
        "case when event_type <> 'view' then concat('t', event_id) end as title", "concat('c', cast(floor(value) as bigint)) as content", "ts as at",
    )
    return N.project_log(log).select("id", "title", "content")


@query(f"{with_views('links')}, m AS (SELECT DISTINCT src, (src + dst) % 97 AS dst, link_type FROM links) SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.src = m.src AND l.dst = m.dst AND l.link_type = m.link_type)")
def link_upserts(spark, sf):
    k = D.links(spark, sf)
    return N.new_links(k, k.withColumn("dst", (F.col("src") + F.col("dst")) % 97)).select("src", "dst", "link_type")

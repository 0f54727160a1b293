"""Notes, links, key-value writes, accesses, tool logs and claims as views of the given tables.

``SQL`` has the same views as common table expressions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

EPOCH = "2024-01-01 00:00:00"


def n_documents(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "documents").count()


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, content (with front matter, links and tags), lang, source, created_at."""
    n = n_documents(spark, sf_dir)
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("Doc "), F.col("doc_id")).alias("title"),
        F.expr(f"concat('---\\ntags: [', lang, ', ', source, ']\\n---\\n', text, ' [[Doc ', (doc_id * 7 + 1) % {n}, ']] [[rel:causal|Doc ', (doc_id * 13 + 5) % {n}, ']] #', lang, ' #', source)").alias("content"),
        "lang",
        "source",
        F.expr(f"timestamp '{EPOCH}' + make_interval(0, 0, 0, 0, cast(doc_id as int), 0, 0)").alias("created_at"),
    )


def note_tags(notes_: DataFrame) -> DataFrame:
    return notes_.select("id", F.explode(F.array("lang", "source")).alias("tag")).distinct()


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, link_type, valid_from, valid_until."""
    n = n_documents(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("doc_id")
    wiki = d.select(
        F.col("doc_id").alias("src"), F.expr(f"(doc_id * 7 + 1) % {n}").alias("dst"), F.lit("wikilink").alias("link_type"),
        F.expr(f"timestamp '{EPOCH}'").alias("valid_from"), F.expr("case when doc_id % 3 = 0 then timestamp '2024-01-15 00:00:00' end").alias("valid_until"),
    )
    causal = d.filter("doc_id % 5 <> 0").select(
        F.col("doc_id").alias("src"), F.expr(f"(doc_id * 13 + 5) % {n}").alias("dst"), F.lit("causal").alias("link_type"),
        F.expr("timestamp '2024-01-10 00:00:00'").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"),
    )
    return wiki.unionAll(causal)


def kv_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as seq", "user_id as agent_id", "case when event_id % 2 = 0 then 'default' else 'chat' end as namespace",
        "event_type as key", "value", "cast(ts as timestamp) as written_at", "case when event_id % 4 = 0 then 86400 * 7 end as ttl_seconds",
    )


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = n_documents(spark, sf_dir)
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id", f"event_id % {n} as note_id", "cast(ts as timestamp) as accessed_at",
        "case event_type when 'view' then 'read' when 'click' then 'search_hit' when 'purchase' then 'mcp_retrieve' else 'graph_traverse' end as access_kind",
        "case when event_type in ('click', 'purchase') then concat('q', user_id % 12) end as query_context", "user_id as agent_id",
    )


def tool_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id", "user_id as agent_id", "event_type as tool_name", "props as input",
        "case when event_type = 'error' then case when event_id % 2 = 0 then 'error' else 'timeout' end else 'success' end as status",
        "cast(floor(value) as bigint) as duration_ms", "cast(ts as timestamp) as created_at",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id as id", "embedding", "label")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first line as a claim on the document itself, and on the next one: id, note_id, source_id, claim, source_text."""
    d = table(spark, sf_dir, "documents")
    own = d.selectExpr("doc_id as note_id", "doc_id as source_id", "split(text, '\\n')[0] as claim", "text as source_text")
    nxt = d.selectExpr("doc_id - 1 as note_id", "doc_id as source_id", "text as source_text")
    other = nxt.join(d.selectExpr("doc_id as note_id", "split(text, '\\n')[0] as claim"), "note_id").filter("note_id % 2 = 0")
    return own.unionByName(other.select(*own.columns)).withColumn("id", F.col("note_id") * 2 + F.when(F.col("note_id") == F.col("source_id"), 0).otherwise(1))


SQL = {
    "notes": """notes AS (SELECT doc_id AS id, 'Doc ' || doc_id AS title,
        '---' || chr(10) || 'tags: [' || lang || ', ' || source || ']' || chr(10) || '---' || chr(10) || text
        || ' [[Doc ' || (doc_id * 7 + 1) % n || ']] [[rel:causal|Doc ' || (doc_id * 13 + 5) % n || ']] #' || lang || ' #' || source AS content,
        lang, source, TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS created_at
        FROM documents, (SELECT count(*) AS n FROM documents))""",
    "note_tags": "note_tags AS (SELECT DISTINCT id, unnest([lang, source]) AS tag FROM notes)",
    "links": """links AS (SELECT doc_id AS src, (doc_id * 7 + 1) % n AS dst, 'wikilink' AS link_type, TIMESTAMP '2024-01-01 00:00:00' AS valid_from,
        CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' END AS valid_until FROM documents, (SELECT count(*) AS n FROM documents)
        UNION ALL SELECT doc_id, (doc_id * 13 + 5) % n, 'causal', TIMESTAMP '2024-01-10 00:00:00', NULL FROM documents, (SELECT count(*) AS n FROM documents) WHERE doc_id % 5 <> 0)""",
    "kv": """kv AS (SELECT event_id AS seq, user_id AS agent_id, CASE WHEN event_id % 2 = 0 THEN 'default' ELSE 'chat' END AS namespace,
        event_type AS key, value, ts AS written_at, CASE WHEN event_id % 4 = 0 THEN 86400 * 7 END AS ttl_seconds FROM events)""",
    "access_log": """access_log AS (SELECT event_id AS id, event_id % n AS note_id, ts AS accessed_at,
        CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'search_hit' WHEN 'purchase' THEN 'mcp_retrieve' ELSE 'graph_traverse' END AS access_kind,
        CASE WHEN event_type IN ('click', 'purchase') THEN 'q' || (user_id % 12) END AS query_context, user_id AS agent_id
        FROM events, (SELECT count(*) AS n FROM documents))""",
    "tool_logs": """tool_logs AS (SELECT event_id AS id, user_id AS agent_id, event_type AS tool_name, props AS input,
        CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'error' ELSE 'timeout' END ELSE 'success' END AS status,
        CAST(floor(value) AS BIGINT) AS duration_ms, ts AS created_at FROM events)""",
    "claims": """claims AS (SELECT note_id * 2 + CASE WHEN note_id = source_id THEN 0 ELSE 1 END AS id, * FROM (
        SELECT doc_id AS note_id, doc_id AS source_id, split_part(text, chr(10), 1) AS claim, text AS source_text FROM documents
        UNION ALL SELECT a.doc_id, b.doc_id, split_part(a.text, chr(10), 1), b.text FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0))""",
}


def with_views(*names: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ", ".join(SQL[n] for n in names)

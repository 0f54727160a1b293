"""Queries over the link graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
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


def _seeds(spark, sf):
    """The benchmark items' numbers as seed notes."""
    return D.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"))


def _vertices(spark, sf):
    n = D.notes(spark, sf)
    return n, D.links(spark, sf), D.note_tags(n)


_BFS2 = """, e AS (SELECT src AS a, dst AS b FROM {l} UNION SELECT dst, src FROM {l}), d1 AS (SELECT DISTINCT item_id AS seed, b AS id FROM benchmark JOIN e ON a = item_id WHERE b <> item_id),
d2 AS (SELECT DISTINCT seed, b AS id FROM d1 JOIN e ON a = id WHERE b <> seed)
SELECT seed, id, 1 AS depth FROM d1 UNION ALL SELECT seed, id, 2 FROM (SELECT * FROM d2 EXCEPT SELECT * FROM d1)"""


@query(f"{with_views('links')} SELECT dst AS id, src AS other, link_type FROM links")
def backlinks(spark, sf):
    return D.links(spark, sf).select(F.col("dst").alias("id"), F.col("src").alias("other"), "link_type")


@query(f"{with_views('links')} SELECT src AS id, dst AS other, link_type FROM links")
def forward_links(spark, sf):
    return D.links(spark, sf).select(F.col("src").alias("id"), F.col("dst").alias("other"), "link_type")


@query(f"""{with_views('notes', 'note_tags', 'links')} SELECT (SELECT count(*) FROM notes) AS total_notes, (SELECT count(*) FROM links) AS total_links, (SELECT count(DISTINCT tag) FROM note_tags) AS total_tags,
(SELECT count(*) FROM notes WHERE id NOT IN (SELECT src FROM links UNION SELECT dst FROM links)) AS orphan_notes, (SELECT dst FROM links GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1) AS most_linked""")
def graph_stats(spark, sf):
    return G.stats(*_vertices(spark, sf))


@query(f"{with_views('links')} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM links UNION ALL SELECT dst FROM links) GROUP BY id")
def degree_counts(spark, sf):
    return G.degrees(D.links(spark, sf))


@query(f"{with_views('notes', 'links')} SELECT id FROM notes WHERE id NOT IN (SELECT src FROM links WHERE link_type = 'causal' UNION SELECT dst FROM links WHERE link_type = 'causal')")
def orphans(spark, sf):
    """Notes without causal links."""
    n, k, _ = _vertices(spark, sf)
    return G.orphans(n, G.of_types(k, " Causal "))


@query(f"{with_views('notes', 'note_tags', 'links')} SELECT id, 'Doc ' || id AS title, (SELECT count(*) FROM note_tags t WHERE t.id = v.id) AS tag_count, count(*) AS link_count FROM (SELECT src AS id FROM links UNION ALL SELECT dst FROM links) v GROUP BY id")
def graph_nodes(spark, sf):
    return G.vertices(*_vertices(spark, sf))


@query(with_views("links") + _BFS2.format(l="links"))
def bfs_depth2(spark, sf):
    return G.bfs(D.links(spark, sf), _seeds(spark, sf), 2)


@query(with_views("links") + ", t AS (SELECT * FROM links WHERE link_type = 'causal')" + _BFS2.format(l="t"))
def bfs_typed(spark, sf):
    return G.bfs(G.of_types(D.links(spark, sf), "causal"), _seeds(spark, sf), 2)


@query(with_views("links") + ", t AS (SELECT * FROM links WHERE valid_until IS NULL)" + _BFS2.format(l="t").replace("SELECT seed, id, 1 AS depth", ", x AS (SELECT seed, id, 1 AS depth", 1) + ") SELECT id, min(depth) AS depth FROM x WHERE id NOT IN (SELECT item_id FROM benchmark) GROUP BY id ORDER BY depth, id LIMIT 100")
def graph_neighbors(spark, sf):
    return G.neighbors(D.links(spark, sf), _seeds(spark, sf), 2, 100)


@query(f"""{with_views('links', recursive=True)}, p AS (SELECT item_id AS source, item_id * 3 + 2 AS target FROM benchmark), e AS (SELECT DISTINCT src AS a, dst AS b FROM links),
w(source, id, path) USING KEY (source, id) AS (SELECT DISTINCT source, source, [source] FROM p
UNION SELECT w.source, e.b, min(list_append(w.path, e.b)) FROM w JOIN e ON e.a = w.id LEFT JOIN recurring.w AS r ON r.source = w.source AND r.id = e.b WHERE r.id IS NULL GROUP BY w.source, e.b)
SELECT p.source, p.target, coalesce(array_to_string(path, '>'), '') AS path FROM p LEFT JOIN w ON w.source = p.source AND w.id = p.target""")
def shortest_path(spark, sf):
    pairs = D.table(spark, sf, "benchmark").selectExpr("item_id as source", "item_id * 3 + 2 as target")
    return G.shortest_paths(D.links(spark, sf), pairs).select("source", "target", F.array_join("path", ">").alias("path"))


@query(with_views("links") + ", k AS (SELECT * FROM links)" + _BFS2.format(l="k").replace("SELECT seed, id, 1 AS depth", ", x AS (SELECT seed, id, 1 AS depth", 1) + "), nodes AS (SELECT id FROM x UNION SELECT item_id FROM benchmark) SELECT src, dst, link_type FROM links WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)")
def subgraph_export(spark, sf):
    k = D.links(spark, sf)
    near = G.bfs(k, _seeds(spark, sf), 2).select("id").union(_seeds(spark, sf))
    return G.induced(k, near).select("src", "dst", "link_type")


@query(f"{with_views('notes', 'note_tags', 'links')}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM links UNION ALL SELECT dst FROM links) GROUP BY id) SELECT n.id, title, coalesce(degree, 0) AS degree, (SELECT min(tag) FROM note_tags t WHERE t.id = n.id) AS primary_tag FROM notes n LEFT JOIN d USING (id) ORDER BY degree DESC, n.id LIMIT 500")
def full_graph_topn(spark, sf):
    return G.full_graph(*_vertices(spark, sf), limit=500)


@query(f"{with_views('links')} SELECT src, dst, link_type FROM links WHERE valid_from <= TIMESTAMP '2024-01-12 00:00:00' AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-01-12 00:00:00')")
def asof_edges(spark, sf):
    return G.as_of(D.links(spark, sf), F.expr("timestamp '2024-01-12 00:00:00'")).select("src", "dst", "link_type")


@query(f"{with_views('links')} SELECT src, dst, link_type FROM links WHERE valid_until IS NULL OR valid_until > TIMESTAMP '2024-01-20 00:00:00'")
def valid_edges(spark, sf):
    return D.links(spark, sf).filter(G.currently_valid(F.expr("timestamp '2024-01-20 00:00:00'"))).select("src", "dst", "link_type")


@query(f"""{with_views('notes', 'links')}, k AS (SELECT src, dst, link_type FROM links WHERE valid_until IS NULL OR valid_until > TIMESTAMP '2024-01-20 00:00:00'), e AS (SELECT src AS a, dst AS b, link_type, 'outgoing' AS direction, src FROM k UNION ALL SELECT dst, src, link_type, 'incoming', src FROM k),
one AS (SELECT item_id AS seed, e.* FROM benchmark JOIN e ON a = item_id WHERE b <> item_id QUALIFY row_number() OVER (PARTITION BY item_id, b ORDER BY a, direction DESC, link_type) = 1),
two AS (SELECT o.seed, e.* FROM one o JOIN e ON e.a = o.b WHERE e.b <> o.seed AND NOT EXISTS (SELECT 1 FROM one x WHERE x.seed = o.seed AND x.b = e.b) QUALIFY row_number() OVER (PARTITION BY o.seed, e.b ORDER BY e.a, e.direction DESC, e.link_type) = 1),
f AS (SELECT *, 1 AS hop FROM one UNION ALL SELECT *, 2 FROM two)
SELECT seed, b AS id, hop, link_type, direction, CASE WHEN link_type = 'causal' AND src % 2 = 0 THEN 'follow_guidance' WHEN link_type = 'causal' THEN 'check_condition' WHEN (length(content) % 100) / 100.0 > 0.7 THEN 'review_central_nodes' END AS action FROM f LEFT JOIN notes ON id = b""")
def guidance(spark, sf):
    n = D.notes(spark, sf)
    scores = n.select("id", (F.length("content") % 100 / 100).alias("consolidation_score"))
    k = D.links(spark, sf).withColumn("attributes", F.when(F.col("link_type") == "causal", F.to_json(F.struct(F.when(F.col("src") % 2 == 0, F.lit("go on")).alias("guidance"), F.when(F.col("src") % 2 == 1, F.lit("if so")).alias("condition")))))
    return G.guidance(k, _seeds(spark, sf), scores, F.expr("timestamp '2024-01-20 00:00:00'"))


@query(f"{with_views('notes', 'links')} SELECT 1 AS part, id AS a, CAST(NULL AS BIGINT) AS b, '  \"' || id || '\" [label=\"' || title || '\"];' AS line FROM notes UNION ALL SELECT 2, src, dst, '  \"' || src || '\" -> \"' || dst || '\" [label=\"' || link_type || '\"];' FROM links")
def graph_dot(spark, sf):
    n, k, _ = _vertices(spark, sf)
    return G.to_dot(n, k)

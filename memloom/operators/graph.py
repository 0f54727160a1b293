"""Graph operators over edges (src, dst, link_type, valid_from, valid_until); loops run over frontiers, not over nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def currently_valid(at: Column) -> Column:
    return F.col("valid_until").isNull() | (F.col("valid_until") > at)


def as_of(links: DataFrame, at: Column) -> DataFrame:
    """Edges that held at a point in time: begun, and not yet ended."""
    return links.filter((F.col("valid_from") <= at) & currently_valid(at))


def of_types(links: DataFrame, types: str | None) -> DataFrame:
    """Edges of a comma-separated list of types (any case, spaces around); all for none."""
    wanted = [t.strip().lower() for t in (types or "").split(",") if t.strip()]
    return links.filter(F.lower("link_type").isin(wanted)) if wanted else links


def undirected(links: DataFrame) -> DataFrame:
    a = links.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return a.unionAll(a.select(F.col("b").alias("a"), F.col("a").alias("b")))


def bfs(links: DataFrame, seeds: DataFrame, depth: int, directed: bool = False) -> DataFrame:
    """(seed, id, depth): nodes within ``depth`` steps of each seed (a column id), without the seed itself, at their least depth."""
    edges = links.select(F.col("src").alias("a"), F.col("dst").alias("b")) if directed else undirected(links)
    edges = edges.distinct()
    front = seeds.select(F.col("id").alias("seed"), "id").distinct()
    seen = front.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        step = front.join(edges, F.col("id") == F.col("a")).select("seed", F.col("b").alias("id")).distinct()
        front = step.join(seen, ["seed", "id"], "left_anti")
        if depth > 2:
            front = materialize(front)
            if front.isEmpty():
                break
        seen = seen.unionByName(front.withColumn("depth", F.lit(d)))
    return seen.filter("depth > 0")


def neighbors(links: DataFrame, seeds: DataFrame, depth: int, limit: int) -> DataFrame:
    """Nodes around a set of seeds over open edges: the first ``limit`` by depth and id."""
    seeds = seeds.select("id").distinct()
    open_ = links.filter("valid_until is null")
    found = bfs(open_, seeds, depth).groupBy("id").agg(F.min("depth").alias("depth")).join(seeds, "id", "left_anti")
    return found.orderBy("depth", "id").limit(limit)


def shortest_paths(links: DataFrame, pairs: DataFrame, max_depth: int | None = None, types: str | None = None) -> DataFrame:
    """(source, target, path) for pairs, along edge directions: the least path by order of ids among the shortest.

    A pair of equal ids has the path of itself; a pair without a path has an empty one
    (with ``max_depth``, also one whose path is longer). The search goes on from both
    ends, each round from the end with fewer nodes to go on from, until every pair has
    met or has an end that reaches nothing new. Each round keeps one path for each end and node.
    """
    edges = materialize(of_types(links, types).select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    pairs = materialize(pairs.select("source", "target").distinct())
    ends = ("source", "target")
    front = [materialize(pairs.select(e, F.col(e).alias("id"), F.array(e).alias("path")).distinct()) for e in ends]
    seen = [f.select(e, "id") for e, f in zip(ends, front)]
    left, found, depth = pairs, None, 0
    while True:
        # The ends are as far from each other as both have gone: a node that both reached last is on a shortest path.
        met = left.join(front[0], "source").join(front[1].withColumnRenamed("path", "rest"), ["target", "id"])
        whole = F.concat("path", F.slice("rest", 2, F.size("rest")))
        met = materialize(met.groupBy("source", "target").agg(F.min(whole).alias("path")))
        found = met if found is None else found.unionByName(met)
        if depth == max_depth:
            break
        left = left.join(met, ["source", "target"], "left_anti")
        for e, f in zip(ends, front):
            left = left.join(f.select(e).distinct(), e, "left_semi")
        left = materialize(left.select("source", "target"))
        if left.isEmpty():
            break
        i = int(front[1].count() < front[0].count())
        e, here, there = ends[i], *(("a", "b") if i == 0 else ("b", "a"))
        path = F.array_append("path", F.col(there)) if i == 0 else F.array_prepend("path", F.col(there))
        step = front[i].join(left.select(e).distinct(), e, "left_semi").join(edges, F.col("id") == F.col(here)).select(e, F.col(there).alias("id"), path.alias("path"))
        front[i] = materialize(step.join(seen[i], [e, "id"], "left_anti").groupBy(e, "id").agg(F.min("path").alias("path")))
        seen[i] = seen[i].unionByName(front[i].select(e, "id"))
        depth += 1
    out = pairs.join(found, list(ends), "left")
    return out.select("source", "target", F.coalesce("path", F.array().cast("array<bigint>")).alias("path"))


def degrees(links: DataFrame) -> DataFrame:
    """(id, degree): a self-loop counts twice."""
    return undirected(links).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def in_out(links: DataFrame) -> DataFrame:
    """(id, in_links, out_links) of the nodes with any."""
    both = links.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(links.select("src", F.lit(0), F.lit(1)))
    return both.groupBy("id").agg(F.sum("i").alias("in_links"), F.sum("o").alias("out_links"))


def orphans(notes: DataFrame, links: DataFrame) -> DataFrame:
    return notes.select("id").join(undirected(links).select(F.col("a").alias("id")), "id", "left_anti")


def vertices(notes: DataFrame, links: DataFrame, tags: DataFrame) -> DataFrame:
    """Nodes of the graph: link endpoints only; (id, title, tag_count, link_count). Unknown ends have their id as title."""
    t = tags.groupBy("id").agg(F.countDistinct("tag").alias("tag_count"))
    d = degrees(links).withColumnRenamed("degree", "link_count")
    out = d.join(notes.select("id", "title"), "id", "left").join(t, "id", "left")
    return out.select("id", F.coalesce("title", F.col("id").cast("string")).alias("title"), F.coalesce("tag_count", F.lit(0)).alias("tag_count"), "link_count")


def induced(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are among the nodes."""
    ids = nodes.select("id").distinct()
    return links.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def stats(notes: DataFrame, links: DataFrame, tags: DataFrame) -> DataFrame:
    """total_notes, total_links, total_tags, orphan_notes, most_linked (highest in-degree, least id)."""
    most = links.groupBy("dst").count().orderBy(F.desc("count"), "dst").limit(1).select(F.col("dst").alias("most_linked"))
    parts = [
        notes.agg(F.count(F.lit(1)).alias("v")).select(F.lit("total_notes").alias("k"), "v"),
        links.agg(F.count(F.lit(1)).alias("v")).select(F.lit("total_links"), "v"),
        tags.agg(F.countDistinct("tag").alias("v")).select(F.lit("total_tags"), "v"),
        orphans(notes, links).agg(F.count(F.lit(1)).alias("v")).select(F.lit("orphan_notes"), "v"),
        most.select(F.lit("most_linked"), F.col("most_linked").cast("long")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    names = ["total_notes", "total_links", "total_tags", "orphan_notes", "most_linked"]
    return out.groupBy().pivot("k", names).agg(F.first("v")).select(*names)


def full_graph(notes: DataFrame, links: DataFrame, tags: DataFrame, limit: int = 500, title_part: str | None = None) -> DataFrame:
    """(id, title, degree, primary_tag): the nodes with the highest degree; the primary tag is the least by name."""
    d = notes.select("id", "title").join(degrees(links), "id", "left")
    if title_part:
        d = d.filter(F.contains(F.lower("title"), F.lit(title_part.lower())))
    first = tags.groupBy("id").agg(F.min("tag").alias("primary_tag"))
    picked = d.withColumn("degree", F.coalesce("degree", F.lit(0))).orderBy(F.desc("degree"), "id").limit(limit)
    return picked.join(first, "id", "left").select("id", "title", "degree", "primary_tag")


def guidance(links: DataFrame, seeds: DataFrame, scores: DataFrame, now: Column, hops: int = 2) -> DataFrame:
    """(seed, id, hop, link_type, direction, action): nodes around each seed over valid edges, each by its first edge.

    ``links`` may have attributes (JSON text): its guidance, condition or pitfall decides
    the action; otherwise nodes with a consolidation score over .7 are to be reviewed.
    """
    valid = links.filter(currently_valid(now))
    attr = F.col("attributes") if "attributes" in links.columns else F.lit(None).cast("string")
    out = valid.select(F.col("src").alias("a"), F.col("dst").alias("b"), "link_type", F.lit("outgoing").alias("direction"), attr.alias("attributes"))
    edges = out.unionAll(out.select(F.col("b").alias("a"), F.col("a").alias("b"), "link_type", F.lit("incoming"), "attributes"))
    front = seeds.select(F.col("id").alias("seed"), "id").distinct()
    seen = front.select("seed", "id", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("link_type"), F.lit(None).cast("string").alias("direction"), F.lit(None).cast("string").alias("attributes"))
    for h in range(1, hops + 1):
        step = front.join(edges, F.col("id") == F.col("a")).select("seed", F.col("b").alias("id"), "a", "link_type", "direction", "attributes")
        step = step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti")
        w = Window.partitionBy("seed", "id").orderBy("a", F.desc("direction"), "link_type")
        new = materialize(step.withColumn("n", F.row_number().over(w)).filter("n = 1").select("seed", "id", F.lit(h).alias("hop"), "link_type", "direction", "attributes"))
        seen = seen.unionByName(new)
        front = new.select("seed", "id")
    g = lambda k: F.get_json_object("attributes", f"$.{k}").isNotNull()
    action = F.when(g("guidance"), "follow_guidance").when(g("condition"), "check_condition").when(g("pitfalls"), "avoid_pitfall").when(F.col("consolidation_score") > 0.7, "review_central_nodes")
    return seen.filter("hop > 0").join(scores.select("id", "consolidation_score"), "id", "left").select("seed", "id", "hop", "link_type", "direction", action.alias("action"))


def to_dot(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Lines of a DOT graph, one row each, in order of (part, a, b)."""
    n = nodes.select(F.lit(1).alias("part"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.format_string('  "%s" [label="%s"];', F.col("id").cast("string"), F.replace(F.col("title"), F.lit('"'), F.lit('\\"'))).alias("line"))
    e = links.select(F.lit(2), "src", "dst", F.format_string('  "%s" -> "%s" [label="%s"];', F.col("src").cast("string"), F.col("dst").cast("string"), F.col("link_type")))
    return n.unionAll(e)


def to_json_lines(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """A JSON object for each node and edge, one row each, in order of (part, a, b)."""
    n = nodes.select(F.lit(1).alias("part"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.to_json(F.struct("id", "title")).alias("line"))
    e = links.select(F.lit(2), "src", "dst", F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "link_type")))
    return n.unionAll(e)


def to_text(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """A line for each edge with the titles of both ends, empty where there is no such node, in order of (a, b)."""
    title = lambda c, name: nodes.select(F.col("id").alias(c), F.col("title").alias(name))
    e = links.join(title("src", "s"), "src", "left").join(title("dst", "t"), "dst", "left")
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.format_string("  %s ──[%s]──> %s", F.coalesce("s", F.lit("")), F.col("link_type"), F.coalesce("t", F.lit(""))).alias("line"))

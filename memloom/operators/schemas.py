"""Schemas over clusters of notes: proposals and what became of them, lineage, and the other logs of consolidation.

The log of consolidation events has id, note_id, event_type, proposal_id, score_after,
reason and created_at. Proposals have no state of their own: what is pending follows
from the log, so that a repeated job adds rows and changes none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLAGGED, PROMOTED, REJECTED = "flagged_for_review", "promoted_to_schema", "schema_proposal_rejected"
EVENTS = ["note_id", "event_type", "proposal_id", "score_after", "reason", "created_at"]


def recent_events(events: DataFrame, limit: int = 200) -> DataFrame:
    """The newest events of the whole log; ties by the higher id."""
    return events.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def episodes(vectors: DataFrame, notes: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """The vectors of notes that may be sources of a schema: no schemas, none that has a parent, and if given only ``allowed`` (id)."""
    free = notes.filter("coalesce(node_type, '') <> 'schema' and parent_schema_id is null").select("id")
    out = vectors.join(free, "id", "left_semi")
    return out if allowed is None else out.join(allowed.select("id"), "id", "left_semi")


def propose(members: DataFrame, texts: DataFrame, similarity: DataFrame, nearest: DataFrame) -> DataFrame:
    """(proposal_id, title, content, sources, mean_similarity, action, schema_id) for each cluster of ``members`` (id, cluster).

    ``texts``: cluster, title, content; ``similarity``: cluster, mean_similarity; ``nearest``: cluster, schema_id,
    decision (patch or create). A proposal is named by its cluster; without a schema to patch it creates one.
    """
    sources = members.groupBy("cluster").agg(F.array_sort(F.collect_list("id")).alias("sources"))
    p = sources.join(texts, "cluster").join(similarity, "cluster").join(nearest.select("cluster", "schema_id", "decision"), "cluster", "left")
    patch = F.coalesce(F.col("decision") == "patch", F.lit(False))
    return p.select(F.col("cluster").alias("proposal_id"), "title", "content", "sources", "mean_similarity", F.when(patch, "patch").otherwise("create").alias("action"), F.when(patch, F.col("schema_id")).alias("schema_id"))


def flag(proposals: DataFrame, at: Column) -> DataFrame:
    """The events that put proposals up for review, at their first source."""
    return proposals.select(F.col("sources")[0].alias("note_id"), F.lit(FLAGGED).alias("event_type"), "proposal_id", F.col("mean_similarity").alias("score_after"), F.lit("proposed").alias("reason"), at.alias("created_at"))


def reject(proposals: DataFrame, by: str, reason: str, at: Column) -> DataFrame:
    """The events of proposals that a reviewer turns down; no note changes."""
    why = F.concat(F.lit("proposal_id="), F.col("proposal_id"), F.lit(f" gating=human_rejected by={by} reason={reason}"))
    return proposals.select(F.col("sources")[0].alias("note_id"), F.lit(REJECTED).alias("event_type"), "proposal_id", F.col("mean_similarity").alias("score_after"), why.alias("reason"), at.alias("created_at"))


def commit(proposals: DataFrame, known: DataFrame, new_id: Column, gating: str, at: Column) -> dict[str, DataFrame]:
    """What commits proposals: rows of schemas, schema_sources, parents, links and events; no note is deleted.

    A patch of a schema that is in ``known`` (id) keeps its id; any other proposal makes a schema with ``new_id``.
    """
    there = known.select(F.col("id").alias("schema_id"), F.lit(True).alias("there")).distinct()
    p = proposals.join(there, "schema_id", "left").withColumn("schema_id", F.when(F.col("there") & (F.col("action") == "patch"), F.col("schema_id")).otherwise(new_id))
    each = p.select("proposal_id", "schema_id", "mean_similarity", F.explode("sources").alias("note_id"))
    why = F.concat(F.lit("proposal_id="), F.col("proposal_id"), F.lit(" schema_id="), F.col("schema_id"), F.lit(f" gating={gating}"))

    def event(rows: DataFrame, note: str) -> DataFrame:
        return rows.select(F.col(note).alias("note_id"), F.lit(PROMOTED).alias("event_type"), "proposal_id", F.col("mean_similarity").alias("score_after"), why.alias("reason"), at.alias("created_at"))

    return {
        "schemas": p.select(F.col("schema_id").alias("id"), "title", "content", F.lit("schema").alias("node_type"), at.alias("updated_at")),
        "schema_sources": each.select("schema_id", F.col("note_id").alias("source_note_id"), F.col("mean_similarity").alias("similarity_score"), at.alias("consolidated_at")),
        "parents": each.select(F.col("note_id").alias("id"), F.col("schema_id").alias("parent_schema_id")),
        "links": each.select(F.col("schema_id").alias("src"), F.col("note_id").alias("dst"), F.lit("wikilink").alias("link_type")),
        "events": event(each, "note_id").unionByName(event(p, "schema_id")),
    }


def pending(proposals: DataFrame, events: DataFrame) -> DataFrame:
    """Proposals that the log has flagged and neither promoted nor rejected."""
    of = lambda *kinds: events.filter(F.col("event_type").isin(*kinds)).select("proposal_id").distinct()
    return proposals.join(of(FLAGGED), "proposal_id", "left_semi").join(of(PROMOTED, REJECTED), "proposal_id", "left_anti")


def resolve_pending(open_: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, proposal_id) for each of ``wanted`` (wanted): the pending proposal of that id, else the least one with that source; null if none."""
    by_id = open_.select(F.col("proposal_id").alias("wanted"), F.col("proposal_id").alias("own"))
    by_source = open_.select(F.explode("sources").alias("wanted"), "proposal_id").groupBy("wanted").agg(F.min("proposal_id").alias("other"))
    return wanted.distinct().join(by_id, "wanted", "left").join(by_source, "wanted", "left").select("wanted", F.coalesce("own", "other").alias("proposal_id"))


def lineage(schema_sources: DataFrame, notes: DataFrame, events: DataFrame) -> DataFrame:
    """(schema_id, position, note_id, title, similarity, rationale): each schema's sources, most similar first, with the reason of their latest promotion."""
    s = schema_sources.join(notes.select(F.col("id").alias("source_note_id"), "title"), "source_note_id")
    last = events.filter(F.col("event_type") == PROMOTED).join(schema_sources.select("schema_id", F.col("source_note_id").alias("note_id")), "note_id")
    last = last.groupBy("schema_id").agg(F.max_by("reason", F.struct("created_at", "note_id")).alias("rationale"))
    w = Window.partitionBy("schema_id").orderBy(F.desc("similarity_score"), "source_note_id")
    return s.withColumn("position", F.row_number().over(w)).join(last, "schema_id", "left").select("schema_id", "position", F.col("source_note_id").alias("note_id"), "title", F.col("similarity_score").alias("similarity"), "rationale")


def record_contradictions(found: DataFrame, known: DataFrame, at: Column) -> DataFrame:
    """New rows (a, b, combined, status, detected_at) of pairs (a, b, combined) that the log does not have in either order."""
    pair = lambda d: d.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    new = found.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")}).join(pair(known), ["x", "y"], "left_anti").dropDuplicates(["x", "y"])
    return new.select("a", "b", "combined", F.lit("open").alias("status"), at.alias("detected_at"))


def resolve_contradictions(log: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The log with resolutions (a, b, resolution, at): of several the last by time and text counts."""
    last = resolutions.groupBy("a", "b").agg(F.max_by("resolution", F.struct("at", "resolution")).alias("resolution"), F.max("at").alias("resolved_at"))
    return log.join(last, ["a", "b"], "left").withColumn("status", F.when(F.col("resolved_at").isNotNull(), "resolved").otherwise(F.col("status")))


def open_contradictions(log: DataFrame, limit: int = 50) -> DataFrame:
    """The open ones with the highest combined score; ties by ids."""
    return log.filter("status = 'open'").orderBy(F.desc("combined"), "a", "b").limit(limit)


def record_rejections(notes: DataFrame, at: Column, days: int = 90) -> DataFrame:
    """(id, score_at_rejection, reason, rejected_at, suppress_until) of notes (id, score, reason): they are not flagged again for ``days``."""
    return notes.select("id", F.col("score").alias("score_at_rejection"), "reason", at.alias("rejected_at"), (at + F.make_dt_interval(F.lit(days))).alias("suppress_until"))


def explain_scores(notes: DataFrame, links: DataFrame, diversity: DataFrame, salience: DataFrame) -> DataFrame:
    """(id, salience, degree, diversity and what each adds, raw, score): only links that have not ended count."""
    ends = links.filter("valid_until is null").select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    out = notes.select("id").join(salience.select("id", "salience"), "id", "left").join(ends, "id", "left").join(diversity.select(F.col("note_id").alias("id"), "diversity"), "id", "left").na.fill(0)
    out = out.withColumns({"by_salience": F.round(0.45 * F.col("salience"), 6), "by_degree": F.round(0.25 * F.log1p("degree"), 6), "by_diversity": F.round(0.30 * F.least(F.greatest("diversity", F.lit(0.0)), F.lit(1.0)), 6)})
    raw = 0.45 * F.col("salience") + 0.25 * F.log1p("degree") + 0.30 * F.least(F.greatest("diversity", F.lit(0.0)), F.lit(1.0))
    return out.withColumn("score", F.round(1 / (1 + F.exp(-raw)), 6))


def digest_summary(notes: DataFrame, links: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """One row: notes created and modified, links begun and words of previews in the last hours before ``now``."""
    since = now - F.make_dt_interval(F.lit(0), F.lit(hours))
    recent = lambda c: (F.col(c) > since) & (F.col(c) <= now)
    words = F.size(F.array_remove(F.split("preview", r"\s+"), ""))
    n = notes.agg(F.count_if(recent("created_at")).alias("notes_created"), F.count_if(recent("updated_at")).alias("notes_modified"), F.coalesce(F.sum(F.when(recent("updated_at"), words)), F.lit(0)).alias("words"))
    # two tables of one row each
    return n.withColumn("new_links", links.agg(F.count_if(recent("valid_from"))).scalar())

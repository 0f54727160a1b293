"""Note listings, lookups and the change log they are projected from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .graph import in_out

SORTS = {
    "updated_desc": ("updated_at", False),
    "updated_asc": ("updated_at", True),
    "created_desc": ("created_at", False),
    "created_asc": ("created_at", True),
    "title_asc": ("title", True),
}


def details(notes: DataFrame, tags: DataFrame, links: DataFrame) -> DataFrame:
    """Notes with their sorted tags and in- and out-link counts."""
    t = tags.groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    out = notes.join(t, "id", "left").join(in_out(links), "id", "left")
    return out.withColumns({"tags": F.coalesce("tags", F.array().cast("array<string>")), "in_links": F.coalesce("in_links", F.lit(0)), "out_links": F.coalesce("out_links", F.lit(0))})


def listing(notes: DataFrame, tags: DataFrame, sort: str = "updated_desc", limit: int = 20, offset: int = 0, tag: str | None = None) -> DataFrame:
    """Summaries (id, title, preview, tag_count) in a sort order with ties by id, one page of them."""
    col, up = SORTS[sort]
    if tag is not None:
        notes = notes.join(tags.filter(F.col("tag") == tag).select("id").distinct(), "id", "left_semi")
    page = notes.orderBy(F.col(col).asc() if up else F.col(col).desc(), "id").offset(offset).limit(limit)
    # only the tags of the page are counted
    n = tags.join(page.select("id"), "id", "left_semi").groupBy("id").agg(F.countDistinct("tag").alias("tag_count"))
    return page.join(n, "id", "left").select("id", "title", X.preview(F.col("content")).alias("preview"), F.coalesce("tag_count", F.lit(0)).alias("tag_count"))


def by_title(notes: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, id): each reference's note by exact title, the first created of several."""
    w = Window.partitionBy("title").orderBy("created_at", "id")
    first = notes.withColumn("n", F.row_number().over(w)).filter("n = 1").select(F.col("title").alias("ref"), "id")
    return refs.join(first, "ref", "left")


def resolve(notes: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, id): each reference as an id if there is such a note, else as a title, else null."""
    ids = notes.select(F.col("id").cast("string").alias("ref"), F.col("id").alias("as_id"))
    both = by_title(notes, refs.select("ref").distinct()).join(ids, "ref", "left")
    return both.select("ref", F.coalesce("as_id", "id").alias("id"))


def by_ids(notes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Notes for (request, ids), in the order of the ids; missing ones are left out."""
    w = wanted.select("request", F.posexplode("ids").alias("pos", "id"))
    return w.join(notes, "id").select("request", "pos", "id", "title")


def missing_embeddings(notes: DataFrame, vectors: DataFrame) -> DataFrame:
    return notes.join(vectors.select("id").distinct(), "id", "left_anti").select("id", "title")


def project_log(log: DataFrame) -> DataFrame:
    """Notes as they stand after a change log (seq, op, id, title, content, at).

    create and update set the fields that are not null, the last word for each field
    counts; a delete ends a note until it is created again.
    """
    ended = log.filter("op = 'delete'").groupBy("id").agg(F.max("seq").alias("ended"))
    alive = log.join(ended, "id", "left").filter("op <> 'delete' and (ended is null or seq > ended)")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    out = alive.groupBy("id").agg(last("title"), last("content"), F.min_by("at", "seq").alias("created_at"), F.max_by("at", "seq").alias("updated_at"), F.max((F.col("op") == "create").cast("int")).alias("made"))
    return out.filter("made = 1").drop("made")


def new_links(links: DataFrame, more: DataFrame) -> DataFrame:
    """Links to add: the first of each (src, dst, link_type) that is not there yet."""
    key = ["src", "dst", "link_type"]
    w = Window.partitionBy(*key).orderBy("valid_from")
    return more.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n").join(links, key, "left_anti")


def cascade_delete(links: DataFrame, tags: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and tags that remain when notes (id) are deleted."""
    g = gone.select("id").distinct()
    return links.join(g.withColumnRenamed("id", "src"), "src", "left_anti").join(g.withColumnRenamed("id", "dst"), "dst", "left_anti"), tags.join(g, "id", "left_anti")

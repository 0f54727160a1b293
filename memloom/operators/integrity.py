"""Provenance, contradictions, hash chains and the verification report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .graph import orphans
from .pairs import jaccard_pairs


def attach_claims(claims: DataFrame) -> DataFrame:
    """Claims (id, claim, source_text, ...) with score, method and passed; those that do not pass are to be rejected."""
    v = X.verify_overlap(F.coalesce("claim", F.lit("")), F.coalesce("source_text", F.lit("")))
    # a generator row, not a column: its fields would each compute the whole comparison again
    out = claims.select(*claims.columns, F.inline(F.array(v)))
    return out.select(*claims.columns, F.round("score", 6).alias("score"), "method", "passed")


def claim_spans(claims: DataFrame, notes: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims (id, note_id, claim_start, claim_end, source_id, source_span_start, source_span_end) by byte offsets, checked: with score, method, status.

    ``notes``: id, content; ``sources``: id, excerpt. The claim is the note's bytes from start to end and is held against the source's
    span, or its whole excerpt where the span is missing or out of bounds; offsets within a character move to its nearest end
    inside. status is accepted, or why a claim is refused: note, source (not there), bounds, or overlap (score under the
    least). Claims of one note keep their own rows; a null note or source is not there.
    """
    c = claims.join(notes.select(F.col("id").alias("note_id"), F.coalesce("content", F.lit("")).alias("_note"), F.lit(True).alias("_has_note")), "note_id", "left")
    c = c.join(sources.select(F.col("id").alias("source_id"), F.coalesce("excerpt", F.lit("")).alias("_source"), F.lit(True).alias("_has_source")), "source_id", "left")
    start, end, s, e = (F.col(k) for k in ("claim_start", "claim_end", "source_span_start", "source_span_end"))
    inside = F.coalesce((start >= 0) & (start < end) & (end <= F.octet_length("_note")), F.lit(False))
    part = F.coalesce((s >= 0) & (e > s) & (e <= F.octet_length("_source")), F.lit(False))
    text = F.when(inside, X.slice_bytes(F.col("_note"), start, end)).otherwise("")
    source = F.when(part, X.slice_bytes(F.col("_source"), s, e)).otherwise(F.col("_source"))
    keep = ["id", "note_id", "claim_start", "claim_end", "source_id", "source_span_start", "source_span_end"]
    got = attach_claims(c.select(*keep, text.alias("claim"), source.alias("source_text"), "_has_note", "_has_source", inside.alias("_inside")))
    status = F.when(F.col("_has_note").isNull(), "note").when(F.col("_has_source").isNull(), "source").when(~F.col("_inside"), "bounds").when(~F.col("passed"), "overlap").otherwise("accepted")
    return got.select(*keep, "claim", "score", "method", status.alias("status"))


def spans_of_notes(spans: DataFrame, sources: DataFrame) -> DataFrame:
    """The accepted spans of each note in the order of their start (then id), numbered from 1, with uri and title of their sources (id, uri, title)."""
    w = Window.partitionBy("note_id").orderBy("claim_start", "id")
    out = spans.filter("status = 'accepted'").drop("status", "claim").withColumn("position", F.row_number().over(w))
    return out.join(sources.select(F.col("id").alias("source_id"), "uri", F.col("title").alias("source_title")), "source_id")


def new_sources(sources: DataFrame) -> DataFrame:
    """(uri, content_hash) once each, the first by id: what an upsert of sources keeps."""
    w = Window.partitionBy("uri", "content_hash").orderBy("id")
    return sources.withColumn("content_hash", F.sha2("content", 256)).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def authority(spans: DataFrame) -> DataFrame:
    """(note_id, authority, sources): mean verification score and sorted source ids of each note's claims."""
    return spans.groupBy("note_id").agg(F.avg("score").alias("authority"), F.array_sort(F.collect_set("source_id")).alias("sources"))


def contradictions(notes: DataFrame, spans: DataFrame, least_overlap: float = 0.35, least_score: float = 0.60, tau_days: float = 14.0) -> DataFrame:
    """(a, b, semantic, recency, authority, combined): similar notes that differ in polarity or in the sources they cite."""
    t = notes.select("id", X.tokens(F.col("content")).alias("tokens"))
    p = jaccard_pairs(t, least_overlap)
    side = notes.select("id", "created_at", X.negated(F.col("content")).alias("neg")).join(authority(spans).withColumnRenamed("note_id", "id"), "id", "left")
    for k in "ab":
        p = p.join(side.select(F.col("id").alias(k), F.col("created_at").alias(f"at_{k}"), F.col("neg").alias(f"neg_{k}"), F.col("authority").alias(f"auth_{k}"), F.col("sources").alias(f"src_{k}")), k)
    differ = (F.col("neg_a") != F.col("neg_b")) | F.coalesce(F.col("src_a") != F.col("src_b"), F.lit(False))
    auth = F.expr("case when auth_a is not null and auth_b is not null then (auth_a + auth_b) / 2 else coalesce(auth_a, auth_b, 0D) * 0.5 end")
    rec = X.recency(F.col("at_a"), F.col("at_b"), tau_days)
    out = p.filter(differ).select("a", "b", F.round("jaccard", 6).alias("semantic"), F.round(rec, 6).alias("recency"), F.round(auth, 6).alias("authority"), F.round(0.5 * F.col("jaccard") + 0.2 * rec + 0.3 * auth, 6).alias("combined"))
    return out.filter(F.col("combined") >= least_score)


def event_hash(prev: Column) -> Column:
    return F.sha2(F.concat(F.col("id").cast("string"), F.col("event_type"), F.coalesce("payload", F.lit("")), F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS"), prev), 256)


def chain(events: DataFrame, key: str = "stream", heads: DataFrame | None = None) -> DataFrame:
    """Events (id, stream, event_type, payload, event_time) with prev_hash and event_hash, one chain for each stream.

    ``heads`` (stream, event_hash) are the last hashes of chains that are stored already; their streams go on from there.

    A chain is sequential, so each stream is folded in one task in Arrow batches, its hash
    carried on from row to row; streams are what spreads the work.
    """
    import hashlib

    import pyarrow as pa

    def run(batches):
        last: dict = {}
        for b in batches:
            prev, own = [], []
            for s, body, head in zip(b.column(at).to_pylist(), b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if s not in last:
                    last = {s: head}
                prev.append(last[s])
                last[s] = hashlib.sha256((body + last[s]).encode()).hexdigest()
                own.append(last[s])
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(prev, pa.string()), pa.array(own, pa.string())], names=[*b.schema.names[:-2], "prev_hash", "event_hash"])

    at = events.columns.index(key)
    body = F.concat(F.col("id").cast("string"), F.col("event_type"), F.coalesce("payload", F.lit("")), F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    rows = events.withColumn("_body", body)
    if heads is None:
        rows = rows.withColumn("_head", F.lit(""))
    else:
        known = heads.select(key, F.col("event_hash").alias("_head"))
        rows = rows.join(known, key, "left").select(*events.columns, "_body", F.coalesce("_head", F.lit("")).alias("_head"))
    rows = rows.repartition(key).sortWithinPartitions(key, "event_time", "id")
    schema = ", ".join(f"{n} {t}" for n, t in events.dtypes) + ", prev_hash string, event_hash string"
    return rows.mapInArrow(run, schema)


def check_chain(events: DataFrame, key: str = "stream") -> DataFrame:
    """(stream, events, broken_links, wrong_hashes): links compared with the row before, and hashes made again from the row itself."""
    w = Window.partitionBy(key).orderBy("event_time", "id")
    before = F.coalesce(F.lag("event_hash").over(w), F.lit(""))
    e = events.withColumn("_broken", (F.col("prev_hash") != before).cast("int")).withColumn("_wrong", (F.col("event_hash") != event_hash(F.col("prev_hash"))).cast("int"))
    return e.groupBy(key).agg(F.count(F.lit(1)).alias("events"), F.sum("_broken").alias("broken_links"), F.sum("_wrong").alias("wrong_hashes"))


def check_long_chain(events: DataFrame, parts: int | None = None) -> DataFrame:
    """(events, broken_links, wrong_hashes, head) of one chain of events, checked in many tasks.

    Events (id, event_type, payload, event_time, prev_hash, event_hash) are dealt by ranges of (event_time, id). Each
    task makes the hashes of its rows again and compares its links; the first and last row of each range are
    compared with those of its neighbours, one small row a range. head is the last hash, from which ``chain`` goes on.
    """
    import pyarrow as pa

    rows = events.select(F.unix_micros("event_time").alias("t"), "id", "prev_hash", "event_hash", (F.col("event_hash") != event_hash(F.col("prev_hash"))).alias("wrong"))
    order = ("t", "id")
    dealt = (rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)).sortWithinPartitions(*order)

    def run(batches):
        n = broken = wrong = 0
        first = last = None
        for b in batches:
            if not len(b):
                continue
            prev, own = b.column(2).to_pylist(), b.column(3).to_pylist()
            if first is None:
                first = (b.column(0)[0].as_py(), b.column(1)[0].as_py(), prev[0])
            else:
                broken += prev[0] != last
            broken += sum(p != o for p, o in zip(prev[1:], own, strict=False))
            wrong += sum(w is not False for w in b.column(4).to_pylist())
            n, last = n + len(b), own[-1]
        if n:
            cols = [[x] for x in (*first, last, n, broken, wrong)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["t", "id", "prev", "last", "n", "broken", "wrong"])

    ranges = dealt.mapInArrow(run, "t long, id long, prev string, last string, n long, broken long, wrong long")
    # a row for each range from here on
    before = F.coalesce(F.lag("last").over(Window.orderBy(*order)), F.lit(""))
    met = ranges.withColumn("seam", (~F.col("prev").eqNullSafe(before)).cast("long"))
    total = met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.coalesce(F.sum(F.col("broken") + F.col("seam")), F.lit(0)).alias("broken_links"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("wrong_hashes"), F.max_by("last", F.struct("t", "id")).alias("head"))
    return total


def dangling(notes: DataFrame, links: DataFrame, claims: DataFrame) -> DataFrame:
    """(kind, id, missing): link ends and claims that refer to notes that are not there."""
    ids = notes.select(F.col("id").alias("missing"))
    s = links.select(F.lit("link_src").alias("kind"), F.col("dst").alias("id"), F.col("src").alias("missing"))
    d = links.select(F.lit("link_dst").alias("kind"), F.col("src").alias("id"), F.col("dst").alias("missing"))
    c = claims.select(F.lit("claim_source").alias("kind"), "id", F.col("source_id").alias("missing"))
    return s.unionAll(d).unionAll(c).join(ids, "missing", "left_anti").select("kind", "id", "missing").distinct()


def verify_report(notes: DataFrame, links: DataFrame, claims: DataFrame) -> DataFrame:
    """One row: notes, links, claims, grounded notes, dangling references, failed claims, orphans, ok (orphans are no fault)."""
    spans = attach_claims(claims)
    parts = {
        "notes": notes.agg(F.count(F.lit(1))),
        "links": links.agg(F.count(F.lit(1))),
        "claims": claims.agg(F.count(F.lit(1))),
        "grounded": spans.filter("passed").agg(F.countDistinct("note_id")),
        "dangling": dangling(notes, links, claims).agg(F.count(F.lit(1))),
        "failed_claims": spans.filter("not passed").agg(F.count(F.lit(1))),
        "orphans": orphans(notes, links).agg(F.count(F.lit(1))),
    }
    out = None
    for k, d in parts.items():
        row = d.toDF("v").select(F.lit(k).alias("k"), F.col("v").cast("long").alias("v"))
        out = row if out is None else out.unionAll(row)
    wide = out.groupBy().pivot("k", list(parts)).agg(F.first("v"))
    return wide.withColumn("ok", (F.col("dangling") == 0) & (F.col("failed_claims") == 0))

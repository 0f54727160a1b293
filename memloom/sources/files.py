"""Markdown folders, document ingest and synchronisation by manifests."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def import_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, content, tags) of all .md files below a folder; tags are the inline ones and those of the front matter."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    title = F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", ""))
    both = F.array_sort(F.array_union(X.tags(F.col("content")), X.yaml_list(X.front_field(F.col("content"), "tags"))))
    return raw.select("path", title.alias("title"), "content", both.alias("tags"))


def export_markdown(notes: DataFrame, path: str, front_matter: bool = True) -> None:
    """One text file for each note in a folder named by its sanitised title."""
    head = F.concat(F.lit("---\ntags: ["), F.array_join("tags", ", "), F.lit("]\n---\n\n")) if front_matter else F.lit("")
    out = notes.select(F.concat(head, F.coalesce("content", F.lit(""))).alias("value"), F.concat(X.sanitize_filename(F.col("title")), F.lit(".md")).alias("file"))
    out.repartition("file").write.mode("overwrite").option("lineSep", "\n").partitionBy("file").text(path)


def chunk_text(text: str, size: int = 1200, overlap: int = 200) -> list[str]:
    """Paragraphs packed into chunks of at most ``size`` bytes; each begins with the last ``overlap`` bytes of the one before.

    Longer paragraphs are cut at white space. Cuts never fall within a character.
    """
    if size <= overlap:
        raise ValueError("size must be over overlap")

    def floor(b: bytes, at: int) -> int:
        at = min(at, len(b))
        while 0 < at < len(b) and b[at] & 0xC0 == 0x80:
            at -= 1
        return at

    out: list[str] = []
    now = b""
    for para in (p.strip().encode() for p in text.split("\n\n")):
        if not para:
            continue
        if now and len(now) + len(para) + 2 > size:
            out.append(now.decode().strip())
            now = now[floor(now, max(0, len(now) - overlap)) :] + b"\n"
        now = now + b"\n\n" + para if now else para
        while len(now) > size:
            limit = floor(now, size)
            head = now[:limit].decode()
            spaces = [i for i, c in enumerate(head) if c.isspace()]
            cut = len(head[: spaces[-1]].encode()) if spaces else limit
            out.append(now[:cut].decode().strip())
            # without room for an overlap the cut itself moves on
            now = now[floor(now, max(0, cut - overlap)) or cut or limit :]
    if now.strip():
        out.append(now.decode().strip())
    return [c for c in out if c]


def chunk_documents(docs: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """(id, position, chunk, n_bytes) of documents (id, content)."""

    def run(batches):
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = chunk_text(t or "", size, overlap)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(c), pa.int64()), pa.array(range(len(c)), pa.int32()), pa.array(c, pa.string()), pa.array([len(x.encode()) for x in c], pa.int64())], names=["id", "position", "chunk", "n_bytes"])

    return docs.select(F.col("id").cast("long"), "content").mapInArrow(run, T.StructType([T.StructField("id", T.LongType()), T.StructField("position", T.IntegerType()), T.StructField("chunk", T.StringType()), T.StructField("n_bytes", T.LongType())]))


def ingest(docs: DataFrame, size: int = 1200, overlap: int = 200) -> tuple[DataFrame, DataFrame]:
    """Notes and chunk_of links for documents (id, title, content): a parent with a 600-byte preview, and one note for each chunk."""
    head = F.when(F.octet_length("content") <= 600, F.col("content")).otherwise(F.regexp_replace(X.truncate_bytes(F.col("content"), 600), r"\s\S*$", ""))
    parents = docs.select(F.col("id").cast("string").alias("id"), "title", head.alias("content"))
    c = chunk_documents(docs, size, overlap).join(docs.select("id", "title"), "id")
    key = F.concat(F.col("id").cast("string"), F.lit("#"), F.col("position").cast("string"))
    chunks = c.select(key.alias("id"), F.concat(F.col("title"), F.lit(" ["), (F.col("position") + 1).cast("string"), F.lit("]")).alias("title"), F.col("chunk").alias("content"))
    links = c.select(key.alias("src"), F.col("id").cast("string").alias("dst"), F.lit("chunk_of").alias("link_type"))
    return parents.unionAll(chunks), links


def content_hash(title: Column, content: Column) -> Column:
    return F.base64(F.unhex(F.sha2(F.concat_ws("|", title, content), 256)))


def manifest(notes: DataFrame) -> DataFrame:
    """(id, hash): base64 of the SHA-256 of title|content."""
    return notes.select("id", content_hash(F.col("title"), F.col("content")).alias("hash"))


def sync_actions(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(id, action) from two manifests (id, hash): push what is only here, pull what is only there, and update where hashes differ."""
    a = local.select("id", F.col("hash").alias("here"))
    b = remote.select("id", F.col("hash").alias("there"))
    action = F.when(F.col("there").isNull(), "push").when(F.col("here").isNull(), "pull").when(F.col("here") != F.col("there"), "update").otherwise("same")
    return a.join(b, "id", "full_outer").select("id", action.alias("action"))


def note_file(notes: DataFrame, device: str) -> DataFrame:
    """(file, text): the file that stands for each note (id, title, content, tags, created_at, updated_at): a header and the content."""
    at = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    text = F.concat(
        F.lit("---\nid: "), F.col("id").cast("string"), F.lit("\ntags: ["), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", "), F.lit("]\ncreated: "), F.coalesce(at("created_at"), F.lit("")),
        F.lit("\nupdated: "), F.coalesce(at("updated_at"), F.lit("")), F.lit(f"\ndevice: {device}\n---\n"), F.coalesce("content", F.lit("")),
    )
    return notes.select(F.concat(X.sanitize_filename(F.col("title")), F.lit(".md")).alias("file"), text.alias("text"))


def folder_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of the .md files directly in a folder; none if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        return spark.createDataFrame([], "file string, text string")
    raw = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return raw.select(F.url_decode(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\+", "%2B")).alias("file"), F.col("value").alias("text"))


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it; a local one without its checksum files, which others' edits would break."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return (fs.getRawFileSystem() if fs.getUri().getScheme() == "file" else fs), at


def push_folder(notes: DataFrame, path: str, device: str = "device") -> int:
    """Write the file of every note that is not there as it should be (its text and a newline); how many were written.

    Of notes with one file name the last by updated_at, then id, is written; notes without a title have none. Tasks write to a
    folder beside the target under Spark's commit protocol, so a lost task leaves nothing behind; whole files are then moved
    into place, one rename a changed file. A push that stopped halfway is simply run again. The manifest of all notes
    is written last, to ``_manifest``.
    """
    spark = notes.sparkSession
    w = Window.partitionBy(X.sanitize_filename(F.col("title"))).orderBy(F.desc("updated_at"), F.desc("id"))
    once = notes.filter("title is not null").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    there = folder_files(spark, path).select("file", F.sha2("text", 256).alias("there"))
    wanted = F.sha2(F.concat("text", F.lit("\n")), 256)
    todo = note_file(once, device).join(there, "file", "left").filter(F.col("there").isNull() | (F.col("there") != wanted))
    staging = f"{path.rstrip('/')}-staging-{uuid.uuid4().hex}"
    todo.select("file", "text").repartition("file").write.option("lineSep", "\n").partitionBy("file").text(staging)
    fs, folder = _folder(spark, path)
    _, made = _folder(spark, staging)
    fs.mkdirs(folder)
    n = 0
    for d in fs.listStatus(made):
        for part in fs.listStatus(d.getPath()) if d.isDirectory() else ():
            if part.getPath().getName().startswith("part-"):
                target = spark._jvm.org.apache.hadoop.fs.Path(folder, unquote(d.getPath().getName().removeprefix("file=")))
                fs.delete(target, False)
                fs.rename(part.getPath(), target)
                n += 1
    fs.delete(made, True)
    manifest(notes).write.mode("overwrite").json(f"{path}/_manifest")
    return n


def pull_folder(notes: DataFrame, path: str) -> DataFrame:
    """(op, id, title, content, tags): what the folder's files change in the notes (id, title, content).

    A file belongs to the note with its name as title, else as sanitised title, the last by id of several; where its body (without header and one last
    newline) differs from the content it is an update, with null tags, as they stay; a file of no note is a create with a null
    id and the body's inline tags.
    """
    files = folder_files(notes.sparkSession, path).select("file", F.regexp_replace(X.body(F.col("text")), r"\n\z", "").alias("body"))
    titled = notes.filter("title is not null").select("id", "title", "content", F.array(F.struct(F.lit(True).alias("exact"), F.col("title").alias("stem")), F.struct(F.lit(False).alias("exact"), X.sanitize_filename(F.col("title")).alias("stem"))).alias("names"))
    named = titled.select("id", "title", "content", F.inline("names")).groupBy(F.concat("stem", F.lit(".md")).alias("file"))
    mine = named.agg(F.max_by(F.struct("id", "title", "content"), F.struct("exact", "id")).alias("s"))
    both = files.join(mine, "file", "left").select("file", "body", "s.*")
    changed = both.filter(F.col("id").isNull() | (F.sha2(F.coalesce("content", F.lit("")), 256) != F.sha2("body", 256)))
    made = F.col("id").isNull()
    title = F.coalesce("title", F.regexp_replace("file", r"\.md$", ""))
    return changed.select(F.when(made, "create").otherwise("update").alias("op"), "id", title.alias("title"), F.col("body").alias("content"), F.when(made, F.array_distinct(X.tags(F.col("body")))).alias("tags"))

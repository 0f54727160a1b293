"""Stores that are kept by batches: one vector a note, and the log of accesses with its counters.

A batch is written to folders of its own. A batch that is run again, as after a failure,
replaces them, so it counts once; what is current is worked out when it is read, from
the last batch of each key or from sums over batches. Compaction makes a new generation and
names it in a small table last, so that readers see the old or the new one whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cascade


class _Batches:
    """Tables under ``path``, by generation and batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at)

    @property
    def generation(self) -> int:
        """The last generation that was named."""
        named = f"{self.path}/generations"
        return self.spark.read.schema("number int").parquet(named).agg(F.max("number")).first()[0] if self._there(named) else 0

    def _folder(self, table: str, generation: int | None = None) -> str:
        return f"{self.path}/{table}/generation={self.generation if generation is None else generation}"

    def _read(self, table: str, schema: str) -> DataFrame:
        folder = self._folder(table)
        if not self._there(folder):
            return self.spark.createDataFrame([], f"{schema}, batch long")
        return self.spark.read.schema(f"{schema}, batch long").parquet(folder)

    def _write(self, df: DataFrame, table: str, batch: int, *by: str) -> None:
        out = df.write.mode("overwrite")
        (out.partitionBy(*by) if by else out).parquet(f"{self._folder(table)}/batch={batch}")

    def _name(self, generation: int) -> None:
        self.spark.createDataFrame([(generation,)], "number int").write.mode("append").parquet(f"{self.path}/generations")


class VectorStore(_Batches):
    """One vector a note, of one width: that of the first batch."""

    SCHEMA = "note_id long, embedding array<float>, dimensions int, model string, created_at timestamp, bucket int"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        super().__init__(spark, path)
        self.buckets = buckets

    def width(self) -> int | None:
        first = self._read("vectors", self.SCHEMA).select("dimensions").limit(1).collect()
        return first[0][0] if first else None

    def put(self, rows: DataFrame, batch: int, notes: DataFrame | None = None) -> None:
        """Store (note_id, embedding, model, created_at); a note's older vector is replaced, of several rows for a note in a batch the newest counts.

        The whole batch is refused (ValueError) and nothing is written if a vector is null or not of the store's width, or a
        note is null or not among ``notes`` (id).
        """
        v = rows.select(F.col("note_id").cast("long").alias("note_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("model").cast("string").alias("model"), F.col("created_at").cast("timestamp").alias("created_at"))
        got = v.agg(F.min(F.coalesce(F.size("embedding"), F.lit(-1))), F.max(F.size("embedding")), F.count(F.when(F.col("note_id").isNull() | F.col("embedding").isNull(), 1))).first()
        least, most, odd = got
        width = self.width() or most
        if odd or (most is not None and not least == most == width):
            raise ValueError(f"vectors of this store have {width} numbers and a note")
        if notes is not None and not v.join(notes.select(F.col("id").alias("note_id")), "note_id", "left_anti").isEmpty():
            raise ValueError("vectors of notes that are not there")
        newest = F.max_by(F.struct("embedding", "model", "created_at"), F.struct("created_at", "model", "embedding"))
        once = v.groupBy("note_id").agg(newest.alias("s")).select("note_id", "s.embedding", F.size("s.embedding").alias("dimensions"), "s.model", "s.created_at")
        self._write(once.withColumn("bucket", self._bucket()), "vectors", batch, "bucket")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("note_id"), F.lit(self.buckets)).cast("int")

    def current(self, ids: DataFrame | None = None) -> DataFrame:
        """(note_id, embedding, dimensions, model, created_at) of all notes, or of (note_id) only, whose buckets alone are read."""
        rows = self._read("vectors", self.SCHEMA)
        if ids is not None:
            wanted = ids.select(F.col("note_id").cast("long").alias("note_id")).distinct()
            asked = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]  # numbers of buckets
            rows = rows.filter(F.col("bucket").isin(asked)).join(wanted, "note_id", "left_semi")
        fields = ("embedding", "dimensions", "model", "created_at")
        return rows.groupBy("note_id").agg(F.max_by(F.struct(*fields), "batch").alias("s")).select("note_id", "s.*")

    def compact(self) -> None:
        """A new generation with the current vectors alone."""
        new, last = self.generation + 1, self._read("vectors", self.SCHEMA).agg(F.coalesce(F.max("batch"), F.lit(0))).first()[0]
        self.current().withColumn("bucket", self._bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self._folder('vectors', new)}/batch={last}")
        self._name(new)


class AccessStore(_Batches):
    """The log of accesses to notes, and how often and when last each was accessed."""

    SCHEMA = "note_id long, accessed_at timestamp, access_kind string, query_context string, agent_id string"

    def record(self, rows: DataFrame, batch: int) -> None:
        """Append a batch of accesses (note_id, accessed_at, access_kind, query_context, agent_id) and its counts; also for ``foreachBatch``. Rows without a note are left out."""
        log = rows.filter("note_id is not null").select(*(F.col(c.split(" ")[0]).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in self.SCHEMA.split(", ")))
        self._write(log, "log", batch)
        # counted from what was written, so that log and counts agree even if the source would give other rows now
        written = self.spark.read.schema(self.SCHEMA).parquet(f"{self._folder('log')}/batch={batch}")
        self._write(written.groupBy("note_id").agg(F.count(F.lit(1)).alias("access_count"), F.max("accessed_at").alias("last_accessed_at")), "counts", batch)

    def log(self) -> DataFrame:
        return self._read("log", self.SCHEMA)

    def counters(self) -> DataFrame:
        """(note_id, access_count, last_accessed_at), from the counts of the batches."""
        n = self._read("counts", "note_id long, access_count long, last_accessed_at timestamp")
        return n.groupBy("note_id").agg(F.sum("access_count").alias("access_count"), F.max("last_accessed_at").alias("last_accessed_at"))

    def salience(self, now: Column) -> DataFrame:
        """Cascade levels of each note as the whole log gives them."""
        return cascade.salience(self.log(), now)


def search_accesses(context: DataFrame, queries: DataFrame, at: Column) -> DataFrame:
    """The log rows of retrieved contexts (query_id, id) for queries (query_id, query): each source of each query is a search hit at ``at``."""
    hit = context.select("query_id", F.col("id").alias("note_id")).distinct().join(queries.select("query_id", F.col("query").alias("query_context")), "query_id", "left")
    return hit.select("note_id", at.alias("accessed_at"), F.lit("search_hit").alias("access_kind"), "query_context", F.lit(None).cast("string").alias("agent_id"))

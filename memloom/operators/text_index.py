"""A stored full-text index: postings in buckets by their first term, written once and kept current by batches of changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.porter import stemmed
from . import search as S

_POSTINGS = "id long, dl int, field int, pos int, a string, b string, batch long, bucket int"


class TextIndex:
    """Postings, lengths and terms under ``path``, all by batch; of a note the last batch that holds it counts.

    A batch that is applied again replaces its own folders, so a job that failed is simply run again.
    Searches give what a scan of the current notes gives, and read only the buckets of their terms.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    @classmethod
    def build(cls, notes: DataFrame, path: str, buckets: int = 64) -> TextIndex:
        """A new index of notes (id, title, content)."""
        index = cls(notes.sparkSession, path, buckets)
        index.apply(notes.withColumn("deleted", F.lit(False)), 0)
        return index

    def _bucket(self, term: str):
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Store a batch of changes (id, title, content, deleted): new and changed notes whole, one row an id; numbers of batches rise. Null ids are left out."""
        rows = changes.filter("id is not null").select(F.col("id").cast("long").alias("id"), "title", "content", F.coalesce("deleted", F.lit(False)).alias("deleted"))
        here = rows.filter("not deleted")
        p = S.postings(here).withColumn("bucket", self._bucket("a"))
        terms = p.select(F.col("a").alias("term")).distinct().withColumn("stem", stemmed(F.array("term"))[0]).withColumn("bucket", self._bucket("stem"))
        size = rows.filter("deleted").select("id", F.lit(None).cast("int").alias("dl")).unionByName(S.lengths(here))
        p.repartition("bucket", "a").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/batch={batch}")
        terms.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/terms/batch={batch}")
        size.write.mode("overwrite").parquet(f"{self.path}/notes/batch={batch}")

    def notes(self) -> DataFrame:
        """(id, dl, batch) of the current notes."""
        every = self.spark.read.schema("id long, dl int, batch long").parquet(f"{self.path}/notes")
        last = every.groupBy("id").agg(F.max_by(F.struct("dl", "batch"), "batch").alias("s"))
        return last.select("id", "s.dl", "s.batch").filter("dl is not null")

    def _some(self, kind: str, schema: str, terms: DataFrame) -> DataFrame:
        """Rows of the buckets that the terms (term) fall into; numbers of buckets are all that the driver gets."""
        asked = [r[0] for r in terms.select(self._bucket("term").alias("b")).distinct().collect()]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}").filter(F.col("bucket").isin(asked))

    def postings(self, terms: DataFrame) -> DataFrame:
        """Current postings whose first term may be one of (term)."""
        return self._some("postings", _POSTINGS, terms).join(self.notes().select("id", "batch"), ["id", "batch"], "left_semi")

    def phrase_search(self, queries: DataFrame, k: int = 20, offset: int = 0, stem: bool = True) -> DataFrame:
        """As ``search.phrase_search`` over the current notes."""
        q = S.phrase_terms(queries, stem)
        known = None
        if stem:
            stems = q.select(F.explode("terms").alias("stem")).distinct()
            known = self._some("terms", "term string, stem string, batch long, bucket int", stems.withColumnRenamed("stem", "term")).select("term", "stem").distinct().join(stems, "stem", "left_semi")
        want = S.wanted_pairs(q, known)
        return S.phrase_hits(self.postings(want.select(F.col("a").alias("term"))), self.notes(), want, k, offset)

    def any_term_search(self, queries: DataFrame, k: int = 20, least_bytes: int = 3) -> DataFrame:
        """As ``search.any_term_search`` over the current notes."""
        want = S.question_terms(queries, least_bytes)
        return S.any_term_hits(self.postings(want.select(F.col("a").alias("term"))), self.notes(), want, k)

    def compact(self) -> TextIndex:
        """The same index without what changes have replaced, as one batch under a new path."""
        new = TextIndex(self.spark, f"{self.path}-{uuid.uuid4().hex[:8]}", self.buckets)
        live = self.notes()
        every = self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings").join(live.select("id", "batch"), ["id", "batch"], "left_semi").drop("batch")
        every.repartition("bucket", "a").write.partitionBy("bucket").parquet(f"{new.path}/postings/batch=0")
        terms = self.spark.read.schema("term string, stem string, batch long, bucket int").parquet(f"{self.path}/terms").drop("batch").distinct()
        terms.join(every.select(F.col("a").alias("term")).distinct(), "term", "left_semi").write.partitionBy("bucket").parquet(f"{new.path}/terms/batch=0")
        live.drop("batch").write.parquet(f"{new.path}/notes/batch=0")
        return new

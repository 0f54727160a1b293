"""Corpus pipeline: documents to packed training sequences.

Each stage is a function (spark, docs, sf_dir) -> DataFrame and works on all that the
one before it kept; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.jaccard_join import near_duplicates
from memloom.llm.neighbours import vote_quality
from memloom.llm.packing import pack_documents
from memloom.llm.quality_rules import quality_rules
from memloom.llm.secrets import redact_secrets
from memloom.session import materialize, table


def _whole(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row, so that no column of an operator can clash with one of the documents."""
    return docs.select("doc_id", "text", F.struct("*").alias("_doc"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour vote predicts good (score >= 0.3); null texts score as empty ones."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # the text goes through Python once; the other columns are one, so that none can clash with those of the vote
    whole = docs.select("doc_id", "text", (F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))).alias("_rest"))
    kept = vote_quality(whole, table(spark, sf_dir, "labels"), threshold=0.3, keep_text=True).filter("predicted = 1")
    return kept.select(*(F.col(c) if c not in rest else F.col("_rest")[c].alias(c) for c in docs.columns))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio; the trusted target is what the labels call good and not toxic."""
    good = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0")
    return quality_rules(_whole(docs), good).filter("kept").select("_doc.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate group (five words, similarity 0.8), once if its row is repeated.

    Documents without words are groups of their own; rows without an id can't be told apart and stay.
    """
    found = near_duplicates(docs, size=5, percent=80)
    stay = found.filter("doc_id = component_id").select("doc_id").distinct().hint("shuffle_hash")
    once = docs.filter("doc_id is not null").join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by its kind in brackets; n_chars follows the text."""
    out = redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("n-gram Jaccard join", one_of_each_group),
    ("secret scans", redact),
    ("best-fit packing", pack),
]

#: Token ids, a fitted classifier and similarity groups are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Wiki transactions: operations are validated as rows; a transaction commits as a whole or not at all."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

OPS = "array<struct<op: string, id: bigint, title: string, content: string, src: bigint, dst: bigint, link_type: string, uri: string, claims: array<struct<claim_start: int, claim_end: int, source_id: bigint, source_content: string>>>>"


def operations(transactions: DataFrame) -> DataFrame:
    """One row for each operation of transactions (tx_id, operations as JSON text)."""
    return transactions.select("tx_id", F.posexplode(F.from_json("operations", OPS)).alias("pos", "o")).select("tx_id", "pos", "o.*")


def validate(transactions: DataFrame, notes: DataFrame, require_provenance: bool = True) -> DataFrame:
    """(tx_id, operations, status, errors): committed if every operation is valid, else failed with all reasons.

    Unreadable JSON fails; updates and links need notes that exist or that the
    transaction creates; claims need bounds within the content and overlap with their
    source; created and updated contents need a claim if provenance is required.
    """
    ops = operations(transactions)
    made = ops.filter("op = 'create_note'").select("tx_id", "id")
    known = notes.select(F.col("id"), F.lit(True).alias("there"))
    errors = []
    kinds = ["create_note", "update_note", "create_link", "upsert_source"]
    errors.append(ops.filter(~F.coalesce(F.col("op").isin(kinds), F.lit(False))).select("tx_id", "pos", F.lit("unknown operation").alias("error")))
    for op, col in (("update_note", "id"), ("create_link", "src"), ("create_link", "dst")):
        want = ops.filter(F.col("op") == op).select("tx_id", "pos", F.col(col).alias("id"))
        miss = want.join(known, "id", "left_anti").join(made, ["tx_id", "id"], "left_anti")
        errors.append(miss.select("tx_id", "pos", F.lit(f"{op}: no note {col}").alias("error")))
    body = ops.filter("op in ('create_note', 'update_note') and content is not null")
    if require_provenance:
        errors.append(body.filter(F.coalesce(F.size("claims"), F.lit(0)) <= 0).select("tx_id", "pos", F.lit("no claim").alias("error")))
    claims = body.select("tx_id", "pos", "content", F.explode("claims").alias("c"))
    bad = (F.col("c.claim_start") < 0) | (F.col("c.claim_end") <= F.col("c.claim_start")) | (F.col("c.claim_end") > F.octet_length("content"))
    errors.append(claims.filter(bad).select("tx_id", "pos", F.lit("claim out of bounds").alias("error")))
    span = X.slice_bytes(F.col("content"), F.col("c.claim_start"), F.col("c.claim_end"))
    weak = claims.filter(~bad).filter(~X.verify_overlap(span, F.coalesce("c.source_content", F.lit("")))["passed"])
    errors.append(weak.select("tx_id", "pos", F.lit("claim not borne out").alias("error")))
    unread = transactions.filter(F.from_json("operations", OPS).isNull()).select("tx_id", F.lit(-1).alias("pos"), F.lit("unreadable").alias("error"))
    every = unread
    for e in errors:
        every = every.unionByName(e)
    found = every.groupBy("tx_id").agg(F.array_sort(F.collect_set(F.concat(F.col("pos").cast("string"), F.lit(": "), F.col("error")))).alias("errors"))
    n = ops.groupBy("tx_id").agg(F.count(F.lit(1)).alias("operations"))
    out = transactions.select("tx_id").join(n, "tx_id", "left").join(found, "tx_id", "left")
    return out.select("tx_id", F.coalesce("operations", F.lit(0)).alias("operations"), F.when(F.col("errors").isNull(), "committed").otherwise("failed").alias("status"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))


def publish(tables: dict[str, DataFrame], path: str) -> int:
    """Write tables as a new version and publish it by renaming a manifest into place; the new version's number.

    Readers of the old version keep theirs; a job that fails before the rename leaves no trace they can see.
    """
    spark = next(iter(tables.values())).sparkSession
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    version = current(spark, path) + 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/v{version}/{name}")
    draft, final = (jvm.org.apache.hadoop.fs.Path(f"{path}/{n}") for n in (f".manifest-{version}.draft", f"manifest-{version}"))
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"version": version, "tables": sorted(tables)}).encode()))
    out.close()
    if not fs.rename(draft, final):
        raise RuntimeError(f"version {version} has been published by another writer")
    return version


def current(spark, path: str) -> int:
    """The newest published version; 0 if there is none."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/manifest-*"))
    return max([0, *(int(s.getPath().getName().rsplit("-", 1)[1]) for s in found or [])])


def read_version(spark, path: str, name: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{path}/v{version or current(spark, path)}/{name}")

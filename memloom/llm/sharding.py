"""Sharding by extendible hashing.

A shard is a prefix of a row's hash bits. The directory starts with one shard of all
rows; a shard over its byte limit is split on one more bit, the others stay. Since
a prefix that fits makes all longer ones needless, the result is the shortest prefix
of each row that fits. It is found from sums over cells (prefixes somewhat longer
than needed), a table that grows with the number of shards, not of rows; only cells
that still don't fit are cut on further bits from their rows.

Rows that share all bits of the key's hash (a hot key) are split on the bits of a
hash of their row id columns, and rows that share those too (repeated rows) on the
bits of a hash of their place in the stored table, so which of equal rows is where goes by the layout of the files. So every shard fits, except one that
holds a single row over the limit.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

BITS = 60


def bits60(text: Column) -> Column:
    """The first 60 bits of the MD5 of a text as a long; null counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _split(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """rows (_path, _h, _bytes, ...) with _depth, the shortest prefix that fits; and those for which all bits don't do.

    Rows of different _path have directories of their own.
    """
    total = rows.agg(F.sum("_bytes")).first()[0] or 0
    depth = min(BITS, max(4, math.ceil(math.log2(max(1.0, total / limit))) + 4))
    known, low, done = rows.withColumn("_depth", F.lit(0)), 0, []
    while True:
        cell = F.shiftright("_h", BITS - depth).alias("_cell")
        cells = materialize(known.groupBy("_path", cell).agg(F.sum("_bytes").alias("_b"), F.count(F.lit(1)).alias("_n")))
        each = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("_d")).withColumn("_p", F.expr(f"shiftright(_cell, {depth} - _d)"))
        over = each.groupBy("_path", "_d", "_p").agg(F.sum("_b").alias("_b"), F.sum("_n").alias("_n")).filter((F.col("_b") > limit) & (F.col("_n") > 1)).select("_path", "_d", "_p")
        deep = each.join(over, ["_path", "_d", "_p"]).groupBy("_path", "_cell").agg((F.max("_d") + 1).alias("_deep"))
        at = known.withColumn("_cell", cell).join(deep, ["_path", "_cell"], "left").drop("_cell")
        at = materialize(at.withColumn("_depth", F.coalesce("_deep", "_depth")).drop("_deep"))
        done.append(at.filter(F.col("_depth") <= depth))
        left = at.filter(F.col("_depth") > depth)
        if depth == BITS or left.isEmpty():
            break
        known, low, depth = left, depth, min(BITS, depth + 8)
    return reduce(DataFrame.unionByName, done), left


def extendible_shards(df: DataFrame, key: str, n_bytes: Column, limit: int) -> DataFrame:
    """``df`` plus n_bytes, depth and shard: 's' and the bits of the shard's prefix, parts of the three hashes apart by '.'.

    ``limit`` is the most bytes of a shard. Null keys hash like the empty text; null
    sizes count as 0; an empty table gives an empty one; columns named n_bytes, depth
    and shard are replaced. Rows are written to the shared folder, so give only the
    columns that are needed.
    """
    df = df.withColumn("n_bytes", F.coalesce(n_bytes, F.lit(0)).cast("long")).drop("depth", "shard")
    names = df.columns
    rows = materialize(df.select("*", F.col("n_bytes").alias("_bytes"), F.lit("s").alias("_path"), bits60(F.col(key).cast("string")).alias("_h")))
    found = []
    for level in range(3):
        fit, left = _split(rows, limit)
        shard = F.concat("_path", F.expr(f"substring(lpad(bin(_h), {BITS}, '0'), 1, _depth)"))
        found.append(fit.select(*names, (F.col("_depth") + BITS * level).alias("depth"), shard.alias("shard")))
        if level == 2 or left.isEmpty():
            break
        path = F.concat("_path", F.lpad(F.bin("_h"), BITS, "0"), F.lit("."))
        then = F.to_json(F.struct(*names)) if level == 0 else F.monotonically_increasing_id().cast("string")
        rows = materialize(left.withColumns({"_path": path, "_h": bits60(then)}).drop("_depth"))
    return reduce(DataFrame.unionByName, found)


def directory(sharded: DataFrame) -> DataFrame:
    """(shard, depth, n_rows, n_bytes, first, slots) of the result of ``extendible_shards``: the directory, one row for each shard.

    The directory has 2 ** (the greatest depth) slots, as a shard's depth within the hash that
    it was split on last says; ``first`` is the first slot of a shard and ``slots`` how many point to it, both as
    exact decimals. A key's slot is the number of its first bits, so the row with first <= slot < first + slots has its shard.
    """
    last = F.substring_index("shard", ".", -1)
    bits = F.when(F.col("shard").contains("."), last).otherwise(F.substring("shard", 2, BITS))
    shards = sharded.groupBy("shard", "depth").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))
    shards = shards.withColumn("bits", bits).withColumn("path", F.when(F.col("shard").contains("."), F.regexp_extract("shard", r"^(.*)\.", 1)).otherwise("s"))
    whole = shards.groupBy("path").agg(F.max(F.length("bits")).alias("most"))
    out = shards.join(whole, "path").withColumn("slots", F.pow(F.lit(2.0), F.col("most") - F.length("bits")).cast("decimal(20,0)"))
    first = F.conv(F.rpad("bits", F.col("most"), F.lit("0")), 2, 10).cast("decimal(20,0)")
    return out.select("shard", "depth", "n_rows", "n_bytes", F.coalesce(first, F.lit(0).cast("decimal(20,0)")).alias("first"), "slots")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of Parquet files for each shard; a shard's rows are written by the task that holds them."""
    sharded.repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(path)

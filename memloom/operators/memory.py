"""Key-value memory and tool logs as projections of append-only logs.

A write log has seq, agent_id, namespace, key, value, written_at, ttl_seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["agent_id", "namespace", "key"]


def expired(now: Column) -> Column:
    """Whether an entry's time to live is over; entries without one never expire."""
    return F.coalesce(F.unix_timestamp(now) > F.unix_timestamp("written_at") + F.col("ttl_seconds"), F.lit(False))


def store(log: DataFrame, policy: str = "overwrite") -> DataFrame:
    """The current entries after all writes: the last write of each key; with policy reject the first one.

    version_and_keep and invalidate have the same current entries as overwrite; what they keep is in ``history``.
    """
    pick = F.min_by if policy == "reject" else F.max_by
    cols = ["seq", "value", "written_at", "ttl_seconds"]
    return log.groupBy(*KEY).agg(F.count(F.lit(1)).alias("writes"), *(pick(c, "seq").alias(c) for c in cols))


def conflicts(log: DataFrame) -> DataFrame:
    """Writes that policy reject refuses: all but the first of each key."""
    w = Window.partitionBy(*KEY).orderBy("seq")
    return log.withColumn("n", F.row_number().over(w)).filter("n > 1").drop("n")


def history(log: DataFrame) -> DataFrame:
    """Superseded versions: each write but the last of its key, with when and by which write it was superseded."""
    w = Window.partitionBy(*KEY).orderBy("seq")
    out = log.withColumns({"superseded_at": F.lead("written_at").over(w), "superseded_by": F.lead("seq").over(w)})
    return out.filter("superseded_by is not null")


def live(entries: DataFrame, now: Column) -> DataFrame:
    return entries.filter(~expired(now))


def with_prefix(entries: DataFrame, prefix: str) -> DataFrame:
    """Entries whose key begins with a prefix in any ASCII case; % and _ in it are wildcards."""
    return entries.filter(F.col("key").ilike(prefix + "%"))


def recent_tool_logs(logs: DataFrame, limit: int = 50) -> DataFrame:
    """The newest logs of each agent."""
    w = Window.partitionBy("agent_id").orderBy(F.desc("created_at"), F.desc("id"))
    return logs.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit).drop("n")


def tool_rollup(logs: DataFrame) -> DataFrame:
    """Calls and mean duration by tool and status."""
    return logs.groupBy("tool_name", "status").agg(F.count(F.lit(1)).alias("calls"), F.round(F.avg("duration_ms"), 4).alias("mean_ms"), F.max("duration_ms").alias("max_ms"))

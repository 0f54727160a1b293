"""Structured Streaming forms of the stateful operators: windows, first-seen keys, current entries, embedding queue, cascade state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cascade import Cascade


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts and sums by user, day and type, final once the watermark has passed."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy("user_id", F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def first_writes(writes: DataFrame, late: str = "1 day") -> DataFrame:
    """The first write of each key within the watermark: policy reject on a stream."""
    return writes.withWatermark("written_at", late).dropDuplicatesWithinWatermark(["agent_id", "namespace", "key"])


def current_entries(writes: DataFrame) -> DataFrame:
    """The last write of each key as of each batch (update mode)."""
    return writes.groupBy("agent_id", "namespace", "key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def live_entries(writes: DataFrame, late: str = "1 hour") -> DataFrame:
    """(agent_id, namespace, key, value, seq, op) of a stream of writes: set with the newest value of each batch, expired once its time is over.

    A write with ``ttl_seconds`` ends that long after ``written_at``, one without never. The entry's timer fires when the watermark
    (``late`` behind the newest write of all) has passed its end; then the key leaves the state. Writes that are older
    than the one held, by seq, change nothing.
    """
    names = ["agent_id", "namespace", "key"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        def row(value: float | None, seq: int, op: str) -> pd.DataFrame:
            return pd.DataFrame({**{n: [k] for n, k in zip(names, key, strict=True)}, "value": [value], "seq": [seq], "op": [op]})

        if state.hasTimedOut:
            value, seq, _ = state.get
            state.remove()
            yield row(value, seq, "expired")
            return
        value, seq, end = state.get if state.exists else (None, -1, -1)
        new = max((r for f in frames for r in f[["seq", "value", "end"]].itertuples(index=False, name=None)), default=None)
        if new is not None and new[0] > seq:
            seq, value, end = int(new[0]), new[1], int(new[2])
            yield row(value, seq, "set")
        state.update((None if value is None or value != value else float(value), seq, end))
        if end >= 0:
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    end = F.coalesce(F.unix_millis("written_at") + F.col("ttl_seconds").cast("long") * 1000, F.lit(-1))
    rows = writes.withColumn("written_at", F.col("written_at").cast("timestamp")).withWatermark("written_at", late).select(*names, F.col("value").cast("double"), F.col("seq").cast("long"), end.alias("end"), "written_at")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    return rows.groupBy(*names).applyInPandasWithState(step, f"{kinds}, value double, seq long, op string", "value double, seq long, end long", "append", "EventTimeTimeout")


def embedding_queue(notes: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, batch_files: int = 32) -> StreamingQuery:
    """Embeds new notes batch by batch and appends the vectors; a batch that is run again replaces its own folder."""

    def write(df: DataFrame, batch: int) -> None:
        embed(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return notes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cascade_state(accesses: DataFrame, config: Cascade = Cascade()) -> DataFrame:
    """(note_id, accesses, salience) after each batch of accesses (note_id, accessed_at), with levels kept as state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, at, levels = state.get if state.exists else (0, 0.0, [0.0] * config.levels)
        u = np.array(levels)
        for t in sorted(t for f in frames for t in f["t"]):
            u = config.advance(u, t - at) if n else u
            u[0] += config.pulse
            n, at = n + 1, max(t, at)
        state.update((n, float(at), u.tolist()))
        yield pd.DataFrame({"note_id": [key[0]], "accesses": [n], "salience": [float(u.mean())]})

    rows = accesses.filter("note_id is not null and accessed_at is not null").select("note_id", (F.unix_micros("accessed_at") / 1e6).alias("t"))
    return rows.groupBy("note_id").applyInPandasWithState(step, "note_id long, accesses long, salience double", "n long, at double, levels array<double>", "update", "NoTimeout")

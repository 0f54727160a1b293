"""Cascade memory dynamics: coupled levels that are driven by accesses and leak over time.

Between two accesses the system is linear, so ``n`` Euler steps of equal size are one
matrix power, and in the basis of the matrix' eigenvectors one power of each eigenvalue,
which is computed for whole batches of accesses. A note's accesses are folded in order; notes are what spreads the work.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_STEPS = 200_000


@dataclass(frozen=True)
class Cascade:
    """Levels, capacity of the first in seconds, ratio between capacities, coupling, pulse of an access, and whether the deepest level leaks."""

    levels: int = 6
    base_seconds: float = 3600.0
    ratio: float = 4.0
    coupling: float = 1.0
    pulse: float = 1.0
    leaky: bool = True

    def generator(self) -> np.ndarray:
        """The matrix of du/dt = A u."""
        a = np.zeros((self.levels, self.levels))
        for k in range(self.levels):
            rate = self.coupling / (self.base_seconds * self.ratio**k)
            if k:
                a[k, k - 1] = rate
            a[k, k] = -2 * rate
            if k + 1 < self.levels:
                a[k, k + 1] = rate
            elif not self.leaky:
                a[k, k] += rate
        return a

    def advance(self, u: np.ndarray, dt: float) -> np.ndarray:
        """Levels after ``dt`` seconds: zero long after the slowest timescale, else equal Euler steps of at most an eighth of the fastest one."""
        if dt <= 0 or not self.levels:
            return u
        if self.leaky and dt > 10 * self.base_seconds * self.ratio ** (self.levels - 1) / self.coupling:
            return np.zeros_like(u)
        n = min(max(int(np.ceil(dt / (self.base_seconds / (8 * self.coupling)))), 1), MAX_STEPS)
        return np.linalg.matrix_power(np.eye(self.levels) + self.generator() * (dt / n), n) @ u

    def modes(self) -> tuple[np.ndarray, np.ndarray]:
        """Eigenvalues and eigenvectors of the generator, which is similar to a symmetric matrix, so both are real."""
        values, vectors = np.linalg.eig(self.generator())
        return values.real, vectors.real

    def fading(self, dt: np.ndarray, values: np.ndarray) -> np.ndarray:
        """What is left of each mode after each of the times, one row for each: as ``advance`` does it."""
        n = np.clip(np.ceil(dt / (self.base_seconds / (8 * self.coupling))), 1, MAX_STEPS)
        left = (1 + values * (dt / n)[:, None]) ** n[:, None]
        if self.leaky:
            left[dt > 10 * self.base_seconds * self.ratio ** (self.levels - 1) / self.coupling] = 0
        left[dt <= 0] = 1
        return left

    def replay(self, times: list[float], now: float) -> np.ndarray:
        """Levels at ``now`` after accesses at ``times`` (sorted)."""
        u, at = np.zeros(self.levels), None
        for t in times:
            u = self.advance(u, t - at) if at is not None else u
            u[0] += self.pulse
            at = t
        return self.advance(u, now - at) if at is not None else u


def salience(accesses: DataFrame, now: Column, config: Cascade = Cascade()) -> DataFrame:
    """(note_id, accesses, last_accessed_at, levels, salience) at ``now`` from accesses (note_id, accessed_at).

    Salience is the mean of the levels. Accesses at one time each pulse; those without
    a note or a time are left out. Rows stream through sorted tasks, so a note with very
    many accesses needs no more memory than one with few.
    """
    rows = accesses.filter("note_id is not null and accessed_at is not null").select("note_id", F.unix_micros("accessed_at").alias("t"), F.unix_micros(now).alias("now"))

    def run(batches):
        values, vectors = config.modes()
        pulse = np.linalg.solve(vectors, np.eye(config.levels)[0] * config.pulse)
        note, u, at, n, end = None, np.zeros(config.levels), 0, 0, 0

        def rows_of(out: list[tuple]) -> pa.RecordBatch:
            ids, counts, last, modes, ends = zip(*out, strict=True)
            levels = (np.array(modes) * config.fading((np.array(ends) - np.array(last)) / 1e6, values)) @ vectors.T
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(last, pa.int64()), pa.array(levels.tolist(), pa.list_(pa.float64()))], names=["note_id", "accesses", "last", "levels"])

        for b in batches:
            ids, t = b.column(0).to_pylist(), b.column(1).to_numpy()
            if not ids:
                continue
            now_ = b.column(2)[0].as_py()
            # the first row of a task follows none, so its own time stands before it
            left = config.fading(np.diff(t, prepend=at if note is not None else t[0]) / 1e6, values)
            out: list[tuple] = []
            for i, name in enumerate(ids):
                if name != note:
                    if note is not None:
                        out.append((note, n, at, u, end))
                    note, u, n = name, pulse, 0
                else:
                    u = u * left[i] + pulse
                at, n, end = int(t[i]), n + 1, now_
            if out:
                yield rows_of(out)
        if note is not None:
            yield rows_of([(note, n, at, u, end)])

    got = rows.repartition("note_id").sortWithinPartitions("note_id", "t").mapInArrow(run, "note_id long, accesses long, last long, levels array<double>")
    mean = F.aggregate("levels", F.lit(0.0), lambda a, x: a + x) / F.size("levels")
    return got.select("note_id", "accesses", F.timestamp_micros("last").alias("last_accessed_at"), "levels", F.round(mean, 6).alias("salience"))

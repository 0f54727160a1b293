"""Quality classification by nearest-neighbour voting among labelled latent-semantic vectors.

Texts become hashed byte n-gram weights, and a singular value decomposition of a
bounded labelled sample gives the latent space. The labelled vectors (a number of rows
that is a parameter, times the rank) go to every task; there each document's exact
cosines with all of them come from blocked matrix products, and the labels of the
nearest ones vote, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import with_columns

#: Labelled rows of each label that the model is fitted on at most: those with the smallest hashes of their id.
FIT_ROWS = 1500
DIMS = 1 << 13
RANK = 64
NEIGHBOURS = 25
BLOCK = 256


def features(text: str) -> np.ndarray:
    """Damped shares of hashed byte 3-grams, and of words that repeat the word before them or the one before that.

    All 0 for texts under three bytes.
    """
    x = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    out = np.zeros(DIMS + 2, np.float32)
    if len(x) < 3:
        return out
    h = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(19)
    n = np.bincount(h, minlength=DIMS)
    out[:DIMS] = np.sqrt(n / len(h))
    w = text.split()
    for k in (1, 2):
        out[DIMS + k - 1] = (sum(map(eq, w, w[k:])) / max(1, len(w))) ** 0.5
    return out


@dataclass
class Model:
    """idf and axes of the latent space, unit vectors with labels in it, and the score of texts without evidence."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float = 0.5

    def embed(self, block: np.ndarray) -> np.ndarray:
        v = (block * self.idf) @ self.axes
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, n, out=np.zeros_like(v), where=n > 1e-12)

    def score(self, block: np.ndarray) -> np.ndarray:
        """The similarity-weighted share of label 1 among the nearest vectors; the prior where none is similar."""
        if not len(self.labels):
            return np.full(len(block), self.prior)
        sims = self.embed(block) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(sims, near, 1).astype(float), 0) ** 8
        total = w.sum(1)
        return np.where(total > 0, (w * self.labels[near]).sum(1) / np.where(total > 0, total, 1), self.prior)


def latent(x: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Model:
    """Fit the latent space on the rows of ``x``, which are weighted in place (a randomised decomposition with a fixed seed)."""
    idf = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + np.float32(1)
    x *= idf
    rank = min(rank, *x.shape) if len(x) else 0
    if not rank:
        return Model(idf, np.zeros((x.shape[1], 0), np.float32), np.zeros((len(x), 0), np.float32), labels)
    q = np.random.default_rng(7).standard_normal((x.shape[1], rank + 16), np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    axes = (q @ vt.T[:, :rank]).astype(np.float32)
    v = x @ axes
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return Model(idf, axes, np.divide(v, n, out=np.zeros_like(v), where=n > 1e-12), labels)


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> Model:
    """A model from labelled documents outside the held-out fold; ``rows`` of each label at most.

    Only ids and labels choose the sample: 2 * ``rows`` sparse vectors of DIMS + 2 at most, which one task
    turns into the model; that model is what comes to the driver. Rows without text, id or label are left out; of
    repeated ids the one with the least vector counts. Texts without evidence get the smoothed share of
    label 1 among the NEIGHBOURS shortest of these texts. Without any labelled row every score is 0.5.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    known = known.filter(fold() != 0).withColumn("h", F.xxhash64("doc_id"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = [known.filter(F.col("y") == y).orderBy("h", "doc_id").limit(rows) for y in (0, 1)]
    ids = docs.sparkSession.createDataFrame([tuple(r) for p in picked for r in p.select("doc_id", "y").collect()], "doc_id long, y int")
    some = docs.select(F.col("doc_id").cast("long"), "text").filter("text is not null").join(F.broadcast(ids), "doc_id")

    def sparse(texts: list[str]) -> list[tuple]:
        out = []
        for t in texts:
            x = features(t)
            at = np.flatnonzero(x)
            out.append((at.tolist(), x[at].tolist(), len(t.encode())))
        return out

    fields = [("at", T.ArrayType(T.IntegerType())), ("x", T.ArrayType(T.FloatType())), ("bytes", T.LongType())]
    sample = with_columns(some, "text", fields, lambda: sparse, drop=True).select("doc_id", "y", "at", "x", "bytes")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = from_sample(pa.Table.from_batches([*batches], schema=_SAMPLE))
        cols = [pa.array([a.tobytes()], pa.binary()) for a in (m.idf, m.axes, m.vectors, m.labels)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([m.prior])], names=["idf", "axes", "vectors", "labels", "prior"])

    # the sample is bounded, so one task fits the model, and the driver gets the model alone
    r = sample.repartition(1).mapInArrow(learn, "idf binary, axes binary, vectors binary, labels binary, prior double").first()
    if r is None:
        return from_sample(_SAMPLE.empty_table())
    labels_, axes = np.frombuffer(r["labels"]), np.frombuffer(r["axes"], np.float32).reshape(DIMS + 2, -1)
    return Model(np.frombuffer(r["idf"], np.float32), axes, np.frombuffer(r["vectors"], np.float32).reshape(len(labels_), axes.shape[1]), labels_, r["prior"])


_SAMPLE = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float32())), ("bytes", pa.int64())])


def from_sample(rows: pa.Table) -> Model:
    """The model of sparse vectors (doc_id, y, at, x, bytes), in the order of their ids; of repeated ids the one with the least vector counts."""
    got = rows.combine_chunks()
    ends, at, value = (got["at"].chunk(0).offsets.to_numpy(), got["at"].chunk(0).values.to_numpy(), got["x"].chunk(0).values.to_numpy()) if len(got) else (np.zeros(1, int), *[np.zeros(0)] * 2)
    vectors = {}
    for i, d in enumerate(got["doc_id"].to_pylist()):
        key = (at[ends[i] : ends[i + 1]].tobytes(), value[ends[i] : ends[i + 1]].tobytes())
        vectors[d] = min(vectors.get(d, (key, i)), (key, i))
    keep = [vectors[d][1] for d in sorted(vectors)]
    y, size = got["y"].to_numpy().astype(float)[keep], got["bytes"].to_numpy()[keep]
    del vectors
    x = np.zeros((len(keep), DIMS + 2), np.float32)
    for row, i in enumerate(keep):
        x[row, at[ends[i] : ends[i + 1]]] = value[ends[i] : ends[i + 1]]
    model = latent(x, y)
    shortest = y[np.argsort(size, kind="stable")[:NEIGHBOURS]]
    model.prior = float((shortest.sum() + 1) / (len(shortest) + 2))
    return model


def vote_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, keep_text: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, any others) without text unless it is to be kept, plus held_out, score and predicted.

    Every whole text is scored by text alone; null texts count as empty and score the prior that
    ``fit`` learns from the shortest labelled texts, as do texts under three bytes. held_out is null for a null doc_id. Repeated rows are
    scored alike; columns named like the new ones are replaced, others pass through. No shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def make():
        m = model.value

        def run(texts: list[str]) -> list[tuple]:
            out = []
            for i in range(0, len(texts), BLOCK):
                block = np.stack([features(t) for t in texts[i : i + BLOCK]])
                for s in m.score(block).round(6).tolist():
                    out.append((s, int(s >= threshold)))
            return out

        return run

    out = docs.withColumn("held_out", fold() == 0)
    return with_columns(out, "text", [("score", T.DoubleType()), ("predicted", T.IntegerType())], make, drop=not keep_text)

"""Vectors in cells around pivots: exact and probed neighbours, joins within a radius, and a stored index.

A bounded sample gives pivots; each vector belongs to the cell of its nearest pivot, whose radius
is the distance of its farthest vector. No vector of a cell is nearer to a point than the point's
distance to the pivot less the radius, so a point only meets the cells that this bound lets it
reach. Cells with many vectors, as copies make, are dealt in parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch

#: Vectors that pivots are chosen from at most (those with the smallest hashes of their id), and pivots at most.
SAMPLE, MOST_CELLS = 16_384, 4096
#: Vectors of a cell, about, and of a part of a cell that meets points in one task.
CELL, PART = 1024, 4096
#: Points that are compared with a part at once.
CHUNK = 1024
#: Numbers of the vectors of a block that goes to every task, at most, and rows that a task hands on at once.
BLOCK_NUMBERS, OUT = 4_194_304, 65_536
#: Distances are rounded to 6 digits; bounds leave room for that.
SLACK = 2e-6


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * (x @ y.T), 0))


def _units(rows: pa.RecordBatch, x: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows whose vectors are not zero, and their vectors made one long."""
    norm = np.sqrt((x**2).sum(1))
    some = norm > 0
    return rows.filter(pa.array(some)), x[some] / norm[some][:, None]


def whole(vectors: DataFrame, width: int | None = None, kind: str = "array<double>") -> tuple[DataFrame, int]:
    """(id, v) of the vectors (id, embedding) of one width, by default that of most of them, without nulls; and the width."""
    v = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("v")).filter("id is not null and v is not null and not exists(v, x -> x is null)")
    if width is None:
        first = v.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").first()
        width = first["w"] if first else 0
    return v.filter(F.size("v") == width), width


def choose_pivots(v: DataFrame, width: int, cells: int, rounds: int = 4, of: int | None = None, unit: bool = False) -> np.ndarray:
    """``cells`` pivots (fewer if there are fewer distinct vectors): means of a few rounds over a bounded sample, made in one task.

    ``of``: the number of vectors, by which most need not be sorted; ``unit``: pivots of the vectors made one long, without zero vectors.
    """
    cells = max(1, min(cells, MOST_CELLS))

    def fit(batches):
        parts = [_units(b, x)[1] if unit else x for b in batches for x in [_matrix(b.column(0), width)]]
        x = np.unique(np.concatenate(parts), axis=0) if parts else np.zeros((0, width))
        p = x[np.random.default_rng(5).permutation(len(x))[:cells]]
        for _ in range(rounds if len(p) < len(x) else 0):
            own = np.concatenate([_distances(x[i : i + CHUNK], p).argmin(1) for i in range(0, len(x), CHUNK)])
            n = np.bincount(own, minlength=len(p))
            order = np.argsort(own, kind="stable")
            sums = np.add.reduceat(x[order], np.flatnonzero(np.diff(own[order], prepend=-1)))
            p = p.copy()
            p[n > 0] = sums / n[n > 0][:, None]
        yield pa.RecordBatch.from_arrays([pa.array(list(p), pa.list_(pa.float64()))], names=["v"])

    hashed = v.withColumn("h", F.xxhash64("id"))
    if of and of > 4 * SAMPLE:
        hashed = hashed.filter(F.col("h") < -(2**63) + 2**64 * 2 * SAMPLE // of)
    sample = hashed.orderBy("h", "id").limit(SAMPLE).select("v")
    got = sample.coalesce(1).mapInArrow(fit, "v array<double>").collect()  # MOST_CELLS rows at most
    return np.array([r["v"] for r in got], float).reshape(-1, width)


def assign(v: DataFrame, pivots: np.ndarray, unit: bool = False) -> DataFrame:
    """(id, v, cell, d): the nearest pivot of each vector and its distance; ``unit``: those of the vector made one long, without zero vectors."""
    shared = v.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        p = shared.value
        for b in batches:
            for first in range(0, len(b), CHUNK):
                part = b.slice(first, CHUNK)
                x = _matrix(part.column(1), p.shape[1])
                if unit:
                    part, x = _units(part, x)
                d = _distances(x, p)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["id", "v", "cell", "d"])

    return v.select("id", "v").mapInArrow(run, f"id long, v {v.schema['v'].dataType.simpleString()}, cell int, d double")


def cell_sizes(stored: DataFrame) -> dict[int, tuple[float, int]]:
    """Radius and number of vectors of each cell that has any."""
    return {r["cell"]: (r["radius"], r["n"]) for r in stored.groupBy("cell").agg(F.max("d").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}


def _parts(n: int) -> int:
    return -(-n // PART)


def meet(stored: DataFrame, asks: DataFrame, width: int, pick: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(query_id, id, d) of the points that ``asks`` (cell, part, id, v, limit) sends to the parts of ``stored`` (cell, part, id, v).

    ``pick`` gets distances (points by vectors, rounded), the points' limits and which pairs are a vector
    with itself, and gives the places of the pairs that stay. A task holds one part of a cell and a chunk of points.
    """
    both = stored.select("cell", "part", F.lit(0).alias("side"), "id", "v", F.lit(0.0).alias("limit")).unionByName(asks.select("cell", "part", F.lit(1).alias("side"), "id", "v", "limit"))
    both = both.repartition("cell", "part").sortWithinPartitions("cell", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held = None, np.zeros(0, np.int64), np.zeros((0, width))
        for b in batches:
            key = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(b)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                cell, part, side = key[i].tolist()
                some = b.slice(i, j - i)
                if (cell, part) != now:
                    now, ids, held = (cell, part), np.zeros(0, np.int64), np.zeros((0, width))
                if not side:
                    ids = np.concatenate([ids, some.column(3).to_numpy()])
                    held = np.concatenate([held, _matrix(some.column(4), width)])
                    continue
                for first in range(0, len(some) if len(ids) else 0, CHUNK):
                    points = some.slice(first, CHUNK)
                    names = points.column(3).to_numpy()
                    d = _distances(_matrix(points.column(4), width), held).round(6)
                    p, q = pick(d, points.column(5).to_numpy(), names[:, None] == ids)
                    yield pa.RecordBatch.from_arrays([pa.array(names[p]), pa.array(ids[q]), pa.array(d[p, q])], names=["query_id", "id", "d"])

    return both.mapInArrow(run, "query_id long, id long, d double")


def send(points: DataFrame, pivots: np.ndarray, sizes: dict[int, tuple[float, int]], probes: int | None = None, skip: int = 0, own_and_later: bool = False) -> DataFrame:
    """(cell, part, id, v, limit): each of the points (id, v, limit) for each part of the cells it may reach within its limit.

    ``probes``: only so many cells, those with the nearest pivots; ``skip``: all but so many. ``own_and_later``: only
    the point's own cell and those numbered after it, for joins of a table with itself.
    """
    used = np.array(sorted(sizes), int)
    shared = points.sparkSession.sparkContext.broadcast((pivots, used, np.array([sizes[c][0] for c in used.tolist()]), np.array([_parts(sizes[c][1]) for c in used.tolist()], int)))

    def run(batches):
        p, used, radius, parts = shared.value
        for b in batches:
            for first in range(0, len(b) if len(used) else 0, CHUNK):
                some = b.slice(first, CHUNK)
                every = _distances(_matrix(some.column(1), p.shape[1]), p)
                d = every[:, used]
                reach = d - radius <= some.column(2).to_numpy()[:, None] + SLACK
                if probes is not None or skip:
                    place = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1)
                    reach &= place >= skip if probes is None else place < probes
                if own_and_later:
                    reach &= used >= every.argmin(1)[:, None]
                i, c = np.nonzero(reach)
                n = parts[c]
                i, c = np.repeat(i, n), np.repeat(c, n)
                part = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(used[c].astype(np.int32)), pa.array(part.astype(np.int32)), *(some.column(k).take(pa.array(i)) for k in range(3))], names=["cell", "part", "id", "v", "limit"])

    return points.select("id", "v", "limit").mapInArrow(run, "cell int, part int, id long, v array<double>, limit double")


def _dealt(stored: DataFrame, sizes: dict[int, tuple[float, int]]) -> DataFrame:
    """Stored vectors with their part of the cell, by a hash of the id."""
    many = {c: _parts(n) for c, (_, n) in sizes.items() if n > PART}
    parts: Column = F.lit(1)
    if many:
        parts = F.coalesce(F.create_map(*(F.lit(x) for pair in many.items() for x in pair))[F.col("cell")], parts)
    return stored.withColumn("part", F.pmod(F.xxhash64("id"), parts.cast("long")).cast("int"))


def _best(k: int, others: bool) -> Callable:
    """Of each point's row the ``k`` least distances within its limit, with all that tie with the last."""

    def pick(d: np.ndarray, limit: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.where(d <= limit[:, None] + SLACK, d, np.inf)
        if others:
            d[same] = np.inf
        last = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
        return np.nonzero((d <= last[:, None]) & (d < np.inf))

    return pick


def _top(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("d", "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _search(stored: DataFrame, pivots: np.ndarray, sizes: dict[int, tuple[float, int]], points: DataFrame, k: int, probes: int | None, others: bool, scratch: Scratch, prune: bool = False) -> DataFrame:
    """(query_id, id, score, rank) of points (id, v) among the stored vectors (id, v, cell, d)."""
    width = pivots.shape[1]
    far = points.withColumn("limit", F.lit(float("inf")))

    def at(asks: DataFrame) -> DataFrame:
        asks = scratch.write(asks, "asks")
        some = stored
        if prune:  # read only the folders of the cells that are asked for
            some = stored.filter(F.col("cell").isin([r[0] for r in asks.select("cell").distinct().collect()]))
        return meet(_dealt(some, sizes), asks, width, _best(k, others))

    first = scratch.write(at(send(far, pivots, sizes, probes=1 if probes is None else probes)), "near")
    found = first
    if probes is None:
        # a point whose first cell has k neighbours need not look farther than the k-th of them
        kth = _top(first, k).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("d").alias("limit"))
        again = points.join(kth, "id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
        found = first.unionByName(scratch.write(at(send(again, pivots, sizes, skip=1)), "rest"))
    return _top(found, k).select("query_id", "id", F.col("d").alias("score"), "rank")


def widths(vectors: DataFrame) -> list[int]:
    """The widths of the vectors (id, embedding) that are not empty."""
    rows = vectors.filter("embedding is not null").groupBy(F.size("embedding").alias("w")).agg(F.count(F.lit(1))).collect()
    return sorted(r["w"] for r in rows if r["w"] > 0)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame | None, k: int = 10, size: int = CELL, width: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` vectors (id, embedding) nearest by L2 to each of (query_id, vector), exactly, ties by id.

    Without ``queries`` every vector looks for its nearest others. Each point first meets its nearest cell, and
    then only the cells that may hold something nearer than the k-th vector found there. Only vectors of one
    ``width`` (by default the most usual one) take part, null ones and null ids never. Repeated query ids must not differ.
    """
    scratch = Scratch(vectors.sparkSession)
    v, width = whole(vectors, width)
    n = v.count()
    if not n or not width:
        return vectors.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    pivots = choose_pivots(v, width, -(-n // size))
    stored = scratch.write(assign(v, pivots), "stored")
    points = stored.select("id", "v") if queries is None else whole(queries.select(F.col("query_id").alias("id"), F.col("vector").alias("embedding")), width)[0]
    return _search(stored, pivots, cell_sizes(stored), points, k, None, queries is None, scratch)


def _cell_blocks(sizes: dict[int, tuple[float, int]], most: int) -> list[tuple[int, int, int, int]]:
    """(first cell, last cell, part, parts) of blocks of ``most`` vectors at most; larger cells are dealt in parts by a hash of the id."""
    out, first, last, held = [], None, 0, 0
    for cell in sorted(sizes):
        n = sizes[cell][1]
        parts = -(-n // most)
        if first is not None and (parts > 1 or held + n > most):
            out.append((first, last, 0, 1))
            first = None
        if parts > 1:
            out += [(cell, cell, k, parts) for k in range(parts)]
            continue
        if first is None:
            first, held = cell, 0
        last, held = cell, held + n
    return out if first is None else [*out, (first, last, 0, 1)]


def _pairs_with(block: tuple, batches: Iterator[pa.RecordBatch], radius: float, least: float) -> Iterator[pa.RecordBatch]:
    """(a, b, similarity) of points (id, v, cell) with the block's vectors of later cells, or of their own cell with a larger id."""
    ids, held, cuts, cells, pivots, radii = block
    width = held.shape[1]
    held = held.astype(float)
    held /= np.sqrt((held**2).sum(1))[:, None]
    short = held.astype(np.float32)
    bound = np.float32(least - 1e-6 - width * 2e-7)  # products of short numbers are this near to the true ones
    for b in batches:
        for first in range(0, len(b), CHUNK):
            points = b.slice(first, CHUNK)
            points, x = _units(points, _matrix(points.column(1), width))
            names, own, brief = points.column(0).to_numpy(), points.column(2).to_numpy(), x.astype(np.float32)
            reach = (_distances(x, pivots) - radii <= radius + SLACK) & (own[:, None] <= cells)
            for c in np.flatnonzero(reach.any(0)).tolist():
                some = np.flatnonzero(reach[:, c])
                low, high = cuts[c], cuts[c + 1]
                p, q = np.divmod(np.flatnonzero((brief[some] @ short[low:high].T >= bound).ravel()), high - low)
                p, q = some[p], q + low
                later = (own[p] < cells[c]) | (names[p] < ids[q])
                p, q = p[later], q[later]
                for k in range(0, len(p), OUT):
                    i, j = p[k : k + OUT], q[k : k + OUT]
                    dot = np.einsum("ij,ij->i", x[i], held[j])
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(names[i], ids[j])), pa.array(np.maximum(names[i], ids[j])), pa.array(dot)], names=["a", "b", "similarity"])


def pairs_within(vectors: DataFrame, least: float, size: int = CELL, width: int | None = None) -> DataFrame:
    """(a, b, similarity) with a < b of the vectors (id, embedding) with a cosine of ``least`` (over 0) or more, exactly.

    Cells go to every task in blocks of bounded size, and all vectors of the block's cells and those numbered before pass by. On
    vectors of length one a cosine is a distance, so a vector meets only the cells that this distance reaches; where vectors form
    groups, most pairs of cells never meet. Nothing is shuffled or written for each pair. Zero vectors
    are similar to none; vectors of another ``width`` than this (by default the most usual one), null ones and null ids take no part.
    """
    if least <= 0:
        raise ValueError("similarities of 0 or less hold for nearly all pairs")
    spark, kind = vectors.sparkSession, vectors.schema["embedding"].dataType.simpleString()
    scratch, schema = Scratch(spark), "a long, b long, similarity double"
    v, width = whole(vectors, width, kind if kind == "array<float>" else "array<double>")
    repeated = lambda: not v.groupBy("id").count().filter("count > 1").isEmpty()
    if several := repeated():
        v = v.dropDuplicates(["id", "v"])
        several = repeated()
    n = v.count()
    if not n or not width:
        return spark.createDataFrame([], schema)
    pivots = choose_pivots(v, width, -(-n // size), of=n, unit=True)
    # dealt anew, since a few large files would make a few long tasks
    stored = scratch.write(assign(v, pivots, unit=True).repartition(4 * spark.sparkContext.defaultParallelism, "id"), "stored")
    sizes = cell_sizes(stored)
    if not sizes:
        return spark.createDataFrame([], schema)
    radius = float(np.sqrt(max(0.0, 2 - 2 * (least - 1e-6))))

    def met(first: int, last: int, part: int, parts: int) -> DataFrame:
        held = stored.filter(F.col("cell").between(first, last) & (F.pmod(F.xxhash64("id"), F.lit(parts)) == part)).select("id", "v", "cell").toArrow().combine_chunks().sort_by("cell")
        cell = held.column(2).to_numpy()
        cuts = np.flatnonzero(np.diff(cell, prepend=-1))
        cells = cell[cuts]
        x = held.column(1).combine_chunks().flatten().to_numpy().reshape(-1, width)
        shared = spark.sparkContext.broadcast((held.column(0).to_numpy(), x, np.append(cuts, len(cell)), cells, pivots[cells], np.array([sizes[c][0] for c in cells.tolist()])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if len(shared.value[0]):
                yield from _pairs_with(shared.value, batches, radius, least)

        return stored.filter(F.col("cell") <= last).select("id", "v", "cell").mapInArrow(run, schema)

    near = reduce(DataFrame.unionByName, [met(*block) for block in _cell_blocks(sizes, max(CELL, BLOCK_NUMBERS // width))])
    near = near.select("a", "b", F.round(F.least(F.greatest("similarity", F.lit(-1.0)), F.lit(1.0)), 6).alias("similarity")).filter(F.col("similarity") >= least)
    return near.distinct() if several else near


class VectorIndex:
    """Cells stored under ``path``: every vector in the folder of its cell, and each cell's pivot.

    Searches read the folders of the cells they ask for only. Pivots are fitted once on a bounded sample;
    vectors that are added later join the cell of their nearest pivot, and radii are those of what is stored.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/pivots").orderBy("cell").collect()  # MOST_CELLS at most
        self.pivots = np.array([r["v"] for r in rows], float).reshape(len(rows), -1)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, size: int = CELL) -> VectorIndex:
        """A new index of (id, embedding), about ``size`` vectors a cell; an index that is there is replaced. Vectors of another width than the most usual one are refused."""
        spark = vectors.sparkSession
        v, width = whole(vectors)
        pivots = choose_pivots(v, width, -(-v.count() // size))
        rows = [(i, p) for i, p in enumerate(pivots.tolist())]
        spark.createDataFrame(rows, "cell int, v array<double>").write.mode("overwrite").parquet(f"{path}/pivots")
        out = cls(spark, path)
        out._write(vectors, "overwrite")
        return out

    def add(self, vectors: DataFrame) -> None:
        """Store more vectors; ids that are there already are not replaced (``storage.VectorStore`` keeps one vector an id)."""
        self._write(vectors, "append")

    def _write(self, vectors: DataFrame, mode: str) -> None:
        width = self.pivots.shape[1]
        if not vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") != width)).isEmpty():
            raise ValueError(f"vectors of this index have {width} numbers")
        assign(whole(vectors, width)[0], self.pivots).repartition("cell").write.partitionBy("cell").mode(mode).parquet(f"{self.path}/vectors")

    @property
    def stored(self) -> DataFrame:
        return self.spark.read.schema("id long, v array<double>, d double, cell int").parquet(f"{self.path}/vectors")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """(query_id, id, score, rank) for (query_id, vector): exactly, or among the ``probes`` nearest cells of each query."""
        points = whole(queries.select(F.col("query_id").alias("id"), F.col("vector").alias("embedding")), self.pivots.shape[1])[0]
        return _search(self.stored, self.pivots, cell_sizes(self.stored), points, k, probes, False, Scratch(self.spark), prune=True)

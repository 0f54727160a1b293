"""Best-fit packing by linear grouping.

Items are the pieces of tokenised documents; only their lengths, whole numbers from
1 to the capacity, matter to the plan. So the plan is made from the histogram of
lengths (``capacity`` numbers at most, however many documents there are):

1. Large lengths are cut into groups of equal cardinality and rounded up to the
   longest of their group.
2. For these few sizes, configurations (multisets of sizes that fit a sequence) are
   optimised by column generation, and rounded down to whole sequences.
3. Actual lengths take the places of their group's size, in runs.
4. What is left, small lengths last, goes best-fit into the room that is left, again
   in runs, and into new sequences where none fits.

A run is (how many sequences, the lengths in them): the number of runs depends on the
capacity and the number of groups, not on the data. The documents get their places by
a distributed rank among the items of equal length, joined to the plan by length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .arrow import pieces
from .chunks import ChunkEncoder

#: Weight of the duals of the best bound when columns are priced, and how close to that bound the sequences have to come.
SMOOTH, CLOSE = 0.9, 1e-3
#: Items of one length are ranked in this many parts, so that a length with a third of all rows is no single task.
RANK_PARTS = 64


# ---- tokens -------------------------------------------------------------------------------------------------


@lru_cache(1)
def encoder(path: str, plain: bool = False) -> ChunkEncoder:
    """A function from texts to little-endian uint32 ids of a byte-level BPE tokenizer file; with ``plain``, special tokens' strings are text."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = plain
    tok.no_truncation()
    tok.no_padding()
    size = np.zeros(tok.get_vocab_size(), np.int64)
    for token, i in tok.get_vocab().items():
        size[i] = len(token)  # a byte-level token has one character for each byte

    def whole(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(texts: list[str]) -> list[bytes]:
        """All chunks in one text, cut apart again where their bytes end."""
        ids = np.array(tok.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum([len(t.encode()) for t in texts])
        cuts = np.searchsorted(np.cumsum(size[ids]), ends, side="left") + 1
        raw, at, out = ids.tobytes(), 0, []
        for c in (4 * cuts).tolist():
            out.append(raw[at:c])
            at = c
        return out

    return ChunkEncoder(lambda texts: apart(texts) if texts else [], whole, lines=True, limit=600_000)


PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of each document's ids plus ``end_id``: (doc_id, piece, start, length, ids_crc32).

    Documents over the capacity are cut so that all pieces but the first are full.
    Null and empty texts are one piece, the end id; a null doc_id stays null;
    repeated rows give repeated pieces; other columns of ``docs`` are not carried.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa

        enc = encoder(tokenizer_path)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            at = 0
            for part in pieces(texts):
                rows = []
                for d, x in zip(ids[at : at + len(part)], enc(part), strict=True):
                    x += end
                    n = len(x) // 4
                    start, k = 0, n % capacity or capacity
                    piece = 0
                    while start < n:
                        rows.append((d, piece, start, k, zlib.crc32(x[4 * start : 4 * (start + k)])))
                        start, k, piece = start + k, capacity, piece + 1
                at += len(part)
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=PIECES.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


# ---- plan ---------------------------------------------------------------------------------------------------


def linear_groups(hist: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of (nearly) equal cardinality from the longest down: (rounded size, [(length, how many)])."""
    total = sum(hist.values())
    left = {s: n for s, n in hist.items() if n > 0}
    out = []
    each = max(1, -(-total // max(1, groups)))
    room, now = each, []
    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            k = min(n, room)
            now.append((s, k))
            n -= k
            room -= k
            if not room:
                out.append((now[0][0], now))
                room, now = each, []
    if now:
        out.append((now[0][0], now))
    merged: dict[int, list] = {}
    for size, items in out:
        merged.setdefault(size, []).extend(items)
    return list(merged.items())


class Knapsack:
    """The multiset of sizes (ascending) within the capacity with the highest total value, for any values.

    As many capacities as the least size has units are solved at once, since they only look at lower ones.
    """

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity, self.blocks = sizes, capacity, []
        step = int(sizes[0])
        for c in range(step, capacity + 1, step):
            now = np.arange(c, min(c + step, capacity + 1))
            k = int(np.searchsorted(sizes, now[-1], side="right"))
            room = now[:, None] - sizes[None, :k]
            self.blocks.append((now, k, np.where(room >= 0, room, capacity + 1), np.arange(len(now))))

    def best(self, values: np.ndarray) -> tuple[float, np.ndarray]:
        best = np.zeros(self.capacity + 2)
        best[-1] = -np.inf
        pick = np.full(self.capacity + 1, -1)
        for now, k, room, all_rows in self.blocks:
            x = best[room] + values[:k]
            i = x.argmax(1)
            x = x[all_rows, i]
            before = best[now[0] - 1]
            top = np.maximum.accumulate(np.maximum(x, before))
            pick[now] = np.where(x > np.concatenate([[before], top[:-1]]) + 1e-12, i, -1)
            best[now] = top
        counts = np.zeros(len(self.sizes))
        c = self.capacity
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                counts[pick[c]] += 1
                c -= int(self.sizes[pick[c]])
        return float(best[self.capacity]), counts


def inverted(m: np.ndarray) -> np.ndarray:
    """The inverse of a square matrix by elimination with row pivots.

    Array operations only: BLAS starts threads, which may stall beside a JVM and whose number would change the plan.
    """
    n = len(m)
    a = np.concatenate([m, np.eye(n)], axis=1)
    for i in range(n):
        j = i + int(np.abs(a[i:, i]).argmax())
        if j != i:
            a[[i, j]] = a[[j, i]]
        a[i] /= a[i, i]
        factor = a[:, i].copy()
        factor[i] = 0
        a -= factor[:, None] * a[i]
    return a[:, n:].copy()


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 20_000) -> list[tuple[int, list[int]]]:
    """Whole numbers of sequences of each configuration: column generation on the few sizes, rounded down.

    Columns are priced by duals smoothed towards those of the best bound so far, which takes far fewer
    rounds. The inverse of the basis is updated by each column, and made anew at times against rounding errors.
    No product goes through BLAS, so the plan is the same for any number of threads.
    """
    order = np.argsort(sizes)
    s, need = np.array(sizes)[order], np.array(demand, float)[order]
    k = len(s)
    fill = Knapsack(s, capacity)
    each = (capacity // s).astype(float)
    basis, inverse = np.diag(each), np.diag(1 / each)
    x = need / each
    centre, bound = inverse.sum(0), 0.0
    for r in range(rounds):
        if r % 200 == 199:
            inverse = inverted(basis)
            x = np.maximum((inverse * need).sum(1), 0)
        duals = inverse.sum(0)
        pattern = None
        for weight in (SMOOTH, 0.0):
            at = weight * centre + (1 - weight) * duals
            worth, found = fill.best(at)
            least = float((at * need).sum()) / max(worth, 1.0)
            if least > bound:
                centre, bound = at / max(worth, 1.0), least
            if (found * duals).sum() > 1 + 1e-7:
                pattern = found
                break
        if pattern is None or x.sum() <= bound * (1 + CLOSE):
            break
        step = (inverse * pattern).sum(1)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        t = max(0.0, ratio[out])
        x = np.maximum(x - t * step, 0)
        x[out] = t
        basis[:, out] = pattern
        row = inverse[out] / step[out]
        inverse -= step[:, None] * row
        inverse[out] = row
    back = np.empty(k, int)
    back[order] = np.arange(k)
    return [(int(n + 1e-9), basis[back, j].astype(int).tolist()) for j, n in enumerate(x) if int(n + 1e-9) > 0]


def substitute(configs: list[tuple[int, list[int]]], groups: list[tuple[int, list[tuple[int, int]]]]) -> tuple[list[tuple[int, tuple[int, ...]]], dict[int, int]]:
    """Put actual lengths in the places of their group's size: runs of equal sequences, and the lengths left over."""
    stock = [list(reversed(items)) for _, items in groups]
    runs: list[tuple[int, tuple[int, ...]]] = []
    for n, pattern in configs:
        todo = [(n, ())]
        for g, times in enumerate(pattern):
            for _ in range(times):
                after = []
                for m, have in todo:
                    while m and stock[g]:
                        s, c = stock[g].pop()
                        k = min(m, c)
                        if c > k:
                            stock[g].append((s, c - k))
                        after.append((k, (*have, s)))
                        m -= k
                    if m:
                        after.append((m, have))
                todo = after
        runs += [r for r in todo if r[1]]
    left: defaultdict[int, int] = defaultdict(int)
    for items in stock:
        for s, c in items:
            left[s] += c
    return runs, dict(left)


def best_fit(runs: list[tuple[int, tuple[int, ...]]], left: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Put the lengths left over, longest first, where the least room remains; whole runs at a time."""
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for n, have in runs:
        by_room[capacity - sum(have)].append((n, have))
    rooms = sorted(by_room)

    def put(room: int, run: tuple[int, tuple[int, ...]]) -> None:
        if not by_room.get(room):
            i = bisect_left(rooms, room)
            if i == len(rooms) or rooms[i] != room:
                rooms.insert(i, room)
        by_room[room].append(run)

    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            i = bisect_left(rooms, s)
            while i < len(rooms) and not by_room[rooms[i]]:
                rooms.pop(i)
            if i < len(rooms):
                room = rooms[i]
                m, have = by_room[room].pop()
                k = min(m, n)
                if m > k:
                    by_room[room].append((m - k, have))
                put(room - s, (k, (*have, s)))
                n -= k
            else:
                each = capacity // s
                if n >= each:
                    put(capacity - each * s, (n // each, (s,) * each))
                    n %= each
                else:
                    put(capacity - n * s, (1, (s,) * n))
                    n = 0
    merged: defaultdict[tuple[int, ...], int] = defaultdict(int)
    for rs in by_room.values():
        for n, have in rs:
            merged[tuple(sorted(have, reverse=True))] += n
    return sorted(((n, h) for h, n in merged.items()), key=lambda r: r[1], reverse=True)


def plan(hist: dict[int, int], capacity: int = 1024, groups: int = 256, small: int | None = None) -> list[tuple[int, tuple[int, ...]]]:
    """Runs (how many sequences, their lengths) that hold each length of ``hist`` as often as it says.

    Lengths over ``small`` (by default an eighth of the capacity) are large: they are rounded up within the
    groups and configured. Lengths of the whole capacity are sequences of their own. What rounding up leaves
    of a configured sequence, small lengths fill.
    """
    small = capacity // 8 if small is None else small
    large = {s: n for s, n in hist.items() if small < s < capacity and n > 0}
    left = {s: n for s, n in hist.items() if s <= small and n > 0}
    runs = [(hist[capacity], (capacity,))] if hist.get(capacity) else []
    if large:
        gs = linear_groups(large, groups)
        configured, rest = substitute(configurations([s for s, _ in gs], [sum(c for _, c in items) for _, items in gs], capacity), gs)
        runs += configured
        for s, n in rest.items():
            left[s] = left.get(s, 0) + n
    return best_fit(runs, left, capacity)


# ---- documents to their places ------------------------------------------------------------------------------


def intervals(runs: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset) for each place of each run."""
    rank: defaultdict[int, int] = defaultdict(int)
    out, base = [], 0
    for n, have in runs:
        offset = 0
        for s in have:
            out.append((s, rank[s], rank[s] + n, base, offset))
            rank[s] += n
            offset += s
        base += n
    return out


def pack(items: DataFrame, capacity: int = 1024) -> DataFrame:
    """``items`` (with an integer column length, 1 to the capacity) plus sequence_id and offset.

    The driver gets the histogram of lengths (``capacity`` rows at most) and gives back
    places as intervals of ranks, a table whose size depends on the capacity and the
    number of groups only; both it and the rank offsets (``capacity * RANK_PARTS`` rows)
    are small by construction. Items of equal length are interchangeable; repeated rows
    get places of their own. An empty table gives an empty one. Columns sequence_id and
    offset of the input are replaced.
    """
    spark = items.sparkSession
    names = [c for c in items.columns if c not in ("length", "sequence_id", "offset")]
    # the row itself is one column, so that none of its names can clash with those used here
    row = F.struct(*names) if names else F.struct(F.lit(0).alias("none"))
    items = items.select(row.alias("row"), F.col("length").cast("long").alias("length")).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(RANK_PARTS)).cast("int"))
    sums = items.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).collect()  # capacity * RANK_PARTS rows at most
    hist: defaultdict[int, int] = defaultdict(int)
    firsts = []
    for r in sorted(sums, key=lambda r: (r["length"], r["part"])):
        firsts.append((r["length"], r["part"], hist[r["length"]]))
        hist[r["length"]] += r["n"]
    places = intervals(plan(dict(hist), capacity))
    first = spark.createDataFrame(firsts, "length long, part int, first long")
    at = spark.createDataFrame(places, "length long, lo long, hi long, base long, place long")
    ranked = items.withColumn("i", F.row_number().over(Window.partitionBy("length", "part").orderBy("row")) - 1).join(F.broadcast(first), ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("i") + F.col("first"))
    # Each length's intervals as one sorted array, so that a hot length is one probe and no fan-out.
    arrays = at.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("hi", "lo", "base", "place"))).alias("places"))
    placed = ranked.join(F.broadcast(arrays), "length").withColumn("p", F.element_at(F.filter("places", lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"])), 1))
    return placed.select(*(F.col("row")[c].alias(c) for c in names), "length", (F.col("p.base") + F.col("rank") - F.col("p.lo")).alias("sequence_id"), F.col("p.place").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenise, cut and pack: (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece.

    Pieces are written once to the shared folder, since the plan and the places both read them.
    """
    return pack(materialize(token_pieces(docs, tokenizer_path, capacity, end_id)), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

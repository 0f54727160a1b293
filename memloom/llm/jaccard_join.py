"""N-gram Jaccard join with prefix trees.

Documents are sets of hashed word n-grams in one global order: n-grams that many
documents share last, else by hash. Two sets that are similar enough share n-grams
among their first few, so only sets that do so meet. Each shared n-gram has a hub, the
set among its holders that shares most, and all sets that share an n-gram with a hub are
its neighbourhood: two sets that link are in one. Neighbourhoods are dealt in bounded
blocks; in each, the ordered sets are stored in a trie, and all sets descend it together,
sharing the overlap of common beginnings and leaving subtrees whose set sizes and
remaining lengths can't reach the threshold.

Texts with equal sets are one class, so copies cost nothing here. Components need not
all links but all that join two components: the parts of a large neighbourhood are first
compared each for itself, together with the hub; then sets of different components
across the parts. No link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: N-grams that are ordered last: the most frequent ones of the corpus, this many at most.
HOT = 100_000
#: An n-gram counts as frequent from this many occurrences on, as counted within blocks of documents.
HOT_LEAST = 24
#: Sets that link share at least one in so many n-grams among their first ones, which are that many more.
SHARE = 20
#: Sets in one part of a block at most, as dealt by hash (two parts of a large neighbourhood meet in a block) ...
BLOCK = 512
#: ... and n-grams in them at most (a larger set is a part of its own).
BLOCK_GRAMS = 400_000
#: Cells of the table in which sets descend a trie at most; more sets descend in turns.
CELLS = 4_000_000
#: Bytes of text that are hashed at once.
HASHED = 1 << 20
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
_BASE = 0xD1342543DE82EF95


# ---- sets ---------------------------------------------------------------------------------------------------


@lru_cache(1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """A number for each byte, the same for A-Z as for a-z, and which bytes part words."""
    value = np.frombuffer(b"".join(hashlib.md5(bytes([c])).digest()[:8] for c in range(256)), np.uint64).copy()
    value[65:91] = value[97:123]
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return value, space


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base from 0 to ``n``, and those of its inverse, modulo 2**64."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n + 1, np.uint64(base))
        p[0] = 1
        both.append(np.cumprod(p, dtype=np.uint64))
    return both[0], both[1]


def _hash_words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a piece of text, and their first places; a word ends where a text begins."""
    value, space = _bytes()
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[begins] = True
    edge[0] = edge[-1] = True
    first = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]])))
    last = np.flatnonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]])))
    up, down = _powers(max(HASHED, 1 << int(len(data)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[data] * up[: len(data)], dtype=np.uint64)])
    h = (sums[last + 1] - sums[first]) * down[first] + (last - first).astype(np.uint64) * _MULTIPLIERS[0]
    h = (h ^ (h >> np.uint64(32))) * _MULTIPLIERS[1]
    return h ^ (h >> np.uint64(29)), first


def _word_hashes(data: np.ndarray) -> np.ndarray:
    """The hashes of one text's words, a bounded piece of it at a time; a piece ends at white space."""
    space, out, at = _bytes()[1], [], 0
    while at < len(data):
        end = min(at + HASHED, len(data))
        while end < len(data) and not (found := np.flatnonzero(space[data[at:end]])).size:
            end = min(end + HASHED, len(data))  # one long word
        if end < len(data):
            end = at + int(found[-1]) + 1
        out.append(_hash_words(data[at:end], np.zeros(1, np.int64))[0])
        at = end
    return np.concatenate([*out, np.zeros(0, np.uint64)])


def _windows(w: np.ndarray, k: int) -> np.ndarray:
    """63-bit hashes of all runs of ``k`` words."""
    n = len(w) - k + 1
    x = np.full(max(n, 0), np.uint64(k))
    for i in range(k):
        x = (x ^ w[i : n + i]) * _MULTIPLIERS[i % 8] if n > 0 else x
        x ^= x >> np.uint64(29)
    return x >> np.uint64(1)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _set(w: np.ndarray, size: int) -> np.ndarray:
    return _distinct(_windows(w, min(size, len(w)))) if len(w) else w


def ngrams(text: str, size: int) -> np.ndarray:
    """63-bit hashes of the distinct n-grams, sorted; fewer words than ``size`` are one n-gram, no words none. A-Z count as a-z."""
    return _set(_word_hashes(np.frombuffer(text.encode(), np.uint8)), size)


def ngram_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """``ngrams`` of each text of a column (null: empty); the texts of a piece of about HASHED bytes are hashed together."""
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + HASHED, side="right")) - 1)
        piece, begins = data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        if to == at + 1:
            yield _set(_word_hashes(piece), size)
        else:
            w, first = _hash_words(piece, begins)
            x, cuts = _windows(w, size), np.searchsorted(first, begins)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield _distinct(x[a : b - size + 1]) if b - a >= size else _set(w[a:b], size)
        at = to


def ordered(grams: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The set in the global order: as numbers of which frequent n-grams have the highest bit."""
    if not len(hot) or not len(grams):
        return grams
    at = np.searchsorted(hot, grams)
    last = hot[np.minimum(at, len(hot) - 1)] == grams
    return np.concatenate([grams[~last], grams[last] | np.uint64(1 << 63)]) if last.any() else grams


def class_id(grams: np.ndarray) -> int:
    """One number for a set."""
    return int.from_bytes(hashlib.md5(grams.tobytes()).digest()[:8], "little", signed=True)


def least_shared(n: int) -> int:
    """How many of their first n-grams two sets that link must share, by the size of the smaller one."""
    return max(1, n // SHARE)


def prefix_length(n: int, percent: int) -> int:
    """How many of a set's first n-grams must hold that many of any set that it links with."""
    return n - -(-percent * n // 100) + least_shared(n)


def links(shared: int, n: int, m: int, percent: int) -> bool:
    return (100 + percent) * shared >= percent * (n + m)


# ---- prefix trees -------------------------------------------------------------------------------------------


def _tree(s: list[np.ndarray]) -> list[tuple[int, int, int, int, list[int]]]:
    """The trie of sorted sequences, as nodes: first and last sequence below, where its own values begin and end, its children."""
    common = []
    for a, b in zip(s, s[1:], strict=False):
        k = min(len(a), len(b))
        differ = np.flatnonzero(a[:k] != b[:k])
        common.append(int(differ[0]) if len(differ) else k)
    nodes: list[tuple[int, int, int, int, list[int]]] = []
    stack = [(0, len(s), 0, -1)]
    while stack:
        lo, hi, depth, parent = stack.pop()
        end = min(common[lo : hi - 1], default=len(s[lo]))
        me = len(nodes)
        nodes.append((lo, hi, depth, end, []))
        if parent >= 0:
            nodes[parent][4].append(me)
        start = lo
        while start < hi and len(s[start]) == end:  # these end in the node itself
            start += 1
        for i in range(start, hi):
            if i + 1 == hi or common[i] <= end:
                stack.append((start, i + 1, end, me))
                start = i + 1
    return nodes


def trie_join(sets: list[np.ndarray], labels: list[int], percent: int, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs (of places in ``sets``) that link sets of different components; ``labels`` are the components known before.

    Pairs whose components have been joined by earlier pairs are left out. With ``sides``, sets of one side
    (0 or more) have been compared before. Equal sets must have been made one. Only n-grams that two of the
    sets have are stored in the trie, since no other can be shared; bounds use the whole sets' sizes.
    """
    n = len(sets)
    grams, at, times = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    v = int((times > 1).sum())
    cuts = np.cumsum([0, *map(len, sets)])
    short = [place[k[times[k] > 1]] for k in (at[cuts[i] : cuts[i + 1]] for i in range(n))]
    keys = [x.astype(">u4").tobytes() for x in short]
    order = sorted(range(n), key=keys.__getitem__)
    s = [short[i] for i in order]
    size, lab = np.array([len(sets[i]) for i in order]), np.array([labels[i] for i in order])
    side = np.array([sides[i] if sides else -1 for i in order])
    rest = np.array([len(x) for x in s])
    nodes = _tree(s)
    bounds = []  # least and most set size, longest sequence, and the one label and side below, if there is one
    for lo, hi, *_ in nodes:
        one, same = lab[lo] if (lab[lo:hi] == lab[lo]).all() else None, side[lo] if side[lo] >= 0 and (side[lo:hi] == side[lo]).all() else None
        bounds.append((size[lo:hi].min(), size[lo:hi].max(), rest[lo:hi].max(), one, same))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    turn = max(1, CELLS // (v + 1))
    for begin in range(0, n, turn):
        some = np.arange(begin, min(begin + turn, n))  # the sets that descend in this turn
        has = np.zeros((v + 1, len(some)), np.uint8)
        for j, q in enumerate(some):
            has[s[q], j] = 1
        left = np.cumsum(has[::-1], axis=0, dtype=np.int32)[::-1]  # n-grams that a set has from a place on
        todo = [(0, some, np.zeros(len(some), np.int64))]
        while todo:
            me, q, shared = todo.pop()
            lo, hi, depth, end, children = nodes[me]
            least, most, longest, one, same = bounds[me]
            ok = (q < hi - 1) & (100 * np.minimum(size[q], most) >= percent * np.maximum(size[q], least))
            if one is not None:
                ok &= lab[q] != one
            if same is not None:
                ok &= side[q] != same
            q, shared = q[ok], shared[ok]
            if not len(q):
                continue
            if end > depth:
                own = s[lo][depth:end]
                shared = shared + has[own].sum(0, dtype=np.int64)[q - begin]
                remaining = left[own[-1] + 1, q - begin]
            else:
                remaining = left[s[lo][end - 1] + 1 if end else 0, q - begin]
            ok = (100 + percent) * (shared + np.minimum(remaining, longest - end)) >= percent * (size[q] + least)
            q, shared = q[ok], shared[ok]
            at_node = lo
            while at_node < hi and rest[at_node] == end and len(q):
                y = at_node
                hit = (q < y) & (lab[q] != lab[y]) & ((side[q] != side[y]) | (side[q] < 0)) & ((100 + percent) * shared >= percent * (size[q] + size[y]))
                for x in q[hit].tolist():
                    a, b = find(int(lab[x])), find(int(lab[y]))
                    if a != b:
                        root[a] = b
                        out.append((order[x], order[y]))
                at_node += 1
            if len(q):
                todo += [(c, q, shared) for c in children]
    return out


# ---- components ---------------------------------------------------------------------------------------------


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): the least node of each one's component, by large and small stars; written as ``name``."""
    work = f"{name}_edges"
    now = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), work)
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.write(moved.union(small.select("u", F.col("m").alias("v"))).distinct(), work)
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if sign == seen:
            break
        seen = sign
    out = scratch.write(now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v"), F.col("v")).distinct()).distinct(), name)
    scratch.drop(work)
    return out


# ---- corpus -------------------------------------------------------------------------------------------------


def survey(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, cid) of each document, and in rows of their own (gram, times): n-grams that occur often in a block of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["doc_id", "n", "cid", "gram", "times"], [pa.int64()] * 5
        kept, held, seen = [], 0, set()

        def often() -> pa.RecordBatch:
            grams, times = np.unique(np.concatenate([*kept, np.zeros(0, np.uint64)]), return_counts=True)
            grams, times = grams[times >= 3].astype(np.int64), times[times >= 3]
            none = pa.nulls(len(grams), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.array(grams), pa.array(times.astype(np.int64))], names=names)

        for b in batches:
            n, cid = [], []
            for g in ngram_sets(b.column(1), size):
                n.append(len(g))
                cid.append(class_id(g) if len(g) else None)
                if cid[-1] not in seen:
                    seen.add(cid[-1])
                    kept.append(g)
                    held += len(g)
                if held > 4_000_000:
                    yield often()
                    kept, held, seen = [], 0, set()
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), none, none], names=names)
        yield often()

    return docs.mapInArrow(run, "doc_id long, n long, cid long, gram long, times long")


def prefixes(docs: DataFrame, size: int, percent: int, hot) -> DataFrame:
    """(doc_id, cid, n, grams) of each document with words: the first n-grams in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 4
            values = np.concatenate([*cols[3], np.zeros(0, np.int64)])
            ends = np.cumsum([0, *map(len, cols[3])]).astype(np.int32)
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["doc_id", "cid", "n", "grams"])

        for b in batches:
            rows, held = [], 0
            for d, g in zip(b.column(0).to_pylist(), ngram_sets(b.column(1), size), strict=True):
                if len(g):
                    first = ordered(g, hot.value)[: prefix_length(len(g), percent)].view(np.int64)
                    rows.append((d, class_id(g), len(g), first))
                    held += len(first)
                if held > 1_000_000:
                    yield out(rows)
                    rows, held = [], 0
            yield out(rows)

    return docs.mapInArrow(run, "doc_id long, cid long, n long, grams array<long>")


def join_blocks(members: DataFrame, size: int, percent: int, hot) -> DataFrame:
    """Links (a, b) within blocks of (block, cid, label, side, text), each block in one task and bounded.

    Texts, which compress, are dealt instead of sets; a text of another row with the same id is left out.
    """

    def solve(parts: list[tuple[pa.Array, ...]]) -> list[tuple[int, int]]:
        found: dict[int, tuple[int, int, np.ndarray]] = {}
        for cids, labels, sides, texts in parts:
            for cid, label, side, g in zip(cids.to_pylist(), labels.to_pylist(), sides.to_pylist(), ngram_sets(texts, size), strict=True):
                if cid not in found and len(g) and class_id(g) == cid:
                    found[cid] = (label, side, ordered(g, hot.value))
        if len(found) < 2:
            return []
        cids, (labels, sides, sets) = list(found), zip(*found.values(), strict=True)
        return [(cids[i], cids[j]) for i, j in trie_join(list(sets), list(labels), percent, list(sides))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            out = []
            blocks = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)] if len(blocks) else [0]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if blocks[i] != now:
                    out += solve(parts)
                    now, parts = blocks[i], []
                parts.append(tuple(b.column(c).slice(i, j - i) for c in range(1, 5)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
        if out := solve(parts):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    dealt = members.select("block", "cid", "label", "side", "text").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, "a long, b long")


def shared_rows(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows (gram, cid, n) whose n-gram another set has too; written as ``name``."""
    twice = scratch.write(rows.groupBy("gram").count().filter("count > 1").select("gram"), "twice")
    out = scratch.write(rows.join(twice, "gram", "left_semi"), name)
    scratch.drop("twice")
    return out


def enough(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of the sets that share as many first n-grams as a link needs: a partner may be smaller, but by ``percent`` at most."""
    need = F.greatest(F.lit(1), F.floor((F.col("n") * percent / 100) / SHARE) - 1)
    return rows.join(rows.groupBy("cid", "n").count().filter(F.col("count") >= need).select("cid"), "cid", "left_semi")


def neighbourhoods(near: DataFrame) -> DataFrame:
    """(hub, cid, n): for each n-gram of (gram, cid, n) its holders, with the one of them as hub that shares most.

    What a set shares is the sum over its n-grams of the logarithm of their holders, in whole
    numbers, so that a group of near copies has one hub for nearly all of its n-grams.
    """
    holders = near.groupBy("gram").agg((F.log2(F.count(F.lit(1))) * 16).cast("long").alias("w"))
    weight = near.join(holders, "gram").groupBy("cid").agg(F.sum("w").alias("w"))
    hubs = near.join(weight, "cid").groupBy("gram").agg(F.max_by("cid", F.struct("w", "cid")).alias("hub"))
    return near.join(hubs, "gram").select("hub", "cid", "n").distinct()


def _parts(count, grams):
    return F.greatest(F.ceil(count / BLOCK), F.ceil(grams / BLOCK_GRAMS)).cast("long")


def own_blocks(members: DataFrame) -> DataFrame:
    """(block, cid, label, side): each neighbourhood in parts that all hold the hub, each part compared for itself."""
    parts = members.groupBy("hub").agg(_parts(F.count(F.lit(1)), F.sum("n")).alias("parts"))
    dealt = members.join(parts, "hub").select("hub", "cid", F.pmod(F.xxhash64("cid"), F.col("parts")).alias("part"))
    hubs = dealt.filter("cid <> hub").select("hub", F.col("hub").alias("cid"), "part").distinct()
    blocks = dealt.filter("cid <> hub").union(hubs)
    return blocks.select(F.xxhash64("hub", "part").alias("block"), "cid", F.col("cid").alias("label"), F.lit(-1).alias("side"))


def cross_blocks(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(block, cid, label, side): the sets of a neighbourhood of several parts, dealt so that all of different components meet.

    The sets of its most frequent component need not meet each other; so the parts of the
    others meet them and each other. Two sets of equal sides in a block need not be compared.
    """
    large = members.groupBy("hub").agg(_parts(F.count(F.lit(1)), F.sum("n")).alias("parts")).filter("parts > 1").select("hub")
    rows = members.join(large, "hub").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    sums = rows.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    split = sums.groupBy("hub").agg(F.max_by(F.struct("label", "c", "s"), F.struct("c", "label")).alias("m"), F.sum("c").alias("c"), F.sum("s").alias("s")).filter("c > m.c")
    plan = split.select("hub", F.col("m.label").alias("main"), _parts(F.col("m.c"), F.col("m.s")).alias("mains"), _parts(F.col("c") - F.col("m.c"), F.col("s") - F.col("m.s")).alias("others"))
    in_main = F.col("label") == F.col("main")
    own = F.pmod(F.xxhash64("cid", F.lit(1)), F.when(in_main, F.col("mains")).otherwise(F.col("others"))) + F.when(in_main, 0).otherwise(F.col("mains"))
    met = F.explode(F.sequence(F.when(in_main, F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("others") - 1))
    pairs = rows.join(plan, "hub").select("hub", "cid", "label", own.alias("own"), met.alias("met"))
    side = F.when(F.col("own") < F.col("met"), 0).when(F.col("own") > F.col("met"), 1).otherwise(-1)
    return pairs.select(F.xxhash64("hub", F.least("own", "met"), F.greatest("own", "met")).alias("block"), "cid", "label", side.alias("side"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text): the least doc_id reachable by links.

    Two documents link if the Jaccard similarity of their sets of word n-grams is
    ``percent`` or more in a hundred. Null and empty texts, and texts of white space, have
    an empty set and link with nothing; equal sets always link. Rows with a null doc_id
    get the component of their class's least doc_id, null if it has none. Repeated rows
    are one class; other columns are ignored; an empty table gives an empty one.
    N-grams are compared by 63-bit hashes, sets by 64 bits of a digest.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    seen = scratch.write(survey(docs, size), "seen")
    rows = seen.filter("gram is null").select("doc_id", "n", "cid")
    often = seen.filter("gram is not null").groupBy("gram").agg(F.sum("times").alias("t")).filter(F.col("t") >= HOT_LEAST).orderBy(F.desc("t"), "gram").limit(HOT)
    hot = spark.sparkContext.broadcast(np.sort(often.select("gram").toArrow()["gram"].to_numpy().astype(np.uint64)))
    classes = rows.filter("cid is not null and doc_id is not null").groupBy("cid").agg(F.min("doc_id").alias("doc_id"))
    first = scratch.write(prefixes(docs, size, percent, hot).join(classes, ["cid", "doc_id"], "left_semi").select("cid", "n", "grams"), "first")

    # sets meet where they share enough of their first n-grams; those of single sets go first, then the sets that are left with too few
    some = shared_rows(first.dropDuplicates(["cid"]).select("cid", "n", F.explode("grams").alias("gram")), scratch, "some")
    near = shared_rows(enough(some, percent), scratch, "near")
    scratch.drop("first", "some")
    ids = classes.join(near.select("cid").distinct(), "cid", "left_semi")
    texts = scratch.write(docs.join(ids, "doc_id").select("cid", "text"), "texts")
    members = scratch.write(neighbourhoods(near), "members")
    scratch.drop("near")

    found = scratch.write(join_blocks(own_blocks(members).join(texts, "cid"), size, percent, hot), "found")
    labels = components(found, scratch, "own")
    more = scratch.write(join_blocks(cross_blocks(members, labels).join(texts, "cid"), size, percent, hot), "more")
    scratch.drop("members", "texts")
    labels = components(found.union(more), scratch, "labels")
    scratch.drop("found", "more", "own")
    least = labels.join(classes.withColumnRenamed("cid", "node"), "node").groupBy("label").agg(F.min("doc_id").alias("component"))
    of = labels.join(least, "label").select(F.col("node").alias("cid"), "component")
    known = classes.join(of, "cid", "left").select("cid", F.coalesce("component", "doc_id").alias("component"))
    out = rows.join(known, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))

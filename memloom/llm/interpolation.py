"""Language-model scores by deleted interpolation.

An n-gram's probability is its share of its context's occurrences in the training documents (its
maximum-likelihood estimate), mixed with the probability of the next shorter n-gram:

    P_k(w | c) = weight_k(how often c occurs) * count(c w) / count(c) + (1 - weight_k) * P_k-1(w | shorter c)

down to single tokens and a uniform share for each known token and one for all unknown ones. Weights
depend on the power of two below the context's frequency. They are learned by expectation-maximisation
on documents that are left out of the counts meanwhile; the scores then use the counts of all
training documents.

The n-grams of the whole corpus are counted. A task numbers the distinct n-grams of a block of
documents and asks for their counts by sorted 64-bit hashes, cut at fixed hash values: each range of
hashes is one group, which sums the counts of all blocks and answers every block in the order
in which it asked. So a shuffle carries each distinct n-gram of a block once, a frequent one no more
often than a rare one, and an answer is a count without a key. The ranges are so many that a group
has about GROUP n-grams, however large the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .arrow import ROWS, pieces

#: Tokens of a block, and n-grams of a range of hashes (about).
BLOCK, GROUP = 2_000_000, 2_000_000
#: What a block's documents are for: counts, weights, or neither.
RETAINED, TUNING, NEW = 0, 1, 2
#: One training document in so many learns weights.
TUNE = 10
#: Weights are learned from how often each ratio of the two estimates occurs, by steps of this part of a factor of two.
STEPS = 32
#: Context frequencies from this power of two on share a weight.
BUCKETS = 48
#: Characters of a text that are cut into words at once.
LONG = 1 << 22

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END, BEGIN = 0, 1
#: Words cannot be white space, so these stand for the end and the begin of a text.
_MARKS = (b"\n", b"\t")


# ---- arrays as bytes that compress well ---------------------------------------------------------------------


def planes(x: np.ndarray) -> bytes:
    """Whole numbers as their lowest bytes, then their next bytes, and so on, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def joined(raw: bytes, kind: type) -> np.ndarray:
    """The inverse of ``planes``."""
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


# ---- blocks of documents ------------------------------------------------------------------------------------


class Numbers(dict):
    """Words by the order in which they are first met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def words(text: str) -> Iterator[list[bytes]]:
    """The words of a text, A-Z in lower case, in lists of bounded length."""
    raw, at = text.encode().translate(_LOWER), 0
    while at < len(raw):
        end = raw.find(b" ", at + LONG)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


class Block:
    """Documents of one use, as numbers of their words."""

    def __init__(self):
        self.numbers = Numbers({w: i for i, w in enumerate(_MARKS)})
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.tokens: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, text: str) -> None:
        get, n = self.numbers.__getitem__, 1
        for some in words(text):
            self.tokens.append(np.fromiter(map(get, some), np.uint32, len(some)))
            n += len(some)
        self.tokens.append(np.zeros(1, np.uint32))
        self.ids.append(doc_id)
        self.sizes.append(n)
        self.held += n

    def row(self) -> tuple[list[int | None], list[int], bytes, bytes, int]:
        """Ids and sizes of the documents, hashes of the words (frequent ones first; as differences) and numbers of the tokens, number of tokens."""
        import xxhash

        tokens = np.concatenate(self.tokens)
        marks = len(_MARKS)
        often = np.bincount(tokens, minlength=len(self.numbers))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.numbers), np.uint64, len(self.numbers))
        # words that are equally frequent by ascending hashes, whose differences are shorter
        order = np.concatenate([np.arange(marks), marks + np.lexsort((hashes[marks:], -often[marks:]))])
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        return self.ids, self.sizes, planes(np.diff(hashes[order], prepend=np.uint64(0))), planes(place[tokens]), self.held


def uses(doc_id: Column) -> Column:
    """What a document is for: NEW for the fold that is not learned from and for a null id, TUNING for one training document in TUNE."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    return F.when(doc_id.isNull() | (h % 5 == 1), NEW).when((h / 5).cast("long") % TUNE == 0, TUNING).otherwise(RETAINED)


def blocks(docs: DataFrame) -> DataFrame:
    """The documents (doc_id, text) in blocks of one use: (block, use, n_tokens, ids, sizes, hashes, tokens)."""

    def give(number, use, block):
        ids, sizes, hashes, tokens, n = block.row()
        cols = [pa.array([number], pa.int64()), pa.array([use], pa.int32()), pa.array([n], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([hashes]), pa.array([tokens])]
        return pa.RecordBatch.from_arrays(cols, names=["block", "use", "n_tokens", "ids", "sizes", "hashes", "tokens"])

    def run(batches):
        number, now = TaskContext.get().partitionId() << 32, [Block(), Block(), Block()]
        for b in batches:
            for first in range(0, len(b), ROWS):
                some = b.slice(first, ROWS)
                ids, use = some.column(0).to_pylist(), some.column(2).to_pylist()
                at = 0
                for part in pieces([t or "" for t in some.column(1).to_pylist()]):
                    for t in part:
                        block = now[use[at]]
                        block.add(ids[at], t)
                        if block.held >= BLOCK:
                            yield give(number, use[at], block)
                            now[use[at]] = Block()
                            number += 1
                        at += 1
        for u, block in enumerate(now):
            if block.held:
                yield give(number, u, block)
                number += 1

    cols = F.col("doc_id").cast("long"), F.col("text").cast("string"), uses(F.col("doc_id").cast("long"))
    return docs.select(*cols).mapInArrow(run, "block long, use int, n_tokens long, ids array<long>, sizes array<long>, hashes binary, tokens binary")


# ---- n-grams of a block -------------------------------------------------------------------------------------


def _mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of their context and of their last word."""
    x = context * np.uint64(0x9E3779B97F4A7C15) + (word ^ (word >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Grams:
    """The n-grams of one length in a block: hash and occurrences of each, and the number of each token's own."""

    def __init__(self, hashes: np.ndarray, often: np.ndarray, of_token: np.ndarray):
        self.hashes, self.often, self.of_token = hashes, often, of_token

    def order(self) -> np.ndarray:
        return np.argsort(self.hashes, kind="stable")


def grams(hashes: bytes, tokens: bytes, sizes: np.ndarray, longest: int) -> Iterator[Grams]:
    """Of each length up to ``longest``, one length after another. Single tokens include the begin mark, which occurs once a document."""
    word_hash, token = np.cumsum(joined(hashes, np.uint64), dtype=np.uint64), joined(tokens, np.uint32)
    first = np.cumsum(sizes) - sizes
    often = np.bincount(token, minlength=len(word_hash))
    often[BEGIN] = len(sizes)
    last = Grams(word_hash, often, token)
    yield last
    for _ in range(1, longest):
        # the context's number; texts begin with a context of begin marks alone, which is numbered after all others
        key = np.empty(len(token), np.int64)
        key[1:] = last.of_token[:-1]
        key[first] = len(last.hashes)
        key *= len(word_hash)
        key += token
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.concatenate([[True], key[1:] != key[:-1]])
        of_token = np.empty(len(token), np.uint32)
        of_token[order] = np.cumsum(starts, dtype=np.uint32) - np.uint32(1)
        del order
        starts = np.flatnonzero(starts)
        key = key[starts]
        often = np.diff(starts, append=len(token))
        context_hash = np.concatenate([last.hashes, word_hash[[BEGIN]]])
        last = Grams(_mixed(context_hash[key // len(word_hash)], word_hash[key % len(word_hash)]), often, of_token)
        del key, starts, context_hash
        yield last


def bounds(parts: int) -> np.ndarray:
    """The first hash of each range but the first."""
    return np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)


def requests(found: DataFrame, longest: int, parts: int) -> DataFrame:
    """(part, block, use, length, grams, often): each block's n-grams of each length by ranges of hashes, ascending, as differences; often is null for blocks that are not learned from."""

    def run(batches):
        cut = bounds(parts)
        for b in batches:
            for i in range(len(b)):
                block, use, hashes, tokens = (b.column(c)[i].as_py() for c in ("block", "use", "hashes", "tokens"))
                for length, g in enumerate(grams(hashes, tokens, np.array(b.column("sizes")[i].as_py()), longest), 1):
                    order = g.order()
                    h, n = g.hashes[order], g.often[order].astype(np.uint32)
                    ends = [0, *np.searchsorted(h, cut).tolist(), len(h)]
                    some = [(p, planes(np.diff(h[i:j], prepend=np.uint64(0))), None if use == NEW else planes(n[i:j])) for p, (i, j) in enumerate(zip(ends, ends[1:], strict=False)) if i < j]
                    k = len(some)
                    cols = list(zip(*some, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([block] * k, pa.int64()), pa.array([use] * k, pa.int32()), pa.array([length] * k, pa.int32()), pa.array(cols[1]), pa.array(cols[2], pa.binary())], names=["part", "block", "use", "length", "grams", "often"])

    return found.select("block", "use", "sizes", "hashes", "tokens").mapInArrow(run, "part int, block long, use int, length int, grams binary, often binary")


def answers(asked: DataFrame, parts: int) -> DataFrame:
    """(block, use, length, part, trained, retained, known): how often each n-gram that a block asked for occurs in all training documents, and in those that weights are not learned from (for blocks that learn them); known: distinct training n-grams of that length and range, on one row."""

    def total(t: pa.Table) -> pa.Table:
        part, rows = t["part"][0].as_py(), []
        for length in sorted(set(t["length"].to_pylist())):
            mine = t.filter(pa.compute.equal(t["length"], length))
            use, block = mine["use"].to_pylist(), mine["block"].to_pylist()
            hashes = [np.cumsum(joined(x, np.uint64), dtype=np.uint64) for x in mine["grams"].to_pylist()]
            size = np.array(list(map(len, hashes)))
            every, at = np.unique(np.concatenate(hashes), return_inverse=True)
            del hashes
            at, known, end = at.astype(np.uint32), len(every), np.cumsum(size)
            del every
            retained, trained = np.zeros(known, np.int64), np.zeros(known, np.int64)
            for k, (u, often) in enumerate(zip(use, mine["often"].to_pylist(), strict=True)):
                if u != NEW:
                    # an n-gram stands once in a block
                    here, n = at[end[k] - size[k] : end[k]], joined(often, np.uint32)
                    trained[here] += n
                    if u == RETAINED:
                        retained[here] += n
            for k, (b, u) in enumerate(zip(block, use, strict=True)):
                here = at[end[k] - size[k] : end[k]]
                rows.append((b, u, length, part, planes(trained[here]), planes(retained[here]) if u == TUNING else None, int((trained > 0).sum()) if k == 0 else 0))
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["block", "use", "length", "part", "trained", "retained", "known"])

    return asked.repartition(parts, "part").groupBy("part").applyInArrow(total, "block long, use int, length int, part int, trained binary, retained binary, known long")


# ---- the model ----------------------------------------------------------------------------------------------


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for contexts that never occur, else one more than the power of two below the frequency."""
    return np.where(context > 0, np.minimum(np.frexp(np.maximum(context, 1).astype(float))[1], BUCKETS), 0).astype(np.int8)


def mixed(found: Iterator[tuple[Grams, np.ndarray]], sizes: np.ndarray, n_tokens: int, known: int, weights: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, from its n-grams and their counts: each token's bucket, maximum-likelihood estimate (0 in bucket 0), and probability by the shorter ones; then the probability by all that have weights.

    Single tokens are all in bucket 1.
    """
    first = np.cumsum(sizes) - sizes
    context, begins, p = None, 0, None
    for k, (g, counts) in enumerate(found):
        own = counts[g.of_token]
        if context is None:
            begins, p = counts[BEGIN], np.full(len(own), 1 / (known + 1))
            b, estimate = np.full(len(own), int(n_tokens > 0), np.int8), own / max(n_tokens, 1)
        else:
            b, estimate = bucket(context), own / np.maximum(context, 1)
        context = np.empty(len(own), np.int64)
        context[1:] = own[:-1]
        context[first] = begins
        del own
        yield b, estimate, p
        if k < len(weights):
            w = weights[k][b]
            p = w * estimate + (1 - w) * p
    yield np.zeros(0), np.zeros(0), p


def learned(ratios: list[tuple[int, int | None, int]], rounds: int = 1000) -> np.ndarray:
    """The weight of each bucket by expectation-maximisation, from (bucket, cell, how many tokens).

    A cell is the rounded logarithm of how many times the estimate is the shorter n-grams' probability, None
    for an estimate of 0. Each bucket has one imagined token for and one against, so that no weight is 0 or 1.
    A bucket without tokens takes the weight of the one before it; bucket 0 has none.
    """
    out, last = np.zeros(BUCKETS + 1), 0.5
    for b in range(1, BUCKETS + 1):
        mine = [(0.0 if c is None else 2.0 ** (c / STEPS), n) for i, c, n in sorted(ratios, key=repr) if i == b]
        if mine:
            r, n = (np.array(x, float) for x in zip(*mine, strict=True))
            w = 0.5
            for _ in range(rounds):
                new = (float((n * w * r / (w * r + 1 - w)).sum()) + 1) / (float(n.sum()) + 2)
                if abs(new - w) < 1e-12:
                    break
                w = new
            last = w
        out[b] = last
    return out


def _counted(block: pa.Table, told: pa.Table, column: str, longest: int) -> Iterator[tuple[Grams, np.ndarray]]:
    """The n-grams of a block, length by length, with the counts in its answers."""
    told = told.sort_by([("length", "ascending"), ("part", "ascending")])
    lengths, raw = np.array(told["length"].to_pylist()), told[column]
    for k, g in enumerate(grams(block["hashes"][0].as_py(), block["tokens"][0].as_py(), np.array(block["sizes"][0].as_py()), longest), 1):
        n = np.empty(len(g.hashes), np.int64)
        n[g.order()] = np.concatenate([joined(raw[int(i)].as_py(), np.int64) for i in np.flatnonzero(lengths == k)])
        yield g, n


def ratios(found: DataFrame, told: DataFrame, weights: list[np.ndarray], n_tokens: int, known: int) -> DataFrame:
    """(bucket, cell, n) over all tokens of the blocks that learn weights, for the length after those that have them."""
    length = len(weights) + 1

    def cells(block: pa.Table, told: pa.Table) -> pa.Table:
        sizes = np.array(block["sizes"][0].as_py())
        for k, (b, estimate, p) in enumerate(mixed(_counted(block, told, "retained", length), sizes, n_tokens, known, weights), 1):
            if k == length:
                break
        seen = estimate > 0
        cell = np.where(seen, np.rint(np.log2(np.where(seen, estimate, 1) / p) * STEPS), np.nan)
        key = np.where(seen, cell, -1e6)
        every, n = np.unique(np.stack([b.astype(float), key], 1)[b > 0], axis=0, return_counts=True)
        return pa.table({"bucket": pa.array(every[:, 0].astype(np.int32)), "cell": pa.array(every[:, 1].astype(np.int32), mask=every[:, 1] == -1e6), "n": pa.array(n.astype(np.int64))})

    mine = found.filter(F.col("use") == TUNING).select("block", "sizes", "hashes", "tokens")
    theirs = told.filter((F.col("use") == TUNING) & (F.col("length") <= length)).select(F.col("block").alias("to"), "length", "part", "retained")
    return mine.groupBy("block").cogroup(theirs.groupBy("to")).applyInArrow(cells, "bucket int, cell int, n long").groupBy("bucket", "cell").agg(F.sum("n").alias("n"))


def interpolated_scores(docs: DataFrame, longest: int = 2) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are the words between ASCII white space, A-Z in lower case, and an end. The model learns n-grams of up
    to ``longest`` tokens from the documents whose crc32(doc_id as text) mod 5 is not 1, all of them and whole;
    base_score is by single tokens with half a count added. Scores are sums of log10. Null and empty texts
    are an end alone. Rows without an id are scored, not learned from, and have a null held_out. Repeated rows count
    each; other columns are not carried. Without training documents every token has the probability 1. N-grams are told
    apart by 64-bit hashes. Blocks and answers are written to the shared folder; what comes to the driver
    are sums and at most BUCKETS times some 4,000 ratios for each length.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.write(blocks(docs), "blocks")
    tokens = {r["use"]: r["n"] for r in found.groupBy("use").agg(F.sum("n_tokens").alias("n")).collect()}
    parts = 1 + longest * sum(tokens.values()) // GROUP
    told = scratch.write(answers(requests(found, longest, parts), parts), "answers")
    retained, trained = tokens.get(RETAINED, 0), tokens.get(RETAINED, 0) + tokens.get(TUNING, 0)
    # the begin mark is no token
    known = (told.filter("length = 1").agg(F.sum("known")).first()[0] or 0) - (trained > 0)
    weights: list[np.ndarray] = []
    for _ in range(longest):
        weights.append(learned([tuple(r) for r in ratios(found, told, weights, retained, known).collect()]))

    def score(block: pa.Table, told: pa.Table) -> pa.Table:
        sizes = np.array(block["sizes"][0].as_py())
        for k, (_, estimate, p) in enumerate(mixed(_counted(block, told, "trained", longest), sizes, trained, known, weights)):
            if k == 0:
                c = np.rint(estimate * trained)  # the token's own count
        first = np.cumsum(sizes) - sizes
        sums = [np.add.reduceat(x, first) for x in ((c > 0).astype(np.int64), np.log10((c + 0.5) / (trained + 0.5 * (known + 1))), np.log10(p))]
        return pa.table({"doc_id": block["ids"].combine_chunks().flatten(), "n_tokens": sizes, "n_known": sums[0], "base_score": sums[1], "score": sums[2]})

    rows = found.select("block", "ids", "sizes", "hashes", "tokens")
    theirs = told.select(F.col("block").alias("to"), "length", "part", "trained")
    out = rows.groupBy("block").cogroup(theirs.groupBy("to")).applyInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(trained).cast("long").alias("train_tokens"), "base_score", "score")

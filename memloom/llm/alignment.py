"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same stretch of a text.

Both tokenisations of a whole text are laid over each other by byte offsets. Offsets where both
end cut the tokens into groups; those before tokens that both begin with a space also cut the
text into windows (mostly words). A window's groups depend on its ids alone, so they are worked
out once for each pair of id tuples and remembered.

How many documents hold a pair of ids is counted in two steps: distinct pairs of a block of
documents leave the task as one array with their documents in it, and these are summed on Spark.
The sums return to the blocks that asked for them, which hold their documents' pairs as numbers
into that array, so no row for each pair of each document is ever shuffled.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .arrow import ROWS, pieces
from .chunks import spaced
from .packing import encoder
from .token_counts import LONG, MARK, prove

#: A block is given away when its documents have this many tokens of the first tokenizer.
BLOCK = 4_000_000
#: A worker forgets its words when it holds this many, and its windows when they take this many bytes (about).
WORDS, HELD = 400_000, 100_000_000
#: What a remembered window takes besides its strings.
EACH = 320
#: Up to so many links of a window are kept one by one, more of them by distinct pairs.
FEW = 64


# ---- tokens and their bytes ---------------------------------------------------------------------------------


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 ones for themselves, the rest from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(other)}


def byte_level_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer file."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(path).get_vocab()
    byte = byte_of_character()
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return out


#: Marks ids of the second tokenizer where those of both stand in one array.
SECOND = np.uint32(1 << 31)


class Tokens:
    """Both tokenisations of whole texts: ids as little-endian unsigned 32-bit integers, those of the second with the mark SECOND.

    The first tokenizer is a byte-level one and gets a space before the text; the second, a piece model, adds its
    own. Both cut ordinary texts at spaces, so each distinct word is encoded once in a while by both; texts with odd
    spaces or the piece model's own mark are encoded whole.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.first = encoder(a_path, plain=True)
        self.sp = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.apart = prove(self.sp) is not None
        n = range(self.sp.get_piece_size())
        pieces_of = [bytes([int(self.sp.id_to_piece(i)[3:-1], 16)]) if self.sp.is_byte(i) else self.sp.id_to_piece(i).replace(MARK, " ").encode() for i in n]
        self.bytes_of = byte_level_tokens(a_path), pieces_of
        self.known: dict[str, bytes] = {}

    def second(self, texts: list[str]) -> list[bytes]:
        return [(np.array(ids, np.uint32) | SECOND).tobytes() for ids in self.sp.encode(texts, num_threads=1)]

    def _words(self, new: list[str]) -> list[bytes]:
        """Ids of words that stand after a space."""
        ids = self.sp.encode(new, num_threads=1)
        ends = np.cumsum([0, *map(len, ids)]) * 4
        b = (np.fromiter(chain.from_iterable(ids), np.uint32, int(ends[-1] // 4)) | SECOND).tobytes()
        ends = ends.tolist()
        return [a + b[i:j] for a, i, j in zip(self.first.apart([" " + w for w in new]), ends, ends[1:], strict=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > WORDS:
            known.clear()
        cut = [t.split(" ") if t and self.apart and MARK not in t and not spaced(" " + t) else None for t in texts]
        new = [w for w in set().union(*(c for c in cut if c)) if w not in known]
        known.update(zip(new, self._words(new), strict=True))
        get = known.__getitem__
        whole = [t for t, c in zip(texts, cut, strict=True) if t and c is None]
        odd = iter(list(zip(self.first([" " + t for t in whole]), self.second(whole), strict=True)) if whole else [])
        out = [b"".join(map(get, c)) if c else b"".join(next(odd)) if t else b"" for t, c in zip(texts, cut, strict=True)]
        for w in new:
            if len(w) > LONG:
                del known[w]
        return out


# ---- windows ------------------------------------------------------------------------------------------------


def shared_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of either side end at or before each offset where both end."""
    at = np.minimum(np.searchsorted(a_ends, b_ends), len(a_ends) - 1)
    hit = a_ends[at] == b_ends
    return at[hit] + 1, np.flatnonzero(hit) + 1


def apart(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ids of either side, one array after another, and how many of each there are up to the end of each array (from 0)."""
    every = np.frombuffer(b"".join(ids), "<u4")
    second = every >= SECOND
    last = np.cumsum([0, *map(len, ids)]) // 4
    b_last = np.concatenate([[0], np.cumsum(second)])[last]
    return every[~second].astype(np.int64), (every[second] ^ SECOND).astype(np.int64), last - b_last, b_last


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


class Windows:
    """What is known of windows, by number: groups as text, their number, links, and the pairs of the links."""

    def __init__(self, a_tokens: list[bytes], b_tokens: list[bytes]):
        self.n_tokens = len(a_tokens), len(b_tokens)
        self.sizes = [np.array(list(map(len, t)), np.int64) for t in (a_tokens, b_tokens)]
        # each id as text, with what follows it inside and at the end of its group
        self.written = _objects([f"{i}{mark}" for n, last in ((len(a_tokens), "|"), (len(b_tokens), ";")) for mark in (",", last) for i in range(n)])
        self.bytes_of = [_objects(t) for t in (a_tokens, b_tokens)]
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.held = 0
        self.text: list[str] = []
        self.groups: list[int] = []
        self.links: list[int] = []
        self.pairs: list[bytes] = []
        #: How often each pair of a window with many links is linked; the other windows have a pair for each link.
        self.times: dict[int, bytes] = {}
        #: In how many calls each was used.
        self.uses = np.zeros(0, np.int64)

    def used(self, numbers: np.ndarray) -> None:
        """Note distinct windows as used once more."""
        if len(self.uses) < len(self.number):
            self.uses = np.concatenate([self.uses, np.zeros(2 * len(self.number) - len(self.uses), np.int64)])
        self.uses[numbers] += 1

    def forget(self) -> None:
        """Keep the windows used most often, half of them at most."""
        n = len(self.number)
        uses = self.uses[:n]
        keep = np.flatnonzero(uses > np.median(uses)).tolist() if len(uses) == n else []
        keys, old = list(self.number), (self.text, self.groups, self.links, self.pairs)
        times, held, uses = self.times, self.held, uses[keep] if keep else None
        self.clear()
        for new, was in zip((self.text, self.groups, self.links, self.pairs), old, strict=True):
            new += [was[i] for i in keep]
        self.number = {keys[i]: k for k, i in enumerate(keep)}
        self.times = {k: times[i] for k, i in enumerate(keep) if i in times}
        if keep:
            # their counts begin anew, so that windows of the past make room
            self.uses, self.held = np.zeros(len(keep), np.int64), held * len(keep) // n

    def learn(self, keys: list[bytes]) -> None:
        """Work out new windows (ids of the first side, then of the second), all at once: their groups lie between the shared ends of their tokens, laid one after another."""
        a, b, a_upto, b_upto = apart(keys)
        a_bytes, b_bytes = (np.concatenate([[0], np.cumsum(size[ids])]) for size, ids in zip(self.sizes, (a, b), strict=True))
        i, j = shared_ends(a_bytes[1:], b_bytes[1:])
        x, y = np.diff(i, prepend=0), np.diff(j, prepend=0)
        upto = np.searchsorted(i, a_upto, "right")
        links = np.concatenate([[0], np.cumsum(x * y)])
        of_window = np.diff(links[upto])
        # groups as text: a token's place is after all tokens of earlier groups, and after its group's tokens of the first side
        a_place = np.arange(len(a)) + np.repeat(j - y, x)
        b_place = np.arange(len(b)) + np.repeat(i, y)
        code = np.empty(len(a) + len(b), np.int64)
        code[a_place], code[b_place] = a, b + 2 * self.n_tokens[0]
        code[a_place[i - 1]] += self.n_tokens[0]
        code[b_place[j - 1]] += self.n_tokens[1]
        written = self.written[code].tolist()
        # a pair for each link, but for windows with many
        few = np.repeat(of_window <= FEW, np.diff(upto))
        n = (x * y)[few]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(y[few], n)
        pairs = (a[np.repeat((i - x)[few], n) + k // wide] << 32 | b[np.repeat((j - y)[few], n) + k % wide]).tobytes()
        both, groups = (a_upto + b_upto).tolist(), np.diff(upto).tolist()
        at = 0
        for w, (key, m) in enumerate(zip(keys, of_window.tolist(), strict=True)):
            self.text.append("".join(written[both[w] : both[w + 1]])[:-1])
            if m <= FEW:
                self.pairs.append(pairs[at : at + 8 * m])
                at += 8 * m
            else:
                some = Counter()
                for g in range(upto[w], upto[w + 1]):
                    left, right = (Counter(ids[e - s : e].tolist()) for ids, e, s in ((a, i[g], x[g]), (b, j[g], y[g])))
                    for t, c in left.items():
                        for u, d in right.items():
                            some[t << 32 | u] += c * d
                self.pairs.append(array("q", some.keys()).tobytes())
                self.times[len(self.number)] = array("q", some.values()).tobytes()
            self.number[key] = len(self.number)
        self.groups += groups
        self.links += of_window.tolist()
        self.held += EACH * len(keys) + 2 * 4 * len(code) + len(written) * 6 + 8 * min(int(links[-1]), 1 << 40)


class Aligner:
    """Aligns texts by two tokenizer files: a byte-level one, which gets a space before the text, and a piece model, which adds its own."""

    def __init__(self, a_path: str, b_path: str):
        self.tokens = Tokens(a_path, b_path)
        self.spaced = [np.array([t[:1] == b" " for t in ts]) for ts in self.tokens.bytes_of]
        self.windows = Windows(*self.tokens.bytes_of)

    def __call__(self, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """For each text (n_a, n_b, n_groups, n_links, groups_sha256); and of all texts: number of distinct pairs each, pairs, times linked."""
        w = self.windows
        if w.held > HELD:
            w.forget()
        raw, ids = [(" " + t).encode() if t else b"" for t in texts], self.tokens(texts)
        while True:
            a, b, a_last, b_last = apart(ids)
            a_ends, b_ends = (np.concatenate([[0], np.cumsum(size[x])]) for size, x in zip(w.sizes, (a, b), strict=True))
            length = np.array(list(map(len, raw)))
            wrong = np.flatnonzero((np.diff(a_ends[a_last]) != length) | (np.diff(b_ends[b_last]) != length))
            if not len(wrong):
                break
            for i in wrong.tolist():
                raw[i] = ids[i] = b""
        numbers, upto = self._windows(a, b, a_last, a_ends[1:], b_ends[1:])
        out, good = [], []
        text = w.text.__getitem__
        sides = (w.bytes_of[0], a, a_last.tolist()), (w.bytes_of[1], b, b_last.tolist())
        every = b"".join(raw)
        right = all(b"".join(t[x].tolist()) == every for t, x, _ in sides)
        groups, links = (np.concatenate([[0], np.cumsum([x[i] for i in numbers], dtype=np.int64)]) for x in (w.groups, w.links))
        n_a, n_b = np.diff(a_last).tolist(), np.diff(b_last).tolist()
        for d, (i, j) in enumerate(zip(upto[:-1], upto[1:], strict=True)):
            if i < j and (right or all(b"".join(t[x[at[d] : at[d + 1]]].tolist()) == raw[d] for t, x, at in sides)):
                good.append(d)
                out.append((n_a[d], n_b[d], int(groups[j] - groups[i]), int(links[j] - links[i]), hashlib.sha256(";".join(map(text, numbers[i:j])).encode()).hexdigest()))
            else:
                out.append((0, 0, 0, 0, ""))
        return out, *self._pairs(numbers, upto, good, len(texts))

    def _windows(self, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[list[int], list[int]]:
        """The number of each window, and how many windows there are up to the end of each text (from 0)."""
        if not len(a):
            return [], [0] * len(a_last)
        i, j = shared_ends(a_ends, b_ends)
        ends = np.zeros(len(a) + 1, bool)
        ends[a_last] = True
        cut = ends[i] | (self.spaced[0][a[np.minimum(i, len(a) - 1)]] & self.spaced[1][b[np.minimum(j, len(b) - 1)]])
        i, j = i[cut], j[cut]
        upto = np.searchsorted(i, a_last, "right").tolist()
        # a window's key: its ids of the first side, then those of the second
        x, y = np.diff(i, prepend=0), np.diff(j, prepend=0)
        every = np.empty(len(a) + len(b), np.uint32)
        every[np.arange(len(a)) + np.repeat(j - y, x)] = a
        every[np.arange(len(b)) + np.repeat(i, y)] = b.astype(np.uint32) | SECOND
        laid, at = every.tobytes(), [0, *(4 * (i + j)).tolist()]
        keys = [laid[p:q] for p, q in pairwise(at)]
        number = self.windows.number
        found = list(map(number.get, keys))
        if None in found:
            self.windows.learn(list(dict.fromkeys([k for k, n in zip(keys, found, strict=True) if n is None])))
            found = [number[k] if n is None else n for n, k in zip(found, keys, strict=True)]
        return found, upto

    def _pairs(self, numbers: list[int], upto: list[int], good: list[int], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of distinct pairs of each text, and these pairs and how often they are linked, text by text."""
        keep = np.zeros(n, bool)
        keep[good] = True
        text = np.repeat(np.arange(n), np.diff(upto))
        some = keep[text]
        used, at = np.unique(np.array(numbers, np.int64)[some], return_inverse=True)
        self.windows.used(used)
        if not len(used):
            return np.zeros(n, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = [self.windows.pairs[i] for i in used.tolist()]
        size = np.array(list(map(len, pairs))) // 8
        first = np.cumsum(size) - size
        values, place = np.unique(np.frombuffer(b"".join(pairs), np.int64), return_inverse=True)
        times = np.ones(len(place), np.int64)
        for k, i in enumerate(used.tolist()):
            if i in self.windows.times:
                times[first[k] : first[k] + size[k]] = np.frombuffer(self.windows.times[i], np.int64)
        # windows of a text once, with how often they stand there; then their pairs
        both, often = np.unique(text[some] * len(used) + at, return_counts=True)
        text, at = both // len(used), both % len(used)
        each = size[at]
        src = np.arange(int(each.sum())) + np.repeat(first[at] - (np.cumsum(each) - each), each)
        key = np.repeat(text, each) * len(values) + place[src]
        weight = np.repeat(often, each) * times[src]
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total = np.add.reduceat(weight[order], start)
        key = key[start]
        return np.bincount(key // len(values), minlength=n), values[key % len(values)], total


@lru_cache(1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


# ---- documents ----------------------------------------------------------------------------------------------

_SCHEMA = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at array<int>, times array<long>, pairs array<long>, n_docs array<long>"


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, kind))


def blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document, whose pairs are numbers into its block's ascending pairs, and a row for each block (pairs not null) with these pairs and how many of its documents hold each."""

    def give(number, ids, rows, sizes, pairs, times):
        size = np.concatenate(sizes)
        values, at, docs_of = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
        n = len(rows)
        cols = [pa.array(np.full(n, number)), pa.array(ids, pa.int64()), *(pa.array(c, pa.string() if i == 4 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True)))]
        none = [pa.nulls(n, pa.list_(pa.int64()))] * 2
        names = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times", "pairs", "n_docs"]
        yield pa.RecordBatch.from_arrays([*cols, _lists(at, size, pa.int32()), _lists(np.concatenate(times), size, pa.int64()), *none], names=names)
        one = [len(values)]
        head = [pa.array([number]), *(pa.nulls(1, t) for t in (*[pa.int64()] * 5, pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())))]
        yield pa.RecordBatch.from_arrays([*head, _lists(values, one, pa.int64()), _lists(docs_of, one, pa.int64())], names=names)

    def run(batches):
        align, number = aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        ids, rows, sizes, pairs, times, held = [], [], [], [], [], 0
        for b in batches:
            for first in range(0, len(b), ROWS):
                some = b.slice(first, ROWS)
                ids += some.column(0).to_pylist()
                for part in pieces([t or "" for t in some.column(1).to_pylist()]):
                    got, size, pair, often = align(part)
                    rows += got
                    sizes.append(size)
                    pairs.append(pair)
                    times.append(often)
                    held += sum(r[0] for r in got)
                if held > BLOCK:
                    yield from give(number, ids, rows, sizes, pairs, times)
                    number += 1
                    ids, rows, sizes, pairs, times, held = [], [], [], [], [], 0
        if rows:
            yield from give(number, ids, rows, sizes, pairs, times)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SCHEMA)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, count, best): how many documents hold each pair, and whether no other pair of its first id has more; from ``blocks``."""
    sums = found.filter("pairs is not null").select(F.inline(F.arrays_zip("pairs", "n_docs"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("n_docs").alias("count"))
    # a first id has no more pairs than the second tokenizer has tokens
    most = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))
    return sums.withColumn("best", F.col("count") == most)


def align_tokens(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best counts links whose pair of ids is held by as many documents as any pair of its first id; count_sum
    adds these numbers of documents over all links. Texts that are null or empty, or whose tokens' bytes are
    not those of a space and the text (as with the piece model's own mark in it), have zeros and '' for the
    digest. Repeated rows count as documents of their own; other columns are not carried; an empty table gives
    an empty one. Blocks are written once to the shared folder, so that their numbers stay the same.
    """
    found = Scratch(docs.sparkSession).write(blocks(docs, a_path, b_path), "blocks")
    asked = found.filter("pairs is not null").select(F.col("block").alias("to"), F.explode("pairs").alias("pair"))
    answers = asked.join(pair_counts(found), "pair").select("to", "pair", "count", "best")
    rows = found.filter("pairs is null").drop("pairs", "n_docs")

    def score(docs: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("pair")
        count, best = known["count"].to_numpy(), known["best"].to_numpy().astype(np.int64)
        at, times = docs["at"].combine_chunks(), docs["times"].combine_chunks()
        sizes = np.diff(at.offsets.to_numpy())
        i, n = at.flatten().to_numpy(), times.flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes)])
        sums = [np.diff(np.concatenate([[0], np.cumsum(x[i] * n)])[ends]) for x in (best, count)]
        cols = {c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        return pa.table(cols | {"n_best": sums[0], "count_sum": sums[1], "groups_sha256": docs["groups_sha256"]})

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(score, schema)

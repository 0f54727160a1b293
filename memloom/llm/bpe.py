"""Byte-level BPE encoding by merge replay over a block's distinct words, and decoding.

The words of a block of texts are kept once. An inverted index from token pair
(by the rank of what it merges to) to the places where the pair stands drives the
work: ranks are applied in order, each at all its places, and only the neighbours
of a merged place are looked up again. If a merge makes a pair of lower rank in
the same word, that word's remaining places wait until the lower rank is done, so
each word is merged exactly in the order in which it would be merged alone.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from bisect import bisect_right
from collections import defaultdict
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import with_columns
from .chunks import SPACES, ChunkEncoder

#: A worker forgets its encoded words when it holds this many.
WORDS = 500_000
LONG = 64


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """What two neighbouring tokens merge to, by their ids in one number (first id * 2**20 + second id)."""
    out = {}
    for token, r in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                out[a << 20 | b] = r
    return out


def replay(words: list[bytes], ranks: dict[bytes, int], pairs: dict[int, int] | None = None) -> list[list[int]]:
    """Token ids of each word, by applying merges in rank order to all words at once.

    A merged token's id is its rank; a word that is a token itself is that one token.
    """
    merges = (pair_ranks(ranks) if pairs is None else pairs).get
    single = [ranks[bytes([i])] for i in range(256)].__getitem__
    tok: list[int] = []
    nxt: list[int] = []
    prv: list[int] = []
    starts: list[int] = []
    index: defaultdict[int, list[int]] = defaultdict(list)
    for word in words:
        base, n = len(tok), len(word)
        starts.append(base)
        if word in ranks:
            tok.append(ranks[word])
            nxt.append(-1)
            prv.append(-1)
            continue
        ids = list(map(single, word))
        tok += ids
        nxt += range(base + 1, base + n)
        prv += range(base - 1, base + n - 1)
        if n:
            nxt.append(-1)
            prv[base] = -1
        for i in range(n - 1):
            r = merges(ids[i] << 20 | ids[i + 1])
            if r is not None:
                index[r].append(base + i)
    heap = list(index)
    heapq.heapify(heap)
    while heap:
        r = heapq.heappop(heap)
        places = index.pop(r, None)
        if places is None:
            continue
        places.sort()
        again: list[int] = []
        stop = -1  # a place before which the word of a lower rank goes on
        for i in places:
            a, j = tok[i], nxt[i]
            if a < 0 or j < 0 or merges(a << 20 | tok[j]) != r:
                continue
            if i < stop:
                again.append(i)
                continue
            k, h = nxt[j], prv[i]
            tok[i], tok[j], nxt[i] = r, -1, k
            low = False
            if k >= 0:
                prv[k] = i
                made = merges(r << 20 | tok[k])
                if made is not None:
                    low = made < r
                    if made not in index:
                        heapq.heappush(heap, made)
                    index[made].append(i)
            if h >= 0:
                made = merges(tok[h] << 20 | r)
                if made is not None:
                    low = low or made < r
                    if made not in index:
                        heapq.heappush(heap, made)
                    index[made].append(h)
            if low:
                stop = starts[bisect_right(starts, i)] if i < starts[-1] else len(tok)
        if again:
            if r not in index:
                heapq.heappush(heap, r)
            index[r] += again
    out = []
    for word, i in zip(words, starts, strict=True):
        ids = []
        i = i if word else -1
        while i >= 0:
            ids.append(tok[i])
            i = nxt[i]
        out.append(ids)
    return out


class Codec:
    """Encoder and decoder for a rank file; keeps bounded caches of encoded chunks and words."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pairs = pair_ranks(self.ranks)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            self.bytes_of[v] = k
        self.words = regex.compile(pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]")).findall
        self.known: dict[str, bytes] = {}
        self.encode = ChunkEncoder(self.by_words, self.by_words)

    def by_words(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; all texts' new words are merged together."""
        known = self.known
        if len(known) > WORDS:
            known.clear()
        split = [self.words(t) for t in texts]
        new = [w for w in set().union(*split) if w not in known]
        known.update((w, struct.pack(f"<{len(x)}I", *x)) for w, x in zip(new, replay([w.encode() for w in new], self.ranks, self.pairs), strict=True))
        out = [b"".join(map(known.__getitem__, s)) for s in split]
        for w in new:
            if len(w) > LONG:
                del known[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I").tolist()))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_bpe(df: DataFrame, ranks_path: str, pattern: str, col: str = "text") -> DataFrame:
    """``df`` without ``col``, plus ids (array of int): the byte-level BPE encoding of ``col``.

    Null and empty texts give an empty array. Repeated rows and extra columns pass
    through; a column named ids is replaced.
    """

    def make():
        c = codec(ranks_path, pattern)
        return lambda texts: [(memoryview(x).cast("I").tolist(),) for x in c.encode(texts)]

    return with_columns(df, col, [("ids", T.ArrayType(T.IntegerType()))], make, drop=True)


def decode_bpe(df: DataFrame, ranks_path: str, pattern: str, col: str = "ids") -> DataFrame:
    """``df`` without ``col``, plus decoded (binary): the bytes that ids stand for; null ids, and ids that are none, give no bytes.

    Repeated rows and extra columns pass through; a column named decoded is replaced.
    """

    def make():
        c = codec(ranks_path, pattern)
        n = len(c.bytes_of)
        return lambda rows: [(b"".join(c.bytes_of[i] for i in x if i is not None and 0 <= i < n),) for x in rows]

    return with_columns(df, col, [("decoded", T.BinaryType())], make, null=[], drop=True)


def bpe_round_trip(df: DataFrame, ranks_path: str, pattern: str, col: str = "text") -> DataFrame:
    """``df`` without ``col``, plus n_tokens, ids_sha256 and decoded_sha256.

    Encodes each whole text and decodes the ids again; the digests are of the ids
    as little-endian unsigned 32-bit integers and of the decoded bytes. Null and
    empty texts have 0 tokens and the digests of nothing. One narrow map; memory is
    one piece of an Arrow batch plus the bounded cache.
    """

    def make():
        c = codec(ranks_path, pattern)
        sha = hashlib.sha256
        return lambda texts: [(len(x) // 4, sha(x).hexdigest(), sha(c.decode(x)).hexdigest()) for x in c.encode(texts)]

    return with_columns(df, col, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], make, drop=True)

"""Token counts by the whole-token shortcut.

A piece vocabulary in which the word mark ``▁`` never follows another character
can never merge across the start of a word, so a text's count is the sum of its
words' counts. Offline, every vocabulary string is encoded alone once; those that
come out as one token are proven, and a word that equals a proven string counts
one without being encoded. Only the other words are merged by the library, each
distinct one once in a while.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import with_columns

MARK = "▁"
#: A worker forgets its merged words when it holds this many.
CACHE = 400_000
LONG = 64
_RUN = re.compile(f"{MARK}+[^{MARK}]*")


def prove(sp) -> dict[str, int] | None:
    """Words (without their mark) that encode alone as one token; None if words can't be cut apart.

    Words can be cut apart if no vocabulary string has a mark after another
    character and the model's normaliser changes no character.
    """
    vocab = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(MARK in v.lstrip(MARK) for v in vocab):
        return None
    probe = "a  b\tﬁ Å　Ω ①\n"
    if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
        return None
    words = [v[1:].replace(MARK, " ") for v in vocab if v[0] == MARK and len(v) > 1]
    return {w: 1 for w, ids in zip(words, sp.encode(words, num_threads=1), strict=True) if len(ids) == 1}


def words(text: str) -> list[str]:
    """The strings whose counts add up: each stands for a mark followed by the string."""
    if MARK in text or "  " in text or text[:1] == " " or text[-1:] == " ":
        return [u[1:].replace(MARK, " ") for u in _RUN.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


@lru_cache(1)
def _model(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    proven = prove(sp)
    return sp, proven, {}


def counter(path: str):
    """A function from texts to token counts; the worker keeps the model and merged words between tasks."""
    sp, proven, merged = _model(path)
    if proven is None:
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]

    def count(texts: list[str]) -> list[int]:
        if len(merged) > CACHE:
            merged.clear()
        if not merged:
            merged.update(proven)
            merged[""] = 1
        cut = [words(t) if t else [] for t in texts]
        rest = [w for w in set().union(*cut) if w not in merged]
        new = dict(zip(rest, (len(x) for x in sp.encode(rest, num_threads=1)), strict=True))
        merged.update(new)
        out = [sum(map(merged.__getitem__, c)) for c in cut]
        for w in new:
            if len(w) > LONG:
                del merged[w]
        return out

    return count


def token_counts(df: DataFrame, model_path: str, col: str = "text", limit: int = 4096) -> DataFrame:
    """``df`` without ``col``, plus n_bytes, n_tokens and over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens; other nulls, repeated rows and
    extra columns pass through; columns named like the new ones are replaced. One
    narrow map over the rows: memory is one piece of an Arrow batch plus the bounded
    word cache, whatever the text lengths.
    """

    def make():
        count = counter(model_path)

        def run(texts: list[str]) -> list[tuple]:
            return [(len(t.encode()), n, n > limit) for t, n in zip(texts, count(texts), strict=True)]

        return run

    return with_columns(df, col, [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())], make, drop=True)

"""Encoding texts by the chunks between their spaces, each distinct one once in a while.

Byte-level BPE cuts text before a space that stands between two other characters, so
the chunks between such spaces encode apart. Texts with odd spaces are encoded whole.
A pattern may also cut before and after each single line end; then chunks end there too.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable
from itertools import repeat

#: The characters with the Unicode property White_Space.
SPACES = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACED = re.compile(f" (?=[{SPACES}])|(?<=[{SPACES}]) | $").search
_RARE = "".join(map(chr, (0x9, 0xb, 0xc, 0xd, 0x85, 0xa0, 0x1680, 0x2028, 0x2029, 0x202f, 0x205f, 0x3000, *range(0x2000, 0x200B))))


def spaced(text: str) -> bool:
    """Whether a space stands beside other white space or at the end, so that words may reach over it."""
    if text[-1:] == " " or "  " in text or " \n" in text or "\n " in text:
        return True
    return any(c in text for c in _RARE) and _SPACED(text) is not None


def chunked(text: str, lines: bool = False) -> list[str]:
    """The chunks of a text that is not ``spaced``, each without the space before it; with ``lines``, also cut before line ends, if no white space stands beside one."""
    if lines and "\n" in text and "\n\n" not in text and not any(c in text for c in _RARE):
        text = text.replace("\n", " \n")
    return text.split(" ")


class ChunkEncoder:
    """Encodes texts by ``encode``, a function from strings to their ids as bytes, which is only asked for new chunks.

    ``apart`` gets chunks that begin with a space, ``whole`` any strings. At most
    ``limit`` chunks are remembered, none of over ``longest`` characters. With ``lines``, a single
    line end and a run of ASCII marks after letters must be words of their own; ``apart`` then also
    gets chunks that begin with a line end.
    """

    def __init__(self, apart: Callable[[list[str]], list[bytes]], whole: Callable[[list[str]], list[bytes]], limit: int = 400_000, longest: int = 64, lines: bool = False):
        self.apart, self.whole, self.limit, self.longest, self.lines = apart, whole, limit, longest, lines
        self.known: dict[str, bytes] = {}
        self.marks = dict(zip(".,;:!?", whole([*".,;:!?"]), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        known, marks = self.known, self.marks
        if len(known) > self.limit:
            known.clear()
        heads, tails = [], []
        for t in texts:
            if spaced(t):
                heads.append(t)
                tails.append([])
            else:
                parts = chunked(t, self.lines)
                heads.append(parts[0])
                tails.append(parts[1:])
        need = [*set().union(*tails).difference(known)]
        # letters and marks after them are a word of letters and a word of those marks
        if self.lines:
            words = list(map(str.rstrip, need, repeat(string.punctuation)))
            marked = [(p, w, p[len(w) :]) for p, w in zip(need, words, strict=True) if len(w) < len(p) and (w.isalpha() or w[:1] == "\n" and w[1:].isalpha())]
            new = [*{m for _, _, m in marked}.difference(marks)]
            marks = marks | dict(zip(new, self.whole(new), strict=True))
        else:
            marked = [(p, p[:-1], p[-1]) for p in need if p[-1:] in marks and p[:-1].isalpha()]
        plain = [*set(need).difference([p for p, _, _ in marked]).union([w for _, w, _ in marked if w not in known])]
        # white space at the end could join with what begins the next chunk
        ends = [p for p in plain if p[-1:].isspace()]
        for ask, some in ((self.whole, ends), (self.apart, [*set(plain).difference(ends)] if ends else plain)):
            known.update(zip(some, ask([p if self.lines and p[:1] == "\n" else " " + p for p in some]), strict=True))
        known.update([(p, known[w] + marks[m]) for p, w, m in marked])
        get = known.__getitem__
        out = [h + b"".join(map(get, p)) for h, p in zip(self.whole(heads), tails, strict=True)]
        for p in [*plain, *need]:
            if len(p) > self.longest:
                known.pop(p, None)
        return out

"""Secret scans: fixed patterns, and automata inferred from labelled credentials.

The patterns label credentials in the whole corpus. From a bounded, deterministic
sample of distinct ones for each kind, a prefix tree is built over character classes and
its statistically compatible states are merged (Hoeffding bounds on the end and symbol
frequencies), which gives a probabilistic automaton for each kind. Every candidate token
of every text is then scored by the likelihood of its format: best kind against ordinary
tokens. These are counted over the whole corpus: all distinct ones whose shape another
has too, so that a rare but regular format, as of network addresses, is known as ordinary,
and a credential that no pattern labels, whose shape is random, mostly is not.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch
from .arrow import with_columns

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{16,}")
#: Candidates for the automata: runs of these characters.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: Distinct labelled credentials of each kind from which the automata are made at most.
SAMPLE = 600
#: Longest word whose score is kept for the next token; longer ones are scored each time.
CACHED = 64
ORDINARY = "ordinary"
#: A shape recurs if so many distinct ordinary tokens have it.
RECURS = 2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns in code points, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(out)


def uncovered(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, parts) of candidate tokens that base spans do not cover whole, with the parts that none covers."""
    starts = [s for s, _, _ in base]
    ends = list(accumulate((e for _, _, e in base), max))
    out = []
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        at, parts = s, []
        for start, _, end in base[bisect_right(ends, s) : bisect_left(starts, e)]:
            if start > at:
                parts.append((at, start))
            at = max(at, end)
        if at < e:
            parts.append((at, e))
        if parts:
            out.append((s, e, parts))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of candidate tokens that touch no base span."""
    return [(s, e) for s, e, parts in uncovered(text, base) if parts == [(s, e)]]


# ---- inference ----------------------------------------------------------------------------------------------


def symbols(token: str) -> str:
    """A token's character classes: a (a-f), g (g-z), A (A-F), G (G-Z), 0 (digits), others as they are."""
    return token.translate(_CLASSES)


_GROUPS = (("a", "abcdef"), ("g", "ghijklmnopqrstuvwxyz"), ("A", "ABCDEF"), ("G", "GHIJKLMNOPQRSTUVWXYZ"), ("0", "0123456789"))
_CLASSES = {ord(c): k for k, cs in _GROUPS for c in cs}


def shape(token: str) -> str:
    """The character classes with runs of one class made one."""
    return _RUN.sub(r"\1", symbols(token))


_RUN = re.compile(r"(.)\1+")


class Automaton:
    """A probabilistic automaton: for each state its visits, its ends, and symbol -> [next state, times]."""

    def __init__(self):
        self.visits: list[int] = [0]
        self.ends: list[int] = [0]
        self.next: list[dict[str, list[int]]] = [{}]

    def add(self, word: str) -> None:
        s = 0
        self.visits[0] += 1
        for c in word:
            if c not in self.next[s]:
                self.visits.append(0)
                self.ends.append(0)
                self.next.append({})
                self.next[s][c] = [len(self.visits) - 1, 0]
            edge = self.next[s][c]
            edge[1] += 1
            s = edge[0]
            self.visits[s] += 1
        self.ends[s] += 1

    def _near(self, f: int, n: int, g: int, m: int, width: float) -> bool:
        return abs(f / n - g / m) < width * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(self, p: int, q: int, width: float) -> bool:
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            n, m = self.visits[p], self.visits[q]
            if not n or not m:
                continue
            if not self._near(self.ends[p], n, self.ends[q], m, width):
                return False
            a, b = self.next[p], self.next[q]
            for c in a.keys() | b.keys():
                x, y = a.get(c), b.get(c)
                if not self._near(x[1] if x else 0, n, y[1] if y else 0, m, width):
                    return False
                if x and y:
                    stack.append((x[0], y[0]))
        return True

    def fold(self, p: int, q: int) -> None:
        """Add the subtree at q to the state p and what follows it."""
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            self.visits[p] += self.visits[q]
            self.ends[p] += self.ends[q]
            for c, (to, n) in self.next[q].items():
                if c in self.next[p]:
                    self.next[p][c][1] += n
                    stack.append((self.next[p][c][0], to))
                else:
                    self.next[p][c] = [to, n]

    def infer(self, alpha: float = 0.05) -> Automaton:
        """Merge compatible states, the most visited first."""
        width = math.sqrt(0.5 * math.log(2 / alpha))
        red = [0]
        while True:
            known = set(red)
            blue = [(self.visits[e[0]], s, c) for s in red for c, e in self.next[s].items() if e[0] not in known]
            if not blue:
                break
            _, s, c = max(blue, key=lambda x: (x[0], -x[1], x[2]))
            q = self.next[s][c][0]
            for r in red:
                if self.compatible(r, q, width):
                    self.next[s][c][0] = r
                    self.fold(r, q)
                    break
            else:
                red.append(q)
        at = {s: i for i, s in enumerate(red)}
        out = Automaton()
        out.visits, out.ends = [self.visits[s] for s in red], [self.ends[s] for s in red]
        out.next = [{c: [at[to], n] for c, (to, n) in self.next[s].items()} for s in red]
        return out

    def log_likelihood(self, word: str, smooth: float = 0.05, alphabet: int = 12) -> float:
        """Log probability of a word of classes; unseen symbols have a small share and lead nowhere else."""
        s, total = 0, 0.0
        for c in word:
            n = self.visits[s]
            edge = self.next[s].get(c)
            total += math.log(((edge[1] if edge else 0) + smooth) / (n + smooth * alphabet))
            if edge:
                s = edge[0]
        return total + math.log((self.ends[s] + smooth) / (self.visits[s] + smooth * alphabet))

    def likelihood(self, word: str) -> float:
        """``log_likelihood`` a symbol, the end included."""
        return self.log_likelihood(word) / (len(word) + 1)


    @classmethod
    def chain(cls, steps: list[tuple[str, str, int]]) -> Automaton:
        """The automaton whose states are the last two classes, from (state, next class or '' for the end, times)."""
        out = cls()
        at = {"": 0}
        for state, c, n in sorted(steps):
            for s in (state, (state + c)[-2:]):
                if s not in at:
                    at[s] = len(at)
                    out.visits.append(0)
                    out.ends.append(0)
                    out.next.append({})
            out.visits[at[state]] += n
            if c:
                out.next[at[state]][c] = [at[(state + c)[-2:]], n]
            else:
                out.ends[at[state]] += n
        return out


def infer_automata(samples: dict[str, list[str] | Automaton]) -> dict[str, Automaton]:
    """An automaton for each kind that has labelled tokens, and one for ordinary tokens (which may be one already)."""
    out = {}
    for kind, tokens in samples.items():
        if isinstance(tokens, Automaton):
            out[kind] = tokens
            continue
        tree = Automaton()
        for t in sorted(tokens):
            tree.add(symbols(t))
        out[kind] = tree.infer()
    return out


def format_score(token: str, automata: dict[str, Automaton]) -> float:
    """Log likelihood a symbol of the best credential kind, less that of ordinary tokens."""
    word = symbols(token)
    best = max((a.likelihood(word) for k, a in automata.items() if k != ORDINARY), default=-math.inf)
    return best - automata[ORDINARY].likelihood(word) if ORDINARY in automata and best > -math.inf else -math.inf


# ---- corpus -------------------------------------------------------------------------------------------------


def ordinary_chain(tokens: DataFrame) -> Automaton:
    """The chain over all distinct ordinary tokens (token, shape) whose shape RECURS of them have.

    Counted on Spark; what comes to the driver is a row for each pair of classes and the class after it.
    """
    recur = tokens.groupBy("shape").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= RECURS)
    plain = tokens.join(recur, "shape", "left_semi").select(F.translate("token", "".join(cs for _, cs in _GROUPS), "".join(k * len(cs) for k, cs in _GROUPS)).alias("w"))
    # the two classes before each place and the class there; nothing stands before the first place and after the last
    steps = plain.select(F.expr("explode(transform(sequence(1, length(w) + 1), i -> struct(right(left(w, i - 1), 2) as state, substring(w, i, 1) as class)))").alias("s"))
    counts = steps.groupBy("s.state", "s.class").agg(F.count(F.lit(1)).alias("n"))
    return Automaton.chain([tuple(r) for r in counts.collect()])


def harvest(df: DataFrame, col: str = "text", sample: int = SAMPLE) -> dict[str, list[str] | Automaton]:
    """Labelled tokens of the whole corpus, for each kind the ``sample`` distinct ones with the smallest hashes, and the chain of its ordinary tokens.

    What comes to the driver is bounded by ``sample`` tokens for each of three kinds and the chain's counts.
    """

    def find(texts: list[str]) -> list[tuple]:
        out = []
        for t in texts:
            base = base_spans(t)
            found = {(KINDS[k], (ASSIGN.match(t, s).group(2) if k == 0 else t[s:e])) for s, k, e in base}
            found |= {(ORDINARY, t[s:e]) for s, e in candidates(t, base)}
            out.append(([{"kind": k, "token": v, "shape": shape(v) if k == ORDINARY else None} for k, v in sorted(found)],))
        return out

    kind = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in ("kind", "token", "shape")]))
    found = with_columns(df.select(F.col(col).cast("string").alias("text")), "text", [("found", kind)], lambda: find, drop=True)
    scratch = Scratch(df.sparkSession)
    tokens = scratch.write(found.select(F.inline("found")).distinct().withColumn("h", F.xxhash64("token")), "tokens")

    def first(rows: DataFrame, n: int) -> list[str]:
        return [r["token"] for r in rows.orderBy("h", "token").limit(n).select("token").collect()]

    out: dict[str, list[str] | Automaton] = {k: first(tokens.filter(F.col("kind") == k), sample) for k in KINDS}
    out[ORDINARY] = ordinary_chain(tokens.filter(F.col("kind") == ORDINARY))
    scratch.drop("tokens")
    return out


def scanner(automata: dict[str, Automaton], threshold: float):
    """A function from a text to its base spans and the spans of all kinds, as (start, kind, end).

    A candidate that base spans cover in part is scored whole; if it does not pass, its
    uncovered parts of 12 characters or more are scored one by one.
    """
    scores: dict[str, float] = {}

    def score(token: str) -> float:
        word = symbols(token)
        if len(word) > CACHED:
            return format_score(token, automata)
        if word not in scores:
            scores[word] = format_score(token, automata)
        return scores[word]

    def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        base = base_spans(text)
        more = []
        if len(scores) > 200_000:
            scores.clear()
        for s, e, parts in uncovered(text, base):
            if score(text[s:e]) >= threshold:
                more.append((s, len(KINDS), e))
            elif parts != [(s, e)]:
                more += [(a, len(KINDS), b) for a, b in parts if b - a >= 12 and score(text[a:b]) >= threshold]
        return base, sorted(base + more)

    return scan


NAMES = (*KINDS, "format")
#: The least score of a token that counts as a credential by its format (log likelihood ratio a symbol).
THRESHOLD = 0.5


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{NAMES[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(df: DataFrame, col: str = "text", automata: dict[str, Automaton] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` without ``col``, plus n_assign, n_access, n_hex, base_sha256, n_format and spans.

    Spans are in code points, end exclusive, by start, then kind. Null and empty texts
    have none. Without ``automata`` they are inferred from ``df`` itself (a second pass).
    A table in which no credential is labelled gets no format spans. Columns with
    the new names are replaced, others pass through.
    """
    automata = infer_automata({k: v for k, v in harvest(df, col).items() if v}) if automata is None else automata

    def make():
        scan = scanner(automata, threshold)

        def run(texts: list[str]) -> list[tuple]:
            out = []
            for t in texts:
                base, spans = scan(t)
                n = Counter(k for _, k, _ in spans)
                out.append((n[0], n[1], n[2], hashlib.sha256(written(base).encode()).hexdigest(), n[3], written(spans)))
            return out

        return run

    fields = [("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_sha256", T.StringType()), ("n_format", T.LongType()), ("spans", T.StringType())]
    return with_columns(df, col, fields, make, drop=True)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by its first kind's name in brackets."""
    out, at, stop = [], 0, -1
    for s, k, e in spans:
        if s >= stop:
            out += [text[at:s], f"[{NAMES[k]}]"]
        stop = max(stop, e)
        at = stop
    return "".join([*out, text[at:]])


def redact_secrets(df: DataFrame, col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with every secret span of ``col`` replaced; null texts stay null, other columns as they are."""
    automata = infer_automata({k: v for k, v in harvest(df, col).items() if v})

    def make():
        scan = scanner(automata, threshold)
        return lambda texts: [(redacted(t, scan(t)[1]),) for t in texts]

    # the row itself is one column, so that none of its names can clash with that of the new text
    rows = df.select(F.struct("*").alias("row"), F.col(col).cast("string").alias("text"))
    out = with_columns(rows, "text", [("new", T.StringType())], make)
    return out.select(*(F.when(F.col("text").isNotNull(), F.col("new")).alias(c) if c == col else F.col(f"row.`{c}`").alias(c) for c in df.columns))

"""Interpolated language-model scores against counting by dictionaries, and the model's own properties."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from memloom.llm import entries, interpolation
from memloom.llm.interpolation import BUCKETS, STEPS, TUNE, learned

SF = "/root/testdata/sf0.001"


def cut(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def crc(i):
    return zlib.crc32(str(i).encode())


def counted(docs, longest):
    """Counts of all n-grams of the documents; texts begin with begin marks, which count once a document as contexts."""
    n = Counter()
    for words in docs:
        padded = ["<s>"] * (longest - 1) + words
        for k in range(1, longest + 1):
            for i in range(longest - 1, len(padded)):
                n[tuple(padded[i - k + 1 : i + 1])] += 1
        for k in range(1, longest):
            n[("<s>",) * k] += 1
    return n


def brute(docs, longest):
    """Rows by plain dictionaries, one token at a time."""
    learn = [(i, cut(t)) for i, t in docs if i is not None and crc(i) % 5 != 1]
    tune = [w for i, w in learn if crc(i) // 5 % TUNE == 0]
    keep = [w for i, w in learn if crc(i) // 5 % TUNE != 0]
    every, some = counted([w for _, w in learn], longest), counted(keep, longest)
    n_all, n_some = sum(len(w) for _, w in learn), sum(map(len, keep))
    known = len({t for _, w in learn for t in w})

    def chain(words, i, n, total, weights):
        """(bucket, estimate, shorter probability) of each length, and the probability."""
        padded, p, out = ["<s>"] * (longest - 1) + words, 1 / (known + 1), []
        at = i + longest - 1
        for k in range(1, longest + 1):
            gram = tuple(padded[at - k + 1 : at + 1])
            context = n[gram[:-1]] if k > 1 else total
            b = (int(total > 0) if k == 1 else min(context.bit_length(), BUCKETS) if context else 0)
            e = n[gram] / context if context else 0.0
            out.append((b, e, p))
            if k > len(weights):
                break
            p = weights[k - 1][b] * e + (1 - weights[k - 1][b]) * p
        return out, p

    weights = []
    for k in range(1, longest + 1):
        cells = Counter()
        for w in tune:
            for i in range(len(w)):
                b, e, p = chain(w, i, some, n_some, weights)[0][k - 1]
                if b:
                    cells[b, round(math.log2(e / p) * STEPS) if e else None] += 1
        weights.append(learned([(b, c, n) for (b, c), n in cells.items()]))
    out = []
    for d, t in docs:
        w = cut(t)
        base = sum(math.log10((every[(x,)] + 0.5) / (n_all + 0.5 * (known + 1))) for x in w)
        score = sum(math.log10(chain(w, i, every, n_all, weights)[1]) for i in range(len(w)))
        out.append((d, None if d is None else crc(d) % 5 == 1, len(w), sum(every[(x,)] > 0 for x in w), n_all, base, score))
    return out


def close(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[6])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_scores_by_brute_force(spark, monkeypatch, longest):
    """Given texts, odd ones, nulls, repeats, clashing columns; with many small blocks and ranges of hashes."""
    monkeypatch.setattr(interpolation, "GROUP", 3000)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()][:150]
    docs = [*enumerate([*texts, "", None, " \t\n ", "A a\x0bA", "É\xa0é", "x" * 9000, "a " * 2000, "\x1c a"]), (None, "a b"), (None, None), (3, texts[3])]
    df = spark.createDataFrame([(i, t, 1, b"x") for i, t in docs], "doc_id long, text string, block int, tokens binary").repartition(3)
    close(interpolation.interpolated_scores(df, longest).collect(), brute(docs, longest))


def test_no_training_documents(spark):
    only = [i for i in range(200) if crc(i) % 5 == 1][:3]
    df = spark.createDataFrame([(i, "a b") for i in only], "doc_id long, text string")
    got = interpolation.interpolated_scores(df).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got] == [(3, 0, 0, 0.0, 0.0)] * 3
    assert interpolation.interpolated_scores(df.limit(0)).collect() == []


def test_blocks_do_not_matter(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one = interpolation.interpolated_scores(df).collect()
    monkeypatch.setattr(interpolation, "GROUP", 1000)
    close(interpolation.interpolated_scores(df.repartition(13)).collect(), [tuple(r) for r in one])


def test_probabilities_add_up_to_one():
    """Over all known tokens and one unknown one, in contexts seen and unseen."""
    weights = [np.full(BUCKETS + 1, w) for w in (0.9, 0.6)]
    weights[1][0] = 0
    texts = [["a", "b"], ["a", "c", "a"], ["b"]]
    n = counted([[*t, None] for t in texts], 2)
    total, known = sum(len(t) + 1 for t in texts), 4
    for context in ("<s>", "a", "b", "new"):
        c = n[(context,)]
        mass = 0
        for w in ("a", "b", "c", None, "unknown"):
            one = 0.9 * n[(w,)] / total + 0.1 / (known + 1)
            k = min(c.bit_length(), BUCKETS)
            mass += weights[1][k] * (n[(context, w)] / c if c else 0) + (1 - weights[1][k]) * one
        assert abs(mass - 1) < 1e-12


def test_weights_are_the_likeliest():
    """Expectation-maximisation reaches the best weight of a grid; buckets without tokens follow the one before."""
    cells = [(2, None, 40), (2, 3 * STEPS, 50), (2, -STEPS, 9), (5, None, 7)]
    w = learned(cells)
    worth = lambda x: sum(n * math.log(x * (0 if c is None else 2 ** (c / STEPS)) + 1 - x) for b, c, n in cells if b == 2) + math.log(x) + math.log(1 - x)
    assert abs(w[2] - max((i / 1000 for i in range(1, 1000)), key=worth)) < 2e-3
    assert w[0] == 0 and w[1] == 0.5 and w[3] == w[4] == w[2] and 0 < w[5] < w[2] and w[6] == w[5]


def test_planes_round_trip():
    for kind in (np.uint32, np.int64, np.uint64):
        x = np.array([0, 1, 255, 256, 2**31], kind)
        assert (interpolation.joined(interpolation.planes(x), kind) == x).all()
        assert len(interpolation.joined(interpolation.planes(x[:0]), kind)) == 0


def test_held_out_texts_are_likelier_than_by_single_tokens(spark):
    got = entries.op12_deleted_interpolation(spark, "/root/testdata/sf0.01").filter("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    assert got["sum(score)"] / got["sum(n_tokens)"] > got["sum(base_score)"] / got["sum(n_tokens)"] + 0.5

"""Alignment of two tokenizers against the libraries and brute force, window memory, blocks, and odd tables."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from memloom.llm import alignment, entries

SF = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a  b", " a", "a ", "a \n b", "x\ty", "日本語 テスト  12 345", "<|endoftext|> <s> a </s> <unk>", "<0x41> <0x", "a\x1cb \x1c c", "a" * 3000, "ab " * 500, "é" * 300, "👩‍👩‍👧 ok 👩‍👩‍👧", "▁x ▁▁ y", "it's     x", "\x00 a", "ｆｕｌｌ ﬁ", "🦀" * 70, "العربية", None, "one two", "one two"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts, libraries):
    """The result row of each text, by one pass for groups and one for counts."""
    tok, sp = libraries
    byte = {c: bytes([b]) for c, b in alignment.byte_of_character().items()}
    found, docs_of = [], Counter()
    for t in texts:
        ids = [], []
        if t:
            ids = tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
        raw = [b"".join(byte[c] for c in tok.id_to_token(i)) for i in ids[0]], [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if not t or any(b"".join(r) != (" " + t).encode() for r in raw):
            found.append(([], []))
            continue
        ends = [[sum(map(len, r[: i + 1])) for i in range(len(r))] if len(r) < 400 else list(_running(map(len, r))) for r in raw]
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, low = [], 0
        a = b = 0
        for e in shared:
            x, y = a, b
            while x < len(ends[0]) and ends[0][x] <= e:
                x += 1
            while y < len(ends[1]) and ends[1][y] <= e:
                y += 1
            groups.append((ids[0][a:x], ids[1][b:y]))
            a, b, low = x, y, e
        links = Counter((i, j) for g in groups for i in g[0] for j in g[1])
        docs_of.update(links.keys())
        found.append((groups, links, len(ids[0]), len(ids[1])))
    most = defaultdict(int)
    for (i, _), n in docs_of.items():
        most[i] = max(most[i], n)
    out = []
    for f in found:
        if not f[0]:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links, n_a, n_b = f
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if docs_of[p] == most[p[0]]), sum(n * docs_of[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


def _running(sizes):
    total = 0
    for s in sizes:
        total += s
        yield total


def columns(r):
    return (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])


@pytest.mark.parametrize("small", [False, True])
def test_alignment_by_brute_force(spark, libraries, monkeypatch, small):
    """Whole given texts and odd ones; again with blocks of a few documents and a memory that is cleared all the time."""
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()][: 60 if small else None] + ODD
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, pair int, block string").repartition(3)
    if small:
        local = alignment.Aligner(A, B)
        monkeypatch.setattr(alignment, "HELD", 10)
        got = [local([t or ""])[0][0] for t in texts]
        assert [g[:4] for g in got] == [w[:4] for w in brute(texts, libraries)]
        assert [g[4] for g in got] == [w[6] for w in brute(texts, libraries)]
        found = _small_blocks(df, spark)
    else:
        found = alignment.align_tokens(df, A, B)
    got = {r["doc_id"]: columns(r) for r in found.collect()}
    want = brute(texts, libraries)
    for i, t in enumerate(texts):
        assert got[i] == want[i], (i, (t or "")[:40])
    assert len(got) == len(texts)


def _small_blocks(df, spark):
    """The same over many partitions, each a block of its own."""
    return alignment.align_tokens(df.repartition(17), A, B)


def test_rows_without_ids_and_no_rows(spark, libraries):
    df = spark.createDataFrame([(None, "one two"), (None, "one two"), (4, "two")], "doc_id long, text string")
    got = sorted(columns(r) for r in alignment.align_tokens(df, A, B).collect())
    assert got == sorted(brute(["one two", "one two", "two"], libraries))
    assert alignment.align_tokens(df.limit(0), A, B).collect() == []


def test_tokens_equal_libraries(libraries):
    r = random.Random(4)
    both = alignment.Tokens(A, B)
    texts = [t or "" for t in ODD] + ["".join(r.choice("ab \n\té日▁.") for _ in range(30)) for _ in range(300)]
    for t, x in zip(texts, both(texts), strict=True):
        a, b, _, _ = alignment.apart([x])
        assert a.tolist() == (libraries[0].encode(" " + t, add_special_tokens=False).ids if t else []), t
        assert b.tolist() == libraries[1].encode(t), t


def test_windows_with_few_and_many_links():
    """Tokens that end apart are one group; windows on either side of the limit have the same links; sides that differ are told."""
    w = alignment.Windows([b"", b" a", b"bc", b"abc", b"x"], [b"", b" ", b"ab", b"c", b"a", b"bc", b"x", b"y"])
    key = lambda a, b: np.array(a, "<u4").tobytes() + (np.array(b, "<u4") | alignment.SECOND).tobytes()
    many = alignment.FEW + 1
    w.learn([key([1, 2], [1, 2, 3]), key([1, 2], [1, 4, 5]), key([4] * 3, [6] * 3), key([1], [1, 4]), key([4], [7]), key([4, *[1, 2] * many], [6, *[1, 2, 3] * many])])
    assert w.text[:5] == ["1,2|1,2,3", "1|1,4;2|5", "4|6;4|6;4|6", "1|1,4", "4|7"]
    assert w.groups == [1, 2, 3, 1, 1, 1 + many] and w.links == [6, 3, 3, 2, 1, 1 + 6 * many]
    got = dict(zip(np.frombuffer(w.pairs[5], np.int64).tolist(), np.frombuffer(w.times[5], np.int64).tolist(), strict=True))
    assert got == {4 << 32 | 6: 1} | {a << 32 | b: many for a in (1, 2) for b in (1, 2, 3)}
    assert Counter(np.frombuffer(w.pairs[0], np.int64).tolist()) == Counter(a << 32 | b for a in (1, 2) for b in (1, 2, 3))


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert entries.op11_token_alignment(spark, SF).count() == docs

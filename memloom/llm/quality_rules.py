"""Quality rules: fixed counts, and a hashed n-gram log-likelihood ratio of two multinomials.

One multinomial is of a trusted target (documents that are labelled good), the other
of the raw corpus; both over hashed word n-grams, counted over all documents. A
document's score is the mean log ratio over its n-grams.

The target is smoothed towards the raw corpus, so that n-grams a small target has not
seen say little. It is counted in two halves, dealt by a hash of the text, and each
document is scored by the half that its own text is not in: being trusted, or a copy of
a trusted text, changes no score. One threshold decides for every document: it is the
given one, or, if lower, the score that 99 in 100 trusted documents reach; so good
documents outside the labels are rejected about as rarely as trusted ones at any size.

All of it is DataFrame expressions: arrays stay inside the row, and the only rows that
are exploded are reduced to the hash buckets before they are shuffled.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Hash buckets of the multinomials: the bound of what goes to every task.
BUCKETS = 1 << 16
#: Counts that the raw corpus lends to the target: one a bucket.
PRIOR = BUCKETS
#: A document with a lower mean log ratio is rejected, unless too many trusted ones are as low.
THRESHOLD = -0.1
#: One in so many trusted documents may be under the threshold.
TRUSTED_UNDER = 100
#: Halves of the target.
FOLDS = 2
#: White space is the space and the characters 9 to 13.
SPACE = "[ \\x09-\\x0D]+"
WINDOW = 8


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def fold(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


def buckets(g: str, n: int = BUCKETS) -> Column:
    """The hash buckets of words and word pairs, from the array ``g`` of the words' hashes."""
    return F.expr(f"""concat(transform({g}, x -> cast(pmod(x, {n}) as int)),
        case when size({g}) > 1 then transform(sequence(0, size({g}) - 2), i -> cast(pmod(xxhash64({g}[i], {g}[i + 1]), {n}) as int)) else cast(array() as array<int>) end)""")


def mean_ratio(b: str, half: Column, models: list[Column]) -> Column:
    """The mean of the weights of the n-grams in the array ``b`` of buckets, by the model of the row's half (a column that has been computed before); 0 without any."""

    def mean(model: Column) -> Column:
        return F.aggregate(b, F.lit(0.0), lambda a, x: a + model[x], lambda a: a / F.greatest(F.size(b), F.lit(1)))

    return F.when(half == 0, mean(models[0])).otherwise(mean(models[1]))


def counts(keys: DataFrame, n: int) -> np.ndarray:
    """How often each of the keys (b) below ``n`` occurs."""
    got = keys.groupBy("b").count().toArrow()
    out = np.zeros(n, np.int64)
    out[got["b"].to_numpy()] = got["count"].to_numpy()
    return out


def fit(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, n: int = BUCKETS) -> tuple[list[Column], float]:
    """The ``n`` weights for each fold's documents, as constant arrays, and the threshold.

    ``docs`` has doc_id and text; ``trusted`` has the doc_id of the target's documents. All documents are counted.
    The trusted ones are reached by a join of their bucket arrays, so no text is shuffled; the driver gets the
    sums of the buckets and the trusted scores in steps of a thousandth, some ten thousand rows at most.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    counted = docs.select(F.transform(words(text), lambda x: F.xxhash64(x)).alias("g")).select(F.explode(buckets("g", n)).alias("b"))
    raw = counts(counted, n)
    share = (raw + 1) / (raw.sum() + n)
    # always by shuffle: the trusted ids grow with the corpus, so a broadcast that works on small tables is none here
    ids = trusted.select(F.col("doc_id").cast("long").alias("id")).distinct().hint("shuffle_hash")
    hashed = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), fold(text).alias("f"), F.transform(words(text), lambda x: F.xxhash64(x)).alias("g"))
    # buckets travel in two bytes each
    small = hashed.select("id", "f", F.transform(buckets("g", n), lambda x: (x - n // 2).cast("short" if n <= 1 << 16 else "int")).alias("b"))
    good = scratch.write(small.join(ids, "id", "left_semi").select("f", F.transform("b", lambda x: x.cast("int") + n // 2).alias("b")), "good")
    half = counts(good.select(F.explode(F.transform("b", lambda x: x + F.col("f") * n)).alias("b")), FOLDS * n).reshape(FOLDS, n)
    models = []
    for k in range(FOLDS):
        seen = sum(half[j] for j in range(FOLDS) if j != k)
        size = int(seen.sum()) + PRIOR
        ratio = [round(math.log(x), 4) for x in ((seen + PRIOR * share) / size / share).tolist()]
        # a JSON text folds into one array constant; a column of that many values would be copied with every row
        models.append(F.from_json(F.lit(json.dumps(ratio)), "array<double>"))
    # the driver keeps descriptions of each plan that holds the constants, again after each of its stages: so this one has a single stage
    scores = scratch.write(good.filter("size(b) > 0").select(F.round(mean_ratio("b", F.col("f"), models), 3).alias("s")), "scores")
    steps = scores.groupBy("s").count().orderBy("s").collect()
    scratch.drop("good", "scores")
    under = sum(r["count"] for r in steps) // TRUSTED_UNDER
    for r in steps:
        under -= r["count"]
        if under < 0:
            return models, min(threshold, r["s"] - 0.0005)
    return models, threshold


def repeat_words(h: str) -> Column:
    """How many words are in 8-word windows that are found twice or more, from the array ``h`` of the windows' hashes.

    Only arrays with a repeated window are sorted: equal windows are then neighbours,
    and their places, sorted again, cover the words.
    """
    same = "x.h = s[j - 1].h"
    return F.expr(f"""
        case when size({h}) = size(array_distinct({h})) then 0L else
        aggregate(
          array_sort(flatten(transform(
            array(array_sort(transform({h}, (v, i) -> struct(v as h, i as i)))),
            s -> transform(filter(transform(s, (x, j) -> struct(x.i as i, ((j > 0 and {same}) or (j < size(s) - 1 and x.h = s[j + 1].h)) as d)), y -> y.d), y -> y.i)))),
          struct(0L as n, cast(-{WINDOW} as int) as last),
          (a, i) -> struct(a.n + least({WINDOW}, i - a.last) as n, i as last),
          a -> a.n) end""")


def windows(g: str) -> Column:
    """64-bit hashes of the 8-word windows, from the array ``g`` of the words' hashes."""
    of = ", ".join(f"{g}[i + {k}]" for k in range(WINDOW))
    return F.expr(f"case when size({g}) >= {WINDOW} then transform(sequence(0, size({g}) - {WINDOW}), i -> xxhash64({of})) else cast(array() as array<bigint>) end")


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text, any others) plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept.

    ``trusted`` holds the doc_id of the target's documents; ids that are null or not in
    ``docs`` do nothing. Without any, every llr is 0 and the base rules decide. Null and
    empty texts have no words, fail the base rules, and have llr 0. Columns named like
    the new ones are replaced; ``text`` stays. Repeated rows count each time; a row's
    columns do not depend on its place or its neighbours. An empty table gives an empty one.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    docs = docs.drop(*new)
    text = F.coalesce("text", F.lit(""))
    models, least = fit(docs, trusted, threshold)
    # the row itself is one column, so that none of its names can clash with those used here
    d = docs.select(F.struct("*").alias("doc"), text.alias("text"), words(text).alias("w"))
    d = d.select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("g")).select("*", windows("g").alias("h"), buckets("g").alias("b"), fold(F.col("text")).alias("f"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]"))
    d = d.select(
        "doc",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeat_words("h").alias("n_repeat_words"),
        mean_ratio("b", F.col("f"), models).alias("llr"),
    ).withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    # always true, but not to be computed twice: a filter on kept that were pushed below would repeat the arrays within each other's lambdas
    once = F.monotonically_increasing_id() >= 0
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= least) & once).select("doc.*", *new)

"""The registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .alignment import align_tokens
from .bpe import bpe_round_trip
from .interpolation import interpolated_scores
from .jaccard_join import near_duplicates
from .mpeg import media_round_trip
from .neighbours import vote_quality
from .packing import pack_documents
from .quality_rules import quality_rules
from .ranked_search import ranked_search
from .secrets import scan_secrets
from .sharding import extendible_shards
from .token_counts import token_counts
from .tool_calls import link_tool_calls


#: Bytes of text a shard holds at most.
SHARD_BYTES = 1024 * 1024


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text stored as MPEG audio, read back and described."""
    return media_round_trip(table(spark, sf_dir, "documents"))


def op2_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of each document by its id, none over SHARD_BYTES; ``sharding.directory`` of it is the directory."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n_bytes"))
    return extendible_shards(docs, "doc_id", F.col("n_bytes"), SHARD_BYTES)


OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
lv AS (SELECT h, n_bytes, unnest(range(0, 40)) AS lev FROM d),
big AS (SELECT lev, h >> (60 - lev) AS p FROM lv GROUP BY ALL HAVING sum(n_bytes) > {SHARD_BYTES} AND count(*) > 1),
deep AS (SELECT d.doc_id, d.n_bytes, d.h, count(big.lev) AS depth
         FROM d LEFT JOIN big ON big.p = d.h >> (60 - big.lev) GROUP BY ALL)
SELECT doc_id, n_bytes, CAST(depth AS INTEGER) AS depth, 's' || substr(lpad(bin(h), 60, '0'), 1, CAST(depth AS INTEGER)) AS shard FROM deep
"""


def op3_secret_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of fixed patterns and of inferred formats in each text."""
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_ngram_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base rules, and the verdict by the likelihood ratio against documents labelled good and not toxic."""
    good = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0")
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), good).drop("text")


def op5_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of each document's set of 4-word shingles and its component of links of 85 in a hundred."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=85)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op7_neighbour_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score and prediction of each document by its nearest labelled ones."""
    return vote_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), threshold=0.3)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of each text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each text and what they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


#: The tools that the conversations' turns are taken to call, and their argument schemas.
TOOLS = {
    "search": '{"type":"object","properties":{"query":{"type":"string","minLength":1,"maxLength":60},"limit":{"type":"integer","minimum":1,"maximum":40}},"required":["query","limit"],"additionalProperties":false}',
    "lookup": '{"type":"object","properties":{"key":{"type":"string","minLength":3},"exact":{"type":"boolean"}},"required":["key"],"additionalProperties":false}',
    "summarise": '{"type":"object","properties":{"n_words":{"type":"integer","maximum":400},"style":{"enum":["short","long"]}},"required":["n_words","style"]}',
}


def conversation_calls(conv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results derived from (conv_id, turn, role, text): each assistant turn calls a tool, a user turn answers the one before it."""
    name = F.expr("element_at(array('search', 'lookup', 'summarise'), cast(pmod(conv_id + turn, 3) + 1 as int))")
    words = F.size(F.split("text", " "))
    args = (
        F.when(name == "search", F.to_json(F.struct(F.col("text").alias("query"), (F.length("text") % 50).alias("limit"))))
        .when(name == "lookup", F.to_json(F.struct(F.col("text").alias("key"), (F.length("text") % 2 == 0).alias("exact"))))
        .otherwise(F.to_json(F.struct(words.alias("n_words"), F.when(words < 20, "short").when(words < 200, "long").otherwise("full").alias("style"))))
    )
    call_id = F.concat_ws("_", F.lit("call"), "conv_id", "turn")
    before = F.concat_ws("_", F.lit("call"), "conv_id", F.col("turn") - 2)
    calls = conv.filter("role = 'assistant'").select("conv_id", call_id.alias("call_id"), "turn", name.alias("name"), args.alias("arguments"), F.when(F.col("turn") > 2, F.array(before)).otherwise(F.array().cast("array<string>")).alias("depends"))
    answers = conv.filter("role = 'user' and turn > 0").select("conv_id", F.concat_ws("_", F.lit("call"), "conv_id", F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, answers


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results of the conversations, linked, ordered, checked and serialised."""
    calls, answers = conversation_calls(table(spark, sf_dir, "conversations"))
    return link_tool_calls(calls, answers, spark.createDataFrame(list(TOOLS.items()), "name string, schema string"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of each text's tokens by two tokenizers, and how usual the linked pairs are in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of each text by n-grams of up to three tokens, learned from the documents outside one fold."""
    return interpolated_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), longest=3)


def op13_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that score highest for each benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


OP13_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1),
all_docs AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM len),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf CROSS JOIN all_docs GROUP BY term),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN len USING (doc_id) CROSS JOIN all_docs GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""


QUERIES = {f.__name__: f for f in (op1_mpeg_audio, op2_extendible_hashing, op3_secret_grammars, op4_ngram_likelihood, op5_prefix_tree_join, op6_best_fit_packing, op7_neighbour_voting, op8_token_counts, op9_byte_bpe, op10_tool_calls, op11_token_alignment, op12_deleted_interpolation, op13_norm_buckets)}
ORACLES: dict[str, str] = {"op2_extendible_hashing": OP2_SQL, "op13_norm_buckets": OP13_SQL}

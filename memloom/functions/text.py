"""Text functions as column expressions: links, tags, front matter, headings, words, previews, tokens, overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPED = r"(?U)\[\[rel:([a-zA-Z_]\w*)\|([^\]|]+)(?:\|([^\]]+))?\]\]"
PLAIN = r"\[\[([^\]|#]+)(?:#([^\]|]+))?(?:\|([^\]]+))?\]\]"
TAG = r"(?U)(?:^|\s)#([a-zA-Z_][\w/-]*)"
FRONT = r"(?s)^\s*---[\r\n]*+(.*?)\n---[\r\n]*(.*)$"
# Words that carry no evidence, negation marks, suffixes in the order in which they are tried.
STOPWORDS = "the a an is are was were be been being by of to in on at for and or but if then than as with this that these those it its".split()
NEGATIONS = ["not ", "no ", "never ", "cannot ", "isn't ", "doesn't ", "won't "]
SUFFIXES = ["ing", "ies", "ied", "ed", "es", "s"]


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f (or a lambda within it) uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _group(x: Column, pattern: str, i: int) -> Column:
    g = F.trim(F.regexp_extract(x, pattern, i))
    return F.when(g != "", g)


def typed_links(content: Column) -> Column:
    """Typed wiki-links as an array of (raw, target, alias, section, relation)."""
    none = F.lit(None).cast("string")
    return F.transform(
        F.regexp_extract_all(content, F.lit(TYPED), 0),
        lambda x: F.struct(x.alias("raw"), F.trim(F.regexp_extract(x, TYPED, 2)).alias("target"), _group(x, TYPED, 3).alias("alias"), none.alias("section"), F.lower(F.regexp_extract(x, TYPED, 1)).alias("relation")),
    )


def plain_links(content: Column) -> Column:
    """Wiki-links that no typed link covers, in the same form, with relation wikilink."""
    raws = let(F.regexp_extract_all(content, F.lit(TYPED), 0), lambda typed: F.filter(F.regexp_extract_all(content, F.lit(PLAIN), 0), lambda x: ~F.array_contains(typed, x)))
    return F.transform(
        raws,
        lambda x: F.struct(x.alias("raw"), F.trim(F.regexp_extract(x, PLAIN, 1)).alias("target"), _group(x, PLAIN, 3).alias("alias"), _group(x, PLAIN, 2).alias("section"), F.lit("wikilink").alias("relation")),
    )


def wikilinks(content: Column) -> Column:
    """Typed links first, then plain ones."""
    return F.concat(typed_links(content), plain_links(content))


def replace_wikilinks(content: Column, replacement: Callable[[Column], Column]) -> Column:
    """The content with every link's text, wherever it stands, replaced by ``replacement`` of the link; links from the last to the first."""
    return F.aggregate(F.reverse(wikilinks(content)), content, lambda acc, x: F.replace(acc, x["raw"], replacement(x)))


def wikilinks_to_markdown(content: Column) -> Column:
    """Each link as [alias or target](/notes/slug)."""
    slug = lambda x: F.replace(F.lower(x["target"]), F.lit(" "), F.lit("-"))
    return replace_wikilinks(content, lambda x: F.concat(F.lit("["), F.coalesce(x["alias"], x["target"]), F.lit("](/notes/"), slug(x), F.lit(")")))


def tags(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(TAG), 1)


def body(content: Column) -> Column:
    """The content after its front matter."""
    return F.when(content.rlike(FRONT), F.regexp_extract(content, FRONT, 2)).otherwise(content)


def front_field(content: Column, key: str) -> Column:
    """The last value of a key in the front matter; null if there is none."""
    lines = F.filter(F.transform(F.split(F.regexp_extract(content, FRONT, 1), "\n"), F.trim), lambda x: ~x.startswith("#") & x.contains(":") & (F.trim(F.substring_index(x, ":", 1)) == key))
    return F.trim(F.regexp_replace(F.get(F.reverse(lines), F.lit(0)), "^[^:]*:", ""))


def yaml_list(value: Column) -> Column:
    """[a, "b"] or a, b or a as an array."""
    listed = value.rlike(r"^\[.*\]$")
    items = F.split(F.regexp_replace(value, r"^\[(.*)\]$", "$1"), ",")
    clean = F.transform(items, lambda x: F.when(listed, F.regexp_replace(F.regexp_replace(F.trim(x), '^"+|"+$', ""), "^'+|'+$", "")).otherwise(F.trim(x)))
    return F.coalesce(F.filter(clean, lambda x: x != ""), F.array().cast("array<string>"))


def headings(content: Column) -> Column:
    """(level, text) of the lines that begin with one to six #."""
    lines = F.transform(F.split(content, "\n"), F.trim)
    found = F.transform(F.filter(lines, lambda x: x.rlike("^#")), lambda x: F.struct(F.length(F.regexp_extract(x, "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(x, "^#+", "")).alias("text")))
    return F.filter(found, lambda x: (x["level"] <= 6) & (x["text"] != ""))


def word_count(content: Column) -> Column:
    return F.size(F.array_remove(F.split(body(content), r"\s+"), ""))


def truncate_bytes(text: Column, n: int) -> Column:
    """The longest beginning of at most ``n`` UTF-8 bytes that ends between characters."""
    cut = F.make_valid_utf8(F.substring(text.cast("binary"), 1, n).cast("string"))
    return F.when(F.octet_length(text) <= n, text).otherwise(F.regexp_replace(cut, "�$", ""))


def preview(text: Column, n: int = 200) -> Column:
    return F.when(F.octet_length(text) <= n, text).otherwise(F.concat(truncate_bytes(text, n), F.lit("...")))


def slice_bytes(text: Column, start: Column, end: Column) -> Column:
    """Bytes start to end; the start moves up and the end down to the next character."""
    raw = F.make_valid_utf8(F.substring(text.cast("binary"), start + 1, end - start).cast("string"))
    return F.regexp_replace(raw, "^�+|�+$", "")


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""))


def ordered_tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeats; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def negated(text: Column) -> Column:
    return F.lower(text).rlike("|".join(NEGATIONS))


def recency(a: Column, b: Column, tau_days: float = 14.0) -> Column:
    return F.exp(-F.abs(F.unix_timestamp(a) - F.unix_timestamp(b)) / 86400.0 / tau_days)


def normalize(text: Column) -> Column:
    """Lower-case words of letters and digits, one space apart."""
    return F.array_join(F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "), r"\s+"), ""), " ")


def stem_light(word: Column) -> Column:
    """The word without the first suffix that leaves more than two characters."""
    out = word
    for s in reversed(SUFFIXES):
        out = F.when((F.octet_length(word) > len(s) + 2) & word.endswith(s), F.substring(word, F.lit(1), F.length(word) - len(s))).otherwise(out)
    return out


def evidence_tokens(normal: Column) -> Column:
    kept = F.filter(F.split(normal, " "), lambda x: (x != "") & ~x.isin(STOPWORDS))
    return F.array_distinct(F.transform(kept, stem_light))


def trigrams(normal: Column) -> Column:
    """Distinct runs of three characters: what a look-ahead finds at each place."""
    return F.array_distinct(F.regexp_extract_all(normal, F.lit("(?s)(?=(...))"), 1))


def verify_overlap(claim: Column, source: Column, passing: float = 0.55) -> Column:
    """(score, literal, token, trigram, method, passed): how far a source span bears a claim out."""

    def judge(v: Column) -> Column:
        c, s, token, gram = v["c"], v["s"], v["token"], v["gram"]
        literal = F.when(F.contains(s, c), 1.0).when(F.contains(c, s) & (s != ""), 0.75).otherwise(0.0)
        best = F.greatest(literal, token * 0.85, gram * 0.70)
        method = F.when((literal >= token * 0.85) & (literal >= gram * 0.70), "literal").when(token * 0.85 >= gram * 0.70, "token").otherwise("trigram")
        return F.struct(best.alias("score"), literal.alias("literal"), token.alias("token"), gram.alias("trigram"), method.alias("method"), (best >= passing).alias("passed"))

    def compare(p: Column) -> Column:
        token = let(F.struct(evidence_tokens(p["c"]).alias("a"), evidence_tokens(p["s"]).alias("b")), lambda t: jaccard(t["a"], t["b"]))
        gram = let(F.struct(trigrams(p["c"]).alias("a"), trigrams(p["s"]).alias("b")), lambda t: jaccard(t["a"], t["b"]))
        return let(F.struct(p["c"].alias("c"), p["s"].alias("s"), token.alias("token"), gram.alias("gram")), judge)

    return let(F.struct(normalize(claim).alias("c"), normalize(source).alias("s")), compare)


def sanitize_filename(name: Column) -> Column:
    return F.regexp_replace(name, r'[/\\:*?"<>| ]', "_")


def request_hash(prompt: Column, system: Column, temperature: Column, max_tokens: Column) -> Column:
    """SHA-256 of the fields of a request that affect its answer, one line each; null fields have no line. Whole temperatures have no fraction."""
    number = F.regexp_replace(temperature.cast("string"), r"\.0$", "")
    line = lambda name, value: F.coalesce(F.concat(F.lit(name), value, F.lit("\n")), F.lit(""))
    return F.sha2(F.concat(line("prompt:", F.coalesce(prompt, F.lit(""))), line("sys:", system), line("t:", number), line("m:", max_tokens.cast("string"))), 256)


def json_object(text: Column) -> Column:
    """From the first { to the last } of an answer; null if there are none in this order."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def json_array(text: Column) -> Column:
    """From the first [ to the last ] of an answer; null if there are none in this order."""
    return F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit(""))


def abstraction(text: Column) -> Column:
    """title, content, rationale, action and sibling of a schema in an answer; null if there is no JSON with a content."""
    j = F.from_json(F.coalesce(json_object(text), text), "title string, content string, rationale string, action string, sibling_schema_id string")
    patch = F.coalesce(j["action"] == "patch", F.lit(False))
    sibling = F.when(patch & ~j["sibling_schema_id"].isin("", "null"), j["sibling_schema_id"])
    fields = F.struct(F.coalesce(j["title"], F.lit("Schema")).alias("title"), j["content"].alias("content"), F.coalesce(j["rationale"], F.lit("llm rationale omitted")).alias("rationale"), F.when(patch, "patch").otherwise("create").alias("action"), sibling.alias("sibling"))
    return F.when(j["content"].isNotNull(), fields)


def tag_suggestions(text: Column) -> Column:
    """Array of (tag, confidence) in an answer; null if it holds no such JSON array."""
    return F.from_json(json_array(text), "array<struct<tag: string, confidence: double>>")

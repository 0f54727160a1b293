"""Tool-call linking: calls and results joined by identifier, ordered, validated and written as canonical JSON.

Calls and results meet in a hash join on (conversation, call id). Calls are ordered by
levels: a call's step is 0 if it depends on no other call, else one more than the
highest step of those it depends on. Conversations of bounded size are ordered in one
pass each; in larger ones, paths are doubled round by round over all hosts.
Arguments are checked against the tool's JSON schema.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch
from .arrow import with_columns

#: Dependencies of one conversation that one task orders at most; those of larger conversations are ordered by joins.
TOGETHER = 20_000
_TYPES = {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None), "integer": int, "number": (int, float)}
_NUMBERS = ("minimum", "maximum", "minLength", "maxLength")


def is_type(value: object, name: str) -> bool:
    if name == "integer" and isinstance(value, float):
        return value.is_integer()
    return isinstance(value, _TYPES[name]) and (name not in ("integer", "number") or not isinstance(value, bool))


def same(a: object, b: object) -> bool:
    """JSON equality: 1 is 1.0, but not true."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if isinstance(a, list) and isinstance(b, list):
            if len(a) != len(b):
                return False
            todo += zip(a, b, strict=True)
        elif isinstance(a, dict) and isinstance(b, dict):
            if a.keys() != b.keys():
                return False
            todo += ((a[k], b[k]) for k in a)
        elif isinstance(a, (list, dict)) or isinstance(b, (list, dict)) or isinstance(a, bool) != isinstance(b, bool) or a != b:
            return False
    return True


def is_schema(schema: object) -> bool:
    """Whether the keywords that ``violations`` reads have the types that they should."""
    todo = [schema]
    while todo:
        schema = todo.pop()
        if not isinstance(schema, dict):
            return False
        kinds = schema.get("type", [])
        kinds = [kinds] if isinstance(kinds, str) else kinds
        good = (
            isinstance(kinds, list)
            and all(isinstance(k, str) and k in _TYPES for k in kinds)
            and isinstance(schema.get("enum", []), list)
            and all(is_type(schema.get(k, 0), "number") for k in _NUMBERS)
            and isinstance(schema.get("required", []), list)
            and all(isinstance(k, str) for k in schema.get("required", []))
            and isinstance(schema.get("properties", {}), dict)
        )
        if not good:
            return False
        todo += schema.get("properties", {}).values()
        if "items" in schema:
            todo.append(schema["items"])
    return True


def _place(at: tuple | None) -> str:
    """A path from the links (link before, step)."""
    steps = []
    while at:
        at, step = at
        steps.append(step)
    return "".join(["$", *reversed(steps)])


def _own_violations(value: object, schema: dict) -> list[str]:
    """What is wrong with a value itself, whatever it holds."""
    kinds = schema.get("type")
    if kinds and not any(is_type(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return ["type"]
    out = []
    if "enum" in schema and not any(same(value, e) for e in schema["enum"]):
        out.append("enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [k for k, bad in (("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value))) if bad]
    if isinstance(value, str):
        out += [k for k, bad in (("minLength", len(value) < schema.get("minLength", 0)), ("maxLength", len(value) > schema.get("maxLength", len(value)))) if bad]
    return out


def violations(value: object, schema: dict) -> list[str]:
    """Where a value breaks a schema: type, enum, bounds, lengths, properties, required, additionalProperties and items; nested as deeply as it may be."""
    out: list[str] = []
    todo: list[tuple] = [(value, schema, None)]
    while todo:
        value, schema, at = todo.pop()
        if schema is None:  # an error by now, in its place among those of the other properties
            out.append(f"{_place(at)}: {value}")
            continue
        wrong = _own_violations(value, schema)
        out += [f"{_place(at)}: {k}" for k in wrong]
        if wrong == ["type"]:
            continue
        after: list[tuple] = []
        if isinstance(value, list) and "items" in schema:
            after = [(v, schema["items"], (at, f"[{i}]")) for i, v in enumerate(value)]
        if isinstance(value, dict):
            known = schema.get("properties", {})
            out += [f"{_place((at, '.' + k))}: required" for k in schema.get("required", []) if k not in value]
            for k in sorted(value):
                if k in known:
                    after.append((value[k], known[k], (at, f".{k}")))
                elif schema.get("additionalProperties") is False:
                    after.append(("unknown", None, (at, f".{k}")))
        todo += reversed(after)
    return out


def _written_deep(value: object) -> str:
    """As ``canonical``, for values that are nested too deeply for the library."""
    out: list[str] = []
    todo: list[tuple[bool, object]] = [(False, value)]  # (whether it is text by now, what)
    while todo:
        done, v = todo.pop()
        if done:
            out.append(v)
        elif isinstance(v, dict):
            parts = [x for i, k in enumerate(sorted(v)) for x in ((True, ("," if i else "") + json.dumps(k, ensure_ascii=False) + ":"), (False, v[k]))]
            todo += [(True, "}"), *reversed(parts), (True, "{")]
        elif isinstance(v, list):
            parts = [x for i, e in enumerate(v) for x in ((True, "," if i else ""), (False, e))]
            todo += [(True, "]"), *reversed(parts), (True, "[")]
        else:
            out.append(json.dumps(v, ensure_ascii=False, allow_nan=False))
    return "".join(out)


def canonical(value: object) -> str:
    """Sorted keys, no spaces; ValueError for what is no JSON: numbers without a value, and halves of surrogate pairs."""
    try:
        out = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except RecursionError:
        out = _written_deep(value)
    out.encode()
    return out


def _no_number(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


_SPACE = re.compile(r"[ \t\n\r]*")
_PLAIN = re.compile(r"true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")


def _parsed_deep(text: str) -> object:
    """As the library's reader, for texts that are nested too deeply for it: open lists and objects wait on a stack."""

    def skip(i: int) -> tuple[int, str]:
        i = _SPACE.match(text, i).end()
        return i, text[i : i + 1]

    def key(i: int) -> tuple[str, int]:
        i, c = skip(i)
        if c != '"':
            raise ValueError("no key")
        name, i = scanstring(text, i + 1, True)
        i, c = skip(i)
        if c != ":":
            raise ValueError("no colon")
        return name, i + 1

    waits: list[tuple[object, str | None]] = []
    i = 0
    while True:
        i, c = skip(i)
        if c in ("[", "{"):
            value: object = [] if c == "[" else {}
            j, end = skip(i + 1)
            if end != ("]" if c == "[" else "}"):
                name, i = (None, i + 1) if c == "[" else key(i + 1)
                waits.append((value, name))
                continue
            i = j + 1
        elif c == '"':
            value, i = scanstring(text, i + 1, True)
        else:
            m = _PLAIN.match(text, i)
            if not m:
                raise ValueError("no value")
            value, i = json.loads(m[0]), m.end()
        while waits:
            inside, name = waits.pop()
            if isinstance(inside, list):
                inside.append(value)
            else:
                inside[name] = value
            i, c = skip(i)
            if c == ",":
                name, i = (None, i + 1) if isinstance(inside, list) else key(i + 1)
                waits.append((inside, name))
                break
            if c != ("]" if isinstance(inside, list) else "}"):
                raise ValueError("no end")
            value, i = inside, i + 1
        else:
            if skip(i)[1]:
                raise ValueError("more than a value")
            return value


def parse(text: str) -> object:
    """The value of a JSON text, however deeply nested; ValueError if it is none."""
    try:
        value = json.loads(text, parse_constant=_no_number)
    except RecursionError:
        value = _parsed_deep(text)
    canonical(value)
    return value


@lru_cache(256)
def _schema(text: str) -> dict | None:
    """The schema, None if the text holds none."""
    try:
        schema = parse(text)
        return schema if is_schema(schema) else None
    except ValueError:
        return None


def argument_errors(text: str, schema: str | None) -> tuple[object, list[str]]:
    """The arguments (None if they are no JSON), and what is wrong with them."""
    try:
        args = parse(text)
    except ValueError:
        return None, ["json"]
    if schema is None:
        return args, ["unknown tool"]
    known = _schema(schema)
    if known is None:
        return args, ["schema"]
    return args, violations(args, known)


def order(edges: list[tuple[str, str]]) -> dict[str, int]:
    """Steps of the calls that depend on others, from pairs (call, call it depends on); calls on a cycle or behind one are left out."""
    children, left, step = defaultdict(list), defaultdict(int), {}
    for call, parent in set(edges):
        children[parent].append(call)
        left[call] += 1
    now, depth = [p for p in children if p not in left], 0
    while now:
        depth += 1
        after = []
        for p in now:
            for c in children[p]:
                left[c] -= 1
                if not left[c]:
                    step[c] = depth
                    after.append(c)
        now = after
    return step


def small_steps(edges: DataFrame) -> DataFrame:
    """``steps`` of conversations with TOGETHER edges at most, each ordered in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(conv: object, held: list[tuple[str, str]]) -> pa.RecordBatch:
            got = order(held)
            return pa.RecordBatch.from_arrays([pa.array([conv] * len(got), kind), pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], names=["conv_id", "call_id", "step"])

        now, held, kind = None, [], None
        for b in batches:
            kind = b.column(0).type
            for conv, call, parent in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if conv != now:
                    if held:
                        yield out(now, held)
                    now, held = conv, []
                held.append((call, parent))
        if held:
            yield out(now, held)

    kind = edges.schema["conv_id"].dataType.simpleString()
    dealt = edges.select("conv_id", "call_id", "parent").repartition("conv_id").sortWithinPartitions("conv_id")
    return dealt.mapInArrow(run, f"conv_id {kind}, call_id string, step long")


def large_steps(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``steps`` by doubling paths, for conversations of any size.

    A call's step is the maximum of a number and of the steps of the calls that it still waits for, each plus
    a distance. In each round, a call that waits for one that waits for a single other call waits for that
    other instead: so chains and trees take rounds by the logarithm of their depth, other graphs as many as
    their longest chain of calls that wait for several. A distance beyond the number of calls is a cycle.
    """
    key = ["conv_id", "call_id"]
    now = scratch.write(edges.select(*key, "parent", F.lit(1).cast("long").alias("d")), "waits")
    first = edges.select(*key).union(edges.select("conv_id", "parent")).distinct()
    state = scratch.write(first.withColumn("least", F.lit(0).cast("long")).withColumn("cycle", F.lit(False)), "state")
    most = state.count()
    sign = None
    while True:
        got = now.agg(F.count(F.lit(1)), F.sum("d"), F.sum(F.xxhash64(*key, "parent", "d").cast("decimal(20,0)"))).first()
        if not got[0] or got == sign:
            break
        sign = got
        single = now.groupBy(*key).agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("parent", "d")).alias("e"))
        parents = state.join(single, key, "left").select("conv_id", F.col("call_id").alias("parent"), F.col("least").alias("p_least"), F.col("cycle").alias("p_cycle"), F.coalesce("k", F.lit(0)).alias("k"), "e")
        met = scratch.write(now.join(parents, ["conv_id", "parent"]), "met")
        told = met.groupBy(*key).agg(F.max(F.expr("case when k < 2 then p_least + d end")).alias("new"), F.max(F.expr(f"p_cycle or (k = 1 and d + e.d > {most})")).alias("round"))
        after = met.filter(f"not p_cycle and (k > 1 or (k = 1 and d + e.d <= {most}))").select(*key, F.expr("case when k = 1 then e.parent else parent end").alias("parent"), F.expr("case when k = 1 then d + e.d else d end").alias("d"))
        after = after.groupBy(*key, "parent").agg(F.max("d").alias("d"))
        state = scratch.write(state.join(told, key, "left").select(*key, F.greatest("least", F.coalesce("new", F.lit(0))).alias("least"), (F.col("cycle") | F.coalesce("round", F.lit(False))).alias("cycle")), "state")
        now = scratch.write(after, "waits")
    out = scratch.write(state.filter("not cycle and least > 0").join(now, key, "left_anti").select(*key, F.col("least").alias("step")), "large")
    scratch.drop("waits", "state", *(["met"] if "met" in scratch.at else []))
    return out


def steps(edges: DataFrame, scratch: Scratch, together: int | None = None) -> DataFrame:
    """(conv_id, call_id, step) of calls that depend on others, from edges (conv_id, call_id, parent) between calls.

    Calls on a cycle, or behind one, are left out; ids and conversations are not null.
    """
    edges = scratch.write(edges.distinct(), "edges")
    sizes = edges.groupBy("conv_id").count()
    large = scratch.write(sizes.filter(F.col("count") > (TOGETHER if together is None else together)).select("conv_id"), "large_ids")
    small = small_steps(edges.join(large, "conv_id", "left_anti"))
    return small if large.isEmpty() else small.unionByName(large_steps(edges.join(large, "conv_id", "left_semi"), scratch))


RECORD = [("valid", T.BooleanType()), ("errors", T.ArrayType(T.StringType())), ("record", T.StringType())]


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each call id and each result without a call: conv_id, call_id, turn, name, status, step, n_calls, n_results, valid, errors, record.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), depends (array of call ids of the same conversation);
    ``results``: conv_id, call_id, turn, content; ``schemas``: name, schema (JSON text). More columns are ignored.

    status is linked, pending (no result) or orphan (no call). Calls that share an id
    count as one, the first by turn, name and arguments, with the error "duplicate";
    of several results the first by turn and content is linked. Null ids are no link:
    each conversation's calls without id, and its results without id, are one row each.
    Dependencies on ids that are not there give the error "dependency", cycles
    the error "cycle" and no step. Arguments that are no JSON (NaN and infinite numbers and half
    surrogate pairs are none; texts may be nested as deeply as they are), unknown tools, schemas
    that are none and schema violations are errors too; valid means no errors. Null arguments count as {}.
    record is canonical JSON (sorted keys, no spaces) of the call, its result and step.
    Empty tables give an empty result. Duplicates are reduced before they are shuffled.
    """
    key = ["conv_id", "call_id"]
    scratch = Scratch(calls.sparkSession)
    call = calls.groupBy(*key).agg(F.count(F.lit(1)).alias("n_calls"), F.min(F.struct("turn", "name", "arguments", "depends")).alias("c"))
    call = scratch.write(call.select(*key, "n_calls", "c.*"), "calls")
    result = results.groupBy(*key).agg(F.count(F.lit(1)).alias("n_results"), F.min(F.struct("turn", "content")).alias("r"))
    result = result.select(*key, "n_results", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("result"))
    named = call.filter("conv_id is not null and call_id is not null")
    wanted = named.select(*key, F.explode("depends").alias("parent")).filter(F.col("parent").isNotNull())
    there = named.select("conv_id", F.col("call_id").alias("parent"), F.lit(True).alias("there"))
    edges = scratch.write(wanted.distinct().join(there, ["conv_id", "parent"], "left"), "wanted")
    missing = edges.filter("there is null").select(*key).distinct().withColumn("missing", F.lit(True))
    real = edges.filter("there").select(*key, "parent")
    step = steps(real, scratch)
    behind = real.select(*key).distinct().join(step, key, "left").select(*key, F.coalesce("step", F.lit(-1)).alias("step"))
    joined = call.join(behind, key, "left").join(missing, key, "left").withColumn("step", F.coalesce("step", F.lit(0))).withColumn("called", F.lit(True))
    # ids are unique on either side by now, so the hash join has no hot key; null ids are one row a conversation and meet nothing
    thin = result.drop("result").withColumn("answered", F.lit(True))
    joined = joined.join(thin.hint("shuffle_hash"), key, "full_outer")
    # contents, which may be long, are not held in memory by the hash join, but come by a sorted one
    content = result.select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call"), "result")
    joined = joined.join(content, F.col("answered") & F.expr("conv_id <=> r_conv and call_id <=> r_call"), "left").drop("r_conv", "r_call")
    joined = joined.join(schemas.groupBy("name").agg(F.min("schema").alias("schema")), "name", "left")
    joined = joined.withColumn("status", F.expr("case when called is null then 'orphan' when result_turn is null and n_results is null then 'pending' else 'linked' end"))
    joined = joined.withColumn("step", F.expr("case when step >= 0 then step end")).withColumn("turn", F.coalesce("turn", "result_turn"))
    doc = F.to_json(F.struct("conv_id", "call_id", "turn", "name", "arguments", "result", "step", "status", "n_calls", "missing", "schema", "called"))

    def check(rows: list[str]) -> list[tuple]:
        out = []
        for r in map(json.loads, rows):
            errors, args = [], None
            if r.get("called"):
                errors += [e for e, bad in (("duplicate", r["n_calls"] > 1), ("dependency", r.get("missing")), ("cycle", "step" not in r)) if bad]
                args, wrong = argument_errors(r.get("arguments", "{}"), r.get("schema"))
                errors += wrong
            record = {k: r.get(k) for k in ("conv_id", "call_id", "name", "result", "step", "status")} | {"arguments": args}
            out.append((not errors and bool(r.get("called")), errors, canonical(record)))
        return out

    out = joined.select("conv_id", "call_id", "turn", "name", "status", "step", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), doc.alias("_doc"))
    return with_columns(out, "_doc", RECORD, lambda: check, null="{}", drop=True)

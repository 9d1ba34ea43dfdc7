"""Tool-call linking: calls meet their results by identifier, in topological order, with checked arguments, as canonical JSON.

Only DataFrame and SQL functions are used."""

from __future__ import annotations

import json
import re
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: How calls and results stand in message texts (fixed formats), and how arguments refer to another call's result.
CALL = r"(?s)<tool_call>(.*?)</tool_call>"
RESULT = r"(?s)<tool_response>(.*?)</tool_response>"
REFERENCE = r'"\$ref"\s*:\s*"([^"\\]*)"'
#: Names of JSON Schema types, as the shapes of variants spell them; an integer is a number whose canonical text has no point.
TYPES = {"string": "STRING", "integer": "(BIGINT|DOUBLE|DECIMAL.*)", "number": "(BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}
#: Keywords of JSON Schema that are checked, and those that say nothing about a value. Others are refused.
CHECKED = frozenset("type enum const minimum maximum exclusiveMinimum exclusiveMaximum minLength maxLength pattern minItems maxItems items properties required additionalProperties".split())
SILENT = frozenset("title description default examples $schema $id $comment".split())


def parsed(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) found in messages (conv_id, turn, role, text).

    calls: conv_id, turn, item, call_id, name, arguments (JSON text) from assistants' texts; results: conv_id, turn, item,
    call_id, content (JSON text) from tools' texts. What isn't a JSON object gives a row with nulls; null texts give none."""

    def items(role: str, pattern: str) -> DataFrame:
        found = messages.filter(F.col("role") == role).select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("item", "body"))
        return found.withColumn("v", F.try_parse_json("body"))

    calls = items("assistant", CALL).select("conv_id", "turn", "item", F.try_variant_get("v", "$.id", "string").alias("call_id"), F.try_variant_get("v", "$.name", "string").alias("name"), F.to_json(F.try_variant_get("v", "$.arguments", "variant")).alias("arguments"))
    results = items("tool", RESULT).select("conv_id", "turn", "item", F.try_variant_get("v", "$.id", "string").alias("call_id"), F.to_json(F.try_variant_get("v", "$.content", "variant")).alias("content"))
    return calls, results


def _number(token: Column) -> Column:
    """A double as Java spells it, spelt by RFC 8785: whole and plain from 1e-6 up to 1e21, with an exponent beyond."""
    size = F.abs(token.cast("double"))
    plain = F.when(size >= 1, token.cast("decimal(38,16)").cast("string")).otherwise(token.cast("decimal(38,24)").cast("string"))
    far = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, r"\.0E", "E"), "E-", "e-"), r"E(\d)", "e+$1")
    return F.when(size == 0, "0").when((size >= 1e21) | (size < 1e-6), far).otherwise(F.regexp_replace(plain, r"\.?0+$", ""))


def canonical_variant(v: Column) -> Column:
    """A parsed value as JSON text: keys sorted, no spaces, each number spelt one way (RFC 8785; whole numbers and decimals
    that don't fit a double keep all their digits, numbers beyond a double become the string "Infinity")."""
    text = F.to_json(v)
    tokens = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]++|\\.)*+"|[-0-9][-+0-9.E]*+|[^"\-0-9]++'), F.lit(0))
    respelt = F.array_join(F.transform(tokens, lambda x: F.when(x.rlike(r"^-?[0-9.]+E|^-?[0-9]+\.0$"), _number(x)).otherwise(x)), "")
    return F.when(text.rlike(r"[0-9]E|\.0"), respelt).otherwise(text)


def canonical(text: Column) -> Column:
    """JSON text with sorted keys, no spaces and numbers spelt one way; null where it isn't JSON."""
    return canonical_variant(F.try_parse_json(text))


def canonical_value(value) -> str:
    """The same for a value of Python's."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical_value(str(k))}:{canonical_value(x)}" for k, x in sorted(value.items())) + "}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(canonical_value, value)) + "]"
    if isinstance(value, float):
        if value.is_integer() and abs(value) < 1e21:
            return str(int(value))
        digits = repr(value)
        return format(Decimal(digits), "f") if 1e-6 <= abs(value) < 1e21 else re.sub(r"e([+-])0*", r"e\1", digits).replace(".0e", "e")
    return json.dumps(value, ensure_ascii=False)


def quoted(text: Column) -> Column:
    """A string as JSON; null for null."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1))


def faults(x: Column, schema: dict, at: str = "") -> Column:
    """The first fault of a variant by a JSON Schema, or null; at names the value in messages. Null where x is null, which JSON's null isn't.

    Keywords in CHECKED count at every depth, each for values of its own type; a pattern is one of Java's. Keywords in SILENT say nothing, others raise
    ValueError."""
    if unknown := set(schema) - CHECKED - SILENT:
        raise ValueError(f"{sorted(unknown)[0]} isn't checked")
    shape, text = F.schema_of_variant(x), canonical_variant(x)
    has = lambda kind: shape.rlike(f"^{TYPES[kind]}$") & (text.rlike(r"^-?\d+$|e\+") if kind == "integer" else F.lit(True))
    name, inner = at or "arguments", f"{at}." if at else ""
    found: list[Column] = []
    say = lambda wrong, what: found.append(F.when(wrong, f"{name} {what}"))
    if kinds := schema.get("type"):
        kinds = [kinds] if isinstance(kinds, str) else kinds
        say(~reduce(lambda a, b: a | b, map(has, kinds)), "is no " + " or ".join(kinds))
    for values in [schema[k] if k == "enum" else [schema[k]] for k in ("enum", "const") if k in schema]:
        say(~text.isin([canonical_value(v) for v in values]), "has another value")
    number, string, items = F.try_variant_get(x, "$", "double"), F.try_variant_get(x, "$", "string"), F.try_variant_get(x, "$", "array<variant>")
    for key, kind, wrong, what in (
        ("minimum", "number", lambda k: number < k, "is too small"), ("exclusiveMinimum", "number", lambda k: number <= k, "is too small"),
        ("maximum", "number", lambda k: number > k, "is too large"), ("exclusiveMaximum", "number", lambda k: number >= k, "is too large"),
        ("minLength", "string", lambda k: F.char_length(string) < k, "is too short"), ("maxLength", "string", lambda k: F.char_length(string) > k, "is too long"),
        ("pattern", "string", lambda k: ~string.rlike(k), "has another form"),
        ("minItems", "array", lambda k: F.size(items) < k, "has too few items"), ("maxItems", "array", lambda k: F.size(items) > k, "has too many items"),
    ):
        if key in schema:
            say(has(kind) & wrong(schema[key]), what)
    whole = F.try_variant_get(x, "$", "map<string,variant>")  # for names that a path can't spell
    own = lambda p: F.try_variant_get(x, f"$['{p}']", "variant") if re.fullmatch(r"[\w .\-]+", p) else F.try_element_at(whole, F.lit(p))
    known = schema.get("properties", {})
    found += [F.when(has("object") & own(p).isNull(), f"{inner}{p} is missing") for p in schema.get("required", [])]
    found += [F.when(has("object"), faults(own(p), s, f"{inner}{p}")) for p, s in sorted(known.items())]
    more = schema.get("additionalProperties", True)
    extra = F.array_except(F.json_object_keys(F.to_json(x)), F.array(*map(F.lit, known)).cast("array<string>"))
    if more is False:
        found.append(F.when(has("object") & (F.size(extra) > 0), f"{at} has an unknown key" if at else "unknown argument"))
    elif isinstance(more, dict) and more:
        raise ValueError("additionalProperties can only be true or false")
    if schema.get("items"):
        found.append(F.when(has("array"), F.get(F.filter(F.transform(items, lambda e: faults(e, schema["items"], f"{at}[]")), lambda e: e.isNotNull()), F.lit(0))))
    return F.when(x.isNotNull(), F.coalesce(*found, F.lit(None).cast("string")))


def problem(name: Column, arguments: Column, tools: dict) -> Column:
    """Why arguments (JSON text) don't fit a tool's schema, or null. tools: name -> JSON Schema of an object."""
    v = F.try_parse_json(arguments)
    rules = F.when(name.isNull(), "no name").when(v.isNull() | ~F.schema_of_variant(v).rlike("^OBJECT"), "arguments are no object").when(~name.isin(list(tools)), "unknown tool")
    for tool, schema in sorted(tools.items()):
        rules = rules.when(name == tool, faults(v, schema))
    return rules


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): calls in the order of (level, turn, item) never precede what they refer to; null in a cycle or behind one.

    In a well-formed transcript references point back and every level is 0, found by one join. Only conversations where some point ahead go
    on. There, a call whose one reference points back takes the level of what it refers to; such chains are halved in each round.
    Of the others those go, round by round, whose references all have a level; what is left when none goes is in a cycle or behind one."""
    key = ["conv_id", "call_id"]
    node = calls.select(*key, F.struct("turn", "item").alias("at"))
    edge = calls.select(*key, F.struct("turn", "item").alias("at"), F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(REFERENCE), F.lit(1)))).alias("needs"))
    known = node.select("conv_id", F.col("call_id").alias("needs"), F.col("at").alias("needs_at"))
    edge = checkpoint(edge.join(known, ["conv_id", "needs"]).select(*key, "needs", (F.col("needs_at") >= F.col("at")).cast("int").alias("step")))
    ahead = checkpoint(edge.filter("step = 1").select("conv_id").distinct())
    if ahead.isEmpty():
        return node.select(*key, F.lit(0).alias("level"))
    edge = checkpoint(edge.join(ahead, "conv_id", "left_semi"))
    chain = edge.groupBy(*key).agg(F.count("*").alias("n"), F.max("step").alias("step"), F.min("needs").alias("root")).filter("n = 1 and step = 0").select(*key, "root")
    jump = lambda c: c.select("conv_id", F.col("call_id").alias("root"), F.col("root").alias("next"))
    while True:
        chain = checkpoint(chain)
        longer = chain.join(jump(chain), ["conv_id", "root"], "left")
        if longer.filter("next is not null").isEmpty():
            break
        chain = longer.select(*key, F.coalesce("next", "root").alias("root"))
    todo = edge.join(chain, key, "left_anti").join(jump(chain).withColumnRenamed("root", "needs"), ["conv_id", "needs"], "left")
    todo = checkpoint(todo.groupBy(*key, F.coalesce("next", "needs").alias("needs")).agg(F.max("step").alias("step")))
    done = checkpoint(node.select(*key).join(ahead, "conv_id", "left_semi").join(edge, key, "left_anti").withColumn("level", F.lit(0)))
    while True:
        of = done.select("conv_id", F.col("call_id").alias("needs"), "level")
        new = todo.join(of, ["conv_id", "needs"], "left").groupBy(*key).agg(F.max(F.col("level") + F.col("step")).alias("level"), F.max(F.col("level").isNull()).alias("waits"))
        new = checkpoint(new.filter("not waits").select(*key, "level"))
        if new.isEmpty():
            break
        done, todo = checkpoint(done.union(new)), checkpoint(todo.join(new, key, "left_anti"))
    done = done.union(chain.join(done.withColumnRenamed("call_id", "root"), ["conv_id", "root"]).select(*key, "level"))
    out = node.select(*key).join(done, key, "left").join(ahead.withColumn("ahead", F.lit(True)), "conv_id", "left")
    return out.select(*key, F.when(F.col("ahead"), F.col("level")).otherwise(F.lit(0)).alias("level"))


def linked(calls: DataFrame, results: DataFrame, tools: dict) -> DataFrame:
    """One row a call: conv_id, call_id, turn, item, level, name, is_linked, is_repeat, problem, record.

    A call's result is the first one (by turn and item) of its conversation and identifier; of calls that repeat an
    identifier the first has it and the others are repeats, kept without a result. Calls without an identifier or a conversation are kept, unlinked. record is
    canonical JSON: arguments, id, name and result, null where missing. The order within a conversation is (level, turn, item). Joins
    are on conversation and identifier together, so a long conversation is spread over tasks; results without a call are left out.
    Ties in turn and item go to the smaller text. Empty tables give an empty one."""
    key = ["conv_id", "call_id"]
    calls = calls.select(*key, "turn", "item", "name", "arguments")
    owner = calls.filter("call_id is not null and conv_id is not null").groupBy(*key).agg(F.min(F.struct("turn", "item", "name", "arguments")).alias("first"))
    own = owner.select(*key, "first.turn", "first.item", "first.name", "first.arguments")
    got = results.filter("call_id is not null").groupBy(*key).agg(F.min(F.struct("turn", "item", "content")).alias("r")).select(*key, F.col("r.content").alias("content"), F.lit(True).alias("is_linked"))
    own = own.join(got.hint("shuffle_hash"), key, "left").join(levels(own), key, "left").withColumn("is_repeat", F.lit(False))
    numbered = calls.groupBy(*calls.columns).agg(F.count("*").alias("n")).join(own.select(*key, F.struct("turn", "item", "name", "arguments").alias("first")), key, "left")
    same = F.coalesce(F.struct("turn", "item", "name", "arguments").eqNullSafe(F.col("first")), F.lit(False))
    rest = numbered.withColumn("n", F.col("n") - same.cast("int")).filter("n > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    rest = rest.select(*calls.columns, F.lit(None).cast("string").alias("content"), F.lit(False).alias("is_linked"), F.lit(0).alias("level"), (F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()).alias("is_repeat"))
    both = own.select(*calls.columns, "content", F.coalesce("is_linked", F.lit(False)).alias("is_linked"), "level", "is_repeat").union(rest)
    record = F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")), F.lit(',"id":'), F.coalesce(quoted(F.col("call_id")), F.lit("null")), F.lit(',"name":'), F.coalesce(quoted(F.col("name")), F.lit("null")), F.lit(',"result":'), F.coalesce(canonical(F.col("content")), F.lit("null")), F.lit("}"))
    return both.select(*key, "turn", "item", "level", "name", "is_linked", "is_repeat", problem(F.col("name"), F.col("arguments"), tools).alias("problem"), record.alias("record"))


#: The one tool of plain conversations: an assistant that answers.
RESPOND = {"respond": {"type": "object", "properties": {"prompt": {"type": "string"}, "after": {"type": "object"}}, "required": ["prompt"], "additionalProperties": False}}


def exchanges(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations as calls and results: each user's turn calls respond, the assistant's next turn is its result.

    A call's identifier is the turn's number; its arguments hold the prompt and a reference to the call two turns before. A user's row
    without a turn is a call without an identifier, which stays unlinked; an assistant's answers no call, so it gives no result."""
    user = messages.filter("role = 'user'")
    after = F.when(F.col("turn") >= 2, F.concat(F.lit('"after":{"$ref":"'), (F.col("turn") - 2).cast("string"), F.lit('"},'))).otherwise("")
    arguments = F.concat(F.lit("{"), after, F.lit('"prompt":'), F.coalesce(quoted(F.col("text")), F.lit("null")), F.lit("}"))
    calls = user.select("conv_id", F.col("turn").cast("string").alias("call_id"), "turn", F.lit(0).alias("item"), F.lit("respond").alias("name"), arguments.alias("arguments"))
    reply = messages.filter("role = 'assistant' and turn is not null")
    return calls, reply.select("conv_id", (F.col("turn") - 1).cast("string").alias("call_id"), "turn", F.lit(0).alias("item"), F.coalesce(quoted(F.col("text")), F.lit("null")).alias("content"))

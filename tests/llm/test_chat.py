"""Schemas, canonical numbers and orders of op4 against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat

from .test_ann_chat_pipeline import answer, call

NUMBERS = ["100", "1e2", "100.0", "1E+2", "10000e-2", "-0", "-0.0", "0.1", "1e-1", "1.50", "1e20", "1e21", "1.5e21", "1e-6", "1e-7", "1.25e-9", "12345678.5e0", "123456789012345678901234567890", "9007199254740993", "2.5E3", "3e-300", "1.7976931348623157e308"]
CANON = ["100", "100", "100", "100", "100", "0", "0", "0.1", "0.1", "1.5", "100000000000000000000", "1e+21", "1.5e+21", "0.000001", "1e-7", "1.25e-9", "12345678.5", "123456789012345678901234567890", "9007199254740993", "2500", "3e-300", "1.7976931348623157e+308"]


def test_one_record_for_one_value(spark):
    texts = [f'{{"b":[{n},"{n}, 1.0 \\" 1E5"],"a":{n}}}' for n in NUMBERS]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", chat.canonical(F.col("t")).alias("c")).collect()}
    assert [got[i] for i in range(len(texts))] == [f'{{"a":{c},"b":[{c},"{n}, 1.0 \\" 1E5"]}}' for n, c in zip(NUMBERS, CANON)]
    for n, c in zip(NUMBERS, CANON):
        if "." in n or "e" in n:
            assert chat.canonical_value(json.loads(n)) == (c if json.loads(n) else "0")
    assert spark.sql("SELECT 1").select(chat.canonical(F.lit("{"))).first()[0] is None


def plain_faults(x, s):
    """Whether a value breaks a schema, by the rules of JSON Schema."""
    kinds = {"string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None, "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list)}
    kinds["number"] = lambda v: isinstance(v, int | float) and not isinstance(v, bool)
    kinds["integer"] = lambda v: kinds["number"](v) and v == int(v)
    same = lambda a, b: type(a) is type(b) and a == b or kinds["number"](a) and kinds["number"](b) and a == b
    t = s.get("type", [])
    bad = bool(t) and not any(kinds[k](x) for k in ([t] if isinstance(t, str) else t))
    bad |= "enum" in s and not any(same(x, e) for e in s["enum"])
    bad |= "const" in s and not same(x, s["const"])
    if kinds["number"](x):
        bad |= x < s.get("minimum", x) or x > s.get("maximum", x) or x <= s.get("exclusiveMinimum", x - 1) or x >= s.get("exclusiveMaximum", x + 1)
    if isinstance(x, str):
        import re

        bad |= not s.get("minLength", 0) <= len(x) <= s.get("maxLength", 10**6) or not re.search(s.get("pattern", ""), x)
    if isinstance(x, list):
        bad |= not s.get("minItems", 0) <= len(x) <= s.get("maxItems", 10**6) or any(plain_faults(e, s.get("items", {})) for e in x)
    if isinstance(x, dict):
        known = s.get("properties", {})
        bad |= any(p not in x for p in s.get("required", [])) or any(p in x and plain_faults(x[p], known[p]) for p in known)
        bad |= s.get("additionalProperties") is False and any(p not in known for p in x)
    return bool(bad)


NAMES = ["a", "b c", "é", 'q"', "d.e"]


def schema(rng, depth):
    kind = rng.choice(["string", "integer", "number", "boolean", "null", "any", "many"] + ["object", "array"] * (2 if depth else 0))
    s = {} if kind in ("any", "many") else {"type": kind}
    if kind == "many":
        s["type"] = rng.sample(["string", "integer", "boolean", "null"], 2)
    if kind == "object":
        s["properties"] = {p: schema(rng, depth - 1) for p in rng.sample(NAMES, rng.randint(0, 3))}
        s["required"] = rng.sample(NAMES, rng.randint(0, 2))
        s |= {"additionalProperties": False} if rng.random() < 0.3 else {}
    elif kind == "array":
        s["items"] = schema(rng, depth - 1)
        s |= {"minItems": 1, "maxItems": 2} if rng.random() < 0.5 else {}
    elif kind == "string" and rng.random() < 0.6:
        s |= rng.choice([{"minLength": 2}, {"maxLength": 2}, {"pattern": "^x"}, {"enum": ["x", "true", "1"]}])
    elif kind in ("integer", "number") and rng.random() < 0.6:
        s |= rng.choice([{"minimum": 2}, {"maximum": 2}, {"exclusiveMinimum": 2}, {"exclusiveMaximum": 2}, {"enum": [1, 2.5]}])
    elif rng.random() < 0.3:
        s |= rng.choice([{"const": True}, {"enum": [True, 1, "x", None]}, {"const": {"a": 1.0}}])
    return s


def value(rng, depth):
    k = rng.randrange(8 if depth else 6)
    if k == 6:
        return [value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    if k == 7:
        return {p: value(rng, depth - 1) for p in rng.sample(NAMES, rng.randint(0, 3))}
    return rng.choice([None, True, False, 1, 2, 3, 1.0, 2.5, -7, 10**25, "x", "xy", "true", "1", "éé", ""])


def test_schemas_at_every_depth(spark):
    rng = random.Random(11)
    schemas = [{"type": "object", "properties": {"a": schema(rng, 2), "b c": schema(rng, 1)}, "required": rng.sample(["a", "b c"], rng.randint(0, 2))} for _ in range(25)]
    values = [{p: value(rng, 2) for p in rng.sample(["a", "b c", "z"], rng.randint(0, 3))} for _ in range(150)]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string")
    wrong = 0
    for s in schemas:
        out = df.select("i", chat.problem(F.lit("f"), F.col("t"), {"f": s}).alias("p")).collect()
        for r in out:
            wrong += r.p is not None
            assert (r.p is not None) == plain_faults(values[r.i], s), (s, values[r.i], r.p)
    assert 0.2 < wrong / (len(schemas) * len(values)) < 0.95


def test_probed_schemas(spark):
    nested = {"f": {"type": "object", "properties": {"o": {"type": "object", "properties": {"q": {"type": "integer"}}, "required": ["q"]}, "xs": {"type": "array", "items": {"type": "integer"}}, "t": {"enum": [True]}, "n": {"enum": [1]}}}}
    say = lambda a: spark.range(1).select(chat.problem(F.lit("f"), F.lit(json.dumps(a)), nested)).first()[0]
    assert say({"o": {}}) == "o.q is missing" and say({"o": {"q": "1"}}) == "o.q is no integer" and say({"xs": [1, 2.5]}) == "xs[] is no integer"
    assert say({"t": True, "n": 1.0, "o": {"q": 10**30}}) is None and say({"n": "1"}) == "n has another value" and say({"n": None}) == "n has another value"
    with pytest.raises(ValueError):
        chat.faults(F.lit(None), {"oneOf": []})


def plain_levels(calls):
    at = {c: (t, k) for c, t, k, _ in calls}
    needs = {c: [x for x in refs if x in at] for c, _, _, refs in calls}
    level = {}
    while True:
        new = {c: max([level[x] + (at[x] >= at[c]) for x in needs[c]], default=0) for c in at if c not in level and all(x in level for x in needs[c])}
        if not new:
            return {c: level.get(c) for c in at}
        level |= new


def test_levels(spark):
    rng, rows, want = random.Random(12), [], {}
    for conv in range(30):
        n = rng.randint(1, 14)
        calls = [(f"c{k}", k // 2, k % 2, sorted({f"c{rng.randrange(n)}" if rng.random() < 0.15 else f"c{max(0, k - rng.randint(1, 2))}" for _ in range(rng.randint(0, 2))} - ({f"c{k}"} if rng.random() < 0.9 else set()))) for k in range(n)]
        want |= {(conv, c): v for c, v in plain_levels(calls).items()}
        rows += [(conv, c, t, k, json.dumps({"x": [{"$ref": r} for r in refs]})) for c, t, k, refs in calls]
    chained = [(99, f"c{k}", k, 0, json.dumps({"$ref": f"c{k - 1}"} if k else {"$ref": "c9"})) for k in range(40)] + [(98, f"c{k}", k, 0, json.dumps({"$ref": f"c{k - 1}"}) if k else "{}") for k in range(40)]
    want |= {(99, f"c{k}"): None for k in range(40)} | {(98, f"c{k}"): 0 for k in range(40)}
    got = {(r.conv_id, r.call_id): r.level for r in chat.levels(spark.createDataFrame(rows + chained, "conv_id long, call_id string, turn long, item int, arguments string")).collect()}
    assert got == want and len(set(want.values())) > 2


def test_long_repeated_and_clashing(spark):
    """Long arguments, whole messages twice, null conversations, and columns whose names are those of results."""
    long = "é\"\\ " * 20_000
    messages = [(1, 0, "assistant", call("x", a=1, b=2) + call("y", a=long)), (1, 1, "tool", answer("x", long)), (None, 0, "assistant", call("n", a=1)), (None, 1, "tool", answer("n", 2))]
    df = spark.createDataFrame(messages + messages, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("item", "call_id", "level", "record", "v", "n")})
    out = chat.linked(*chat.parsed(df), {"sum": {"type": "object"}}).collect()
    assert len(out) == 6
    assert sorted((r.conv_id, r.call_id, r.is_linked, r.is_repeat, r.level) for r in out if r.conv_id) == [(1, "x", False, True, 0), (1, "x", True, False, 0), (1, "y", False, False, 0), (1, "y", False, True, 0)]
    assert [(r.is_linked, r.is_repeat, r.level) for r in out if r.conv_id is None] == [(False, False, 0)] * 2
    linked = next(r for r in out if r.is_linked)
    assert json.loads(linked.record) == {"arguments": {"a": 1, "b": 2}, "id": "x", "name": "sum", "result": long}

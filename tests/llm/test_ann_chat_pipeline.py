import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ann, chat, mixing, neardup, pieces, quality, queries, secrets

from .test_text_ops import EDGE, needs_model


def plain_nearest(rows, k=10):
    x = np.array([v for _, v in rows])
    ids = [i for i, _ in rows]
    out = {}
    for i, v in rows:
        if i % 100 == 0:
            d = np.sqrt(((x - np.array(v)) ** 2).sum(1)).tolist()
            out[i] = sorted((a, b) for a, b in zip(d, ids) if b != i)[:k]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[::3] = x[0]  # a third of all vectors are equal
    rows = [(i, [float(v) for v in x[i]]) for i in range(3000)]
    bad = [(10_000, None), (10_100, []), (10_200, [0.0] * 16), (10_300, [None] + [1.0] * 15), (10_400, [float("nan")] * 16), (10_500, [float("inf")] * 16), (None, rows[1][1])]
    df = spark.createDataFrame(rows + bad + rows[:50], "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = ann.nearest(df, F.col("vec_id") % 100 == 0, shard_rows=700).collect()
    want, found = plain_nearest(rows), {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert found.keys() == want.keys()
    hits = 0
    for q, f in found.items():
        f.sort()
        assert [x[0] for x in f] == list(range(1, 11)) and [(s, v) for _, v, s in f] == sorted((s, v) for _, v, s in f)
        assert all(s == pytest.approx(float(np.sqrt(((x[v].astype(float) - x[q].astype(float)) ** 2).sum())), abs=1e-12) for _, v, s in f)
        hits += len({v for _, v, _ in f} & {v for _, v in want[q]})
    assert hits >= 0.9 * 10 * len(want)
    assert [(v, s) for _, v, s in found[0]] == [(3 * k, 0.0) for k in range(1, 11)]  # ties go to the smaller vec_id


def test_recall_over_many_shards(spark, monkeypatch):
    """Vectors without any structure, over 12 shards and several blocks of queries; the graphs aren't gathered by dimension."""
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    x = np.random.default_rng(2).normal(size=(6000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = ann.nearest(df, F.col("vec_id") % 100 == 0, shard_rows=500)
    found = {}
    for r in out.collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, f in found.items():
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(f & set(np.argsort(d)[:10].tolist()))
    assert len(found) == 60 and hits >= 0.95 * 600
    assert "hashpartitioning(dim" not in out._jdf.queryExecution().executedPlan().toString()


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0, 1.0]), (100, [3.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 1), (0, 2, 100), (100, 1, 0), (100, 2, 1)]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


TOOLS = {"sum": {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "number"}, "how": {"type": "string", "enum": ["up", "down"]}}, "required": ["a"], "additionalProperties": False}}


def call(i, name="sum", **arguments):
    return f"<tool_call>{json.dumps({'name': name, 'id': i, 'arguments': arguments})}</tool_call>"


def answer(i, content):
    return f"<tool_response>{json.dumps({'id': i, 'content': content})}</tool_response>"


def test_linking(spark):
    messages = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", "one " + call("x", a=1, b=2.5) + call("y", a=2, how="up")),
        (1, 2, "tool", answer("y", {"z": 1, "a": ["é", None]}) + answer("x", 3)),
        (1, 3, "tool", answer("x", "late")),
        (1, 4, "assistant", call("x", a=9)),  # repeats an identifier
        (1, 5, "assistant", call("z", b=1) + call("t", a="1") + call("u", a=1, c=1) + call("v", "other") + call("w", a=1, how="left")),
        (2, 0, "assistant", call("p", a={"$ref": "q"}) + call("q", a=1) + call("r", a={"$ref": "p"})),  # p is called before q
        (3, 0, "assistant", call("m", a={"$ref": "n"}) + call("n", a={"$ref": "m"})),  # a cycle
        (4, 0, "assistant", "<tool_call>broken</tool_call>"),
        (4, 1, "assistant", None),
        (None, None, None, None),
    ]
    calls, results = chat.parsed(spark.createDataFrame(messages, "conv_id long, turn long, role string, text string"))
    out = chat.linked(calls, results, TOOLS).collect()
    assert len(out) == 14
    by = {(r.conv_id, r.call_id, r.turn): r for r in out}
    assert by[1, "x", 1].record == '{"arguments":{"a":1,"b":2.5},"id":"x","name":"sum","result":3}'
    assert by[1, "y", 1].record == '{"arguments":{"a":2,"how":"up"},"id":"y","name":"sum","result":{"a":["é",null],"z":1}}'
    assert by[1, "x", 4].is_repeat and not by[1, "x", 4].is_linked
    assert [by[1, c, 5].problem for c in "ztuvw"] == ["a is missing", "a is no integer", "unknown argument", "unknown tool", "how has another value"]
    order = [r.call_id for r in sorted((r for r in out if r.conv_id == 2), key=lambda r: (r.level, r.turn, r.item))]
    assert order == ["q", "p", "r"]
    assert {r.level for r in out if r.conv_id == 3} == {None} and {r.level for r in out if r.conv_id == 1} == {0}
    assert by[4, None, 0].record == '{"arguments":null,"id":null,"name":null,"result":null}'
    for r in out:
        json.loads(r.record)


def test_linking_empty(spark):
    calls, results = chat.parsed(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat.linked(calls, results, TOOLS).count() == 0
    calls, results = chat.exchanges(spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", 'say "é"\n')], "conv_id long, turn long, role string, text string"))
    assert [r.record for r in chat.linked(calls, results, chat.RESPOND).collect()] == ['{"arguments":{"prompt":null},"id":"0","name":"respond","result":"say \\"é\\"\\n"}']


def test_exchanges_keep_null_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, None, "user", "c"), (1, None, "user", "c"), (1, None, "assistant", "d")]
    calls, results = chat.exchanges(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = [(r.call_id, r.turn, r.is_linked, r.record) for r in chat.linked(calls, results, chat.RESPOND).collect()]
    lost = (None, None, False, '{"arguments":{"prompt":"c"},"id":null,"name":"respond","result":null}')
    assert sorted(out, key=repr) == sorted([("0", 0, True, '{"arguments":{"prompt":"a"},"id":"0","name":"respond","result":"b"}'), lost, lost], key=repr)


@needs_model
def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(500)]
    rows = []
    for i in range(120):
        t = ". ".join(" ".join(rng.choice(vocabulary) for _ in range(9)) for _ in range(rng.randint(1, 9))) + "."
        rows.append((i, t + (" password=abcdefgh12" if i % 10 == 0 else "") + ("\nAll rights reserved." if i % 7 == 0 else ""), "en", "ab"[i % 2] if i % 3 else "c", len(t)))
    rows += [(200 + i, rows[i][1], "en", "a", 1) for i in range(40)] + [(300, None, None, None, None), (301, "", "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secret_scan", "source_mix", "encode_pieces"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # the same by plain Python from each stage's own operator on the rows that its predecessor kept
    kept = {r.doc_id: r.clean_text for r in quality.clean(docs).collect() if r.kept}
    assert 300 not in kept and 301 not in kept and all("All rights" not in t for t in kept.values())
    first = {}
    for i in sorted(kept):
        first.setdefault(kept[i], i)
    alone = {i: t for t, i in first.items()}
    near = {r.doc_id for r in neardup.near_duplicates(spark.createDataFrame(sorted(kept.items()), "doc_id long, text string")).collect() if r.kept}
    assert near <= set(alone)
    clean = {i: secrets.redact(kept[i], secrets.spans(kept[i])[1]) for i in near}
    assert not any("abcdefgh12" in t for t in clean.values())
    source = {r[0]: r[3] for r in rows}
    mixed = mixing.mix(spark.createDataFrame([(i, t, source[i]) for i, t in clean.items()], "doc_id long, text string, source string")).collect()
    t = pieces.Transducer(queries.model_bytes())
    want = sorted((r.doc_id, np.frombuffer(t.encode(clean[r.doc_id]), np.int32).tolist()) for r in mixed for _ in range(r.copies))
    assert sorted((r.doc_id, r.ids) for r in out) == want and all(r.round_trip for r in out)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert k == 4 or stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        # repeated rows, nulls, an empty and a long text, and further columns, some named as results
        odd = docs.filter("doc_id < 8 or doc_id >= 300").union(docs.filter("doc_id < 4")).union(spark.createDataFrame([(9, "word " * 30_000 + ".", None, None, None)], docs.schema))
        odd = odd.withColumns({c: F.lit("clash") for c in ("kept", "clean_text", "copies", "component_id", "spans", "ids", "row", "a.b")})
        columns, n = stage(spark, odd, str(tmp_path)).columns, stage(spark, odd, str(tmp_path)).count()
        assert columns == (docs.columns if k < 4 else ["doc_id", "lang", "source", "ids", "n_pieces", "round_trip"]) and (n == odd.count() if k in (2, 4) else n > 0)


def wordy(seed, n=60):
    rng = random.Random(seed)
    return ". ".join(" ".join(f"word{rng.randrange(500)}" for _ in range(9)) for _ in range(n // 9)) + "."


@needs_model
def test_pipeline_with_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, wordy(1), "en", "a", 1), (None, wordy(2), None, None, None), (7, wordy(3), "en", "a", 1), (7, wordy(3), "en", "a", 1), (8, wordy(4), "en", "a", 1), (8, wordy(5), "en", "b", 1), (9, wordy(3), "en", "a", 1)]
    rows += [(100 + i, wordy(100 + i), "en", "b", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in left), key=repr) == sorted([None, None, 7, 8, *range(100, 120)], key=repr)
    assert {r.text for r in left if r.doc_id is None} == {wordy(1), wordy(2)} and [r.text for r in left if r.doc_id == 8] == [max(wordy(4), wordy(5))]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    mixed = mixing.mix(spark.createDataFrame(left, docs.schema)).collect()
    assert sorted((r.doc_id for r in out), key=repr) == sorted((r.doc_id for r in mixed for _ in range(r.copies)), key=repr)
    assert None in {r.doc_id for r in out}


def test_taken_rows(spark):
    rows = [(1, wordy(1), "a", 5), (1, wordy(1), "a", 6), (1, wordy(2), "a", None), (None, wordy(3), None, 1), (None, None, "b", 1)]
    rows += [(10 + i, wordy(10 + i, 9 * (i + 1)), "b", 1) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    out, mixed = mixing.taken(docs), mixing.mix(docs).collect()
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in mixed)
    counts = {}
    for r in out.collect():
        counts[tuple(r)] = counts.get(tuple(r), 0) + 1
    assert max(counts.values()) <= 3 and set(counts) <= set(rows)
    assert {k[0] for k in counts} >= {r.doc_id for r in mixed if r.copies} and mixing.taken(docs.limit(0)).count() == 0

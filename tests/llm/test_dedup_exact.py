"""What only exact words tell apart, and an index that outlives its session."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import kernels, neardup, substring

from .test_text_ops import plain_components, plain_sets, plain_substrings


def alternating(n, a="a", b="b"):
    """The Thue-Morse word, on which polynomial hashes modulo powers of two collide with its complement."""
    return "".join((a, b)[k.bit_count() & 1] for k in range(n))


@pytest.fixture
def docs(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, text string")


WORDS = [f"w{i}" for i in range(59)]
TWINS = [alternating(2048), alternating(2048, "b", "a")]


def test_long_words_that_differ(docs):
    rows = [(i, " ".join([*WORDS[:30], t, *WORDS[30:]])) for i, t in enumerate(TWINS)]
    out = substring.dedup(docs(rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, out), key=repr) == plain_substrings(rows) and all(r.n_removed == 0 for r in out)
    rows = [(i, " ".join([t, "x", "y", "z", "u"])) for i, t in enumerate(TWINS)]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(rows)).collect()} == plain_components(rows) == {0: (1, 0), 1: (1, 1)}


def test_long_runs_that_differ(docs):
    rows = [(i, alternating(3000, x, y)) for i, (x, y) in enumerate((("p ", "q "), ("q ", "p ")))] + [(2, alternating(1500, "p ", "q ")), (3, alternating(700, "p", "q "))]
    out = substring.dedup(docs(rows), 2).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, out), key=repr) == plain_substrings(rows)


def test_word_hashes_tell_words_apart():
    rng = random.Random(3)
    words = {"".join(rng.choice("ab\0é") for _ in range(rng.randint(1, 40))).encode() for _ in range(30_000)} | {bytes([0]) * k for k in range(1, 200)}
    data = b" ".join(sorted(words))
    h, bounds = kernels.word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert bounds.tolist() == [0, len(words)] and len(set(h.tolist())) == len(words)
    assert kernels.word_hashes(np.frombuffer(b"ABC x" + b"Y" * 50, np.uint8), np.array([0, 55]), True)[0].tolist() == kernels.word_hashes(np.frombuffer(b"abc x" + b"y" * 50, np.uint8), np.array([0, 55]))[0].tolist()
    for k in (1, 2, 5, 25, 50):
        x = rng.choices(range(100), k=200)
        r = kernels.runs(np.array(x, np.uint64), k)
        assert len(set(r.tolist())) == len({tuple(x[i : i + k]) for i in range(201 - k)}) and len(r) == 201 - k


def corpus(seed=5, n=120):
    rng = random.Random(seed)
    text = lambda n: [f"v{rng.randrange(400)}" for _ in range(n)]
    passages = [text(k) for k in (50, 64, 90, 200)]
    rows = []
    for i in range(n):
        w = text(rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            k = rng.randint(0, len(w))
            w[k:k] = rng.choice(passages)
        rows.append((i, " ".join(w)))
    return rows


def test_index_outlives_its_session(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(substring, "PART_ROWS", 8)
    rows, folder, out = corpus(), str(tmp_path / "index"), []
    for lo, hi in ((0, 50), (50, 90), (90, 95), (95, 120)):
        index = substring.Index.open(spark, folder)
        assert len(index.texts) == index.version and [t.hi for t in index.texts] == [x - 1 for x in (50, 90, 95)][: index.version]
        got = index.append(docs(rows[lo:hi]).withColumn("extra", F.col("doc_id") * 2))
        assert all(r.extra == 2 * r.doc_id for r in got.collect())
        out += map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
        for r in index.runs:  # what another session's catalog wouldn't know
            spark.sql(f"DROP TABLE {r.name}")
    assert sorted(out, key=repr) == plain_substrings(rows)
    index = substring.Index.open(spark, folder)
    assert len(index.runs) < 4  # compacted
    with pytest.raises(ValueError, match="above"):
        index.append(docs([(119, "x")]))
    few = index.texts_of(docs([(3, "")]).select("doc_id"))
    assert [r.doc_id for r in few.collect()] == [3] and re.search(r"PartitionFilters: \[[^]]*part#\d+ = 0", few._jdf.queryExecution().executedPlan().toString())
    nameless = index.append(docs([(None, rows[3][1])])).collect()
    assert [(r.doc_id, r.n_removed) for r in nameless] == [(None, 0)] and index.version == 4
    index.drop()
    assert not (tmp_path / "index").exists()


def test_index_of_a_batch_that_died(spark, docs, tmp_path, monkeypatch):
    rows, folder = corpus(7, 60), str(tmp_path / "index")
    substring.Index.open(spark, folder).append(docs(rows[:30]))

    def die(self):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(substring.Index, "save", die)
        with pytest.raises(RuntimeError):
            substring.Index.open(spark, folder).append(docs(rows[30:]))
    out = substring.Index.open(spark, folder).append(docs(rows[30:])).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, out), key=repr) == [r for r in plain_substrings(rows) if r[0] >= 30]


def test_collisions_are_counted(spark, docs):
    """_collide() keeps the pairs with MATCHES equal coordinates whose parities allow the similarity, and none else."""
    rng = random.Random(4)
    base, rows = [f"v{i}" for i in range(200)], []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 25)):
            w[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sig = neardup.signatures(docs(rows))
    tokens = {r.doc_id: r.signature for r in sig.collect()}
    r = sig.orderBy("doc_id").collect()
    i, j = np.triu_indices(len(r), 1)
    sketch, n = np.array([x.sketch for x in r], np.int64).view(np.uint64), np.array([x.n_shingles for x in r])
    got = set(zip(*(x.tolist() for x in neardup._collide(sketch, n, i, j)), strict=True))
    sets = {i: plain_sets(t) for i, t in rows}
    alike = {(a, b) for a in tokens for b in tokens if a < b and sum(x == y for x, y in zip(tokens[a], tokens[b])) >= neardup.MATCHES}
    assert got <= alike and {p for p in alike if 100 * len(sets[p[0]] & sets[p[1]]) >= 75 * len(sets[p[0]] | sets[p[1]])} <= got
    assert 0 < len(alike) < 60 * 59 / 2


def test_near_copies_of_rows_that_share_an_id(docs, monkeypatch):
    monkeypatch.setattr(neardup, "TEXT_PAIRS", 2)
    rng = random.Random(8)
    x, y = ([f"{c}{rng.randrange(900)}" for _ in range(150)] for c in "xy")
    near = lambda w, k: " ".join([*w[:k], "other", *w[k + 1 :]])
    rows = [(5, " ".join(x)), (5, " ".join(y)), (6, near(x, 3)), (7, near(y, 4)), (8, near(y, 90)), (1, "alone here"), *[(20 + k, near(x, k)) for k in range(10, 30)]]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(rows + rows[:1])).collect()}
    assert got == {1: 1} | {i: 5 for i, _ in rows if i != 1}

"""Toxicity by non-negative positive-unlabelled learning of a linear classifier in numpy."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, with_arrays, with_texts

#: Bounds of the training sample: confirmed toxic texts and unlabelled texts, the first of each by a hash of doc_id.
MAX_POSITIVE, MAX_UNLABELLED = 4000, 16000
#: Bound of the vocabulary, and what a word must show to enter: texts with it, and its excess among positives in standard errors.
MAX_WORDS, MIN_TEXTS, MIN_EXCESS = 2000, 3, 3.0
EDGES = " \t\n\x0b\f\r.,;:!?\"'()[]{}<>|*#$%&-_/\\…“”„«»¡¿"


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from (fixed by the contract)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


#: Stems are a word's first letters, of these numbers.
STEMS = (4, 5, 6, 7)
#: A feature is dense where one of so many distinct words has it.
DENSE = 80
#: Words whose features a worker keeps; then it starts anew.
KEPT_WORDS = 150_000


def features(word: str) -> set[str]:
    """A lower-case word without marks at its ends, and its stems."""
    w = word.strip(EDGES)
    return ({w} | {f"{w[:k]}~" for k in STEMS if len(w) > k}) if w else set()


def tokens(text: str | None, of=features) -> set[str]:
    """The features of a text: those of its distinct words, again where two or three words share one, and again where one word in DENSE does."""
    if not text:
        return set()
    distinct = set(text.lower().split())
    n = Counter(chain.from_iterable(map(of, distinct)))
    return {f"{f}{mark}" for f, k in n.items() for mark, is_so in (("", True), ("+2", k > 1), ("+3", k > 2), ("%", k * DENSE >= len(distinct))) if is_so}


class _Known(dict):
    """From a word to those of its features that a model weighs."""

    def __init__(self, vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> frozenset:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = frozenset(features(word) & self.vocabulary)
        return found


@dataclass
class Model:
    """A feature's weight, and the weight that every text has. prior is the share of toxic texts it was trained for."""

    weights: dict[str, float]
    bias: float
    prior: float

    def __post_init__(self):
        self.known = _Known({w.removesuffix("%").split("+")[0] for w in self.weights})

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights.get(w, 0.0) for w in sorted(tokens(text, self.known.__getitem__)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], n_words: int, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model on the presence of features.

    The risk is prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]): positives are taken out of the
    unlabelled texts' risk by the class prior, and where that makes it negative, which only over-fitting does, the step
    goes back up instead."""
    index = [np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (positive, unlabelled)]
    row = [np.repeat(np.arange(len(x)), [len(r) for r in x]) for x in (positive, unlabelled)]
    sizes = [max(1, len(positive)), max(1, len(unlabelled))]
    w, b = np.zeros(n_words), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n_words + 1), np.zeros(n_words + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        z = [b + np.bincount(r, w[i], minlength=n) for i, r, n in zip(index, row, sizes, strict=True)]
        s = [sigmoid(x) for x in z]
        negative = np.mean(np.logaddexp(0, z[1])) - prior * np.mean(np.logaddexp(0, z[0]))
        if negative >= 0:
            g = [prior * (s[0] - 1) / sizes[0] - prior * s[0] / sizes[0], s[1] / sizes[1]]
        else:
            g = [prior * s[0] / sizes[0], -s[1] / sizes[1]]
        grad = np.zeros(n_words + 1)
        for i, r, x in zip(index, row, g, strict=True):
            grad[:-1] += np.bincount(i, x[r], minlength=n_words)
            grad[-1] += x.sum()
        grad[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Trains on confirmed toxic texts of labels (doc_id, toxic) and on texts without regard to their labels.

    Held-out rows give neither labels nor texts. The sample is bounded by MAX_POSITIVE and MAX_UNLABELLED, whatever the size
    of the input; the class prior is the share of toxic rows among all labels that may be learnt from. With no
    toxic label the model has no words and scores all texts alike."""
    docs, labels = (x.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))) for x in (docs.select("doc_id", "text"), labels.select("doc_id", "toxic")))
    n, k = labels.filter("toxic is not null").agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("int"))).first()
    prior = min(0.5, max(1e-4, (k or 0) / max(1, n)))
    first = lambda ids, size, seed: ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(size)
    chosen = first(labels.filter("toxic = 1"), MAX_POSITIVE, 1).withColumn("positive", F.lit(True)).union(first(docs, MAX_UNLABELLED, 2).withColumn("positive", F.lit(False)))
    chosen = stored(chosen)
    ids = chosen.groupBy("doc_id").agg(F.max(F.col("positive").cast("int")).alias("p"), F.max((~F.col("positive")).cast("int")).alias("u"))

    def make():
        import pyarrow as pa

        return lambda b: [pa.array([sorted(tokens(t)) for t in b.column("text").to_pylist()], pa.list_(pa.string()))]

    sample = stored(with_arrays(with_texts(docs, ids), make, "words array<string>").drop("text"))
    n_p, n_u = (int(x or 0) for x in sample.agg(F.sum("p"), F.sum("u")).first())
    if not n_p or not n_u:
        return Model({}, float(np.log(prior / (1 - prior))), prior)
    seen = sample.select("p", "u", F.explode("words").alias("word")).groupBy("word").agg(F.sum("p").alias("in_p"), F.sum("u").alias("in_u"))
    share = (F.col("in_u") + 1) / (n_u + 2)
    excess = (F.col("in_p") / n_p - share) / F.sqrt(share * (1 - share) / n_p)
    vocabulary = [r[0] for r in seen.filter(F.col("in_p") >= MIN_TEXTS).withColumn("excess", excess).filter(F.col("excess") >= MIN_EXCESS).orderBy(F.desc("excess"), "word").limit(MAX_WORDS).select("word").collect()]
    at = {w: i for i, w in enumerate(vocabulary)}
    rows = sample.select("p", "u", F.array_intersect("words", F.array([F.lit(w) for w in vocabulary]).cast("array<string>")).alias("words")).collect()  # bounded by the sample
    index = [(r.p, r.u, np.array([at[w] for w in r.words], np.int64)) for r in rows]
    w, b = fit([x for p, _, x in index if p], [x for _, u, x in index if u], len(vocabulary), prior)
    return Model(dict(zip(vocabulary, w.tolist(), strict=True)), b, prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on), from the text alone.

    A null or empty text has no words and the model's bias as its score. Rows are independent and nothing is shuffled; equal texts score
    alike. The model's size is bounded by MAX_WORDS."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.prior))

    def make():
        m = Model(*shared.value)

        def of(b):
            s = np.array([m.score(t) for t in b.column("text").to_pylist()], np.float64)
            return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

        return of

    return with_arrays(docs, make, "score double, predicted int")

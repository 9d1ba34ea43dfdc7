"""The queries of this subpackage, by name: thin digests of the operators over their whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, mixing, neardup, pieces, quality, secrets, sharding, substring, toxicity
from .common import small_batches, table

#: The tokenizer's model file; it is read by the driver alone.
PIECES = os.environ.get("TESSERA_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = quality.clean(table(spark, sf_dir, "documents", "doc_id", "text"))
    return c.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lines_dropped", "kept_chars")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls in the texts, if any, and the turns themselves as calls."""
    messages = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    own, turns = chat.parsed(messages), chat.exchanges(messages)
    cols = ("conv_id", "call_id", "turn", "item")
    calls = own[0].select(*cols, "name", "arguments").union(turns[0].select(*cols, "name", "arguments"))
    results = own[1].select(*cols, "content").union(turns[1].select(*cols, "content"))
    return chat.linked(calls, results, chat.RESPOND)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents", "doc_id", "n_chars"), "doc_id", SHARDS)


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text", "clean_text")


def model_bytes(path: str = PIECES) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents", "doc_id", "text"), model_bytes()).drop("text")


def _bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(small_batches(spark), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = op1_neighbours, op2_mix, op3_quality, op4_chat, op5_sharding, op6_substring, op7_neardup, op8_toxicity, op9_secrets, op10_pieces
    return {q.__name__: _bounded(q) for q in every}

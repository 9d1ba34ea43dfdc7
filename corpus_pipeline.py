"""A corpus pipeline: quality rules, near-duplicates, secrets, mixing, then piece ids.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents and any others, and returns a DataFrame of the columns of documents; the
last returns piece ids. Any column may be null, rows may repeat, other columns are left out whatever their names, and an empty table gives an
empty one. Null and empty texts fail the quality rules, so that no later stage meets them in a run; each stage says what it does with them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, neardup, pieces, quality, secrets
from tessera.llm.common import BROADCAST_KEYS, shared_dir, small_batches, stored
from tessera.llm.queries import model_bytes

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(df: DataFrame, text: str) -> DataFrame:
    return df.select("doc_id", F.col(text).alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def _keys(keys: DataFrame) -> DataFrame:
    """Keys, broadcast up to the checked bound, so that texts aren't shuffled."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are kept, without the lines that failed. Rows are judged one by one, equal ones alike, whatever their doc_id; null and empty texts go."""
    return _with_text(quality.clean(docs.select(*COLUMNS)).filter("kept"), "clean_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id, of rows that repeat it the one with the greatest text.

    Rows without a doc_id are groups of their own, and all stay. A document without words is linked with none and stays."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    gone = stored(neardup.near_duplicates(docs.select("doc_id", "text")).filter("not kept").select("doc_id").distinct())
    again = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    again = stored(again.join(gone, "doc_id", "left_anti"))
    one = docs.join(_keys(again), "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return docs.join(_keys(gone.union(again)), "doc_id", "left_anti").select(*COLUMNS).union(one.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, repeated ones included, with secrets replaced by a mark; a null text stays null (n_chars too), an empty one empty."""
    small_batches(spark)
    return _with_text(secrets.scan(docs.select(*COLUMNS)), "clean_text")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, none to three times; a row that repeats counts as so many rows, a null source is a source, a text
    without words adds nothing to its source."""
    return mixing.taken(docs.select(*COLUMNS))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_pieces and round_trip of each row; a null text has null ids and no pieces, an empty one no ids."""
    small_batches(spark)
    return pieces.encode(docs.select(*COLUMNS), model_bytes(), remember=False).select("doc_id", "lang", "source", "ids", "n_pieces", "round_trip")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("encode_pieces", encode_pieces),
]

#: MinHash, lexing and piece encoding are beyond SQL; tests hold the pipeline against a plain version in Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}-{name}")
    return docs

"""Keyed dataflow: operators over DataFrames of k and v, with functions that Catalyst sees, and RDD forms for closures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_to_pair(df: DataFrame, key: Column | str, value: Column | str) -> DataFrame:
    k, v = (F.col(x) if isinstance(x, str) else x for x in (key, value))
    return df.select(k.alias("k"), v.alias("v"))


def reduce_by_key(pairs: DataFrame, f: Callable[[Column], Column] = F.sum) -> DataFrame:
    """One row a key, combined in each task before the shuffle."""
    return pairs.groupBy("k").agg(f(F.col("v")).alias("v"))


def group_by_key(pairs: DataFrame) -> DataFrame:
    """All values of each key, sorted; a key's values are held as one row, so hot keys belong into reduce_by_key."""
    return pairs.groupBy("k").agg(F.sort_array(F.collect_list("v")).alias("v"))


def join(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("k", "v").join(b.select("k", F.col("v").alias("w")), "k")


def cogroup(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each key of either side both lists of values, empty where a side has none."""
    left, right = group_by_key(a), group_by_key(b).withColumnRenamed("v", "w")
    kind = lambda df, c: F.array().cast(df.schema[c].dataType)
    return left.join(right, "k", "full").select("k", F.coalesce("v", kind(left, "v")).alias("v"), F.coalesce("w", kind(right, "w")).alias("w"))


def sort_by_key(pairs: DataFrame, partitions: int | None = None) -> DataFrame:
    return pairs.orderBy("k") if partitions is None else pairs.repartitionByRange(partitions, "k").sortWithinPartitions("k")


def take_ordered(df: DataFrame, n: int, *keys) -> list:
    return df.orderBy(*keys).limit(n).collect()


def hash_partitioned(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.repartition(n, *keys)


def word_count(texts: DataFrame, column: str = "text") -> DataFrame:
    """(word, n) of lower-case runs of ASCII letters, digits and underscores."""
    words = F.explode(F.split(F.lower(column), "[^A-Za-z0-9_]+"))
    return texts.select(words.alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def zip_partitions(a: RDD, b: RDD, f: Callable) -> RDD:
    """f(iterator of a, iterator of b) for partitions of equal index, without a shuffle; both sides need as many. A task holds one partition of each."""
    if a.getNumPartitions() != b.getNumPartitions():
        raise ValueError("zipped RDDs need equal numbers of partitions")
    return a.glom().zip(b.glom()).flatMap(lambda both: f(iter(both[0]), iter(both[1])))

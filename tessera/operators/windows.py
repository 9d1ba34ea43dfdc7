"""Ranking windows, as bigint, and windows of the user's own."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import checkpoint
from .pyfunc import groups, map_partitions


class Spec:
    """partition_by(...).order_by(...).order_by_desc(...): orders follow one another. Without partition_by one task sorts all rows; global_row_number() doesn't."""

    def __init__(self, parts=(), orders=()):
        self.parts, self.orders = tuple(parts), tuple(orders)

    def partition_by(self, *columns) -> Spec:
        return Spec(self.parts + columns, self.orders)

    def order_by(self, *columns) -> Spec:
        return Spec(self.parts, self.orders + columns)

    def order_by_desc(self, *names: str) -> Spec:
        return Spec(self.parts, self.orders + tuple(F.desc(n) for n in names))

    def window(self):
        w = W.partitionBy(*self.parts)
        return w.orderBy(*self.orders) if self.orders else w.orderBy(F.lit(0))


def partition_by(*columns) -> Spec:
    return Spec().partition_by(*columns)


def order_by(*columns) -> Spec:
    return Spec().order_by(*columns)


def row_number(spec: Spec) -> Column:
    return F.row_number().over(spec.window()).cast("bigint")


def rank(spec: Spec) -> Column:
    return F.rank().over(spec.window()).cast("bigint")


def dense_rank(spec: Spec) -> Column:
    return F.dense_rank().over(spec.window()).cast("bigint")


def user_window(df: DataFrame, spec: Spec, name: str, kind: str, f: Callable) -> DataFrame:
    """df with f(rows of a partition, in the spec's order) -> values as a last column.

    Nulls come first in ascending and last in descending order, as in ranking windows. Rows are named tuples; a partition is held by one task, as its meaning asks for,
    and a spec without partition_by is one partition."""
    own = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])
    parts = [F.col(p) if isinstance(p, str) else p for p in spec.parts]
    marked = df.select(*[p.alias(f"_part_{i}") for i, p in enumerate(parts)], *[f"`{c}`" for c in own])
    names = [f"_part_{i}" for i in range(len(parts))]
    dealt = marked.repartition(*names) if names else marked.coalesce(1)
    dealt = dealt.sortWithinPartitions(*names, *spec.orders) if names or spec.orders else dealt

    def run(it):
        row = namedtuple("Row", own, rename=True)
        for _, group in groups(it, len(names)):
            held = [row._make(r[len(names) :]) for r in group]
            yield from ((*r, v) for r, v in zip(held, f(held), strict=True))

    return map_partitions(dealt, run, schema)


def global_row_number(df: DataFrame, *orders: Column | str, name: str = "row_number") -> DataFrame:
    """df with the place of each row in an order over all rows, without bringing them into one task: rows are dealt by ranges and sorted,
    and each range's places begin behind the number of rows in those before. Ties have no fixed order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpoint(df.repartitionByRange(n, *orders).sortWithinPartitions(*orders).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # one row a range
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", (before - F.col("_first") + 1).alias("_shift"))
    return placed.withColumn("_part", part).join(F.broadcast(sizes), "_part").select(*[f"`{c}`" for c in df.columns], (F.col("_at") + F.col("_shift")).alias(name))

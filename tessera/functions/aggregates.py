"""The five aggregates, named as in SQL text: count(*), sum(x) ..."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expressions import name_of


def _of(f, name: str, x) -> Column:
    return f(F.col(x) if isinstance(x, str) else x).alias(f"{name}({x if isinstance(x, str) else name_of(x)})")


def count(x="*") -> Column:
    """Rows, or rows where x isn't null."""
    return F.count("*").alias("count(*)") if isinstance(x, str) and x == "*" else _of(F.count, "count", x)


def sum_(x) -> Column:
    return _of(F.sum, "sum", x)


def avg(x) -> Column:
    return _of(F.avg, "avg", x)


def min_(x) -> Column:
    return _of(F.min, "min", x)


def max_(x) -> Column:
    return _of(F.max, "max", x)


#: Keys whose buffers a task holds before it hands them on.
HELD_KEYS = 20_000


@dataclass(frozen=True)
class UserAggregate:
    """An aggregate of the user's own: initial() makes a buffer, update(buffer, value) folds values (None for null), merge joins
    buffers, evaluate gives the result, of the SQL type kind. initial() must be neutral to merge.

    agg(df, keys, value, name) aggregates alone; agg.of(value).alias(name) stands beside the built-in ones in group_agg()."""

    initial: Callable
    update: Callable
    merge: Callable
    evaluate: Callable
    kind: str
    value: str = ""
    name: str = ""

    def of(self, value: str) -> UserAggregate:
        return replace(self, value=value, name=self.name or f"user({value})")

    def alias(self, name: str) -> UserAggregate:
        return replace(self, name=name)

    def __call__(self, df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
        """One row a group (nulls form one); without keys one row, also for no input.

        Each task folds its rows to one buffer a key, and only buffers, pickled, are shuffled, so a hot key doesn't
        meet in one task as rows. Sorted by key, they are merged in one pass."""
        import pickle

        from ..operators.pyfunc import groups, map_partitions

        n, initial, update, merge, evaluate = len(keys), self.initial, self.update, self.merge, self.evaluate
        one_zero = lambda k: F.col(k) + F.lit(0.0) if isinstance(df.schema[k].dataType, T.DoubleType) else F.col(k)
        rows = df.select(*[one_zero(k).alias(k) for k in keys], F.col(value).alias("_value"))
        fields = rows.schema.fields[:n]
        partial = T.StructType([*fields, T.StructField("_buffer", T.BinaryType())])
        final = T.StructType([*fields, T.StructField(name, T._parse_datatype_string(self.kind))])

        def fold(it):
            held: dict = {}
            for r in it:
                key = tuple(r[:n])
                held[key] = update(held[key] if key in held else initial(), r[n])
                if len(held) > HELD_KEYS:
                    yield from ((*k, pickle.dumps(b)) for k, b in held.items())
                    held = {}
            yield from ((*k, pickle.dumps(b)) for k, b in held.items())

        def finish(it):
            for _, group in groups(it, n):
                b, key = initial(), ()
                for r in group:
                    b, key = merge(b, pickle.loads(r[n])), r[:n]
                yield (*key, evaluate(b))

        buffers = map_partitions(rows, fold, partial)
        if n:
            buffers = buffers.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
        else:
            buffers = buffers.union(df.sparkSession.createDataFrame([(pickle.dumps(initial()),)], partial)).coalesce(1)
        return map_partitions(buffers, finish, final)


def user_aggregate(initial, update: Callable, merge: Callable, evaluate: Callable, kind: str) -> UserAggregate:
    return UserAggregate(initial, update, merge, evaluate, kind)
